"""Toxic spans by a two-state linear-chain conditional random field.

Tokens are runs of letters and digits.  Features of a token are hashes of the whole lower-cased token and of
its first 4, 5, 6 and 8 bytes.  Document labels give token labels
by evidence: a feature counts as toxic when the labelled sample holds it mostly in toxic documents, and a
token of a toxic document is labelled toxic when such a feature has it.  The CRF is trained on those tokens
by gradient ascent, the gradient of a transition being its count less its expected count by pairwise marginals;
forward-backward marginals over whole texts give toxic spans, and a logistic regression
on their sums gives the document score.  The marginal from which a token is in a span is fitted on the sample too, so that few
clean documents of it have a span.

Null, empty and wordless texts are scored as texts without toxic tokens (never null).  Repeated rows are
scored alike and kept; extra columns are ignored; without labelled rows of both classes every score is the
smoothed share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

BITS = 18
HEADS = (4, 5, 6, 8)
#: Tokens at which a document's evidence counts half.
TYPICAL = 200.0
#: Least log-odds of a telling feature.
LEAST = 3.0


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (token, feature), token starts and ends, per-row bounds, lower-cased bytes, row offsets."""
    data, offsets = blocks.text_block(column)
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
    hashes = blocks.span_hashes(data, starts, ends, *HEADS)
    salted = [h ^ np.uint64(0x51ED270B * (k + 1)) for k, h in enumerate(hashes)]
    buckets = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in salted], 1) if len(starts) else np.zeros((0, 1 + len(HEADS)), np.int32)
    return buckets, starts, ends, bounds, data, offsets


@dataclass(frozen=True)
class ToxicModel:
    """Emission weights by feature bucket, bias, transitions, and the document regression."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    doc: np.ndarray
    span: float = 0.5


def _sample(labels: DataFrame, column: str, per_class: tuple[int, int], seed: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, by a hash of the id; the sample is bounded, so it may be broadcast."""
    clean = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias("y"))
    draw = F.xxhash64("doc_id", F.lit(seed))
    return clean.where("y = 0").orderBy(draw, "doc_id").limit(per_class[0]).unionByName(clean.where("y = 1").orderBy(draw, "doc_id").limit(per_class[1]))


def fit(docs: DataFrame, labels: DataFrame, clean_rows: int = 1200, toxic_rows: int = 700, seed: int = 5, epochs: int = 40, clean_spans: float = 0.02) -> ToxicModel:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The sample is at most ``clean_rows`` + ``toxic_rows`` labelled rows, whole texts.  At most the share ``clean_spans`` of
    the sample's clean documents reaches the marginal that makes a span (0.5 at least).
    """
    ids = blocks.cut(_sample(labels, "toxic", (clean_rows, toxic_rows), seed))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y")
    drawn = rows.toPandas()
    y = drawn.y.to_numpy()
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return ToxicModel(np.zeros(1 << BITS, np.float32), -8.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    buckets, _, _, bounds, _, _ = _features(pa.array(drawn.text, pa.string()))
    per = np.diff(bounds)
    row = np.repeat(np.arange(len(per)), per)
    weights, bias, trans = _train(buckets, row, bounds, y, epochs)
    model = ToxicModel(weights, bias, trans, np.zeros(4))
    *_, mass, top, per = _marginals(model, pa.array(drawn.text, pa.string()))
    span = max(0.5, float(np.nextafter(np.quantile(top[y == 0], 1 - clean_spans, method="higher"), 2)))
    return ToxicModel(weights, bias, trans, _logistic(_doc_features(mass, top, per), y), span)


def _train(buckets: np.ndarray, row: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int) -> tuple[np.ndarray, float, np.ndarray]:
    # Evidence: documents of each class per feature, each counted once, long ones less, as they hold most words anyway.
    trust = 1 / (1 + np.diff(bounds) / TYPICAL)
    df = np.zeros((2, 1 << BITS))
    for k in range(buckets.shape[1]):
        pair = np.unique(row.astype(np.int64) << BITS | buckets[:, k])
        np.add.at(df, (y[pair >> BITS], pair & ((1 << BITS) - 1)), trust[pair >> BITS])
    size = np.bincount(y, trust, minlength=2)
    odds = np.log((df[1] + 0.5) / (size[1] + 1)) - np.log((df[0] + 0.5) / (size[0] + 1))
    telling = (odds > LEAST) & (df[1] >= max(2.0, 0.02 * size[1]))
    gold = telling[buckets].any(1) & (y[row] == 1)
    # Only features of some weight in the sample get weights of their own.
    used, local = np.unique(buckets, return_inverse=True)
    local = local.reshape(buckets.shape)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-6)
    bias, trans = -3.0, np.zeros((2, 2))
    n = len(row)
    same = np.concatenate(([False], row[1:] == row[:-1]))
    prev_gold = np.where(same, np.concatenate(([False], gold[:-1])), False)
    have = np.array([[((prev_gold == a) & (gold == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    # Tokens in toxic documents weigh as much as those in clean ones; the l2 term keeps rare features small.
    for _ in range(epochs):
        emission = w[local].sum(1) + bias
        p, want = blocks.chain_marginals(emission, bounds, trans, pairwise=True)
        grad = np.bincount(local.ravel(), np.repeat(gold - p, local.shape[1]), len(used)) - 0.05 * w
        g2 += grad**2
        w += 0.6 * grad / np.sqrt(g2)
        bias += 0.2 * np.clip((gold - p).sum() / max(1.0, gold.sum()), -1, 1)
        trans += 0.2 * (have - want) / max(1.0, min(n, 10 * gold.sum()))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return weights, float(bias), trans


def _marginals(model: ToxicModel, column: pa.Array) -> tuple:
    buckets, starts, ends, bounds, data, offsets = _features(column)
    p = blocks.chain_marginals(model.weights[buckets].sum(1) + model.bias, bounds, model.trans)
    per = np.diff(bounds)
    row = np.repeat(np.arange(len(per)), per)
    mass = np.bincount(row, p * (p > 0.2), len(per))
    top = np.zeros(len(per))
    np.maximum.at(top, row, p)
    return p, row, starts, ends, data, offsets, mass, top, per


def _doc_features(mass: np.ndarray, top: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(mass)), np.log1p(2 * mass), top, np.log1p(300 * mass / (n + 60))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])


def score(docs: DataFrame, model: ToxicModel, span_marginal: float | None = None) -> DataFrame:
    """``doc_id, score, predicted, toxic_spans`` of each row of ``docs(doc_id, text)``.

    ``toxic_spans`` are maximal runs of tokens with a marginal of at least ``span_marginal`` (the model's), in characters,
    end exclusive, with the run's largest marginal.
    """
    least = model.span if span_marginal is None else span_marginal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.row_blocks(batches, "text"):
            p, row, starts, ends, data, offsets, mass, top, per = _marginals(model, block.column(1))
            value = 1 / (1 + np.exp(-np.clip(_doc_features(mass, top, per) @ model.doc, -30, 30)))
            hit = p >= least
            head = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & np.concatenate(([False], row[1:] == row[:-1]))))
            tail = np.flatnonzero(hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((row[1:] == row[:-1], [False]))))
            chars = blocks.code_points(data)
            base = chars[offsets[:-1]][row[head]]
            peak = np.maximum.reduceat(np.append(p, 0.0), np.stack([head, tail + 1], 1).ravel())[::2] if len(head) else np.zeros(0)
            items = pa.StructArray.from_arrays([pa.array((chars[starts[head]] - base).astype(np.int32)), pa.array((chars[ends[tail]] - base).astype(np.int32)), pa.array(np.round(peak, 6))], fields=list(SPAN))
            found = pa.ListArray.from_arrays(np.searchsorted(row[head], np.arange(len(per) + 1)).astype(np.int32), items)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), found], ["doc_id", "score", "predicted", "toxic_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, toxic_spans array<struct<start:int,end:int,marginal:double>>")
