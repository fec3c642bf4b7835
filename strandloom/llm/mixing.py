"""Mixing sources to target weights with soft domain membership.

A labelled table gives documents a domain; a naive Bayes classifier over hashed words, tempered by length, predicts
every document's domain posterior p.  Nonnegative document rates r solve

    min over r >= 0 of  sum_k (sum_d r_d n_d p_dk - T w_k)^2 / s_k

for token counts n, targets w (normalised), T tokens in all and s_k = sum_d n_d p_dk, by projected gradient with momentum in the scaled unknowns
sqrt(n_d) r_d.  The objective reaches the driver only as one number per domain and round; a document's rate is
recomputed from its posterior and the rounds' moves, so no state is written between rounds.

Whether the rounds reached the targets is told by residuals, not taken for granted.

Null, empty and wordless texts have no tokens: rate 1, posterior the prior.  Repeated rows get equal rates; extra
columns are ignored; domains without target get weight 0, targets without domain are an error; without labelled rows
there is one domain, ``all``, and every rate is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

BUCKET_BITS = 16


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = blocks.text_block(column)
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
    return (blocks.span_hashes(data, starts, ends)[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), bounds


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    prior: np.ndarray
    words: np.ndarray  # (bucket, domain) log-probabilities


def fit(labelled: DataFrame, rows_per_domain: int = 600, seed: int = 29) -> DomainModel:
    """Learn from ``labelled(doc_id, text, domain)``: about ``rows_per_domain`` rows of each domain, by a hash of the id.

    Priors are the domains' shares of all labelled rows: of those in ``labelled``, or where it is a sample, of the counts
    in its column ``n_labelled`` (one number per domain; a domain without sampled rows has one row without text).
    """
    named = labelled.where(F.col("domain").isNotNull())
    known = named.where(F.col("text").isNotNull())
    rows = F.count("text")
    whole = F.max("n_labelled") if "n_labelled" in labelled.columns else rows
    found = named.groupBy("domain").agg(rows.alias("rows"), whole.alias("whole")).where("whole > 0").collect()
    if not found:
        return DomainModel(("all",), np.zeros(1), np.zeros((1 << BUCKET_BITS, 1), np.float32))
    totals = {r["domain"]: max(r["rows"], 1) for r in found}
    domains = tuple(sorted(totals))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    keep = F.lit(False)
    for name in domains:
        keep = keep | ((F.col("domain") == name) & (draw < int(1_000_000 * min(1.0, rows_per_domain / totals[name]))))
    index = {name: k for k, name in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(index), 1 << BUCKET_BITS), np.int64)
        for block in blocks.row_blocks(batches, "text"):
            word, bounds = _buckets(block.column(0))
            domain = np.repeat([index[x] for x in block.column(1).to_pylist()], np.diff(bounds))
            np.add.at(table, (domain, word), 1)
        k, b = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(table[k, b])], ["k", "b", "n"])

    counted = known.where(keep).select("text", "domain").mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << BUCKET_BITS, len(domains)))
    table[counted.b, counted.k] = counted.n
    shares = {r["domain"]: r["whole"] for r in found}
    prior = np.array([shares[x] for x in domains], float)
    return DomainModel(domains, np.log(prior / prior.sum()), np.log((table + 0.5) / (table.sum(0) + 0.5 * len(table))).astype(np.float32))


#: Evidence grows as tokens to this power.
TEMPER = 0.5


def _posterior(column: pa.Array, model: DomainModel, temper: float = TEMPER) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and (row, domain) posteriors."""
    word, bounds = _buckets(column)
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    logit = np.stack([np.bincount(row, model.words[:, k][word], len(n)) for k in range(len(model.domains))], 1)
    logit = logit * (np.maximum(n, 1) ** (temper - 1.0))[:, None] + model.prior
    p = np.exp(logit - logit.max(1, keepdims=True))
    return n, p / p.sum(1, keepdims=True)


def posteriors(docs: DataFrame, model: DomainModel, temper: float = TEMPER) -> DataFrame:
    """``doc_id, n_tokens, posterior`` of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.row_blocks(batches, "text"):
            n, p = _posterior(block.column(1), model, temper)
            lists = pa.ListArray.from_arrays((np.arange(len(n) + 1) * p.shape[1]).astype(np.int32), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n.astype(np.int64)), lists], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def _rate(p: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Rates after the rounds so far; a move is the momentum, then a step per domain."""
    before = r = np.ones(len(p))
    for momentum, *step in moves:
        ahead = r + momentum * (r - before)
        before, r = r, np.maximum(0.0, ahead - p @ np.array(step))
    return r


def _matrix(batch: pa.RecordBatch, domains: int) -> np.ndarray:
    return batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def solve(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float], rounds: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """The moves that give the rates of :func:`posteriors` rows (see :func:`_rate`), and the relative residual per domain after them.

    Steps are taken with momentum, which starts anew whenever the objective has grown; expected tokens are linear in the rates, so
    those ahead follow from the last two rounds'.

    ``members`` should be materialised, as every round reads it.  Rounds end when every residual is within
    ``tolerance`` of all tokens.
    """
    if unknown := set(targets) - set(domains):
        raise ValueError(f"targets without domain: {sorted(unknown)}")
    k = len(domains)
    want = np.array([float(targets.get(d, 0.0)) for d in domains])
    want /= want.sum()
    names = ["total", *(f"s{i}" for i in range(k)), *(f"g{i}_{j}" for i in range(k) for j in range(k))]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(1 + k + k * k)
        for batch in batches:
            if not batch.num_rows:
                continue
            p, n = _matrix(batch, k), batch.column(1).to_numpy().astype(float)
            acc += np.concatenate(([n.sum()], n @ p, (p.T @ (p * n[:, None])).reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in acc], names)

    sums = np.array(members.mapInArrow(gram, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first(), dtype=float)
    total, share, g = sums[0], sums[1 : 1 + k], sums[1 + k :].reshape(k, k)
    moves = np.zeros((0, 1 + k))
    scale = np.maximum(share, 1e-9 * max(total, 1.0))
    half = np.sqrt(scale)
    rate_of = 1.0 / max(np.linalg.eigvalsh(g / half[:, None] / half[None, :])[-1], 1e-12)
    have = before = share
    worth, run = np.inf, 0
    fields = [f"a{i}" for i in range(k)]
    for _ in range(rounds):
        residual = have - total * want
        if total == 0 or np.abs(residual).max() <= tolerance * total:
            break
        now = float((residual**2 / scale).sum())
        run = run + 1 if now <= worth else 0
        worth = now
        momentum = run / (run + 3.0) if run else 0.0
        ahead = have + momentum * (have - before)
        moves = np.vstack([moves, np.concatenate(([momentum], rate_of * (ahead - total * want) / scale))])

        def expected(batches: Iterator[pa.RecordBatch], moves: np.ndarray = moves) -> Iterator[pa.RecordBatch]:
            acc = np.zeros(k)
            for batch in batches:
                if batch.num_rows:
                    p = _matrix(batch, k)
                    acc += (batch.column(1).to_numpy() * _rate(p, moves)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in acc], fields)

        before, have = have, np.array(members.mapInArrow(expected, ", ".join(f"{x} double" for x in fields)).agg(*[F.sum(x) for x in fields]).first(), dtype=float)
    return moves, (have - total * want) / max(total, 1.0)


def _rated(n: np.ndarray, p: np.ndarray, moves: np.ndarray) -> np.ndarray:
    return np.where(n > 0, _rate(p, moves), 1.0)


def rates(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float], rounds: int = 100, tolerance: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n_tokens, posterior, rate`` of :func:`posteriors` rows, and the relative residual per domain (see :func:`solve`)."""
    moves, residual = solve(members, domains, targets, rounds, tolerance)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rate = _rated(batch.column(1).to_numpy(), _matrix(batch, len(domains)), moves)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["doc_id", "n_tokens", "posterior", "rate"])

    return members.mapInArrow(final, "doc_id long, n_tokens long, posterior array<double>, rate double"), residual


def balanced(domains: tuple[str, ...], low: float = 0.1) -> dict[str, float]:
    """Equal weight to the languages of ``language/quality`` domains; within one, the share ``low`` to low quality."""
    return {d: low if d.endswith("/low") else 1.0 - low for d in domains}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, tolerance: float = 1e-4, rounds: int = 100) -> DataFrame:
    """Rates of all rows of ``docs(doc_id, text)``: ``doc_id, n_tokens, domain, posterior, rate, residual, on_target``.

    ``domain`` is the likeliest one; without ``targets`` they are :func:`balanced`.  ``residual`` is what the domain's expected
    tokens are over (or under) their target after the last round, as a share of all tokens; ``on_target`` tells whether all
    domains' are within ``tolerance``.  Null ids, repeated rows and ties pass like any other row.
    """
    model = fit(labelled)
    members = blocks.cut(posteriors(docs, model))
    rated, residual = rates(members, model.domains, targets or balanced(model.domains), rounds, tolerance)
    best = F.expr("array_position(posterior, array_max(posterior))").cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), best)
    met = F.lit(bool(np.abs(residual).max() <= tolerance))
    return rated.select("doc_id", "n_tokens", pick(model.domains).alias("domain"), "posterior", "rate", pick([float(x) for x in residual]).alias("residual"), met.alias("on_target"))


def mix_rows(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, tolerance: float = 1e-4, rounds: int = 100) -> DataFrame:
    """``docs`` with the columns ``domain`` and ``rate`` of :func:`mix`, which take the place of any of those names.

    Posterior and rate are found again in the row itself, so texts are neither keyed nor shuffled: null and repeated ids keep
    their rows.
    """
    model = fit(labelled)
    moves, _ = solve(blocks.cut(posteriors(docs, model)), model.domains, targets or balanced(model.domains), rounds, tolerance)
    names = [c for c in docs.columns if c not in ("domain", "rate")]
    text = names.index("text")
    rows = docs.select(*names).toDF(*(f"c{k}" for k in range(len(names))))
    schema = rows.select("*", F.lit("").alias("domain"), F.lit(0.0).alias("rate")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.shards(batches, text, blocks.BLOCK_BYTES):
            n, p = _posterior(block.column(text), model)
            named = pa.array([model.domains[k] for k in p.argmax(1).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns, named, pa.array(_rated(n, p, moves))], [*block.schema.names, "domain", "rate"])

    return rows.mapInArrow(run, schema).toDF(*names, "domain", "rate")


def domain_labels(docs: DataFrame, labels: DataFrame, per_class: int = 1500, seed: int = 31) -> DataFrame:
    """``doc_id, text, domain, n_labelled`` of labelled documents: language and quality, as in ``en/high``.

    At most ``per_class`` ids of each quality, by a hash of the id; so few ids may be broadcast.  ``n_labelled`` counts all
    labelled documents of the domain, sampled or not; a domain without a sampled one has a row without id and text.
    """
    clean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    draw = F.xxhash64("doc_id", F.lit(seed))
    ids = blocks.cut(clean.where("quality > 0").orderBy(draw, "doc_id").limit(per_class).unionByName(clean.where("quality <= 0").orderBy(draw, "doc_id").limit(per_class)))
    domain = F.concat_ws("/", F.coalesce("lang", F.lit("und")), F.when(F.col("quality") > 0, "high").otherwise("low")).alias("domain")
    counts = blocks.cut(docs.where("text is not null").select("doc_id", "lang").join(clean, "doc_id").groupBy(domain).agg(F.count(F.lit(1)).alias("n_labelled")))
    sampled = docs.where("text is not null").select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").select("doc_id", "text", domain)
    missing = counts.join(sampled.select("domain").distinct(), "domain", "left_anti").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "domain", "n_labelled")
    return sampled.join(F.broadcast(counts), "domain").select("doc_id", "text", "domain", "n_labelled").unionByName(missing)
