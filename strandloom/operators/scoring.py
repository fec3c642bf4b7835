"""Empirical nulls, percentiles, totals, panel selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna


def hashed_uniform(seed: int) -> Column:
    """A number in [0, 1) from ``construct_id, variant, i``: no stream, so variants are made in any order or place."""
    return F.pmod(F.xxhash64("construct_id", "variant", "i", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def variants(cds: DataFrame, n: int, table_id: int, uniform: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """``construct_id, variant, cds`` of ``n`` synonymous variants of each coding sequence.

    Codons are drawn among synonyms by cumulative weight (uniform without weights, or where a family has none).  The draw
    of variant v does not depend on ``n``: a smaller null is a prefix of a larger one.  One map: nothing is shuffled.
    """
    code = dims.genetic_code(table_id)
    table = []
    for codon, aa in sorted(code.items()):
        options = dims.synonyms(table_id).get(aa, []) if aa != "*" else []
        if codon not in options:
            options = [codon]
        raw = [max(0.0, weights.get(o, 0.0)) if weights else 1.0 for o in options]
        raw = raw if sum(raw) > 0 else [1.0] * len(options)
        total, running = sum(raw), 0.0
        steps = []
        for o, x in zip(options, raw, strict=True):
            running += x / total
            steps.append((o, running))
        table.append((codon, steps))
    width = max(len(x) for _, x in table)
    limits = np.array([[c for _, c in x] + [np.inf] * (width - len(x)) for _, x in table] + [[np.inf] * width])
    texts = [[o for o, _ in x] + [x[-1][0]] * (width - len(x)) for _, x in table]
    letters = np.array([[list(o.encode()) for o in x] for x in texts] + [[[0] * 3] * width], np.uint8)
    last = np.array([len(x) - 1 for _, x in table] + [0])
    index = {c: k for k, (c, _) in enumerate(table)}
    u = uniform if uniform is not None else hashed_uniform(0)
    each = cds.select("construct_id", dna.codons(F.col("cds")).alias("_c")).select("construct_id", "_c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    rows = each.select("construct_id", "variant", F.posexplode("_c").alias("i", "codon"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Codons of a variant come one behind the other, as the explode has no shuffle behind it; the first has i = 0.
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(3).dictionary_encode()
            row = np.array([index.get(x, len(table)) for x in words.dictionary.to_pylist()])[words.indices.to_numpy()]
            pick = np.minimum((batch.column(4).to_numpy()[:, None] >= limits[row]).sum(axis=1), last[row])
            drawn = letters[row, pick]
            heads = np.flatnonzero(batch.column(2).to_numpy() == 0)
            keys = list(zip(*(batch.column(k).take(pa.array(heads)).to_pylist() for k in (0, 1)), strict=True))
            out = []
            parts.append(drawn[: heads[0] if len(heads) else None])
            for k, (head, end) in enumerate(zip(heads.tolist(), np.append(heads, batch.num_rows)[1:].tolist(), strict=True)):
                if key is not None:
                    out.append((*key, _joined(parts)))
                key, parts = keys[k], [drawn[head:end]]
            if out:
                yield _variant_rows(out)
        if key is not None:
            yield _variant_rows([(*key, _joined(parts))])

    return rows.select("construct_id", "variant", "i", "codon", u.cast("double").alias("_u")).mapInArrow(draw, "construct_id long, variant int, cds string")


def _joined(parts: list[np.ndarray]) -> str:
    """The text of codons; those that no table knows are left out."""
    return b"".join(x.tobytes() for x in parts).replace(b"\0", b"").decode()


def _variant_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.string()], strict=True)], ["construct_id", "variant", "cds"])


Steps = tuple[int, int, int, int]
STEPS: Steps = (7919, 104729, 1299709, 1000003)
#: Codons drawn at once.
BLOCK = 1 << 15


def _drawer(n: int, table_id: int, of_codon: dict[str, float], steps: Steps) -> Callable[[int, str], np.ndarray]:
    """Values of ``n`` synonymous variants of a coding sequence: the sum of ``of_codon`` over the codons drawn, by the bases."""
    code = dims.genetic_code(table_id)
    codons = sorted(code)
    options = [[c] if code[c] == "*" or c not in dims.synonyms(table_id)[code[c]] else dims.synonyms(table_id)[code[c]] for c in codons]
    sizes = np.array([len(o) for o in options])
    table = np.zeros((len(codons), sizes.max()))
    for k, o in enumerate(options):
        table[k, : len(o)] = [of_codon[x] for x in o]
    index = {c: k for k, c in enumerate(codons)}
    a, b, c, m = steps

    flat = table.ravel()
    shift = np.arange(n, dtype=np.int64) * b % m
    whole = np.int32 if m * int(sizes.max()) < 2**31 else np.int64

    def draw(cid: int, text: str) -> np.ndarray:
        row = np.array([index[text[i : i + 3]] for i in range(0, len(text) - 2, 3)], np.int64)
        first = ((cid * a + np.arange(len(row), dtype=np.int64) * c) % m).astype(whole)
        many, base = sizes[row].astype(whole), row * table.shape[1]
        values = np.empty(n)
        step = max(1, BLOCK // max(1, len(row)))
        for v in range(0, n, step):
            # The draws of some variants at once; what is drawn stays below m, so a turn is taken off, not divided.
            drawn = first + shift[v : v + step, None].astype(whole)
            drawn -= (drawn >= m) * whole(m)
            drawn *= many
            drawn //= whole(m)
            values[v : v + step] = flat.take(drawn + base).sum(axis=1) / max(1, 3 * len(row))
        return values

    return draw


def additive_null(cds: DataFrame, n: int, table_id: int, of_codon: dict[str, float], steps: Steps = STEPS) -> DataFrame:
    """``construct_id, variant, value`` of ``n`` synonymous variants: the sum of ``of_codon`` over the codons drawn, by the bases.

    A null of a sum needs no variant's text: one map draws all variants of a construct by number.  The draw of codon i of
    variant v is ((id * a + v * b + i * c) mod m) / m with ``steps`` = (a, b, c, m), so it depends on nothing else.
    """
    draw = _drawer(n, table_id, of_codon, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, cid, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(draw(cid, text))], ["construct_id", "variant", "value"])

    return cds.select("construct_id", "cds").mapInArrow(run, "construct_id long, variant int, value double")


def additive_percentile(scores: DataFrame, n: int, table_id: int, of_codon: dict[str, float], direction: str, band: tuple[float, float] | None = None, steps: Steps = STEPS) -> DataFrame:
    """:func:`percentile` of ``scores(construct_id, cds, raw)`` within :func:`additive_null`, in one map: no variant's row leaves it."""
    draw = _drawer(n, table_id, of_codon, steps)

    def deviation(x: np.ndarray | float) -> np.ndarray | float:
        return np.maximum(np.maximum(band[0] - x, x - band[1]), 0.0) if direction == "BAND" else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, text, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = draw(cid, text)
                mine, other = deviation(raw), deviation(values)
                worse = other < mine if direction == "HIGHER_IS_BETTER" else other > mine
                rows.append((cid, raw, n, values.mean(), values.std(ddof=1) if n > 1 else 0.0, (worse.sum() + 0.5 * (other == mine).sum()) / n))
            if rows:
                types = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["construct_id", "raw", "n", "mean", "sd", "percentile"])

    whole = scores.where("raw is not null and cds is not null").select("construct_id", "cds", F.col("raw").cast("double").alias("raw"))
    return whole.mapInArrow(run, "construct_id long, raw double, n long, mean double, sd double, percentile double")


def percentile(null: DataFrame, scores: DataFrame, direction: str, band: tuple[float, float] | None = None) -> DataFrame:
    """``construct_id, raw, n, mean, sd, percentile``: share of the null that is worse, ties counting half.

    ``null`` has ``construct_id, value``, ``scores`` has ``construct_id, raw``; a band compares deviations from it.
    """

    def deviation(x: Column) -> Column:
        return F.greatest(band[0] - x, x - band[1], F.lit(0.0)) if direction == "BAND" else x

    mine, other = deviation(F.col("raw")), deviation(F.col("value"))
    worse = other < mine if direction == "HIGHER_IS_BETTER" else other > mine
    joined = null.join(scores, "construct_id")
    made = joined.groupBy("construct_id", "raw").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.sum(worse.cast("double") + 0.5 * (other == mine).cast("double")).alias("_w"))
    return made.select("construct_id", "raw", "n", "mean", F.coalesce("sd", F.lit(0.0)).alias("sd"), (F.col("_w") / F.col("n")).alias("percentile"))


def weighted_totals(scores: DataFrame) -> DataFrame:
    """``candidate, total`` over available objectives (``percentile`` not null); 0 without weight."""
    w = F.when(F.col("percentile").isNotNull(), F.col("weight"))
    made = scores.groupBy("candidate").agg(F.sum(F.col("percentile") * w).alias("_p"), F.sum(w).alias("_w"))
    return made.select("candidate", F.when(F.col("_w") > 0, F.col("_p") / F.col("_w")).otherwise(0.0).alias("total"))


def comparable_totals(scores: DataFrame) -> DataFrame:
    """:func:`weighted_totals` over the objectives that every candidate of a ``panel`` has.

    Presence is counted per (panel, objective): no pair of candidates is made.
    """
    size = scores.groupBy("panel").agg(F.count_distinct("candidate").alias("_n"))
    have = scores.where("percentile is not null").groupBy("panel", "spec_id").agg(F.count_distinct("candidate").alias("_k"))
    common = have.join(size, "panel").where("_k = _n").select("panel", "spec_id")
    return weighted_totals(scores.join(common, ["panel", "spec_id"], "left_semi"))


def simplex(spark: SparkSession, axes: list[str], steps: int) -> DataFrame:
    """``point, axis, weight`` of the lattice of weights in ``1/steps`` that sum to 1; size is fixed by the arguments."""
    points = sorted(p for p in product(range(steps + 1), repeat=len(axes)) if sum(p) == steps)
    return spark.createDataFrame([(k, a, x / steps) for k, p in enumerate(points) for a, x in zip(axes, p, strict=True)], "point int, axis string, weight double")


def greedy_picks(cds: list[str], k: int) -> list[int]:
    """Indices of up to ``k`` designs: the farthest pair, then whatever is farthest from the picks; ties to the first."""

    first = list(dict.fromkeys(cds))
    if len(first) <= k:
        return [cds.index(x) for x in first]
    # Codons as numbers, short designs filled with what no codon is; a distance counts the codons of its first design.
    width = -(-max(map(len, first)) // 3) * 3
    codes = np.array([np.frombuffer(x.encode().ljust(width, b"\0"), np.uint8) for x in first]).reshape(len(first), -1, 3).astype(np.int32) @ np.array([1 << 16, 1 << 8, 1], np.int32)
    far = [((codes[i, : len(x) // 3] != codes[:, : len(x) // 3]).sum(axis=1) / max(len(x) // 3, 1)).tolist() for i, x in enumerate(first)]
    _, i, j = max((far[i][j], -i, -j) for i in range(len(first)) for j in range(i + 1, len(first)))
    picks = [-i, -j][:k]
    while len(picks) < k:
        rest = [x for x in range(len(first)) if x not in picks]
        picks.append(max(rest, key=lambda x: (min(far[x][p] for p in picks), -x)))
    return [cds.index(first[x]) for x in picks]


def gallery(designs: DataFrame, k: int = 3) -> DataFrame:
    """``panel, pick, candidate, cds``: greedy max-min choice within each panel of designs (a panel is a sweep, so a few dozen)."""
    names = ["panel", "pick", "candidate", "cds"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for panel, designs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = [d["cds"] for d in designs]
                rows += [(panel, n, designs[x]["candidate"], texts[x]) for n, x in enumerate(greedy_picks(texts, k))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.string()], strict=True)], names)

    panels = designs.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct("candidate", "cds"))).alias("designs"))
    return panels.mapInArrow(choose, "panel long, pick int, candidate long, cds string")


def panel_accepted(picks: DataFrame, least: int = 3, distance: float = 0.15) -> DataFrame:
    """``panel, picks, min_distance, accepted``: at least ``least`` picks, all pairs ``distance`` apart; pairs are of picks alone."""
    other = picks.select("panel", F.col("pick").alias("_p"), F.col("cds").alias("_c"))
    near = picks.join(other, "panel").where("pick < _p").groupBy("panel").agg(F.min(dna.codon_distance(F.col("cds"), F.col("_c"))).alias("min_distance"))
    made = picks.groupBy("panel").agg(F.count(F.lit(1)).alias("picks")).join(near, "panel", "left").withColumn("min_distance", F.coalesce("min_distance", F.lit(1.0)))
    return made.withColumn("accepted", (F.col("picks") >= least) & (F.col("min_distance") >= distance))

