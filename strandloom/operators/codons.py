"""Codon statistics.  Code and usage tables have at most 64 rows, so they are broadcast."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna


def codon_rows(cds: DataFrame) -> DataFrame:
    """``construct_id, i, codon`` of whole codons."""
    return cds.select("construct_id", F.posexplode(dna.codons(F.col("cds"))).alias("i", "codon"))


def usage_counts(cds: DataFrame, table_id: int) -> DataFrame:
    """``codon, aa, n`` for all 64 codons; counts are combined before the shuffle, which carries 64 rows a task."""
    code = dims.genetic_code(table_id)
    spark = cds.sparkSession
    table = spark.createDataFrame(sorted(code.items()), "codon string, aa string")
    counted = codon_rows(cds).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    return table.join(F.broadcast(counted), "codon", "left").select("codon", "aa", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def weights(counts: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """``codon, aa, w``: (n + pseudocount) over its family's largest; stops have none."""
    n = F.col("n") + pseudocount
    return counts.where("aa <> '*'").select("codon", "aa", (n / F.max(n).over(Window.partitionBy("aa"))).alias("w"))


def cai(cds: DataFrame, usage: DataFrame) -> DataFrame:
    """``construct_id, cai``: e^(mean ln w) over sense codons but Met and Trp, w <= 0 skipped, 0 without any."""
    scored = codon_rows(cds).join(F.broadcast(usage.where("aa not in ('M', 'W') and w > 0")), "codon")
    mean = scored.groupBy("construct_id").agg(F.exp(F.avg(F.ln("w"))).alias("cai"))
    return cds.select("construct_id").join(mean, "construct_id", "left").select("construct_id", F.coalesce("cai", F.lit(0.0)).alias("cai"))


def chance_cai(cds: DataFrame, usage: DataFrame) -> DataFrame:
    """``construct_id, chance_cai``: CAI expected if each residue's codons were drawn alike."""
    family = usage.where("aa not in ('M', 'W')").groupBy("aa").agg(F.avg(F.ln("w")).alias("m"))
    table = usage.join(family, "aa").select("codon", "m")
    return codon_rows(cds).join(F.broadcast(table), "codon").groupBy("construct_id").agg(F.exp(F.avg("m")).alias("chance_cai"))


def family_stats(counts: DataFrame) -> DataFrame:
    """``aa, mean, top, low`` of families of more than one codon without gaps."""
    return counts.where("aa <> '*'").groupBy("aa").agg(F.avg("n").alias("mean"), F.max("n").alias("top"), F.min("n").alias("low"), F.count(F.lit(1)).alias("_k")).where("_k > 1 and low > 0").drop("_k")


#: Bases of the risk bands of direct repeats: fixed values.
UNIQUE_BP, SUBSTANTIAL_BP, RECA_BP, NEAR_BP, FAR_BP = 20, 100, 200, 100, 1000


def repeat_risk(length: Column, spacer: Column, tandem: Column | None = None) -> Column:
    """Low, moderate or high by length and spacer of a direct repeat; copies that touch (``tandem``) are never low."""
    touch = F.lit(False) if tandem is None else tandem
    apart = F.when(spacer <= F.when(length >= RECA_BP, FAR_BP).otherwise(NEAR_BP), "high").when((spacer <= FAR_BP) | (length >= SUBSTANTIAL_BP), "moderate").otherwise("low")
    return F.when(touch, F.when(length >= UNIQUE_BP, "high").otherwise("moderate")).when(length < UNIQUE_BP, "low").otherwise(apart)


def _reach(table_id: int, window: int) -> Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kernel of :func:`reachable_gc`: first bases of a protein's windows, and the fewest and most G and C each can have."""
    low, high, known = np.zeros((256, 3), np.int64), np.zeros((256, 3), np.int64), np.zeros(256, bool)
    for aa, options in dims.synonyms(table_id).items():
        gc = np.array([[b in "GC" for b in c] for c in options], np.int64)
        low[ord(aa)], high[ord(aa)], known[ord(aa)] = gc.min(0), gc.max(0), True

    def of(protein: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(protein.encode("ascii", "replace"), np.uint8)
        at = np.flatnonzero(known[codes])
        n = max(3 * len(at) - window + 1, 0)
        pos = (3 * at[:, None] + np.arange(3)).ravel()[:n]
        total = [np.concatenate(([0], np.cumsum(x[codes[at]].ravel()))) for x in (low, high)]
        return pos, *(t[window : window + n] - t[:n] for t in total)

    return of


def reachable_gc(proteins: DataFrame, table_id: int, window: int = 50) -> DataFrame:
    """``construct_id, pos, least, most``: GC every window of ``window`` bases of a coding sequence can reach.

    ``proteins`` has ``construct_id, protein``.  Bounds are per base of a codon, so windows that cut codons are bounded too.  One map:
    differences of prefix sums, no base is shuffled.
    """
    names = ["construct_id", "pos", "least", "most"]
    reach = _reach(table_id, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, protein in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pos, least, most = reach(protein)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), cid, np.int64)), pa.array(pos.astype(np.int32)), pa.array(least / window), pa.array(most / window)], names)

    return proteins.where("protein is not null").select("construct_id", "protein").mapInArrow(run, "construct_id long, pos int, least double, most double")


def gc_reach(proteins: DataFrame, table_id: int, window: int = 50) -> DataFrame:
    """``construct_id, windows, highest_least, lowest_most`` of :func:`reachable_gc`, drawn where the windows are made: one row a protein
    of ``window`` bases or more leaves the map."""
    names = ["construct_id", "windows", "highest_least", "lowest_most"]
    reach = _reach(table_id, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, protein in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pos, least, most = reach(protein)
                if len(pos):
                    rows.append((cid, len(pos), int(least.max()) / window, int(most.min()) / window))
            if rows:
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return proteins.where("protein is not null").select("construct_id", "protein").mapInArrow(run, "construct_id long, windows long, highest_least double, lowest_most double")


#: Rows of one length that a block holds, about.
BLOCK = 512


def distances(df: DataFrame, most: int | None = None, blocks: int | None = None) -> DataFrame:
    """``a, b, distance``: the share of codons that differ, for every pair ``a < b`` of coding sequences (ACGT) of one length.

    Of ``df(construct_id, cds)`` with whole codons, one or more; with ``most`` those of so many at most.  A codon is six bits; those of one rank lie
    in one number for 64 codons, so 64 codons of a pair are compared by six of them.  All pairs are asked for, so the rows of one length are dealt into
    ``blocks``, by default so many that each holds about :data:`BLOCK` rows, and each two blocks meet in a group of their own: no task holds more
    than some groups, and a pair is met once.  A row alone of its length has no pair and is not dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for text in batch.column(1).to_pylist():
                two = (np.frombuffer(text.encode(), np.uint8) >> 1 & 3).reshape(-1, 3).T
                bits = np.zeros((6, -(-two.shape[1] // 64) * 64), np.uint8)
                bits[:3, : two.shape[1]], bits[3:, : two.shape[1]] = two & 1, two >> 1
                held.append(np.packbits(bits, axis=1).view(np.int64).T.ravel())
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *held])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), words], ["id", "n", "words"])

    n = F.expr("cast(div(length(cds), 3) as int)")
    sized = df.where("construct_id is not null and length(cds) >= 3").select(F.col("construct_id").cast("long"), "cds", n.alias("n"))
    sized = sized if most is None else sized.where(F.col("n") <= most)
    dealt = F.expr(f"1 + div(count(1), {BLOCK})") if blocks is None else F.lit(blocks)
    shared = sized.groupBy("n").agg(F.count(F.lit(1)).alias("_rows"), dealt.cast("int").alias("blocks")).where("_rows > 1").drop("_rows")
    rows = sized.select("construct_id", "cds", "n").mapInArrow(run, "id long, n int, words array<long>").join(shared, "n")
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    # The first block of a pair of blocks is the lower one.
    left = rows.select("n", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), F.col("id").alias("x_id"), F.col("words").alias("x"))
    right = rows.select("n", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("id").alias("y_id"), F.col("words").alias("y"))
    # Pairs are many where rows are few bytes: their groups are dealt out, not broadcast.
    met = left.join(right.hint("merge"), ["n", "i", "j"]).where("i < j or x_id < y_id")
    differ = lambda at: F.bit_count(functools.reduce(lambda a, b: a.bitwiseOR(b), (F.get("x", at + p).bitwiseXOR(F.get("y", at + p)) for p in range(6))))
    later = F.aggregate(F.sequence(F.lit(1), F.expr("cast(div(n - 1, 64) as int)")), F.lit(0), lambda total, w: total + differ(6 * w))
    total = differ(F.lit(0)) + F.when(F.col("n") > 64, later).otherwise(0)
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), (total / F.col("n")).alias("distance"))
