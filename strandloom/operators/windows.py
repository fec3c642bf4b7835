"""Windowed composition and the regions it gives.

A circle repeats its first bases behind its last, so every start has a whole window.  Windows are made where the construct is; what
is drawn from them shares one hash partitioning on ``construct_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna


def bases(df: DataFrame, ahead: int) -> DataFrame:
    """``construct_id, length, circular, pos, base`` with ``ahead`` bases of a circle repeated behind its end."""
    hay = dna.haystack(F.col("seq"), F.col("circular"), ahead + 1)
    return df.where("length > 0").select("construct_id", "length", "circular", F.posexplode(F.split(hay, "")).alias("pos", "base")).where("base <> ''")


def gc_windows(df: DataFrame, width: int, stride: int = 1) -> DataFrame:
    """``construct_id, length, circular, pos, gc`` of every whole window start; shorter sequences have none.

    Differences of prefix sums in one map per construct: no base is a row, and nothing is shuffled.
    """
    names = ["construct_id", "length", "circular", "pos", "gc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, seq, circular in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(seq.encode(), np.uint8)
                strong = (codes == 71) | (codes == 67)
                total = np.concatenate(([0], np.cumsum(np.concatenate((strong, strong[: width - 1])) if circular else strong)))
                pos = np.arange(0, len(total) - width, stride, dtype=np.int32)
                gc = (total[pos + width] - total[pos]) / width
                fixed = [pa.array(np.full(len(pos), x, t)) for x, t in ((cid, np.int64), (len(seq), np.int32), (bool(circular), np.bool_))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(pos), pa.array(gc)], names)

    whole = df.where((F.col("length") >= width) & (F.col("length") > 0)).select("construct_id", "seq", "circular")
    return whole.mapInArrow(run, "construct_id long, length int, circular boolean, pos int, gc double")


def islands(flagged: DataFrame, width: int, measure: Column, name: str) -> DataFrame:
    """Runs of consecutive flagged starts as regions [first, last + width); a run at a circle's end joins one at its beginning.

    ``flagged`` has ``construct_id, length, circular, pos`` and what ``measure`` (an aggregate named ``name``) reads.
    """
    w = Window.partitionBy("construct_id").orderBy("pos")
    run = flagged.withColumn("_g", F.col("pos") - F.row_number().over(w))
    runs = run.groupBy("construct_id", "length", "circular", "_g").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), measure.alias(name))
    each = Window.partitionBy("construct_id")
    wraps = F.col("circular") & (F.min("first").over(each) == 0) & (F.max("last").over(each) == F.col("length") - 1) & (F.count(F.lit(1)).over(each) > 1)
    marked = runs.withColumn("_wrap", wraps & ((F.col("first") == 0) | (F.col("last") == F.col("length") - 1)))
    key = F.when(F.col("_wrap"), F.lit(-1)).otherwise(F.col("first"))
    # The joined run begins where the later one does and ends one turn on.
    begin = F.when(F.col("_wrap") & (F.col("first") == 0), F.lit(None)).otherwise(F.col("first"))
    stop = F.when(F.col("_wrap") & (F.col("first") == 0), F.col("last") + F.col("length")).when(F.col("_wrap"), F.lit(None)).otherwise(F.col("last"))
    merged = marked.groupBy("construct_id", "length", key.alias("_k")).agg(F.max(begin).alias("start"), F.max(stop).alias("stop"), F.max(name).alias(name))
    return merged.select("construct_id", "start", (F.col("stop") + width).cast("int").alias("end"), name)


def dispersion(df: DataFrame, width: int = 100) -> DataFrame:
    """``construct_id, gc, sd, floor, ratio``: deviation of window GC over what chance gives, linear fragments."""
    linear = df.withColumn("circular", F.lit(False)).withColumn("gc", dna.gc_fraction(F.col("seq")))
    sd = gc_windows(linear, width).groupBy("construct_id").agg(F.stddev_pop("gc").alias("sd"))
    floor = F.sqrt(F.col("gc") * (1 - F.col("gc")) / width)
    return linear.select("construct_id", "gc").join(sd, "construct_id").select("construct_id", "gc", "sd", floor.alias("floor"), F.when(floor > 0, F.col("sd") / floor).otherwise(0.0).alias("ratio"))


def min_max_profile(codon_rows: DataFrame, stats: DataFrame, width: int = 18) -> DataFrame:
    """%MinMax per codon position: ``construct_id, i, min_max``.

    ``codon_rows`` has ``construct_id, i, freq, aa``; ``stats`` has ``aa, mean, top, low`` per family.  Windows are shortened at
    the edges: floor((w - 1) / 2) codons before, floor(w / 2) after.  Codons without a choice hold their place and add nothing.
    ``stats`` has one row per amino acid, so it is broadcast.
    """
    frame = Window.partitionBy("construct_id").orderBy("i").rowsBetween(-((width - 1) // 2), width // 2)
    joined = codon_rows.join(F.broadcast(stats), "aa", "left").withColumn("freq", F.when(F.col("mean").isNotNull(), F.col("freq")))
    total = {c: F.coalesce(F.sum(c).over(frame), F.lit(0.0)) for c in ("freq", "mean", "top", "low")}
    rows = joined.select("construct_id", "i", *[v.alias(f"_{k}") for k, v in total.items()])
    up = 100 * (F.col("_freq") - F.col("_mean")) / (F.col("_top") - F.col("_mean"))
    down = -100 * (F.col("_mean") - F.col("_freq")) / (F.col("_mean") - F.col("_low"))
    return rows.select("construct_id", "i", F.when((F.col("_freq") >= F.col("_mean")) & (F.col("_top") > F.col("_mean")), up).when(F.col("_mean") > F.col("_low"), down).otherwise(0.0).alias("min_max"))
