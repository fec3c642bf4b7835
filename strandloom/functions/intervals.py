"""Interval algebra on a circle.  An interval that wraps has ``end > length``; strands are ignored unless named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shifts(length: Column, circular: Column) -> list[Column]:
    return [F.lit(0), F.when(circular, length), F.when(circular, -length)]


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column, length: Column, circular: Column) -> Column:
    """Longest overlap of two intervals over the shifts 0, +length and -length (the last two on circles)."""
    # ``least`` and ``greatest`` skip nulls, so a shift that does not apply is ruled out by name.
    parts = [F.when(s.isNotNull(), F.greatest(F.lit(0), F.least(a1, b1 + s) - F.greatest(a0, b0 + s))).otherwise(F.lit(0)) for s in _shifts(length, circular)]
    return F.greatest(*parts)


def contains(a0: Column, a1: Column, b0: Column, b1: Column, length: Column, circular: Column) -> Column:
    """Whether interval a holds all of b."""
    inside = [(a0 <= b0 + s) & (b1 + s <= a1) for s in _shifts(length, circular)]
    return inside[0] | F.coalesce(inside[1], F.lit(False)) | F.coalesce(inside[2], F.lit(False))


def coverage(a0: Column, a1: Column, b0: Column, b1: Column, length: Column, circular: Column) -> Column:
    """Share of interval a that b covers."""
    return overlap_length(a0, a1, b0, b1, length, circular) / (a1 - a0)


def circular_spacer(a0: Column, a1: Column, b0: Column, b1: Column, length: Column, circular: Column) -> Column:
    """Bases between two arms; on a circle the shorter way round.  Overlapping arms have none."""
    straight = F.greatest(b0 - a1, F.lit(0))
    around = F.greatest(a0 + length - b1, F.lit(0))
    return F.when(circular, F.least(straight, around)).otherwise(straight)


def pair_span(a0: Column, a1: Column, b0: Column, b1: Column, length: Column, circular: Column) -> tuple[Column, Column]:
    """The arc that bounds two arms, a before b: the one their separation is measured on, on a circle the shorter way round."""
    around = length - (b1 - a0)
    wraps = circular & (b1 <= length) & (around >= 0) & (around < b0 - a1)
    return F.when(wraps, b0).otherwise(a0), F.when(wraps, a1 + length).otherwise(F.greatest(a1, b1))


def rotate(position: Column, by: Column, length: Column) -> Column:
    """Position after the origin moves to ``by``."""
    return F.pmod(position - by, length)


def remap(position: Column, start: Column, end: Column, new_length: Column) -> Column:
    """Position after [start, end) is replaced by ``new_length`` bases; null inside the replaced part."""
    return F.when(position < start, position).when(position >= end, position + new_length - (end - start))


def extended(start: Column, end: Column, by: int, length: Column, circular: Column) -> tuple[Column, Column]:
    """Interval grown by ``by`` on both sides: clamped on a line, wrapped on a circle and never over one turn."""
    size = F.least(end - start + 2 * by, length)
    begin = F.when(circular, F.pmod(start - by, length)).otherwise(F.greatest(start - by, F.lit(0)))
    return begin, F.when(circular, begin + size).otherwise(F.least(end + by, length))


def bins(start: Column, end: Column, length: Column, circular: Column, width: int) -> Column:
    """Bin numbers an interval touches, as an equi-join key; a wrapping interval also touches the bins of its start again."""
    straight = F.sequence(F.floor(start / width), F.floor((F.least(end, length) - 1) / width))
    wrapped = F.when(circular & (end > length), F.sequence(F.lit(0).cast("long"), F.floor((end - length - 1) / width)))
    return F.array_distinct(F.concat(straight, F.coalesce(wrapped, F.array().cast("array<bigint>"))))


def overlap_join(left: DataFrame, right: DataFrame, width: int = 500) -> DataFrame:
    """Pairs of overlapping intervals of one construct.

    Both sides have ``construct_id, start, end``; the left one also ``length, circular`` and the right one its fields under
    ``r_`` names.  The join is hash-partitioned on construct and position bin, so one long construct is cut by bins
    and no side is broadcast.
    """
    keyed = left.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"), F.col("length"), F.col("circular"), width)))
    other = left.select("construct_id", "length", "circular").distinct()
    right_keyed = right.join(other, "construct_id").withColumn("bin", F.explode(bins(F.col("r_start"), F.col("r_end"), F.col("length"), F.col("circular"), width))).drop("length", "circular")
    share = overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), F.col("length"), F.col("circular"))
    return keyed.join(right_keyed, ["construct_id", "bin"]).withColumn("overlap", share).where("overlap > 0").drop("bin").distinct()


def islands(rows: DataFrame, start: Column, end: Column, length: Column, circular: Column, by: tuple[str, ...] = ("construct_id",)) -> DataFrame:
    """Rows with ``island, island_start, island_end``: intervals that share bases, directly or through others, are one island.

    On a circle an interval may run over the origin, and the island that does so takes in those it meets there; its end is past
    ``length``.  Islands that go all the way round are (0, length).  Intervals that only touch are apart; empty ones and
    those without a start or an end are left out.  Everything is one hash partitioning on ``by``.
    """
    line = Window.partitionBy(*by).orderBy("_a", "_b")
    before, so_far, whole = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    turned = F.when(circular, start - F.pmod(start, length)).otherwise(F.lit(0))
    made = rows.withColumn("_a", start - turned).withColumn("_b", end - turned).withColumn("_n", length).withColumn("_round", F.coalesce(circular, F.lit(False))).where("_b > _a")
    made = made.withColumn("_new", F.coalesce((F.col("_a") >= F.max("_b").over(before)).cast("int"), F.lit(1)))
    made = made.withColumn("_g", F.sum("_new").over(so_far)).withColumn("_first", F.max(F.when(F.col("_new") == 1, F.col("_a"))).over(so_far))
    # The last island is the one that runs over the origin; those that begin before the place it comes to are part of it, a turn on.
    made = made.withColumn("_last", F.max("_g").over(whole)).withColumn("_over", F.max("_b").over(whole) - F.col("_n"))
    moved = F.col("_round") & (F.col("_first") < F.col("_over")) & (F.col("_g") < F.col("_last"))
    made = made.withColumn("_turn", F.when(moved, F.col("_n")).otherwise(0)).withColumn("island", F.when(moved, F.col("_last")).otherwise(F.col("_g")))
    each = Window.partitionBy(*by, "island")
    made = made.withColumn("_lo", F.min(F.col("_a") + F.col("_turn")).over(each)).withColumn("_hi", F.max(F.col("_b") + F.col("_turn")).over(each))
    around = F.col("_round") & (F.col("_hi") - F.col("_lo") > F.col("_n"))
    made = made.withColumn("island_start", F.when(around, 0).otherwise(F.col("_lo"))).withColumn("island_end", F.when(around, F.col("_n")).otherwise(F.col("_hi")))
    return made.drop("_a", "_b", "_n", "_round", "_new", "_g", "_first", "_last", "_over", "_turn", "_lo", "_hi")
