"""Vendor length verdicts, the joint envelope of a selection, order layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna


def selection(keys: list[str]) -> list[tuple]:
    """Profiles of a selection: not empty, known, and of one adapter payload."""
    known = {v[0]: v for v in dims.VENDORS}
    if not keys or set(keys) - set(known):
        raise ValueError(f"unknown or empty vendor selection: {keys}")
    if len({known[k][7:] for k in keys}) > 1:
        raise ValueError("a selection must have one adapter payload")
    return [known[k] for k in sorted(set(keys))]


def length_verdicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """``construct_id, length, accepting, verdict``: accept where all take the length, refuse where none, else ambiguous."""
    chosen = selection(keys)
    takes = [F.when(F.col("length").between(v[1], v[2]) if v[1] is not None else F.lit(True), F.lit(v[0])) for v in chosen]
    accepting = F.array_compact(F.array(*takes))
    verdict = F.when(F.size(accepting) == len(chosen), "accept").when(F.size(accepting) == 0, "refuse").otherwise("ambiguous")
    return df.select("construct_id", "length", F.array_join(accepting, ",").alias("accepting"), verdict.alias("verdict"))


def envelope(profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of ``by``): the tightest limits over profiles and which profiles bind them."""
    tight = profiles.groupBy(*by).agg(F.min("homopolymer_at").alias("at"), F.min("homopolymer_gc").alias("gc"), F.max("gc_lo").alias("lo"), F.min("gc_hi").alias("hi"), F.collect_list(F.struct("key", "homopolymer_at", "gc_hi")).alias("_p"))
    binders = lambda field, limit: F.array_join(F.array_sort(F.transform(F.filter("_p", lambda p: p[field] == F.col(limit)), lambda p: p["key"])), ",")
    return tight.select(*by, "at", "gc", "lo", "hi", binders("homopolymer_at", "at").alias("at_binders"), binders("gc_hi", "hi").alias("hi_binders"))


def gc_breaches(df: DataFrame, keys: list[str]) -> DataFrame:
    """``construct_id, gc, deviation`` of ordered fragments (adapters included) outside the selection's GC band."""
    chosen = selection(keys)
    lo = max((v[5] for v in chosen if v[5] is not None), default=0.0)
    hi = min((v[6] for v in chosen if v[6] is not None), default=1.0)
    gc = dna.gc_fraction(F.concat(F.lit(chosen[0][7]), F.col("seq"), F.lit(chosen[0][8])))
    return df.where("length > 0").select("construct_id", gc.alias("gc")).withColumn("deviation", F.greatest(lo - F.col("gc"), F.col("gc") - hi, F.lit(0.0))).where("deviation > 0")


def wells(orders: DataFrame, batch: str, order_by: list[str]) -> DataFrame:
    """Adds ``plate, well``: plates of 96 per batch, A1 to H12 row by row."""
    n = F.row_number().over(Window.partitionBy(batch).orderBy(*order_by)) - 1
    slot = F.col("_n") % 96
    well = F.concat(F.substring(F.lit("ABCDEFGH"), F.floor(slot / 12).cast("int") + 1, F.lit(1)), (slot % 12 + 1).cast("string"))
    return orders.withColumn("_n", n).withColumn("plate", F.floor(F.col("_n") / 96).cast("int")).withColumn("well", well).drop("_n")


def unique_names(orders: DataFrame) -> DataFrame:
    """Orders, or an error at run time where a name occurs twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    checked = orders.withColumn("_dup", twice)
    return checked.where(F.when(F.col("_dup"), F.raise_error(F.concat(F.lit("order name used twice: "), F.col("name")))).otherwise(F.lit(True))).drop("_dup")


def sheet_title_ok(title: Column) -> Column:
    """At most 31 characters, none of []:*?/ or backslash."""
    return (F.length(title).between(1, 31)) & ~title.rlike(r"[\[\]:*?/\\]")


def design_hash(cds: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the canonical JSON of a design without context."""
    return F.substring(F.sha2(F.concat(F.lit('{"cds":"'), F.upper(cds), F.lit('","context":{}}')), 256), 1, 12)
