"""Backbone survey: nearest features, payload candidates, cloning sites, painted segments, homology arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .scan import positions


def nearest(targets: DataFrame, elements: DataFrame, limit: int | None = None) -> DataFrame:
    """``construct_id, j, element, feature, distance, f_start, f_end``: the closest feature of each named element on a target's strand.

    ``targets`` has ``construct_id, j, start, end, strand, length, circular``; ``elements`` the same columns and ``element, upstream``.
    An as-of join without pairs: both lie on an axis that points to the target, and a running maximum carries the last feature
    on.  On a circle every feature lies there twice, a turn apart, and one over half a turn away points the other way; on a line
    only ``limit`` bounds the distance.  Ties go to the lower feature number.
    """
    side = F.when(F.col("upstream"), F.col("strand")).otherwise(-F.col("strand")).alias("_side")
    on_axis = lambda ahead, behind: F.when(F.col("circular"), F.pmod(F.when(F.col("_side") > 0, ahead).otherwise(-behind), F.col("length"))).otherwise(F.when(F.col("_side") > 0, ahead).otherwise(-behind))
    named = elements.select("construct_id", "element", "upstream", side, "length", "circular", F.col("j").alias("feature"), F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    named = named.withColumn("_at", on_axis(F.col("f_end"), F.col("f_start")))
    turns = F.explode(F.when(F.col("circular"), F.array("_at", F.col("_at") - F.col("length"))).otherwise(F.array("_at")))
    named = named.withColumn("_at", turns).select("construct_id", "element", "_side", "_at", F.struct("_at", (-F.col("feature")).alias("minus"), "f_start", "f_end").alias("_last"))
    wanted = elements.select("construct_id", "element", "upstream").distinct()
    asked = targets.join(wanted, "construct_id").withColumn("_side", F.when(F.col("upstream"), F.col("strand")).otherwise(-F.col("strand")))
    asked = asked.select("construct_id", "element", "_side", on_axis(F.col("start"), F.col("end")).alias("_at"), "j", "length", "circular")
    w = Window.partitionBy("construct_id", "element", "_side").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(named, allowMissingColumns=True).withColumn("_near", F.max("_last").over(w)).where("j is not null and _near is not null")
    found = both.withColumn("distance", F.col("_at") - F.col("_near._at")).where(F.when(F.col("circular"), F.col("distance") <= F.floor(F.col("length") / 2)).otherwise(True))
    if limit is not None:
        found = found.where(F.col("distance") <= limit)
    return found.select("construct_id", "j", "element", (-F.col("_near.minus")).alias("feature"), F.col("distance").cast("int").alias("distance"), "_near.f_start", "_near.f_end")


def nearest_upstream(targets: DataFrame, features: DataFrame, limit: int | None = None) -> DataFrame:
    """``construct_id, j, feature, distance``: the closest feature upstream on the same strand (see :func:`nearest`)."""
    return nearest(targets, features.withColumn("element", F.lit("")).withColumn("upstream", F.lit(True)), limit).select("construct_id", "j", "feature", "distance")


def nearest_downstream(targets: DataFrame, features: DataFrame, limit: int | None = None) -> DataFrame:
    """As :func:`nearest_upstream`, on the other side."""
    return nearest(targets, features.withColumn("element", F.lit("")).withColumn("upstream", F.lit(False)), limit).select("construct_id", "j", "feature", "distance")


def occurrences(arms: DataFrame, constructs: DataFrame, width: int) -> DataFrame:
    """``construct_id, arm, position, strand`` of every place of ``arms(construct_id, arm, text, start)`` but its own, on either strand.

    All texts have ``width`` bases.  An equi-join on construct and text, so a construct's arms meet its own positions alone.
    """
    found = positions(constructs, width).select("construct_id", "pos", F.col("kmer").alias("text"))
    back = arms.where(F.col("text") != dna.reverse_complement(F.col("text"))).select("construct_id", "arm", dna.reverse_complement(F.col("text")).alias("text"), "start", F.lit(-1).alias("strand"))
    both = arms.select("construct_id", "arm", "text", "start", F.lit(1).alias("strand")).unionByName(back)
    return both.join(found, ["construct_id", "text"]).where("strand = -1 or pos <> start").select("construct_id", "arm", F.col("pos").alias("position"), "strand")


def shared_arms(arms: DataFrame, least: int = 20) -> DataFrame:
    """``construct_id, arm, other, offset``: pairs of a construct's arms with ``least`` common bases (all of the shorter arm, if it has fewer), on either strand.

    ``offset`` is the first such base of the arm of the lower number.  Arms meet by their pieces, an equi-join.
    """
    pair = arms.alias("a").join(arms.alias("b"), (F.col("a.construct_id") == F.col("b.construct_id")) & (F.col("a.arm") < F.col("b.arm")))
    k = F.least(F.lit(least), F.length("a.text"), F.length("b.text"))
    pieces = lambda text: F.transform(F.sequence(F.lit(1), F.length(text) - F.col("k") + 1), lambda i: F.substring(text, i, F.col("k")))
    made = pair.select("a.construct_id", "a.arm", F.col("b.arm").alias("other"), F.col("a.text").alias("x"), F.col("b.text").alias("y"), k.alias("k")).where("k > 0")
    made = made.withColumn("mine", pieces(F.col("x"))).withColumn("theirs", pieces(F.col("y")))
    either = F.concat("theirs", F.transform("theirs", dna.reverse_complement))
    hit = F.array_position(F.transform("mine", lambda w: F.array_contains(either, w)), True)
    return made.withColumn("hit", hit).where("hit > 0").select("construct_id", "arm", "other", (F.col("hit") - 1).cast("int").alias("offset"))


def identical_repeats(segments: DataFrame) -> DataFrame:
    """``construct_id, first, second, length``: exempt segments of one construct with the same text; they meet by its digest.

    ``segments`` has ``construct_id, j, text``.
    """
    keyed = segments.select("construct_id", "j", F.sha2("text", 256).alias("key"), F.length("text").alias("length"))
    other = keyed.select("construct_id", "key", F.col("j").alias("second"))
    return keyed.join(other, ["construct_id", "key"]).where("j < second").select("construct_id", F.col("j").alias("first"), "second", "length")


def painted(features: DataFrame) -> DataFrame:
    """``construct_id, start, end, j``: segments after painting features in order, later ones over earlier ones."""
    at = F.explode(F.sequence(F.col("start"), F.col("end") - 1))
    cells = features.select("construct_id", at.alias("raw"), "length", "j").withColumn("pos", F.pmod("raw", "length"))
    top = cells.groupBy("construct_id", "pos").agg(F.max("j").alias("j"))
    w = Window.partitionBy("construct_id", "j").orderBy("pos")
    runs = top.withColumn("_g", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("construct_id", "j", "_g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).select("construct_id", "start", "end", "j")


def cloning_sites(features: DataFrame, least: int = 20, most: int = 500) -> DataFrame:
    """``construct_id, j, start, end``: unannotated gaps of 20 to 500 bases behind a forward feature, on a line."""
    w = Window.partitionBy("construct_id").orderBy("start", "end", "j")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0))
    gaps = features.withColumn("_next", F.lead("start").over(w)).withColumn("_reach", reach)
    return gaps.where((F.col("strand") > 0) & (F.col("_reach") == F.col("end")) & (F.col("_next") - F.col("end")).between(least, most)).select("construct_id", "j", F.col("end").alias("start"), F.col("_next").alias("end"))


def rank_sites(candidates: DataFrame, cap: int = 5) -> DataFrame:
    """The ``cap`` best of each construct by score, then protein length, then start."""
    w = Window.partitionBy("construct_id").orderBy(F.desc("score"), F.desc("aa"), "start")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def junction_arms(df: DataFrame, lengths: tuple[int, int] = (15, 40), least_tm: float = 48.0) -> DataFrame:
    """``construct_id, junction, start, end, arm, tm, unique, usable`` of ``df(construct_id, seq, length, circular, junction, at)``.

    Arms are centred on the junction ``at``.  The shortest one that is warm enough and occurs nowhere else, on either strand, is
    taken, else the longest there is; a junction too near the end of a line, or a construct shorter than the arms, has nulls.  All
    lengths are tried within the row, so a sequence is not copied for each.
    """
    least, most = lengths

    def arm(n: Column) -> Column:
        raw = F.col("at") - F.floor(n / 2).cast("int")
        start = F.when(F.col("circular"), F.pmod(raw, F.col("length"))).otherwise(raw).cast("int")
        there = (n <= F.col("length")) & (F.col("circular") | (start >= 0) & (start + n <= F.col("length")))
        return F.when(there, F.struct(start.alias("start"), F.substring("_twice", start + 1, n).alias("arm"), n.alias("n")))

    def measured(x: Column) -> Column:
        around = F.when(F.col("circular"), F.substring("_twice", F.lit(1), F.col("length") + x["n"] - 1)).otherwise(F.col("seq"))
        back = dna.reverse_complement(x["arm"])
        before = F.position(x["arm"], around) != x["start"] + 1
        behind = F.position(x["arm"], around, x["start"] + 2) > 0
        unique = ~(before | behind | (back != x["arm"]) & (F.position(back, around) > 0))
        return F.struct(x["start"], x["arm"], x["n"], dna.melting_temperature(x["arm"], oligo_nm=250.0, table="2004").alias("tm"), unique.alias("unique"))

    rows = df.withColumn("_twice", F.concat("seq", F.when(F.col("circular"), F.substring("seq", 1, most)).otherwise("")))
    none = F.lit(None).cast("struct<start:int,arm:string,n:int,tm:double,unique:boolean>")
    # Once an arm will do, the longer ones are not measured.
    pick = F.aggregate(F.array_compact(F.transform(F.sequence(F.lit(least), F.lit(most)), arm)), none, lambda best, x: F.when(best["unique"] & (best["tm"] >= least_tm), best).otherwise(measured(x)))
    rows = rows.withColumn("b", pick)
    usable = F.coalesce(F.col("b.unique") & (F.col("b.tm") >= least_tm), F.lit(False))
    return rows.select("construct_id", "junction", "b.start", (F.col("b.start") + F.col("b.n")).alias("end"), "b.arm", "b.tm", "b.unique", usable.alias("usable"))


def homology_arms(df: DataFrame, lengths: tuple[int, int] = (15, 40), least_tm: float = 48.0) -> DataFrame:
    """``construct_id, arm_length, arm, tm, unique``: the arm over the origin of each circle of at least two longest arms."""
    rows = df.where(F.col("circular") & (F.col("length") >= 2 * lengths[1])).select("construct_id", "seq", "length", "circular", F.lit("origin").alias("junction"), F.lit(0).alias("at"))
    return junction_arms(rows, lengths, least_tm).select("construct_id", F.length("arm").alias("arm_length"), "arm", "tm", "unique")
