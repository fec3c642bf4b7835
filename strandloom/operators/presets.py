"""Preset weights, label matching and the text report of a design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules

#: Preset, modality, rule, weight: fixed values.
PRESETS = [
    ("lentiviral_hek293", "lentiviral", "f2_near_perfect_repeats", 1.0),
    ("lentiviral_hek293", "lentiviral", "c1_cai", 0.2),
    ("lentiviral_hek293", "lentiviral", "c3_min_max", 0.3),
    ("aav_hek293", "aav", "f2_near_perfect_repeats", 1.0),
    ("aav_hek293", "aav", "c1_cai", 0.2),
    ("aav_hek293", "aav", "c3_min_max", 0.3),
    ("ecoli_expression", "bacterial_expression", "b1_five_prime", 1.0),
    ("ecoli_expression", "bacterial_expression", "c1_cai", 0.2),
    ("ecoli_expression", "bacterial_expression", "c3_min_max", 0.3),
    ("ecoli_expression", "bacterial_expression", "f2_near_perfect_repeats", 0.5),
]
#: Words that mark a selection marker, and a recombination site: fixed values.
MARKERS = ("ampr", "kanr", "puror", "neor", "hygr", "zeor", "bler", "blastr", "bsdr", "cmr", "specr", "tetr", "confers resistance", "resistance gene", "beta-lactamase", "b-lactamase", "lactamase", "acetyltransferase", "aminoglycoside", "phosphotransferase", "nourseothricin")
RECOMBINATION = ("attb", "attp", "attl", "attr", "loxp", "lox2272", "frt", "rox", "gateway")


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset_id string, modality string, spec_id string, weight double")


def resolve(presets: DataFrame, implemented: DataFrame) -> DataFrame:
    """``preset_id, spec_id, weight, status``: ``weighted`` for soft rules, ``hard`` where a weight names a rule that is not priced, ``missing`` where no such rule exists."""
    known = implemented.select("spec_id", "enforcement")
    status = F.when(F.col("enforcement").isNull(), "missing").when(F.col("enforcement") != "SOFT", "hard").otherwise("weighted")
    return presets.join(F.broadcast(known), "spec_id", "left").select("preset_id", "spec_id", "weight", status.alias("status"))


def resolve_slots(presets: DataFrame, matrix: DataFrame) -> DataFrame:
    """Like :func:`resolve`, by the slots a preset meets: the rows of ``matrix`` (:func:`rules.gate_matrix`) of its modality, with what else they hold.

    A weight on a rule that is hard in the slot is ``hard``, whatever the rule's class says.
    """
    slot = F.when(F.col("slot_enforcement") != "SOFT", "hard").otherwise("weighted")
    return matrix.join(F.broadcast(presets), ["modality", "spec_id"]).withColumn("status", slot)


def weights_for(scores: DataFrame, preset_id: str | None) -> DataFrame:
    """Score rows with ``weight``: the preset's where it names the rule, else the rule's default."""
    spark = scores.sparkSession
    base = rules.rules(spark).select("spec_id", "default_weight")
    chosen = preset_table(spark).where(F.col("preset_id") == (preset_id or "")).select("spec_id", F.col("weight").alias("_w"))
    table = base.join(chosen, "spec_id", "left").select("spec_id", F.coalesce("_w", "default_weight").alias("weight"))
    return scores.join(F.broadcast(table), "spec_id")


def is_marker(label: Column) -> Column:
    return F.lower(label).rlike("|".join(MARKERS))


def is_recombination_site(label: Column) -> Column:
    return F.lower(label).rlike("|".join(RECOMBINATION))


def report(scores: DataFrame) -> DataFrame:
    """``candidate, report, complete``: scored objectives, then those not evaluated with their reasons.

    ``scores`` has ``candidate, spec_id, raw, percentile, n, reason``.  A candidate's rows are the rules, so the list is short.
    """
    line = F.when(F.col("percentile").isNotNull(), F.format_string("  %-28s %5.1f%%  (raw %.4g, n=%d)", "spec_id", F.col("percentile") * 100, "raw", "n")).otherwise(F.format_string("  %-28s %s", F.col("spec_id"), F.coalesce("reason", F.lit("unavailable"))))
    rows = scores.withColumn("_line", line).groupBy("candidate").agg(F.array_sort(F.collect_list(F.when(F.col("percentile").isNotNull(), F.col("_line")))).alias("_s"), F.array_sort(F.collect_list(F.when(F.col("percentile").isNull(), F.col("_line")))).alias("_u"))
    head = F.array(F.lit("Objectives (percentile against a random-synonymous null; not a prediction)"))
    body = F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.array(F.lit("  none evaluated")))
    rest = F.when(F.size("_u") > 0, F.concat(F.array(F.lit(""), F.lit("NOT evaluated")), F.col("_u"))).otherwise(F.array().cast("array<string>"))
    return rows.select("candidate", F.array_join(F.concat(head, body, rest), "\n").alias("report"), (F.size("_u") == 0).alias("complete"))
