"""The rule dimension, gating by context slot, effective enforcement, routing of findings and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import intervals

#: Rule, enforcement, evidence, direction, weight, steering weight, localisation, repair policy, cost class: fixed values.
RULES = [
    ("b1_five_prime", "SOFT", "EVIDENCE_BACKED", "HIGHER_IS_BETTER", 1.0, 0.0, "WINDOW_MINUS_1", "SINGLE_PASS", "moderate"),
    ("b2_structure_windows", "SOFT", "EVIDENCE_BACKED", "HIGHER_IS_BETTER", 0.5, 0.0, "WINDOW_MINUS_1", "SINGLE_PASS", "expensive"),
    ("b8_kozak", "SOFT", "EVIDENCE_BACKED", "HIGHER_IS_BETTER", 0.8, 0.0, "WINDOW_MINUS_1", "SINGLE_PASS", "cheap"),
    ("b9_out_of_frame_atg", "HARD_REPAIR", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.0, 0.0, "MOTIF_LEN_MINUS_1", "FIXED_POINT", "cheap"),
    ("c1_cai", "SOFT", "CONTESTED", "BAND", 0.2, 0.0, "WHOLE_SCOPE", "SINGLE_PASS", "cheap"),
    ("c3_min_max", "SOFT", "CONTESTED", "BAND", 0.3, 0.0, "WHOLE_SCOPE", "SINGLE_PASS", "cheap"),
    ("d1_restriction_sites", "HARD_LATTICE", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.0, 0.0, "MOTIF_LEN_MINUS_1", "SINGLE_PASS", "cheap"),
    ("d2_recombinase_sites", "HARD_CHECK", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.0, 0.0, "MOTIF_LEN_MINUS_1", "SINGLE_PASS", "cheap"),
    ("d3_splicing", "SOFT", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.5, 0.3, "WINDOW_MINUS_1", "FIXED_POINT", "cheap"),
    ("d4_internal_polya", "SOFT", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.7, 0.3, "MOTIF_LEN_MINUS_1", "SINGLE_PASS", "cheap"),
    ("d5_cryptic_transcription", "HARD_LATTICE", "CONTESTED", "LOWER_IS_BETTER", 0.0, 0.0, "WINDOW_MINUS_1", "FIXED_POINT", "cheap"),
    ("d6_non_b_dna", "SOFT", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.35, 0.2, "MOTIF_LEN_MINUS_1", "SINGLE_PASS", "cheap"),
    ("d8_cpg_depletion", "SOFT", "CONTESTED", "LOWER_IS_BETTER", 0.35, 0.15, "WINDOW_MINUS_1", "SINGLE_PASS", "cheap"),
    ("e1_homopolymers", "HARD_LATTICE", "VENDOR_ASSERTED", "LOWER_IS_BETTER", 0.0, 0.0, "MOTIF_LEN_MINUS_1", "SINGLE_PASS", "cheap"),
    ("e2_gc_band", "HARD_REPAIR", "VENDOR_ASSERTED", "BAND", 0.0, 0.5, "WINDOW_MINUS_1", "SINGLE_PASS", "cheap"),
    ("e3_windowed_gc", "SOFT", "CONTESTED", "BAND", 0.4, 0.1, "WINDOW_MINUS_1", "SINGLE_PASS", "cheap"),
    ("e4_gc_extent", "SOFT", "CONTESTED", "LOWER_IS_BETTER", 0.6, 0.3, "WINDOW_MINUS_1", "SINGLE_PASS", "cheap"),
    ("e5_synthesis_repeats", "HARD_REPAIR", "VENDOR_ASSERTED", "LOWER_IS_BETTER", 0.0, 0.7, "PAIRED_SEGMENTS", "SINGLE_PASS", "moderate"),
    ("e6_repeat_density", "SOFT", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.65, 0.4, "WINDOW_MINUS_1", "SINGLE_PASS", "cheap"),
    ("e7_short_tandem_repeats", "HARD_REPAIR", "VENDOR_ASSERTED", "LOWER_IS_BETTER", 0.0, 0.5, "WHOLE_SCOPE", "SINGLE_PASS", "cheap"),
    ("e8_kmer_uniqueness", "SOFT", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.55, 0.3, "PAIRED_SEGMENTS", "SINGLE_PASS", "moderate"),
    ("e9_length_tiers", "HARD_CHECK", "VENDOR_ASSERTED", "LOWER_IS_BETTER", 0.0, 0.0, "WHOLE_SCOPE", "SINGLE_PASS", "cheap"),
    ("f1_direct_repeats", "HARD_REPAIR", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.0, 1.0, "PAIRED_SEGMENTS", "SINGLE_PASS", "moderate"),
    ("f2_near_perfect_repeats", "SOFT", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.6, 0.5, "PAIRED_SEGMENTS", "SINGLE_PASS", "moderate"),
    ("f3_inverted_repeats", "HARD_CHECK", "EVIDENCE_BACKED", "LOWER_IS_BETTER", 0.0, 0.0, "PAIRED_SEGMENTS", "SINGLE_PASS", "moderate"),
    ("f5_at_window", "HARD_REPAIR", "CONTESTED", "BAND", 0.0, 0.25, "WINDOW_MINUS_1", "FIXED_POINT", "cheap"),
]
FIELDS = "spec_id string, enforcement string, evidence string, direction string, default_weight double, steering_weight double, localisation string, repair string, cost string"
#: Severity of enforcement, least first.
SEVERITY = ("SOFT", "HARD_CHECK", "HARD_REPAIR", "HARD_LATTICE")
#: Null sample sizes by cost class: fixed values.
NULL_SIZES = {"cheap": 200, "moderate": 40, "expensive": 0}
#: Rules whose thresholds were measured on one folding engine and its parameters: fixed values.
CALIBRATED = {"b1_five_prime": "viennarna:rna_turner2004", "b2_structure_windows": "viennarna:rna_turner2004"}
EUKARYOTES = tuple(sorted(set(dims.HOST_TABLE) - set(dims.BACTERIA)))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, FIELDS)


def rule_set(context: DataFrame, engine: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``spec_id, status`` of the rules over the slots of a context (of each, told apart by the columns ``by``): ``run``, ``gated_out`` or ``unrunnable``.

    Rules that rest on folklore are left out.  Those of :data:`CALIBRATED` run on one folding engine: without an engine they are
    unrunnable, which is reported; on another it is an error, as their thresholds would mean nothing there.
    """
    wrong = sorted(k for k, v in CALIBRATED.items() if engine not in (None, v))
    if wrong:
        raise ValueError(f"the folding engine is {engine}, but thresholds were measured on another: {', '.join(wrong)}")
    unready = F.col("spec_id").isin(*CALIBRATED) if engine is None else F.lit(False)
    folklore = [r[0] for r in RULES if r[2] == "FOLKLORE"]
    made = gate_matrix(context).where(~F.col("spec_id").isin(*folklore)).groupBy(*by, "spec_id").agg(F.max("gated_in").alias("_in"))
    return made.select(*by, "spec_id", F.when(unready, "unrunnable").when(F.col("_in"), "run").otherwise("gated_out").alias("status"))


def slots(spark: SparkSession) -> DataFrame:
    """Every context slot: ``role, host, modality, table_id``; the genetic code is locked to the host."""
    return spark.createDataFrame([(r, h, m, t) for r in dims.ROLES for h, t in sorted(dims.HOST_TABLE.items()) for m in dims.MODALITIES], "role string, host string, modality string, table_id int")


def gate() -> Column:
    """Whether a rule applies to a slot, over columns ``spec_id, role, host, modality``."""
    spec, modality, translated = F.col("spec_id"), F.col("modality"), F.col("role") != "propagation"
    transcribed = ~modality.isin("bacterial_expression", "ivt_mrna")
    return (
        F.when(spec.isin("b1_five_prime", "b2_structure_windows"), modality == "bacterial_expression")
        .when(spec.isin("b8_kozak", "b9_out_of_frame_atg"), F.col("host").isin(*EUKARYOTES) & translated)
        .when(spec.isin("c1_cai", "c3_min_max"), translated)
        .when(spec == "d3_splicing", transcribed & ~F.col("host").isin(*dims.BACTERIA, *dims.YEASTS))
        .when(spec == "d4_internal_polya", transcribed)
        .when(spec.isin("d6_non_b_dna", "e2_gc_band"), modality != "ivt_mrna")
        .otherwise(F.lit(True))
    )


def enforcement_for() -> Column:
    """Enforcement of a rule in a slot; the class value stays beside it in ``enforcement``."""
    spec, modality = F.col("spec_id"), F.col("modality")
    return (
        F.when((spec == "d3_splicing") & modality.isin("lentiviral", "genome_integrated"), "HARD_REPAIR")
        .when((spec == "d4_internal_polya") & modality.isin("lentiviral", "aav", "genome_integrated"), "HARD_REPAIR")
        .when((spec == "d6_non_b_dna") & (modality == "bacterial_expression"), "HARD_REPAIR")
        .when(spec == "d5_cryptic_transcription", "HARD_REPAIR")
        .otherwise(F.col("enforcement"))
    )


def scored_objectives(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``spec_id`` of the rules that are soft and stay soft in every gated slot of a context (:func:`gate_matrix` rows)."""
    hard = F.max((F.col("gated_in") & (F.col("slot_enforcement") != "SOFT")).cast("int"))
    made = matrix.groupBy(*by, "spec_id").agg(F.first("enforcement").alias("enforcement"), hard.alias("hard"))
    return made.where("enforcement = 'SOFT' and hard = 0").select(*by, "spec_id")


def null_size() -> Column:
    """Variants of the null a rule is compared with, by its cost class."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in NULL_SIZES.items() for x in pair]), F.col("cost"))


def gate_matrix(slot_rows: DataFrame) -> DataFrame:
    """Slots with every rule, ``gated_in`` and ``slot_enforcement``: the rule list is exploded onto each slot, not joined."""
    listed = F.array(*[F.struct(F.lit(r[0]).alias("spec_id"), F.lit(r[1]).alias("enforcement")) for r in RULES])
    rows = slot_rows.select("*", F.explode(listed).alias("r")).select("*", "r.spec_id", "r.enforcement").drop("r")
    return rows.withColumn("gated_in", gate()).withColumn("slot_enforcement", enforcement_for())


def severity(enforcement: Column) -> Column:
    out = F.lit(-1)
    for k, name in enumerate(SEVERITY):
        out = F.when(enforcement == name, k).otherwise(out)
    return out


def effective_enforcement(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``spec_id, enforcement`` over a context's (each context's, told apart by the columns ``by``) gated slots: the most severe (for a breach that names no slot)."""
    return matrix.where("gated_in").groupBy(*by, "spec_id").agg(F.max_by("slot_enforcement", severity(F.col("slot_enforcement"))).alias("enforcement"))


def evaluate(breaches: DataFrame) -> DataFrame:
    """``construct_id, spec_id, n, magnitude, worst`` from breach rows; counts are combined before the shuffle."""
    return breaches.groupBy("construct_id", "spec_id").agg(F.count(F.lit(1)).alias("n"), F.sum("magnitude").alias("magnitude"), F.max("magnitude").alias("worst"))


#: Least magnitude at which an evaluation fails, where it is not 1: fixed values.
FAILS_AT = {"d3_splicing": 3.0}


def findings(breaches: DataFrame, enforcement: DataFrame) -> DataFrame:
    """Breaches of failing evaluations with their effective enforcement and route.

    A passing evaluation (no magnitude of 1, or of :data:`FAILS_AT`) contributes nothing.  ``enforcement`` has one row per rule, so it is
    broadcast.  Breaches that carry the ``worst`` magnitude of their evaluation (:func:`.evaluation.breaches` knows it) are not shuffled.
    """
    at = F.lit(1.0)
    for spec, least in FAILS_AT.items():
        at = F.when(F.col("spec_id") == spec, least).otherwise(at)
    worst = F.col("worst") if "worst" in breaches.columns else F.max("magnitude").over(Window.partitionBy("construct_id", "spec_id"))
    routed = breaches.withColumn("_worst", worst).where(F.col("_worst") >= at).drop("_worst", "worst").join(F.broadcast(enforcement), "spec_id")
    route = F.when(F.col("enforcement") == "SOFT", "score").when(F.col("fixable"), "repair").otherwise("advise")
    return routed.withColumn("route", route)


#: Rules that pull against each other over a whole construct, whether or not their breaches overlap: fixed values.
DECLARED = [
    ("b8_kozak", "b9_out_of_frame_atg"), ("b8_kozak", "d1_restriction_sites"), ("c1_cai", "e5_synthesis_repeats"), ("c1_cai", "e6_repeat_density"), ("c1_cai", "f1_direct_repeats"),
    ("d1_restriction_sites", "d2_recombinase_sites"), ("d5_cryptic_transcription", "d8_cpg_depletion"), ("d5_cryptic_transcription", "f5_at_window"), ("d8_cpg_depletion", "e2_gc_band"),
    ("e2_gc_band", "e3_windowed_gc"), ("e2_gc_band", "e4_gc_extent"), ("e2_gc_band", "f5_at_window"), ("e3_windowed_gc", "f5_at_window"), ("e4_gc_extent", "f5_at_window"),
]


def with_hardness(breaches: DataFrame, enforcement: DataFrame | None = None) -> DataFrame:
    """Breaches with ``hard``: by the class of their rule, or by the effective ``enforcement(spec_id, enforcement)`` of the context.

    An ``enforcement`` with a ``construct_id`` has a context for every construct.  It becomes one map a construct before it is
    joined, so that breaches are shuffled on ``construct_id`` alone, as the merge behind it needs them.  A rule that the context
    does not name keeps its class.
    """
    of_class = F.col("spec_id").isin(*[r[0] for r in RULES if r[1] != "SOFT"])
    if enforcement is None:
        return breaches.withColumn("hard", of_class)
    if "construct_id" not in enforcement.columns:
        return breaches.join(F.broadcast(enforcement.select("spec_id", F.col("enforcement").alias("_e"))), "spec_id", "left").withColumn("hard", F.coalesce(F.col("_e") != "SOFT", of_class)).drop("_e")
    maps = enforcement.groupBy("construct_id").agg(F.map_from_entries(F.collect_list(F.struct("spec_id", "enforcement"))).alias("_e"))
    return breaches.join(maps, "construct_id", "left").withColumn("hard", F.coalesce(F.try_element_at("_e", "spec_id") != "SOFT", of_class)).drop("_e")


def _first() -> Column:
    """What puts the breach that binds first: hard before soft, then the larger magnitude, then place and rule."""
    return F.struct((~F.col("hard")).alias("soft"), (-F.col("magnitude")).alias("less"), "start", "end", "spec_id")


def conflicts(breaches: DataFrame, enforcement: DataFrame | None = None) -> DataFrame:
    """``construct_id, start, end, rules, kind, binding, hard_versus_soft``: overlapping breaches of two or more rules.

    ``breaches`` carry ``side`` and their construct's ``length`` and ``circular``; groups are islands, round the origin of circles
    too.  Any unfixable breach makes the kind ``immutable_region``, differing sides ``opposing_gradient``; no side is none.
    ``enforcement`` is that of :func:`with_hardness`.
    """
    shaped = with_hardness(breaches, enforcement)
    placed = intervals.islands(shaped, F.col("start"), F.col("end"), F.col("length"), F.col("circular"))
    made = placed.groupBy("construct_id", "island").agg(
        F.first("island_start").alias("_s"), F.first("island_end").alias("_e"), F.array_sort(F.collect_set("spec_id")).alias("_rules"), F.min(_first()).alias("_top"),
        F.min(F.col("fixable").cast("int")).alias("_fix"), F.size(F.collect_set(F.when(F.col("side") != "", F.col("side")))).alias("_sides"), F.count_distinct("hard").alias("_levels"),
    )
    kind = F.when(F.col("_fix") == 0, "immutable_region").when(F.col("_sides") > 1, "opposing_gradient").otherwise("mutually_exclusive")
    return made.where(F.size("_rules") >= 2).select("construct_id", F.col("_s").alias("start"), F.col("_e").alias("end"), F.array_join("_rules", ",").alias("rules"), kind.alias("kind"), F.col("_top.spec_id").alias("binding"), (F.col("_levels") == 2).alias("hard_versus_soft"))


def declared_conflicts(breaches: DataFrame, present: list[str], enforcement: DataFrame | None = None) -> DataFrame:
    """As :func:`conflicts`, for pairs of :data:`DECLARED` that were both run (``present``) and of which one or both have breaches.

    The interval is that of the first breach by rule and place.  A rule that is satisfied because it won has no breach, so one side is enough.
    """
    pairs = [(a, b) for a, b in DECLARED if a in present and b in present]
    classes = {r[0]: r[1] != "SOFT" for r in RULES}
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(classes[a] != classes[b]).alias("mixed")) for a, b in pairs]) if pairs else F.array().cast("array<struct<a:string,b:string,mixed:boolean>>")
    hit = F.filter(sides, lambda p: (p["a"] == F.col("spec_id")) | (p["b"] == F.col("spec_id")))
    rows = with_hardness(breaches, enforcement).withColumn("_p", F.explode(hit))
    made = rows.groupBy("construct_id", "_p").agg(F.min(F.struct("spec_id", "start", "end")).alias("_at"), F.min(_first()).alias("_top"))
    return made.select("construct_id", "_at.start", "_at.end", F.concat_ws(",", "_p.a", "_p.b").alias("rules"), F.lit("declared").alias("kind"), F.col("_top.spec_id").alias("binding"), F.col("_p.mixed").alias("hard_versus_soft"))
