"""Queries over annotated backbones: evidence of reading frames, sites, untranslated context, features behind a replacement, repetitive regions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, kmers, placement, presets, rules, survey
from .derived import FEATURES_SQL, SQL, constructs, features
from .engine import CONTEXT_SQL, contexts
from .evaluate import _ORF
from .registry import query

KINDS = ("promoter", "CDS", "polyA_signal", "regulatory", "rep_origin", "5'UTR", "sig_peptide", "LTR", "promoter", "intron", "CDS", "3'UTR", "source")
_LIST = ", ".join("'" + k.replace("'", "''") + "'" for k in KINDS)
#: Features with a kind by number, and labels that name a marker, a Kozak sequence or a recombination site now and then.
ANNOTATED = f"""SELECT construct_id, length, circular, j, kind, CASE WHEN (construct_id + j) % 5 = 0 THEN 'AmpR ' || kind WHEN kind = 'regulatory' AND construct_id % 2 = 0 THEN 'Kozak' WHEN (construct_id + j) % 7 = 0 THEN 'loxP' ELSE kind END AS label, CAST(NULL AS STRING) AS note,
  CASE WHEN kind = 'regulatory' AND construct_id % 2 = 1 THEN 'ribosome_binding_site' END AS regulatory_class, start, "end", strand FROM"""
ANNOTATED_SQL = f"""{FEATURES_SQL}, kinded AS (SELECT *, [{_LIST}][CAST((construct_id + j * 5) % {len(KINDS)} AS INT) + 1] AS kind FROM features),
ann AS ({ANNOTATED} kinded), ann_t AS (SELECT *, lower(kind) AS k, label AS txt, regexp_matches(lower(label), '{"|".join(presets.MARKERS)}') AS marker FROM ann)"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.expr(f"(construct_id + j * 5) % {len(KINDS)}") + 1).cast("int"))
    return features(spark, sf_dir).withColumn("kind", kind).selectExpr(*_columns())


def _columns() -> list[str]:
    label = "case when (construct_id + j) % 5 = 0 then concat('AmpR ', kind) when kind = 'regulatory' and construct_id % 2 = 0 then 'Kozak' when (construct_id + j) % 7 = 0 then 'loxP' else kind end as label"
    return ["construct_id", "length", "circular", "j", "kind", label, "cast(null as string) as note", "case when kind = 'regulatory' and construct_id % 2 = 1 then 'ribosome_binding_site' end as regulatory_class", "start", "end", "strand"]


_HIT = "greatest(least(o.e, f.\"end\" {0}) - greatest(o.s, f.start {0}), 0)"
_TOUCH = f"greatest({_HIT.format('')}, {_HIT.format('+ o.length')}, {_HIT.format('- o.length')}) > 0"
SCORES_SQL = f"""{SQL}, {_ORF}, {ANNOTATED_SQL}, o AS (SELECT construct_id, length, strand, lo AS s, lo + stop + 3 - s0 AS e FROM (SELECT construct_id, length, strand, s AS s0, stop, CASE WHEN strand = 1 THEN s % length ELSE ((length - stop - 3) % length + length) % length END AS lo FROM orfs WHERE (stop - s) // 3 >= 20) x),
og AS (SELECT *, CASE WHEN strand = 1 THEN s ELSE e END AS fp FROM o), arms AS (SELECT construct_id, min("end") AS lo, max(start) AS hi FROM ann_t WHERE k IN ('ltr', 'repeat_region') OR regexp_matches(lower(label), 'itr|ltr|inverted terminal repeat') GROUP BY construct_id HAVING count(*) >= 2),
ev AS (SELECT construct_id, s, e, strand, 'length' AS signal, least(6, (e - s) // 3 // 100) AS points FROM og
  UNION ALL SELECT o.construct_id, s, e, o.strand, CASE WHEN k = 'rep_origin' THEN 'origin' WHEN marker THEN 'marker' ELSE 'cds' END, CASE WHEN k = 'rep_origin' OR marker THEN -8 ELSE 2 END FROM og o JOIN ann_t f ON o.construct_id = f.construct_id AND k IN ('cds', 'rep_origin') AND {_TOUCH}
  UNION ALL SELECT o.construct_id, s, e, o.strand, 'kozak', 3 FROM og o JOIN ann_t f ON o.construct_id = f.construct_id AND k = 'regulatory' AND contains(lower(txt), 'kozak') AND fp BETWEEN f.start - 3 AND f."end" + 3
  UNION ALL SELECT o.construct_id, s, e, o.strand, 'signal_peptide', 3 FROM og o JOIN ann_t f ON o.construct_id = f.construct_id AND k = 'sig_peptide' AND abs(CASE WHEN o.strand = 1 THEN f.start ELSE f."end" END - fp) <= 3
  UNION ALL SELECT construct_id, s, e, strand, 'payload', 2 FROM og JOIN arms USING (construct_id) WHERE lo <= s AND e <= hi
  UNION ALL SELECT DISTINCT o.construct_id, s, e, o.strand, 'promoter', 2 FROM og o JOIN ann_t f ON o.construct_id = f.construct_id AND o.strand = f.strand AND k = 'promoter' AND NOT marker AND CASE WHEN o.strand = 1 THEN s - f."end" ELSE f.start - e END BETWEEN 0 AND 2000
  UNION ALL SELECT DISTINCT o.construct_id, s, e, o.strand, 'polya', 2 FROM og o JOIN ann_t f ON o.construct_id = f.construct_id AND o.strand = f.strand AND k IN ('polya_signal', 'polya_site') AND CASE WHEN o.strand = 1 THEN f.start - e ELSE s - f."end" END BETWEEN 0 AND 5000),
scored AS (SELECT construct_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", strand, CAST((e - s) // 3 AS INT) AS aa, CAST(sum(points) AS INT) AS score, array_to_string(list_sort(list(signal || ':' || points)), ',') AS reasons, sum(points) >= 8 AS confident FROM ev GROUP BY construct_id, s, e, strand)"""
GAPS_SQL = """gaps AS (SELECT construct_id, j, label, "end" AS start, coalesce((SELECT min(t.start) FROM ann_t t WHERE t.construct_id = p.construct_id AND t.k NOT IN ('source', 'primer_bind', 'protein_bind', 'regulatory') AND t.start >= p."end"), length) AS stop FROM ann_t p WHERE k = 'promoter' AND strand = 1 AND "end" - start >= 50 AND NOT marker)"""


def _span(start: str, end: str):
    """Positions as text, which both engines leave null alike."""
    return F.when(F.col(start).isNotNull(), F.format_string("%d-%d", start, end))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read for three kinds of evidence, so kept: without it the texts were scanned once for each.
    return evaluation.open_frames(constructs(spark, sf_dir), 1, 20, shape=True).persist(StorageLevel.DISK_ONLY)


@query("frame_scores", f"WITH {SCORES_SQL} SELECT * FROM scored")
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 20 residues and more with their evidence."""
    return placement.frame_scores(_frames(spark, sf_dir), annotated(spark, sf_dir))


@query("insertion_suggestions", f"""WITH {SCORES_SQL}, {GAPS_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY score DESC, aa DESC, start) AS rank FROM scored) x WHERE rank <= 5),
more AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY start - stop, j) AS n FROM gaps WHERE stop - start BETWEEN 20 AND 500 AND construct_id NOT IN (SELECT construct_id FROM best WHERE rank = 1 AND confident))
SELECT construct_id, CAST(rank AS INT) AS rank, 'orf' AS kind, start, "end", strand, score FROM best UNION ALL SELECT construct_id, CAST(n + coalesce((SELECT max(rank) FROM best b WHERE b.construct_id = more.construct_id), 0) AS INT), 'cloning_site', start, stop, 1, 0 FROM more""")
def insertion_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = annotated(spark, sf_dir)
    return placement.suggestions(placement.frame_scores(_frames(spark, sf_dir), marks), placement.polylinkers(marks))


_REQUESTS = "SELECT construct_id, CASE WHEN construct_id % 4 = 0 THEN 30 END AS site_start, CASE WHEN construct_id % 4 = 0 THEN 90 END AS site_end, CAST(NULL AS INT) AS site_strand, CASE WHEN construct_id % 4 = 1 THEN 'amp' END AS site_label FROM constructs WHERE length >= 300"


@query("chosen_sites", f"""WITH {SQL}, {ANNOTATED_SQL}, {GAPS_SQL}, q AS ({_REQUESTS}), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY start - stop, j) AS n FROM gaps WHERE stop - start BETWEEN 20 AND 500) x WHERE n = 1),
c AS (SELECT q.construct_id, count(*) AS n, min(f.start) AS start, min(f."end") AS stop, min(f.strand) AS strand, min(f.label) AS label FROM q JOIN ann_t f ON q.construct_id = f.construct_id AND k = 'cds' AND (site_label IS NULL OR contains(lower(f.label), site_label)) WHERE site_start IS NULL GROUP BY q.construct_id),
s AS (SELECT q.*, CASE WHEN site_start IS NOT NULL THEN 'explicit' WHEN site_label IS NULL AND w.start IS NOT NULL THEN 'cloning_site' WHEN c.n = 1 THEN 'annotated_cds' END AS source, w.start AS ws, w.stop AS we, w.label AS wl, c.n, c.start AS cs, c.stop AS ce, c.strand AS cd, c.label AS cl FROM q LEFT JOIN w USING (construct_id) LEFT JOIN c USING (construct_id))
SELECT construct_id, CASE source WHEN 'explicit' THEN site_start || '-' || site_end WHEN 'cloning_site' THEN ws || '-' || we WHEN 'annotated_cds' THEN cs || '-' || ce END AS span, CASE source WHEN 'annotated_cds' THEN cd WHEN 'explicit' THEN 1 WHEN 'cloning_site' THEN 1 ELSE 0 END AS strand,
  CASE source WHEN 'explicit' THEN 'insert' WHEN 'cloning_site' THEN 'cloning site after ' || wl WHEN 'annotated_cds' THEN cl END AS label, source, CASE WHEN source IS NOT NULL THEN NULL WHEN n > 1 THEN n || ' coding features fit' ELSE 'no coding feature fits' END AS error FROM s""")
def chosen_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the requests name an interval, a quarter a label; the rest leave the choice to the annotation."""
    rows = constructs(spark, sf_dir).where("length >= 300")
    when = lambda r, value: F.when(F.col("construct_id") % 4 == r, value)
    asked = rows.select("construct_id", when(0, 30).alias("site_start"), when(0, 90).alias("site_end"), F.lit(None).cast("int").alias("site_strand"), when(1, "amp").alias("site_label"))
    made = placement.choose_sites(asked, annotated(spark, sf_dir))
    return made.select("construct_id", _span("start", "end").alias("span"), F.coalesce("strand", F.lit(0)).alias("strand"), "label", "source", "error")


def _site(rows: DataFrame) -> DataFrame:
    """The middle third of a construct, on either strand."""
    begin = F.expr("cast(div(length, 3) as int)")
    return rows.select("construct_id", begin.alias("site_start"), (begin + F.expr("cast(3 * div(length, 9) as int)")).alias("site_end"), F.expr("case when construct_id % 3 = 0 then -1 else 1 end").alias("site_strand"), "length", "circular")


_SITE_SQL = "site AS (SELECT construct_id, CAST(length // 3 AS INT) AS a, CAST(length // 3 + 3 * (length // 9) AS INT) AS b, CASE WHEN construct_id % 3 = 0 THEN -1 ELSE 1 END AS d, length, circular FROM constructs WHERE length >= 300)"


@query("remapped_features", f"""WITH {SQL}, {ANNOTATED_SQL}, {_SITE_SQL}, r AS (SELECT f.*, a, b, d, CAST(construct_id % 40 * 3 - 60 AS INT) AS delta, construct_id % 5 = 0 AS kept, CASE WHEN construct_id % 5 = 0 THEN 0 ELSE CAST(construct_id % 40 * 3 - 60 AS INT) END AS dl FROM ann_t f JOIN (SELECT construct_id, a, b, d FROM site) s USING (construct_id)),
m AS (SELECT *, CASE WHEN "end" <= a THEN 0 WHEN start >= b AND ("end" <= length OR circular AND "end" - length <= a) THEN dl END AS shift, CASE WHEN d = 1 THEN start - a ELSE b - "end" END AS phase FROM r),
x AS (SELECT *, CASE WHEN k = 'cds' AND start = a AND "end" = b AND strand = d THEN 'replaced' WHEN k = 'source' THEN 'source' WHEN shift IS NOT NULL THEN 'kept' WHEN kept AND k IN ('cds', 'sig_peptide', 'mat_peptide', 'transit_peptide', 'propeptide') AND start >= a AND "end" <= b AND phase % 3 = 0 AND ("end" - start) % 3 = 0 THEN 'in_frame' WHEN regexp_matches(lower(label), '{"|".join(presets.RECOMBINATION)}') THEN 'recombination_lost' ELSE 'dropped' END AS fate FROM m)
SELECT construct_id, j, kind, label, CASE fate WHEN 'source' THEN '0-' || (length + dl) WHEN 'in_frame' THEN start || '-' || "end" WHEN 'kept' THEN (start + shift) || '-' || ("end" + shift) END AS span, strand, fate FROM x""")
def remapped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the sites keep their protein, and so their length; the others grow or shrink by up to 60 bases."""
    change = F.when(F.col("construct_id") % 5 == 0, 0).otherwise(F.col("construct_id") % 40 * 3 - 60)
    sites = _site(constructs(spark, sf_dir).where("length >= 300")).withColumn("insert_length", (F.col("site_end") - F.col("site_start") + change).cast("int")).withColumn("preserved", F.col("construct_id") % 5 == 0)
    made = placement.remap_features(annotated(spark, sf_dir), sites.drop("length", "circular"))
    return made.select("construct_id", "j", "kind", "label", _span("start", "end").alias("span"), "strand", "fate")


_GAP = "CASE WHEN circular THEN ((raw % length) + length) % length ELSE raw END"
_TURN = "CASE WHEN {hi} > {lo} THEN {hi} WHEN circular AND {hi} + length > {lo} THEN {hi} + length END"


def _utr_sql() -> str:
    named = "CASE WHEN k IN ('5''utr') THEN 'five' WHEN k = 'regulatory' AND regulatory_class = 'ribosome_binding_site' THEN 'rbs' WHEN k = 'promoter' AND NOT marker THEN 'promoter' WHEN k IN ('3''utr') THEN 'three' WHEN k = 'polya_signal' THEN 'polya' END"
    raw = """CASE WHEN el IN ('three', 'polya') THEN CASE WHEN d = 1 THEN f.start - b ELSE a - f."end" END ELSE CASE WHEN d = 1 THEN a - f."end" ELSE f.start - b END END"""
    pick = ", ".join(f"max(CASE WHEN el = '{e}' THEN {c} END) AS {e}_{n}" for e in placement.ELEMENTS for n, c in (("s", "fs"), ("e", "fe"), ("d", "dist")))
    p = _TURN.format(lo="(CASE WHEN d = 1 THEN promoter_e ELSE b END)", hi="(CASE WHEN d = 1 THEN a ELSE promoter_s END)")
    r = _TURN.format(lo="(CASE WHEN d = 1 THEN rbs_s ELSE b END)", hi="(CASE WHEN d = 1 THEN a ELSE rbs_e END)")
    y = _TURN.format(lo="(CASE WHEN d = 1 THEN b ELSE polya_e END)", hi="(CASE WHEN d = 1 THEN polya_s ELSE a END)")
    within = "(v0 <= rbs_s AND rbs_e <= v1 OR circular AND (v0 <= rbs_s + length AND rbs_e + length <= v1 OR v0 <= rbs_s - length AND rbs_e - length <= v1))"
    cross = ' OR '.join(f"({c}least(v1, f.\"end\" {s}) > greatest(v0, f.start {s}))" for c, s in (("", ""), ("u.circular AND ", "+ u.length"), ("u.circular AND ", "- u.length")))
    return f"""WITH {SQL}, {ANNOTATED_SQL}, {_SITE_SQL}, el AS (SELECT *, {named} AS el FROM ann_t), g AS (SELECT s.construct_id, s.length, s.circular, el, f.j AS fj, f.start AS fs, f."end" AS fe, {raw} AS raw FROM site s JOIN el f ON s.construct_id = f.construct_id AND s.d = f.strand AND el IS NOT NULL),
n AS (SELECT *, {_GAP} AS dist FROM g), t AS (SELECT *, row_number() OVER (PARTITION BY construct_id, el ORDER BY dist, fj) AS n FROM n WHERE dist >= 0 AND (NOT circular OR dist <= length // 2)), w AS (SELECT construct_id, {pick} FROM t WHERE n = 1 GROUP BY construct_id),
u0 AS (SELECT site.*, w.* EXCLUDE (construct_id) FROM site LEFT JOIN w USING (construct_id)),
u1 AS (SELECT *, CASE WHEN promoter_s IS NULL THEN NULL WHEN d = 1 THEN promoter_e ELSE b END AS p0, {p} AS p1, CASE WHEN rbs_s IS NULL THEN NULL WHEN d = 1 THEN rbs_s ELSE b END AS r0, {r} AS r1, {y} AS y1, CASE WHEN d = 1 THEN b ELSE polya_e END AS y0 FROM u0),
u2 AS (SELECT *, CASE WHEN five_s IS NOT NULL THEN 'annotated_feature' WHEN p1 - p0 <= 500 THEN 'derived_from_promoter' WHEN r1 - r0 <= 500 THEN 'derived_from_rbs' ELSE 'absent' END AS src FROM u1),
u AS (SELECT *, CASE src WHEN 'annotated_feature' THEN five_s WHEN 'derived_from_promoter' THEN p0 WHEN 'derived_from_rbs' THEN r0 END AS v0, CASE src WHEN 'annotated_feature' THEN five_e WHEN 'derived_from_promoter' THEN p1 WHEN 'derived_from_rbs' THEN r1 END AS v1,
  CASE WHEN three_s IS NOT NULL THEN three_s WHEN polya_s IS NOT NULL AND y1 IS NOT NULL THEN y0 END AS t0, CASE WHEN three_s IS NOT NULL THEN three_e WHEN polya_s IS NOT NULL THEN y1 END AS t1 FROM u2),
i AS (SELECT DISTINCT u.construct_id, true AS spliced FROM u JOIN ann_t f ON u.construct_id = f.construct_id AND k = 'intron' AND src = 'derived_from_promoter' AND ({cross}))
SELECT construct_id, 0 AS j, v0 || '-' || v1 AS five, src AS five_source, t0 || '-' || t1 AS three, rbs_s || '-' || rbs_e AS rbs, CAST(rbs_d AS VARCHAR) AS rbs_spacing,
  array_to_string(list_filter([CASE WHEN five_d > 0 THEN 'gap_behind_leader' END, CASE WHEN five_s IS NULL AND p1 - p0 > 500 THEN 'promoter_too_far' END, CASE WHEN src = 'derived_from_rbs' THEN 'leader_from_rbs' WHEN rbs_s IS NOT NULL AND v0 IS NOT NULL AND NOT {within} THEN 'rbs_outside_leader' END, CASE WHEN rbs_d > 30 THEN 'rbs_far_from_start' END, CASE WHEN v0 IS NULL THEN 'no_leader' END,
  CASE WHEN src = 'derived_from_promoter' THEN CASE WHEN rbs_s IS NOT NULL AND rbs_d <= 30 AND {within} THEN 'leader_inferred_rbs_known' ELSE 'leader_inferred' END END, CASE WHEN spliced THEN 'leader_spliced' END, CASE WHEN t0 IS NULL THEN 'no_trailer' END], lambda x: x IS NOT NULL), ',') AS notes FROM u LEFT JOIN i USING (construct_id)"""


@query("utr_contexts", _utr_sql())
def utr_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _site(constructs(spark, sf_dir).where("length >= 300"))
    targets = sites.select("construct_id", F.lit(0).alias("j"), F.col("site_start").alias("start"), F.col("site_end").alias("end"), F.col("site_strand").alias("strand"), "length", "circular")
    made = placement.utr_context(targets, annotated(spark, sf_dir))
    spans = [_span(f"{e}_start", f"{e}_end").alias(e) for e in ("five", "three", "rbs")]
    return made.select("construct_id", "j", *spans, "five_source", F.col("rbs_spacing").cast("string").alias("rbs_spacing"), "notes")


@query("repeat_regions")
def repeat_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.repeat_regions(kmers.direct_repeats(constructs(spark, sf_dir), 20))


@query("introns_inside_sites", f"""WITH {SQL}, {ANNOTATED_SQL}, {_SITE_SQL} SELECT construct_id, f.j, f.label FROM ann_t f JOIN site s USING (construct_id) WHERE k = 'intron' AND (least(b, f."end") > greatest(a, f.start) OR least(b, f."end" - s.length) > greatest(a, f.start - s.length))""")
def introns_inside_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _site(constructs(spark, sf_dir).where("length >= 300")).withColumnsRenamed({"site_start": "start", "site_end": "end"})
    return placement.introns_inside(annotated(spark, sf_dir), sites)


@query("junction_arms")
def junction_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms at both ends of an insert of the middle third."""
    rows = constructs(spark, sf_dir).where("length >= 9")
    ends = F.explode(F.array(F.struct(F.lit("5'").alias("junction"), F.expr("cast(div(length, 3) as int)").alias("at")), F.struct(F.lit("3'").alias("junction"), F.expr("cast(div(length, 3) + 3 * div(length, 9) as int)").alias("at"))))
    return survey.junction_arms(rows.withColumn("e", ends).select("construct_id", "seq", "length", "circular", "e.junction", "e.at"))


@query("insert_shared_repeats")
def insert_shared_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = constructs(spark, sf_dir)
    inserts = _site(base).select("construct_id", F.col("site_start").alias("start"), F.col("site_end").alias("end"))
    return placement.crossing_repeats(kmers.direct_repeats(base, 20), inserts)


@query("rule_set_lentiviral_human", f"""WITH {CONTEXT_SQL} SELECT construct_id, spec_id, CASE WHEN spec_id IN ('b1_five_prime', 'b2_structure_windows') THEN 'unrunnable' WHEN bool_or(gated_in) THEN 'run' ELSE 'gated_out' END AS status FROM cm WHERE host = 'human' OR modality = 'lentiviral' GROUP BY construct_id, spec_id""")
def rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of constructs for human cells or lentiviral delivery.  No folding engine is here, so its rules are reported as unrunnable."""
    return rules.rule_set(contexts(spark, sf_dir).where("host = 'human' or modality = 'lentiviral'"), by=("construct_id",))
