"""Queries over intervals, rules, vendors, scores and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, verify
from ..functions import dna, intervals
from ..operators import codons as codon_ops
from ..operators import design, evaluation, presets, rules, scoring, survey, transcript, vendors
from ..streaming.scan import event_windows
from .derived import CODING_SQL, CODONS_SQL, FEATURES_SQL, SQL, coding, constructs, features, once
from .registry import query
from .evaluate import ALL_SQL, RULES_SQL, segmented
from .sequence import _starts_sql

OVER = "greatest(0, least(a1, b1 + s) - greatest(a0, b0 + s))"


@query("interval_overlap_circular", f"""WITH {SQL}, {FEATURES_SQL}, p AS (SELECT a.construct_id, a.j AS j, b.j AS r_j, a.start AS a0, a."end" AS a1, b.start AS b0, b."end" AS b1, a.length, a.circular FROM features a JOIN features b ON a.construct_id = b.construct_id WHERE a.j < 3 AND b.j >= 3),
o AS (SELECT *, greatest({OVER.replace(' + s', '')}, CASE WHEN circular THEN {OVER.replace('+ s', '+ length')} ELSE 0 END, CASE WHEN circular THEN {OVER.replace('+ s', '- length')} ELSE 0 END) AS overlap FROM p)
SELECT construct_id, j, r_j, CAST(overlap AS INT) AS overlap FROM o WHERE overlap > 0""")  # fmt: skip
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    left = rows.where("j < 3").drop("strand")
    right = rows.where("j >= 3").select("construct_id", F.col("j").alias("r_j"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlap_join(left, right).select("construct_id", "j", "r_j", "overlap")


@query("exempt_coverage", f"""WITH {SQL}, {FEATURES_SQL}, p AS (SELECT a.construct_id, a.j AS j, a.start AS a0, a."end" AS a1, b.start AS b0, b."end" AS b1, a.length, a.circular FROM features a JOIN features b ON a.construct_id = b.construct_id WHERE a.j < 3 AND b.j >= 3),
o AS (SELECT *, greatest({OVER.replace(' + s', '')}, CASE WHEN circular THEN {OVER.replace('+ s', '+ length')} ELSE 0 END, CASE WHEN circular THEN {OVER.replace('+ s', '- length')} ELSE 0 END) AS overlap FROM p)
SELECT construct_id, j, max(overlap / (a1 - a0)) AS coverage FROM o WHERE overlap > 0 GROUP BY construct_id, j HAVING max(overlap / (a1 - a0)) >= 0.9""")  # fmt: skip
def exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    right = rows.where("j >= 3").select("construct_id", F.col("j").alias("r_j"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    found = intervals.overlap_join(rows.where("j < 3").drop("strand"), right)
    return found.groupBy("construct_id", "j").agg(F.max(F.col("overlap") / (F.col("end") - F.col("start"))).alias("coverage")).where("coverage >= 0.9")


@query("nearest_upstream_feature", f"""WITH {SQL}, {FEATURES_SQL}, p AS (SELECT a.construct_id, a.j, b.j AS feature, CASE WHEN a.strand > 0 THEN a.start - b."end" ELSE b.start - a."end" END AS raw, a.length, a.circular FROM features a JOIN features b ON a.construct_id = b.construct_id AND a.strand = b.strand WHERE a.j < 3 AND b.j >= 3),
d AS (SELECT construct_id, j, feature, CASE WHEN circular THEN ((raw % length) + length) % length ELSE raw END AS distance, length, circular FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY construct_id, j ORDER BY distance, feature) AS n FROM d WHERE distance >= 0 AND (NOT circular OR distance <= length // 2))
SELECT construct_id, j, feature, CAST(distance AS INT) AS distance FROM r WHERE n = 1""")  # fmt: skip
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return survey.nearest_upstream(rows.where("j < 3"), rows.where("j >= 3"))


@query("painted_segments", f"""WITH {SQL}, {FEATURES_SQL}, c AS (SELECT construct_id, raw % length AS pos, max(j) AS j FROM (SELECT construct_id, length, j, unnest(range(start, "end")) AS raw FROM features) x GROUP BY construct_id, raw % length), g AS (SELECT *, pos - row_number() OVER (PARTITION BY construct_id, j ORDER BY pos) AS g FROM c)
SELECT construct_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS "end", j FROM g GROUP BY construct_id, j, g""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.painted(features(spark, sf_dir))


@query("cloning_sites", f"""WITH {SQL}, {FEATURES_SQL}, r AS (SELECT *, max("end") OVER q AS reach, lead(start) OVER (PARTITION BY construct_id ORDER BY start, "end", j) AS nx FROM features WINDOW q AS (PARTITION BY construct_id ORDER BY start, "end", j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT construct_id, j, "end" AS start, nx AS "end" FROM r WHERE strand > 0 AND reach = "end" AND nx - "end" BETWEEN 20 AND 500""")
def cloning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.cloning_sites(features(spark, sf_dir))


@query("site_candidates_ranked", f"""WITH {SQL}, {_starts_sql(3, 's3', False)}, a AS (SELECT construct_id, pos FROM s3 WHERE kmer = 'ATG'), z AS (SELECT construct_id, pos FROM s3 WHERE kmer IN ('TAA', 'TAG', 'TGA')),
n AS (SELECT a.construct_id, a.pos, min(z.pos) AS stop FROM a JOIN z ON a.construct_id = z.construct_id AND z.pos > a.pos AND (z.pos - a.pos) % 3 = 0 GROUP BY a.construct_id, a.pos), o AS (SELECT construct_id, min(pos) AS start, (stop - min(pos)) // 3 AS aa FROM n GROUP BY construct_id, stop),
r AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY least(aa // 100, 6) DESC, aa DESC, start) AS rank FROM o) SELECT construct_id, CAST(start AS INT) AS start, CAST(aa AS BIGINT) AS aa, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")  # fmt: skip
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transcript.open_reading_frames(constructs(spark, sf_dir)).withColumn("aa", F.expr("cast(div(end - 3 - start, 3) as bigint)"))
    scored = found.withColumn("score", F.least(F.floor(F.col("aa") / 100), F.lit(6)))
    return survey.rank_sites(scored).select("construct_id", "start", "aa", "rank")


@query("homology_arms")
def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.homology_arms(constructs(spark, sf_dir))


RULE_VALUES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}')" for r in rules.RULES) + ") v(spec_id, enforcement))"
SLOT_VALUES = "slots AS (SELECT role, host, table_id, modality FROM (VALUES " + ", ".join(f"('{h}', {t})" for h, t in sorted(dims.HOST_TABLE.items())) + ") h(host, table_id), (VALUES " + ", ".join(f"('{r}')" for r in dims.ROLES) + ") r(role), (VALUES " + ", ".join(f"('{m}')" for m in dims.MODALITIES) + ") m(modality))"
MATRIX_SQL = f"""{RULE_VALUES}, {SLOT_VALUES}, matrix AS (SELECT role, host, modality, table_id, spec_id, enforcement,
  CASE WHEN spec_id IN ('b1_five_prime', 'b2_structure_windows') THEN modality = 'bacterial_expression' WHEN spec_id IN ('b8_kozak', 'b9_out_of_frame_atg') THEN host NOT LIKE 'e_coli%' AND role <> 'propagation' WHEN spec_id IN ('c1_cai', 'c3_min_max') THEN role <> 'propagation'
       WHEN spec_id = 'd3_splicing' THEN modality NOT IN ('bacterial_expression', 'ivt_mrna') AND host NOT IN ('e_coli_k12', 'e_coli_bl21', 's_cerevisiae', 'p_pastoris') WHEN spec_id = 'd4_internal_polya' THEN modality NOT IN ('bacterial_expression', 'ivt_mrna')
       WHEN spec_id IN ('d6_non_b_dna', 'e2_gc_band') THEN modality <> 'ivt_mrna' ELSE true END AS gated_in,
  CASE WHEN spec_id = 'd3_splicing' AND modality IN ('lentiviral', 'genome_integrated') THEN 'HARD_REPAIR' WHEN spec_id = 'd4_internal_polya' AND modality IN ('lentiviral', 'aav', 'genome_integrated') THEN 'HARD_REPAIR'
       WHEN spec_id = 'd6_non_b_dna' AND modality = 'bacterial_expression' THEN 'HARD_REPAIR' WHEN spec_id = 'd5_cryptic_transcription' THEN 'HARD_REPAIR' ELSE enforcement END AS slot_enforcement FROM rules, slots)"""


#: Every construct's context: its host and delivery by id, in each role.
CONTEXT_SQL = f"""{SQL}, {MATRIX_SQL}, hosts AS (SELECT list_sort(list(DISTINCT host)) AS h FROM slots), k AS (SELECT construct_id, h[construct_id % {len(dims.HOST_TABLE)} + 1] AS host, {list(dims.MODALITIES)}[construct_id % {len(dims.MODALITIES)} + 1] AS modality FROM constructs, hosts),
cm AS (SELECT k.construct_id, m.* FROM k JOIN matrix m ON k.host = m.host AND k.modality = m.modality)"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``construct_id, role, host, modality, table_id``: three slots a construct."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("construct_id") % n + 1).cast("int"))
    hosts = sorted(dims.HOST_TABLE)
    rows = constructs(spark, sf_dir).select("construct_id", pick(hosts, len(hosts)).alias("host"), pick(dims.MODALITIES, len(dims.MODALITIES)).alias("modality"))
    table = F.element_at(F.create_map(*[F.lit(x) for pair in dims.HOST_TABLE.items() for x in pair]), F.col("host"))
    return rows.select("construct_id", F.explode(F.array(*map(F.lit, dims.ROLES))).alias("role"), "host", "modality", table.alias("table_id"))


@query("rule_gate_matrix", f"WITH {CONTEXT_SQL} SELECT * FROM cm")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.gate_matrix(contexts(spark, sf_dir))


@query("effective_enforcement", f"""WITH {CONTEXT_SQL}, v AS (SELECT *, CASE slot_enforcement WHEN 'SOFT' THEN 0 WHEN 'HARD_CHECK' THEN 1 WHEN 'HARD_REPAIR' THEN 2 ELSE 3 END AS sev FROM cm WHERE gated_in)
SELECT construct_id, spec_id, arg_max(slot_enforcement, sev) AS enforcement FROM v GROUP BY construct_id, spec_id""")
def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.effective_enforcement(rules.gate_matrix(contexts(spark, sf_dir)), ("construct_id",))


@query("scored_objectives", f"""WITH {CONTEXT_SQL} SELECT construct_id, spec_id FROM cm GROUP BY construct_id, spec_id, enforcement HAVING enforcement = 'SOFT' AND NOT bool_or(gated_in AND slot_enforcement <> 'SOFT')""")
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scored_objectives(rules.gate_matrix(contexts(spark, sf_dir)), ("construct_id",))


def _breaches(spark: SparkSession, sf_dir: str, **carried: bool) -> DataFrame:
    """Breaches of all rules of one pass, with the side of the GC band that mending them pushes to."""
    side = F.when(F.col("spec_id") == "d4_internal_polya", "at").when(F.col("spec_id") == "d8_cpg_depletion", "gc").otherwise("")
    return evaluation.breaches(segmented(spark, sf_dir), **carried).withColumn("side", side)


BREACH_SQL = f"""{RULES_SQL}, breaches AS (SELECT construct_id, spec_id, start, stop, magnitude, fixable, CASE WHEN spec_id = 'd4_internal_polya' THEN 'at' WHEN spec_id = 'd8_cpg_depletion' THEN 'gc' ELSE '' END AS side FROM ({ALL_SQL}) x)"""


@query("rule_evaluations", f"WITH {BREACH_SQL} SELECT construct_id, spec_id, count(*) AS n, round(sum(magnitude), 6) AS magnitude, max(magnitude) AS worst FROM breaches GROUP BY construct_id, spec_id")
def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_breaches(spark, sf_dir)).withColumn("magnitude", F.round("magnitude", 6))


@query("routed_findings", f"""WITH {BREACH_SQL}, {MATRIX_SQL}, k AS (SELECT *, CASE slot_enforcement WHEN 'SOFT' THEN 0 WHEN 'HARD_CHECK' THEN 1 WHEN 'HARD_REPAIR' THEN 2 ELSE 3 END AS sev FROM matrix WHERE gated_in AND host = 'human' AND modality = 'plasmid_transient'),
e AS (SELECT spec_id, arg_max(slot_enforcement, sev) AS enforcement FROM k GROUP BY spec_id), f AS (SELECT construct_id, spec_id FROM breaches GROUP BY ALL HAVING max(magnitude) >= CASE WHEN spec_id = 'd3_splicing' THEN 3.0 ELSE 1.0 END)
SELECT b.spec_id, e.enforcement, CASE WHEN e.enforcement = 'SOFT' THEN 'score' WHEN fixable THEN 'repair' ELSE 'advise' END AS route, count(*) AS n FROM breaches b JOIN f USING (construct_id, spec_id) JOIN e ON b.spec_id = e.spec_id GROUP BY ALL""")  # fmt: skip
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = rules.slots(spark).where("host = 'human' and modality = 'plasmid_transient'")
    enforcement = rules.effective_enforcement(rules.gate_matrix(context))
    return rules.findings(_breaches(spark, sf_dir, worst=True), enforcement).groupBy("spec_id", "enforcement", "route").agg(F.count(F.lit(1)).alias("n"))


def islands_sql(table: str) -> str:
    """Islands of ``table(construct_id, start, stop, length, circular)`` by painting: base p is 2p, the link to the next 2p + 1.

    Gives ``isl(construct_id, lo, hi, home, s, e)``: a painted run, the run it belongs to round the origin, and the whole island.
    """
    return f"""pt AS (SELECT DISTINCT construct_id, length, circular, CASE WHEN circular THEN x % (2 * length) ELSE x END AS p FROM (SELECT construct_id, length, circular, unnest(range(2 * start, 2 * stop - 1)) AS x FROM {table}) z),
pr AS (SELECT construct_id, length, circular, g, min(p) AS lo, max(p) AS hi FROM (SELECT *, p - row_number() OVER (PARTITION BY construct_id ORDER BY p) AS g FROM pt) z GROUP BY ALL),
pw AS (SELECT *, circular AND min(lo) OVER w = 0 AND max(hi) OVER w = 2 * length - 1 AS joins, arg_min(hi, lo) OVER w AS hi0, max(lo) OVER w AS lo9 FROM pr WINDOW w AS (PARTITION BY construct_id)),
isl AS (SELECT construct_id, lo, hi, CASE WHEN joins AND lo = 0 THEN lo9 ELSE lo END AS home, CASE WHEN joins AND lo = 0 THEN lo9 ELSE lo END // 2 AS s, CASE WHEN joins AND lo9 > 0 AND lo IN (0, lo9) THEN length + hi0 // 2 + 1 ELSE hi // 2 + 1 END AS e FROM pw)"""


@query("feature_islands", f"""WITH {SQL}, {FEATURES_SQL}, ft AS (SELECT *, "end" AS stop FROM features), {islands_sql('ft')}
SELECT f.construct_id, f.j, CAST(s AS INT) AS island_start, CAST(e AS INT) AS island_end FROM ft f JOIN isl i ON f.construct_id = i.construct_id AND 2 * f.start BETWEEN lo AND hi""")
def feature_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that share bases, merged round the origin of circles."""
    made = intervals.islands(features(spark, sf_dir), *map(F.col, ("start", "end", "length", "circular")))
    return made.select("construct_id", "j", "island_start", "island_end")


_HARD = ", ".join(f"'{r[0]}'" for r in rules.RULES if r[1] != "SOFT")
EFFECTIVE_SQL = f"""{CONTEXT_SQL.replace(SQL + ", ", "", 1)}, ee AS (SELECT construct_id, spec_id, arg_max(slot_enforcement, CASE slot_enforcement WHEN 'SOFT' THEN 0 WHEN 'HARD_CHECK' THEN 1 WHEN 'HARD_REPAIR' THEN 2 ELSE 3 END) AS enforcement FROM cm WHERE gated_in GROUP BY construct_id, spec_id)"""


@query("conflict_groups", f"""WITH {BREACH_SQL}, {EFFECTIVE_SQL}, bb AS (SELECT b.*, length, circular, coalesce(e.enforcement <> 'SOFT', b.spec_id IN ({_HARD})) AS hard FROM breaches b JOIN constructs USING (construct_id) LEFT JOIN ee e ON b.construct_id = e.construct_id AND b.spec_id = e.spec_id),
{islands_sql('bb')}, a AS (SELECT b.construct_id, home, any_value(s) AS s, any_value(e) AS e, list_sort(list(DISTINCT spec_id)) AS rules, min(CAST(fixable AS INT)) AS fix, count(DISTINCT side) FILTER (side <> '') AS sides, count(DISTINCT hard) AS levels, min(row(NOT hard, -magnitude, start, stop, spec_id)) AS top
  FROM bb b JOIN isl i ON b.construct_id = i.construct_id AND 2 * CASE WHEN circular THEN start % length ELSE start END BETWEEN lo AND hi GROUP BY b.construct_id, home)
SELECT construct_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", array_to_string(rules, ',') AS rules, CASE WHEN fix = 0 THEN 'immutable_region' WHEN sides > 1 THEN 'opposing_gradient' ELSE 'mutually_exclusive' END AS kind, top[5] AS binding, levels = 2 AS hard_versus_soft FROM a WHERE len(rules) >= 2""")  # fmt: skip
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping breaches round the origin of circles; what binds is hard in the construct's own context."""
    enforcement = rules.effective_enforcement(rules.gate_matrix(contexts(spark, sf_dir)), ("construct_id",))
    return rules.conflicts(_breaches(spark, sf_dir, shape=True), enforcement)


PAIR = ["idt_gblocks", "twist_gene_fragment"]


@query("vendor_length_verdicts", f"""WITH {SQL}, v AS (SELECT construct_id, length, length BETWEEN 125 AND 3000 AS a, length BETWEEN 300 AND 5000 AS b FROM constructs)
SELECT construct_id, length, CASE WHEN a AND b THEN 'idt_gblocks,twist_gene_fragment' WHEN a THEN 'idt_gblocks' WHEN b THEN 'twist_gene_fragment' ELSE '' END AS accepting, CASE WHEN a AND b THEN 'accept' WHEN a OR b THEN 'ambiguous' ELSE 'refuse' END AS verdict FROM v""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.length_verdicts(constructs(spark, sf_dir), PAIR)


VENDOR_SQL = "vendors AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in v) + ")" for v in dims.VENDORS) + ") v(key, len_lo, len_hi, homopolymer_at, homopolymer_gc, gc_lo, gc_hi, five, three))"


@query("rule_null_sizes", f"""WITH {CONTEXT_SQL}, c(spec_id, cost) AS (VALUES {", ".join(f"('{r[0]}', '{r[8]}')" for r in rules.RULES)}) SELECT construct_id, spec_id, CASE cost WHEN 'cheap' THEN 200 WHEN 'moderate' THEN 40 ELSE 0 END AS variants FROM cm JOIN c USING (spec_id) WHERE role = 'target' AND gated_in""")
def null_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that each rule of a construct's target slot is compared with."""
    rows = rules.gate_matrix(contexts(spark, sf_dir)).where("role = 'target' and gated_in").select("construct_id", "spec_id")
    return rows.join(F.broadcast(rules.rules(spark)), "spec_id").select("construct_id", "spec_id", rules.null_size().alias("variants"))


@query("vendor_envelope", f"""WITH {SQL}, {VENDOR_SQL}, p AS (SELECT construct_id, v.* FROM constructs JOIN vendors v ON length BETWEEN len_lo AND len_hi), t AS (SELECT construct_id, min(homopolymer_at) AS a, min(homopolymer_gc) AS gc, max(gc_lo) AS lo, min(gc_hi) AS hi FROM p GROUP BY construct_id)
SELECT t.construct_id, a AS "at", gc, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, (SELECT string_agg(key, ',' ORDER BY key) FROM p WHERE p.construct_id = t.construct_id AND homopolymer_at = a) AS at_binders, (SELECT string_agg(key, ',' ORDER BY key) FROM p WHERE p.construct_id = t.construct_id AND gc_hi = hi) AS hi_binders FROM t""")
def vendor_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of all vendors that take a construct's length."""
    takes = F.col("length").between(F.col("len_lo"), F.col("len_hi"))
    profiles = constructs(spark, sf_dir).select("construct_id", "length").join(F.broadcast(dims.vendor_table(spark)), takes)
    return vendors.envelope(profiles, ("construct_id",))


@query("vendor_gc_breaches", f"""WITH {SQL}, g AS (SELECT construct_id, (length - length(replace(replace(seq, 'G', ''), 'C', ''))) / length AS gc FROM constructs WHERE length > 0)
SELECT construct_id, gc, greatest(0.28 - gc, gc - 0.77, 0.0) AS deviation FROM g WHERE greatest(0.28 - gc, gc - 0.77, 0.0) > 0""")
def vendor_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.gc_breaches(constructs(spark, sf_dir), PAIR)


@query("plate_wells", """WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
SELECT source, doc_id, CAST(n // 96 AS INT) AS plate, substring('ABCDEFGH', CAST((n % 96) // 12 + 1 AS INT), 1) || CAST(n % 12 + 1 AS VARCHAR) AS well FROM o""")
def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    return vendors.wells(docs, "source", ["doc_id"]).select("source", "doc_id", "plate", "well")


@query("design_hashes", f"""WITH {SQL}, {CODING_SQL} SELECT construct_id, substring(sha256('{{"cds":"' || upper(cds) || '","context":{{}}}}'), 1, 12) AS hash, 'design_' || CAST(construct_id AS VARCHAR) AS label FROM coding""")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding(spark, sf_dir).select("construct_id", vendors.design_hash(F.col("cds")).alias("hash"), dna.tube_label(F.lit("design"), F.col("construct_id").cast("string")).alias("label"))


UNIFORM_SQL = "((construct_id * 7919 + variant * 104729 + i * 1299709) % 1000003) / 1000003.0"


def _uniform():
    return F.expr("((construct_id * 7919 + variant * 104729 + cast(i as bigint) * 1299709) % 1000003) / 1000003.0d")


_SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', [{', '.join(repr(o) for o in (dims.synonyms(1)[a] if a != '*' else [c]))}])" for c, a in sorted(dims.genetic_code(1).items())) + ") v(codon, options))"
NULL_SQL = f"""{SQL}, {CODING_SQL}, {CODONS_SQL}, {_SYN}, d AS (SELECT construct_id, variant, i, codon FROM codons, (SELECT unnest(range(0, 5)) AS variant) v),
p AS (SELECT construct_id, variant, i, options[CAST(floor({UNIFORM_SQL} * len(options)) AS INT) + 1] AS pick FROM d JOIN syn USING (codon)),
nulls AS (SELECT construct_id, variant, sum(3 - length(replace(replace(pick, 'G', ''), 'C', ''))) / (3 * count(*)) AS value FROM p GROUP BY construct_id, variant)"""


@query("percentile_vs_null", f"""WITH {NULL_SQL.replace('range(0, 5)', 'range(0, 200)')}, s AS (SELECT construct_id, (length(cds) - length(replace(replace(cds, 'G', ''), 'C', ''))) / length(cds) AS raw FROM coding),
j AS (SELECT construct_id, raw, value, greatest(0.45 - raw, raw - 0.55, 0) AS x, greatest(0.45 - value, value - 0.55, 0) AS y FROM nulls JOIN s USING (construct_id))
SELECT construct_id, raw, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, sum(CASE WHEN y > x THEN 1.0 WHEN y = x THEN 0.5 ELSE 0.0 END) / count(*) AS percentile FROM j GROUP BY construct_id, raw""")  # fmt: skip
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cds = coding(spark, sf_dir)
    gc = {c: float(sum(b in "GC" for b in c)) for c in dims.CODONS}
    scores = cds.withColumn("raw", dna.gc_fraction(F.col("cds")))
    out = scoring.additive_percentile(scores, rules.NULL_SIZES["cheap"], 1, gc, "BAND", (0.45, 0.55))
    return out.withColumn("mean", F.round("mean", 9)).withColumn("sd", F.round("sd", 9))


SCORES_SQL = f"""{SQL}, q AS (SELECT construct_id AS candidate, construct_id % 97 AS panel, CASE WHEN length >= 50 THEN (length - length(replace(seq, 'G', ''))) / length END AS p1, CASE WHEN length >= 150 THEN (length - length(replace(seq, 'C', ''))) / length END AS p2, CASE WHEN length > 0 THEN (length - length(replace(seq, 'A', ''))) / length END AS p3 FROM constructs),
scores AS (SELECT panel, candidate, 'f1' AS spec_id, p1 AS percentile, 0.5 AS weight FROM q UNION ALL SELECT panel, candidate, 'f2', p2, 1.0 FROM q UNION ALL SELECT panel, candidate, 'f3', p3, 0.25 FROM q)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constructs(spark, sf_dir)
    share = lambda b, least: F.when(F.col("length") >= least, dna.count_of(F.col("seq"), b) / F.col("length"))
    items = F.array(*[F.struct(F.lit(s).alias("spec_id"), share(b, n).alias("percentile"), F.lit(w).alias("weight")) for s, b, n, w in (("f1", "G", 50, 0.5), ("f2", "C", 150, 1.0), ("f3", "A", 1, 0.25))])
    return rows.select((F.col("construct_id") % 97).alias("panel"), F.col("construct_id").alias("candidate"), F.explode(items).alias("s")).select("panel", "candidate", "s.*")


@query("weighted_total", f"WITH {SCORES_SQL} SELECT candidate, round(coalesce(sum(percentile * weight) / sum(CASE WHEN percentile IS NOT NULL THEN weight END), 0.0), 9) AS total FROM scores GROUP BY candidate")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weighted_totals(_scores(spark, sf_dir)).withColumn("total", F.round("total", 9))


@query("comparable_totals", f"""WITH {SCORES_SQL}, n AS (SELECT panel, count(DISTINCT candidate) AS n FROM scores GROUP BY panel), k AS (SELECT panel, spec_id, count(DISTINCT candidate) AS k FROM scores WHERE percentile IS NOT NULL GROUP BY panel, spec_id), c AS (SELECT panel, spec_id FROM n JOIN k USING (panel) WHERE n = k)
SELECT candidate, round(sum(percentile * weight) / sum(weight), 9) AS total FROM scores JOIN c USING (panel, spec_id) GROUP BY candidate""")
def comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.comparable_totals(_scores(spark, sf_dir)).withColumn("total", F.round("total", 9))


@query("simplex_weights", f"""WITH {SQL}, p AS (SELECT a, b, 4 - a - b AS c, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS point FROM (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b) WHERE a + b <= 4),
f AS (SELECT construct_id, (length - length(replace(seq, 'G', ''))) / length AS g, (length - length(replace(seq, 'C', ''))) / length AS cc, (length - length(replace(seq, 'A', ''))) / length AS aa FROM constructs WHERE length > 0)
SELECT construct_id, point, round((a * g + b * cc + c * aa) / 4, 9) AS total FROM f, p""")
def simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three bases of every construct, summed with each weighting of the lattice (15 points, broadcast)."""
    points = scoring.simplex(spark, ["G", "C", "A"], 4)
    share = lambda b: (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))) / F.length("seq")
    parts = F.explode(F.create_map(*[x for b in "GCA" for x in (F.lit(b), share(b))])).alias("axis", "value")
    rows = constructs(spark, sf_dir).where("length > 0").select("construct_id", parts)
    return rows.join(F.broadcast(points), "axis").groupBy("construct_id", "point").agg(F.round(F.sum(F.col("weight") * F.col("value")), 9).alias("total"))


@query("synonymous_variants", f"WITH {NULL_SQL} SELECT construct_id, CAST(variant AS INT) AS variant, string_agg(pick, '' ORDER BY i) AS cds FROM p GROUP BY construct_id, variant")
def synonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.variants(coding(spark, sf_dir), 5, 1, _uniform())


@query("greedy_max_min")
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = scoring.variants(coding(spark, sf_dir), 6, 1)
    return scoring.gallery(sweep.select(F.col("construct_id").alias("panel"), F.col("variant").cast("long").alias("candidate"), "cds")).select("panel", "pick", "candidate", F.length("cds").alias("bases"))


_BY_AA = "bounds AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {min(c[b] in 'GC' for c in o):d}, {max(c[b] in 'GC' for c in o):d})" for a, o in sorted(dims.synonyms(1).items()) for b in range(3)) + ") v(aa, b, lo, hi))"
PROTEIN_SQL = "proteins AS (SELECT doc_id AS construct_id, 'M' || regexp_replace(translate(text, 'acdefghiklmnpqrstvwy', 'ACDEFGHIKLMNPQRSTVWY'), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS protein FROM documents WHERE text IS NOT NULL)"


@query("gc_envelope", f"""WITH {PROTEIN_SQL}, {_BY_AA}, r AS (SELECT construct_id, i, substring(protein, CAST(i + 1 AS INT), 1) AS aa FROM (SELECT construct_id, protein, unnest(range(0, length(protein))) AS i FROM proteins) x), a AS (SELECT construct_id, i * 3 + b AS pos, lo, hi FROM r JOIN bounds USING (aa)),
w AS (SELECT construct_id, pos, sum(lo) OVER q AS lo, sum(hi) OVER q AS hi, count(*) OVER q AS n FROM a WINDOW q AS (PARTITION BY construct_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))
SELECT construct_id, count(*) AS windows, max(lo) / 50 AS highest_least, min(hi) / 50 AS lowest_most FROM w WHERE n = 50 GROUP BY construct_id""")  # fmt: skip
def gc_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon_ops.gc_reach(proteins(spark, sf_dir), 1)


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.select(F.col("doc_id").alias("construct_id"), once(dna.derive_protein(F.col("text"))).alias("protein"))


@query("verify_invariants", f"""WITH {SQL}, c AS (SELECT construct_id, seq, circular, substring(seq, 31, 3 * ((length - 30) // 3)) AS cds FROM constructs WHERE length >= 300), a AS (SELECT *, CASE WHEN circular THEN seq || substring(seq, 1, 5) ELSE seq END AS around FROM c)
SELECT construct_id, substring(cds, 1, 3) IN ('TTG', 'CTG', 'ATG') AS i4, NOT (contains(around, 'GAATTC') OR contains(around, 'GATC')) AS i6, (length(cds) - length(replace(replace(cds, 'G', ''), 'C', ''))) / length(cds) BETWEEN 0.35 AND 0.65 AS i7, NOT regexp_matches(around, 'A{{7,}}|C{{7,}}|G{{7,}}|T{{7,}}') AS i8 FROM a""")
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constructs(spark, sf_dir).where("length >= 300").withColumn("cds_start", F.lit(30)).withColumn("cds_end", F.expr("30 + 3 * cast(div(length - 30, 3) as int)")).withColumn("protein", F.lit(None).cast("string"))
    return verify.checks(rows, 1, ["GAATTC", "GATC"], (0.35, 0.65), 6).select("construct_id", "i4", "i6", "i7", "i8")


@query("lattice_designs")
def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's protein solved at every sweep corner; screening was not run here, and says so."""
    requests = proteins(spark, sf_dir).select(F.col("construct_id").alias("design_id"), "protein", F.lit("not_run").alias("screen"))
    made = design.solve(requests, 1, list(dims.SIX_CUTTERS.values()))
    return made.select("design_id", "lean", F.length("cds").alias("bases"), F.round(dna.gc_fraction(F.col("cds")), 6).alias("gc"), "status", "screen", "degradations")


@query("event_windows", """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def windows_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_windows(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("preset_weights", f"""WITH {CONTEXT_SQL}, presets AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{m}', '{r}', {w})" for p, m, r, w in presets.PRESETS)}) v(preset_id, modality, spec_id, weight))
SELECT construct_id, role, preset_id, spec_id, CAST(weight AS DOUBLE) AS weight, CASE WHEN slot_enforcement <> 'SOFT' THEN 'hard' ELSE 'weighted' END AS status FROM cm JOIN presets USING (modality, spec_id)""")
def preset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets of each construct's delivery, resolved in its slots."""
    made = presets.resolve_slots(presets.preset_table(spark), rules.gate_matrix(contexts(spark, sf_dir)))
    return made.select("construct_id", "role", "preset_id", "spec_id", "weight", "status")


@query("score_report")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("candidate", "spec_id", F.col("percentile").alias("raw"), "percentile", F.lit(5).alias("n"), F.when(F.col("percentile").isNull(), "sequence too short").alias("reason"))
    return presets.report(rows)
