"""Queries over constructs with segments: projections, rule breaches, frames, arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna, intervals
from ..operators import evaluation, survey, transcript, windows
from .derived import FEATURES_SQL, SQL, constructs, features
from .registry import query
from .sequence import _gc_sql, _starts_sql

#: A coding segment from a quarter of a construct on, and from 200 bases an exempt first tenth.
SEGMENT_SQL = f"""{SQL}, seg AS (SELECT construct_id, seq, length, circular, length // 4 AS cs, length // 4 + 3 * (length // 6) AS ce, 0 AS xs, CASE WHEN length >= 200 THEN length // 10 ELSE 0 END AS xe FROM constructs)"""


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``construct_id, seq, length, circular, segments``."""
    rows = constructs(spark, sf_dir)
    part = lambda a, b, kind, when: F.when(when, F.struct(F.expr(a).cast("int").alias("start"), F.expr(b).cast("int").alias("end"), F.lit(kind).alias("kind")))
    cds = part("div(length, 4)", "div(length, 4) + 3 * div(length, 6)", evaluation.DESIGNABLE, F.col("length") >= 6)
    free = part("0", "div(length, 10)", evaluation.REPEAT, F.col("length") >= 200)
    return rows.withColumn("segments", F.array_compact(F.array(cds, free)))


def _touch(s: str, e: str, a: str = "cs", b: str = "ce") -> str:
    """Bases shared by [s, e) and [a, b), round the origin of circles."""
    shift = lambda x: f"least({e}, {b} {x}) - greatest({s}, {a} {x})"
    return f"greatest(0, {shift('')}, CASE WHEN circular THEN {shift('+ length')} ELSE 0 END, CASE WHEN circular THEN {shift('- length')} ELSE 0 END)"


def _fix(s: str, e: str) -> str:
    return f"(ce > cs AND {_touch(s, e)} > 0)"


def _d1_sql() -> str:
    hits = []
    for name, motif in sorted(dims.SIX_CUTTERS.items()):
        k = len(motif)
        for m in dict.fromkeys((motif, dna.complement_text(motif))):
            hits.append(f"SELECT construct_id, '{name}' AS kind, pos AS start, pos + {k} AS stop FROM s{k} WHERE kmer = '{m}'")
    return "d1 AS (SELECT h.construct_id, 'd1_restriction_sites' AS spec_id, kind, start, stop, 1 AS strand, 1.0 AS magnitude, " + _fix("start", "stop") + " AS fixable FROM (" + " UNION ALL ".join(hits) + ") h JOIN seg USING (construct_id))"


_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_HEX = ", ".join(f"'{x}'" for x in (*transcript.POLYA, *transcript.POLYA_VARIANTS))
D4_SQL = f"""d4t AS (SELECT construct_id, length, circular, cs, ce, CASE WHEN circular THEN seq || substring(seq, 1, 40) ELSE seq END AS hay FROM seg),
d4p AS (SELECT construct_id, length, circular, cs, ce, hay, unnest(range(0, length)) AS pos FROM d4t), d4h AS (SELECT *, substring(hay, pos + 1, 6) AS hexamer FROM d4p WHERE substring(hay, pos + 1, 6) IN ({_HEX})),
d4w AS (SELECT *, substring(hay, pos + 17, 30) AS tail FROM d4h),
d4 AS (SELECT construct_id, 'd4_internal_polya' AS spec_id, hexamer AS kind, pos AS start, pos + 6 AS stop, 1 AS strand, CASE WHEN hexamer NOT IN ('AATAAA', 'ATTAAA') THEN 0.2 WHEN regexp_matches(tail, 'GTGT|TGTG') OR list_contains(list_transform(range(1, greatest(1, length(tail) - 4)), lambda i: length(regexp_replace(substring(tail, i, 6), '[^T]', '', 'g')) >= 4), true) THEN 3.0 ELSE 1.0 END AS magnitude, {_fix('pos', 'pos + 6')} AS fixable FROM d4w)"""
E1_SQL = f"""e1n AS (SELECT *, CASE WHEN kmer = lag(kmer) OVER (PARTITION BY construct_id ORDER BY pos) THEN 0 ELSE 1 END AS nw FROM l1), e1g AS (SELECT *, sum(nw) OVER (PARTITION BY construct_id ORDER BY pos) AS grp FROM e1n),
e1r AS (SELECT construct_id, length, circular, kmer AS base, min(pos) AS start, count(*) AS run FROM e1g GROUP BY construct_id, length, circular, grp, kmer),
e1w AS (SELECT *, count(*) OVER q AS runs, first_value(base) OVER o AS b0, first_value(run) OVER o AS r0, last_value(base) OVER o AS b9 FROM e1r WINDOW q AS (PARTITION BY construct_id), o AS (PARTITION BY construct_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e1j AS (SELECT construct_id, base, start, CASE WHEN circular AND runs > 1 AND b0 = b9 AND start + run = length THEN run + r0 ELSE run END AS run FROM e1w WHERE NOT (circular AND runs > 1 AND b0 = b9 AND start = 0)),
e1l AS (SELECT *, CASE WHEN base IN ('A', 'T') THEN 9 ELSE 5 END AS lim FROM e1j),
e1 AS (SELECT construct_id, 'e1_homopolymers' AS spec_id, base AS kind, start, start + run AS stop, 1 AS strand, CAST(run - lim AS DOUBLE) AS magnitude, {_fix('start', 'start + run')} AS fixable FROM e1l JOIN seg USING (construct_id) WHERE run > lim)"""
_RICH = "list_contains(list_transform(range(1, greatest(1, length(tract) - 8)), lambda i: length(regexp_replace(substring(tract, i, 10), '[^CT]', '', 'g')) >= 8), true)"
D3_SQL = f"""d3t AS (SELECT construct_id, length, circular, cs, ce, CASE WHEN circular THEN repeat(seq, 3) ELSE seq END AS hay, CASE WHEN circular THEN length ELSE 0 END AS o FROM seg WHERE length > 0),
d3p AS (SELECT *, unnest(range(0, length)) AS pos FROM d3t), d3s AS (SELECT * FROM d3p WHERE substring(hay, o + pos + 1, 2) IN ('GT', 'AG')),
d3g AS (SELECT *, substring(hay, o + pos, 6) AS six, substring(hay, o + pos - 1, 7) AS seven FROM d3s WHERE substring(hay, o + pos + 1, 2) = 'GT' AND o + pos >= 3 AND o + pos + 6 <= length(hay)),
d3d AS (SELECT construct_id, 'donor' AS kind, ((pos - 3) % length + length) % length AS start, 9 AS size, CASE WHEN six IN ('GGTAAG', 'GGTGAG') THEN 3.0 WHEN regexp_full_match(seven, 'A[ACGT]GT[AG]AG') THEN 1.0 ELSE 0.0 END AS magnitude, length, circular, cs, ce FROM d3g),
d3c AS (SELECT *, substring(hay, greatest(0, o + pos - 40) + 1, greatest(0, o + pos - 5) - greatest(0, o + pos - 40)) AS tract, substring(hay, greatest(0, o + pos - 40) + 1, greatest(0, o + pos - 18) - greatest(0, o + pos - 40)) AS up FROM d3s WHERE substring(hay, o + pos + 1, 2) = 'AG'),
d3a AS (SELECT construct_id, 'acceptor' AS kind, pos AS start, 2 AS size, 1.0 AS magnitude, length, circular, cs, ce FROM d3c WHERE regexp_matches(up, '[CT]T[ACGT]A[CT]') AND {_RICH}),
d3 AS (SELECT construct_id, 'd3_splicing' AS spec_id, kind, start, start + size AS stop, 1 AS strand, magnitude, {_fix('start', 'start + size')} AS fixable FROM (SELECT * FROM d3d UNION ALL SELECT * FROM d3a) x WHERE magnitude > 0)"""
D8_SQL = f"""d8c AS (SELECT construct_id, length, circular, cs, ce, s, substring(hay, s + 1, 200) AS chunk FROM (SELECT *, unnest(range(0, CASE WHEN circular THEN length ELSE length - 199 END, 40)) AS s FROM (SELECT construct_id, length, circular, cs, ce, CASE WHEN circular THEN repeat(seq, 3) ELSE seq END AS hay FROM seg WHERE length >= 200) h) x),
d8n AS (SELECT *, 200 - length(replace(chunk, 'C', '')) AS c, 200 - length(replace(chunk, 'G', '')) AS g, (200 - length(replace(chunk, 'CG', ''))) // 2 AS cg FROM d8c), d8r AS (SELECT *, CASE WHEN c * g > 0 THEN cg * 200 / (c * g) ELSE 0.0 END AS ratio FROM d8n),
d8b AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY ratio DESC, s) AS rn FROM d8r WHERE (c + g) / 200 >= 0.5 AND ratio >= 0.6),
d8 AS (SELECT construct_id, 'd8_cpg_depletion' AS spec_id, 'gardiner_garden' AS kind, s AS start, s + 200 AS stop, 1 AS strand, 1.0 AS magnitude, {_fix('s', 's + 200')} AS fixable FROM d8b WHERE rn = 1)"""
FRAGMENT_SQL = "frag AS (SELECT construct_id, length, circular, cs, ce, substring(seq, cs + 1, ce - cs) AS text, ce - cs AS m FROM seg WHERE ce > cs)"
E6_SQL = f"""{FRAGMENT_SQL}, e6k AS (SELECT construct_id, p, substring(text, p + 1, 9) AS kmer FROM (SELECT construct_id, text, unnest(range(0, m - 8)) AS p FROM frag WHERE m >= 9) x), e6f AS (SELECT construct_id, p, CAST(count(*) OVER (PARTITION BY construct_id, kmer) >= 2 AS INT) AS f FROM e6k),
e6s AS (SELECT construct_id, m, s, least(s + 92, m - 8) AS t FROM (SELECT construct_id, m, unnest(range(0, greatest(1, m - 8 - 92 + 1), 20)) AS s FROM frag WHERE m >= 9) x),
e6w AS (SELECT e6s.construct_id, s, least(s + 100, m) AS e, sum(f) / count(*) AS share FROM e6s JOIN e6f ON e6s.construct_id = e6f.construct_id AND p >= s AND p < t GROUP BY e6s.construct_id, s, m),
e6m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY construct_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM e6w WHERE share >= 0.25), e6g AS (SELECT *, sum(nw) OVER (PARTITION BY construct_id ORDER BY s) AS grp FROM e6m),
e6 AS (SELECT construct_id, 'e6_repeat_density' AS spec_id, 'repetitive' AS kind, min(s) + any_value(cs) AS start, max(e) + any_value(cs) AS stop, 1 AS strand, max(share) AS magnitude, true AS fixable FROM e6g JOIN seg USING (construct_id) GROUP BY construct_id, grp)"""
E7_SQL = f"""e7p AS (SELECT construct_id, text, m, u, unnest(range(0, m - u)) AS p FROM frag, (SELECT unnest(range(1, 7)) AS u) us WHERE m > u), e7s AS (SELECT construct_id, u, p, p - row_number() OVER (PARTITION BY construct_id, u ORDER BY p) AS grp FROM e7p WHERE substring(text, p + 1, 1) = substring(text, p + u + 1, 1)),
e7r AS (SELECT construct_id, u, min(p) AS s, max(p) + 1 + u AS e FROM e7s GROUP BY construct_id, u, grp HAVING count(*) + u >= 20),
e7k AS (SELECT * FROM e7r a WHERE NOT EXISTS (SELECT 1 FROM e7r b WHERE a.construct_id = b.construct_id AND b.u < a.u AND b.s <= a.s AND a.e <= b.e)),
e7 AS (SELECT construct_id, 'e7_short_tandem_repeats' AS spec_id, substring(text, s + 1, u) AS kind, CASE WHEN circular THEN (cs + s) % length ELSE cs + s END AS start, CASE WHEN circular THEN (cs + s) % length ELSE cs + s END + e - s AS stop, 1 AS strand, (e - s - 19) / 20 * CASE WHEN e - s > 100 THEN 2 ELSE 1 END AS magnitude, {_fix('s', 'e')} AS fixable FROM e7k JOIN frag USING (construct_id) WHERE u > 1)"""
RULES_SQL = f"{SEGMENT_SQL}, {_starts_sql(6, 's6')}, {_starts_sql(8, 's8')}, {_starts_sql(1, 'l1', False)}, {_d1_sql()}, {D4_SQL}, {E1_SQL}, {D3_SQL}, {D8_SQL}, {E6_SQL}, {E7_SQL}"
PARTS = ("d1", "d3", "d4", "d8", "e1", "e6", "e7")
ALL_SQL = " UNION ALL ".join(f"SELECT * FROM {x}" for x in PARTS)


def _breach_sql(part: str) -> str:
    return f'WITH {RULES_SQL} SELECT construct_id, kind, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", strand, round(CAST(magnitude AS DOUBLE), 9) AS magnitude, fixable FROM {part}'


def _rule(part: str, spec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = evaluation.breaches(segmented(spark, sf_dir), {spec: evaluation.EVALUATORS[spec]})
        return found.drop("spec_id").withColumn("magnitude", F.round("magnitude", 9))

    query(f"breaches_{spec}", _breach_sql(part))(run)


for _part in PARTS:
    _rule(_part, next(s for s in evaluation.EVALUATORS if s.startswith(_part)))


@query("rule_scores", f"""WITH {RULES_SQL} SELECT construct_id, spec_id, count(*) AS n, sum(CAST(fixable AS INT)) AS n_fixable, round(sum(CAST(magnitude AS DOUBLE)), 6) AS raw_score, max(magnitude) < CASE WHEN spec_id = 'd3_splicing' THEN 3.0 WHEN spec_id = 'e7_short_tandem_repeats' THEN 8.2 WHEN spec_id = 'd4_internal_polya' THEN 1.0 ELSE 0.0 END AS passes FROM ({ALL_SQL}) x GROUP BY construct_id, spec_id""")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of all rules of one pass; a tandem tract over 100 bases has a magnitude of 8.2 or more."""
    found = evaluation.breaches(segmented(spark, sf_dir))
    least = F.when(F.col("spec_id") == "d3_splicing", 3.0).when(F.col("spec_id") == "e7_short_tandem_repeats", 8.2).when(F.col("spec_id") == "d4_internal_polya", 1.0).otherwise(0.0)
    made = found.groupBy("construct_id", "spec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fixable").cast("int")).alias("n_fixable"), F.round(F.sum("magnitude"), 6).alias("raw_score"), F.max("magnitude").alias("worst"))
    return made.withColumn("passes", F.col("worst") < least).drop("worst")


@query("cpg_islands_takai_jones", f"WITH {SEGMENT_SQL}, {D8_SQL.replace('200', '500').replace(', 40))', ', 100))').replace('length - 199', 'length - 499').replace('>= 0.5 AND ratio >= 0.6)', '>= 0.55 AND ratio >= 0.65)')} SELECT construct_id, CAST(start AS INT) AS start, fixable FROM d8")
def takai_jones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.breaches(segmented(spark, sf_dir), {"d8": lambda c: evaluation.cpg_island(c, "takai_jones")})
    return found.select("construct_id", "start", "fixable")


@query("segment_projections", f"""WITH {SEGMENT_SQL} SELECT construct_id, 'DESIGNABLE_CDS' AS kind, CAST(cs AS INT) AS start, CAST(ce AS INT) AS "end", false AS scan_exempt, substring(seq, CAST(cs + 1 AS INT), CAST(ce - cs AS INT)) AS text FROM seg WHERE length >= 6
UNION ALL SELECT construct_id, 'WHITELISTED_REPEAT', 0, CAST(xe AS INT), true, substring(seq, 1, CAST(xe AS INT)) FROM seg WHERE length >= 200""")
def segment_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(spark, sf_dir)
    both = rows.select("construct_id", "seq", F.explode(F.concat(evaluation.editable(F.col("segments")), evaluation.exempt(F.col("segments")))).alias("s"))
    text = dna.circular_slice(F.col("seq"), F.col("s.start"), F.col("s.end"), F.lit(1))
    return both.select("construct_id", "s.kind", "s.start", "s.end", F.col("s.kind").isin(*evaluation.EXEMPT_KINDS).alias("scan_exempt"), text.alias("text"))


@query("editable_features", f"""WITH {SEGMENT_SQL}, {FEATURES_SQL}, j AS (SELECT f.construct_id, f.j, f.start AS s, f."end" AS e, f.length, f.circular, cs, ce, xs, xe FROM features f JOIN seg USING (construct_id))
SELECT construct_id, j, (cs <= s AND e <= ce) OR (circular AND ((cs <= s + length AND e + length <= ce) OR (cs <= s - length AND e - length <= ce))) AS inside, {_fix('s', 'e')} AS touches, round({_touch('s', 'e', 'xs', 'xe')} / (e - s), 9) AS exempt FROM j""")
def editable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).join(segmented(spark, sf_dir).select("construct_id", "segments"), "construct_id")
    args = (F.col("segments"), F.col("start"), F.col("end"), F.col("length"), F.col("circular"))
    return rows.select("construct_id", "j", evaluation.is_editable(*args).alias("inside"), evaluation.overlaps_editable(*args).alias("touches"), F.round(evaluation.exempt_coverage(*args), 9).alias("exempt"))


@query("kmer_recurrence_exempt_12", f"""WITH {SEGMENT_SQL}, {_starts_sql(12, 's12')}, k AS (SELECT s12.construct_id, pos, kmer, count(*) OVER (PARTITION BY s12.construct_id, kmer) AS n, seg.length, seg.circular, xe > 0 AND {_touch('pos', 'pos + 12', 'xs', 'xe').replace('length', 'seg.length').replace('circular', 'seg.circular')} >= 10.8 AS free FROM s12 JOIN seg USING (construct_id)),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY construct_id, kmer ORDER BY pos) < 12 THEN 0 ELSE 1 END AS nw FROM k), l AS (SELECT construct_id, kmer, sum(nw) - CASE WHEN any_value(circular) AND sum(nw) > 1 AND any_value(length) - max(pos) + min(pos) < 12 THEN 1 ELSE 0 END AS sites FROM g GROUP BY construct_id, kmer),
t AS (SELECT construct_id, count(*) FILTER (sites >= 3) AS lk FROM l GROUP BY construct_id), r AS (SELECT construct_id, count(*) FILTER (NOT free) AS scored, count(*) FILTER (NOT free AND n > 1) AS recurring FROM k GROUP BY construct_id)
SELECT construct_id, CAST(coalesce(scored, 0) AS INT) AS scored, CAST(coalesce(recurring, 0) AS INT) AS recurring, CASE WHEN scored > 0 THEN recurring / scored ELSE 0.0 END AS raw_score, CAST(coalesce(lk, 0) AS INT) AS landing_kmers FROM constructs LEFT JOIN r USING (construct_id) LEFT JOIN t USING (construct_id)""")
def recurrence_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recurrence(segmented(spark, sf_dir))


_ORF = f"""orf_t AS (SELECT construct_id, length, circular, strand, CASE WHEN circular THEN repeat(once, 3) ELSE once END AS hay FROM (SELECT construct_id, length, circular, 1 AS strand, seq AS once FROM constructs UNION ALL SELECT construct_id, length, circular, -1, {_RC} FROM constructs) o WHERE length >= 3),
orf_p AS (SELECT * EXCLUDE (hay), substring(hay, pos + 1, 3) AS codon FROM (SELECT *, unnest(range(0, length(hay) - 2)) AS pos FROM orf_t) p), orf_c AS (SELECT * FROM orf_p WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA')),
orf_n AS (SELECT *, min(CASE WHEN codon <> 'ATG' THEN pos END) OVER (PARTITION BY construct_id, strand, pos % 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM orf_c),
orfs AS (SELECT construct_id, strand, length, min(pos) AS s, stop FROM orf_n WHERE codon = 'ATG' AND pos < length AND stop IS NOT NULL GROUP BY construct_id, strand, length, stop)"""


def _orf_sql(least: int) -> str:
    return f"""WITH {SQL}, {_ORF} SELECT construct_id, CAST(lo AS INT) AS start, CAST(lo + stop + 3 - s AS INT) AS "end", strand FROM (SELECT *, CASE WHEN strand = 1 THEN s % length ELSE ((length - stop - 3) % length + length) % length END AS lo FROM orfs WHERE (stop - s) // 3 >= {least}) x"""


@query("orfs_both_strands", _orf_sql(20))
def orfs_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 20 residues and more; :func:`orfs_80` has the default of 80."""
    return evaluation.open_frames(constructs(spark, sf_dir), 1, 20)


@query("orfs_80", _orf_sql(80))
def orfs_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.open_frames(constructs(spark, sf_dir), 1)


@query("nearest_downstream_feature", f"""WITH {SQL}, {FEATURES_SQL}, p AS (SELECT a.construct_id, a.j, b.j AS feature, CASE WHEN a.strand > 0 THEN b.start - a."end" ELSE a.start - b."end" END AS raw, a.length, a.circular FROM features a JOIN features b ON a.construct_id = b.construct_id AND a.strand = b.strand WHERE a.j < 3 AND b.j >= 3),
d AS (SELECT construct_id, j, feature, CASE WHEN circular THEN ((raw % length) + length) % length ELSE raw END AS distance, length, circular FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY construct_id, j ORDER BY distance, feature) AS n FROM d WHERE distance BETWEEN 0 AND 5000 AND (NOT circular OR distance <= length // 2))
SELECT construct_id, j, feature, CAST(distance AS INT) AS distance FROM r WHERE n = 1""")  # fmt: skip
def downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return survey.nearest_downstream(rows.where("j < 3"), rows.where("j >= 3"), 5000)


_ARMS_SQL = f"""{SQL}, arms AS (SELECT construct_id, a AS arm, substring(seq, CAST(1 + (construct_id * 37 + a * 211) % (length - 20) AS INT), 12) AS text, CAST((construct_id * 37 + a * 211) % (length - 20) AS INT) AS start, circular FROM constructs, (SELECT unnest([0, 1, 2]) AS a) n WHERE length >= 60)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constructs(spark, sf_dir).where("length >= 60").select("construct_id", "seq", "length", F.explode(F.array(*map(F.lit, range(3)))).alias("arm"))
    start = F.expr("cast((construct_id * 37 + arm * 211) % (length - 20) as int)")
    return rows.withColumn("start", start).select("construct_id", "arm", F.expr("substring(seq, start + 1, 12)").alias("text"), "start")


@query("arm_occurrences", f"""WITH {_ARMS_SQL}, {_starts_sql(12, 's12')} SELECT arms.construct_id, arm, CAST(pos AS INT) AS position, CASE WHEN kmer = text THEN 1 ELSE -1 END AS strand FROM arms JOIN s12 ON arms.construct_id = s12.construct_id AND (kmer = text OR kmer = reverse(translate(text, 'ACGT', 'TGCA'))) WHERE kmer <> text OR pos <> start""")
def arm_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.occurrences(_arms(spark, sf_dir), constructs(spark, sf_dir), 12)


@query("shared_arms", f"""WITH {_ARMS_SQL}, w AS (SELECT construct_id, arm, i, substring(text, i + 1, 6) AS piece FROM (SELECT construct_id, arm, text, unnest(range(0, 7)) AS i FROM arms) x)
SELECT a.construct_id, a.arm, b.arm AS other, CAST(min(a.i) AS INT) AS "offset" FROM w a JOIN w b ON a.construct_id = b.construct_id AND a.arm < b.arm AND (a.piece = b.piece OR a.piece = reverse(translate(b.piece, 'ACGT', 'TGCA'))) GROUP BY a.construct_id, a.arm, b.arm""")
def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.shared_arms(_arms(spark, sf_dir), 6)


@query("identical_exempt_repeats", f"""WITH {SQL}, x AS (SELECT construct_id, i AS j, substring(seq, CAST(i * 4 + 1 AS INT), 4) AS text FROM (SELECT construct_id, seq, unnest(range(0, 12)) AS i FROM constructs WHERE length >= 48) y)
SELECT a.construct_id, CAST(a.j AS INT) AS first, CAST(b.j AS INT) AS second, CAST(length(a.text) AS INT) AS length FROM x a JOIN x b ON a.construct_id = b.construct_id AND a.text = b.text AND a.j < b.j""")
def identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constructs(spark, sf_dir).where("length >= 48").select("construct_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j"))
    return survey.identical_repeats(rows.select("construct_id", "j", F.expr("substring(seq, j * 4 + 1, 4)").alias("text")))


@query("window_extremes", f"""WITH {SQL}, {_gc_sql(100)}, r AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY gc, pos) AS a, row_number() OVER (PARTITION BY construct_id ORDER BY gc DESC, pos) AS z FROM gcw)
SELECT construct_id, max(CASE WHEN a = 1 THEN pos END) AS lowest, max(CASE WHEN z = 1 THEN pos END) AS highest, min(gc) AS least, max(gc) AS most FROM r GROUP BY construct_id""")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first windows of least and most GC."""
    rows = windows.gc_windows(constructs(spark, sf_dir), 100)
    made = rows.groupBy("construct_id").agg(F.min(F.struct("gc", "pos")).alias("a"), F.max(F.struct("gc", (-F.col("pos")).alias("minus"))).alias("z"))
    return made.select("construct_id", F.col("a.pos").alias("lowest"), (-F.col("z.minus")).alias("highest"), F.col("a.gc").alias("least"), F.col("z.gc").alias("most"))


@query("circular_pair_span", f"""WITH {SQL}, {FEATURES_SQL}, p AS (SELECT a.construct_id, a.j, b.j AS r_j, a.start AS s1, a."end" AS e1, b.start AS s2, b."end" AS e2, a.length, a.circular FROM features a JOIN features b ON a.construct_id = b.construct_id AND a.start < b.start WHERE a.j < 3 AND b.j >= 3)
SELECT construct_id, j, r_j, CAST(CASE WHEN wraps THEN s2 ELSE s1 END AS INT) AS start, CAST(CASE WHEN wraps THEN e1 + length ELSE greatest(e1, e2) END AS INT) AS "end" FROM (SELECT *, circular AND e2 <= length AND length - (e2 - s1) >= 0 AND length - (e2 - s1) < s2 - e1 AS wraps FROM p) q""")
def pair_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    other = rows.where("j >= 3").select("construct_id", F.col("j").alias("r_j"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    pairs = rows.where("j < 3").join(other, "construct_id").where("start < s2")
    begin, stop = intervals.pair_span(F.col("start"), F.col("end"), F.col("s2"), F.col("e2"), F.col("length"), F.col("circular"))
    return pairs.select("construct_id", "j", "r_j", begin.alias("start"), stop.alias("end"))
