"""Queries over rules that are read slot by slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna
from ..operators import evaluation, slots
from .derived import SQL, constructs
from .evaluate import SEGMENT_SQL, segmented
from .registry import query
from .sequence import AA_SQL

HOSTS = sorted(dims.HOST_TABLE)
#: A host without a reference set.
NONE = "sf9"
#: Three slots a construct, each for another host; some read the other strand.
SLOT_SQL = f"sl AS (SELECT construct_id, slot, {list(dims.ROLES)}[slot + 1] AS role, {HOSTS}[(construct_id + slot) % {len(HOSTS)} + 1] AS host, CASE WHEN slot = 1 AND construct_id % 5 = 0 THEN -1 ELSE 1 END AS strand FROM constructs, (SELECT unnest([0, 1, 2]) AS slot) v)"


def _filled(rows: DataFrame) -> DataFrame:
    """-1, no and the empty string for nulls: the rows of a query have no gaps."""
    return rows.fillna(-1).fillna("").fillna(False)


def _filled_sql(body: str, numbers: str, words: str, kept: str) -> str:
    sql = ", ".join([f"coalesce({x}, -1) AS {x}" for x in numbers.split()] + [f"coalesce({x}, '') AS {x}" for x in words.split()] + kept.split())
    return f"{body[: body.rindex('SELECT construct_id,')].rstrip()}, filled AS ({body[body.rindex('SELECT construct_id,') :]}) SELECT construct_id, {sql} FROM filled"


def _pick(names, at):
    return F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))


def slot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``construct_id, slot, role, host, table_id, strand``; only ids are read."""
    rows = constructs(spark, sf_dir).select("construct_id", F.posexplode(F.array(*map(F.lit, dims.ROLES))).alias("slot", "role"))
    table = F.element_at(F.create_map(*[F.lit(x) for pair in dims.HOST_TABLE.items() for x in pair]), F.col("host"))
    rows = rows.withColumn("host", _pick(HOSTS, F.col("construct_id") + F.col("slot"))).withColumn("table_id", table)
    return rows.withColumn("strand", F.when((F.col("slot") == 1) & (F.col("construct_id") % 5 == 0), -1).otherwise(1))


_BANDS = ", ".join(f"('{h}', {a}, {b})" for h, (a, b) in sorted(dims.CAI_BANDS.items()))


_C1_SQL = f"""WITH {SEGMENT_SQL}, {SLOT_SQL}, {AA_SQL}, t AS (SELECT construct_id, substring(seq || seq, cs + 1, ce - cs) AS text FROM seg WHERE ce > cs),
cod AS (SELECT construct_id, substring(text, 3 * i + 1, 3) AS codon FROM (SELECT *, unnest(range(0, length(text) // 3)) AS i FROM t) x), inf AS (SELECT codon, aa FROM aa WHERE aa <> '*' AND aa IN (SELECT aa FROM aa GROUP BY aa HAVING count(*) > 1)),
cnt AS (SELECT host, codon, count(*) AS n FROM (SELECT {HOSTS}[construct_id % {len(HOSTS)} + 1] AS host, codon FROM cod) x WHERE host <> '{NONE}' GROUP BY ALL), hs AS (SELECT DISTINCT host FROM cnt),
w AS (SELECT host, codon, aa, (coalesce(n, 0) + 0.5) / max(coalesce(n, 0) + 0.5) OVER (PARTITION BY host, aa) AS w FROM (SELECT host, codon, aa FROM hs, inf) x LEFT JOIN cnt USING (host, codon)),
ch AS (SELECT host, exp(avg(m)) AS chance FROM (SELECT host, aa, avg(ln(w)) AS m FROM w GROUP BY ALL) x GROUP BY host), band(host, lo, hi) AS (VALUES {_BANDS}),
sc AS (SELECT s.construct_id, slot, exp(avg(ln(w))) AS score, count(*) AS n FROM sl s JOIN cod c ON s.construct_id = c.construct_id JOIN w ON w.host = s.host AND w.codon = CASE WHEN strand = 1 THEN c.codon ELSE reverse(translate(c.codon, 'ACGT', 'TGCA')) END GROUP BY ALL),
r AS (SELECT g.construct_id, CASE WHEN ce > cs THEN cs END AS s, CASE WHEN ce > cs THEN ce END AS e, slot, role, host, score, n, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, chance, CASE WHEN ce <= cs THEN 'no_cds' WHEN chance IS NULL THEN 'no_reference_set' WHEN lo IS NULL THEN 'no_band' WHEN n IS NULL THEN 'no_informative_codons' END AS reason
  FROM seg g JOIN sl USING (construct_id) LEFT JOIN sc USING (construct_id, slot) LEFT JOIN ch USING (host) LEFT JOIN band USING (host) WHERE role <> 'propagation'),
k AS (SELECT *, greatest(lo - score, score - hi, 0) AS away, CASE WHEN lo <= 0 THEN hi - score ELSE least(score - lo, hi - score) END / (1 - chance) AS near, arg_min(reason, slot) FILTER (reason IS NOT NULL) OVER (PARTITION BY construct_id) AS why FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY CASE WHEN away > 0 THEN away ELSE -near - 1 END DESC NULLS LAST, slot) AS rk FROM k),
f AS (SELECT *, why IS NULL AS ok FROM o WHERE rk = 1)
SELECT construct_id, CASE WHEN ok THEN role END AS role, CASE WHEN ok THEN host END AS host, round(CASE WHEN ok THEN score END, 9) AS score, CASE WHEN ok THEN n END AS n, CASE WHEN ok THEN lo END AS lo, CASE WHEN ok THEN hi END AS hi, CASE WHEN NOT ok THEN NULL WHEN score < lo THEN 'lower' WHEN score > hi THEN 'upper' END AS side,
round(CASE WHEN ok THEN away END, 9) AS magnitude, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", NOT ok OR score BETWEEN lo AND hi AS passes, why AS reason FROM f"""  # fmt: skip


@query("breaches_c1_cai", _filled_sql(_C1_SQL, 'score n lo hi magnitude start "end"', "role host side reason", "passes"))
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAI of each construct by its worst slot; a host's reference set is the coding sequence of its own constructs."""
    rows = segmented(spark, sf_dir)
    own = slots.designable(rows).select(_pick(HOSTS, F.col("construct_id")).alias("host"), F.explode(dna.codons(F.col("text"))).alias("codon")).where(F.col("host") != NONE)
    found = slots.codon_adaptation(rows, slot_rows(spark, sf_dir), slots.host_weights(own))
    return _filled(found.withColumn("score", F.round("score", 9)).withColumn("magnitude", F.round("magnitude", 9)))


_C3_SQL = f"""WITH {SEGMENT_SQL}, {SLOT_SQL}, {AA_SQL}, t AS (SELECT construct_id, substring(seq || seq, cs + 1, ce - cs) AS text FROM seg WHERE ce > cs),
cod AS (SELECT construct_id, i, m, substring(text, 3 * i + 1, 3) AS codon FROM (SELECT *, length(text) // 3 AS m, unnest(range(0, length(text) // 3)) AS i FROM t) x), inf AS (SELECT codon, aa FROM aa WHERE aa <> '*' AND aa IN (SELECT aa FROM aa GROUP BY aa HAVING count(*) > 1)),
cnt AS (SELECT host, codon, count(*) AS n FROM (SELECT {HOSTS}[construct_id % {len(HOSTS)} + 1] AS host, codon FROM cod) x WHERE host <> '{NONE}' GROUP BY ALL), hs AS (SELECT DISTINCT host FROM cnt),
fam AS (SELECT host, aa, avg(n) AS mean, max(n) AS top, min(n) AS low FROM inf JOIN cnt USING (codon) JOIN (SELECT aa, count(*) AS size FROM inf GROUP BY aa) z USING (aa) GROUP BY host, aa, size HAVING count(*) = size),
stats AS (SELECT host, codon, n AS freq, mean, top, low FROM cnt JOIN inf USING (codon) JOIN fam USING (host, aa)),
pos AS (SELECT s.construct_id, slot, s.host, CASE WHEN strand = 1 THEN i ELSE m - 1 - i END AS i, CASE WHEN strand = 1 THEN codon ELSE reverse(translate(codon, 'ACGT', 'TGCA')) END AS codon FROM sl s JOIN cod c ON s.construct_id = c.construct_id WHERE role <> 'propagation'),
f AS (SELECT construct_id, slot, count(freq) OVER (PARTITION BY construct_id, slot) AS n, coalesce(sum(freq) OVER q, 0) AS f, coalesce(sum(mean) OVER q, 0) AS m, coalesce(sum(top) OVER q, 0) AS t, coalesce(sum(low) OVER q, 0) AS l FROM pos LEFT JOIN stats USING (host, codon) WINDOW q AS (PARTITION BY construct_id, slot ORDER BY i ROWS BETWEEN 8 PRECEDING AND 9 FOLLOWING)),
sc AS (SELECT construct_id, slot, any_value(n) AS n, avg(v) AS score, max(v) AS peak, min(v) AS trough FROM (SELECT *, CASE WHEN f >= m - 1e-9 THEN CASE WHEN t > m + 1e-9 THEN 100 * (f - m) / (t - m) ELSE 0 END WHEN m > l + 1e-9 THEN -100 * (m - f) / (m - l) ELSE 0 END AS v FROM f WHERE n > 0) x GROUP BY ALL),
r AS (SELECT g.construct_id, CASE WHEN ce > cs THEN cs END AS s, CASE WHEN ce > cs THEN ce END AS e, slot, role, host, score, peak, trough, n, CASE WHEN ce <= cs THEN 'no_cds' WHEN host NOT IN (SELECT host FROM hs) THEN 'no_reference_set' WHEN n IS NULL THEN 'no_informative_codons' END AS reason FROM seg g JOIN sl USING (construct_id) LEFT JOIN sc USING (construct_id, slot) WHERE role <> 'propagation'),
k AS (SELECT *, greatest(-100 - score, score, 0) AS away, arg_min(reason, slot) FILTER (reason IS NOT NULL) OVER (PARTITION BY construct_id) AS why FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY CASE WHEN away > 0 THEN away ELSE score - 1 END DESC NULLS LAST, slot) AS rk FROM k), h AS (SELECT *, why IS NULL AS ok FROM o WHERE rk = 1)
SELECT construct_id, CASE WHEN ok THEN role END AS role, CASE WHEN ok THEN host END AS host, round(CASE WHEN ok THEN score END, 6) AS score, round(CASE WHEN ok THEN peak END, 6) AS peak, round(CASE WHEN ok THEN trough END, 6) AS trough, CASE WHEN ok THEN n END AS n, CASE WHEN ok AND score > 0 THEN 'upper' WHEN ok AND score < -100 THEN 'lower' END AS side,
round(CASE WHEN ok THEN away END, 6) AS magnitude, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", NOT ok OR score BETWEEN -100 AND 0 AS passes, why AS reason FROM h"""  # fmt: skip


@query("breaches_c3_min_max", _filled_sql(_C3_SQL, 'score peak trough n magnitude start "end"', "role host side reason", "passes"))
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """%MinMax of each construct by its worst slot, on the raw codon counts of a host's own constructs."""
    rows = segmented(spark, sf_dir)
    own = slots.designable(rows).select(_pick(HOSTS, F.col("construct_id")).alias("host"), F.explode(dna.codons(F.col("text"))).alias("codon")).where(F.col("host") != NONE)
    found = slots.codon_landscape(rows, slot_rows(spark, sf_dir), own.groupBy("host", "codon").agg(F.count(F.lit(1)).cast("double").alias("freq")))
    for c in ("score", "peak", "trough", "magnitude"):
        found = found.withColumn(c, F.round(c, 6))
    return _filled(found)


_STARTS = {t: dims.STARTS[t].split() for t in sorted(set(dims.HOST_TABLE.values()))}
_IS_START = " OR ".join(f"(host {'' if t == 11 else 'NOT '}LIKE 'e_coli%' AND substring(context, 7, 3) IN ({', '.join(repr(x) for x in s)}))" for t, s in _STARTS.items())
_HOLDS = lambda a, b: f"(({a} <= lead AND lead + 6 <= {b}) OR circular AND (({a} <= lead + length AND lead + length + 6 <= {b}) OR ({a} <= lead - length AND lead - length + 6 <= {b})))"


_B8_SQL = f"""WITH {SQL}, {SLOT_SQL}, g AS (SELECT *, CASE WHEN circular THEN s + 3 * (length // 6) ELSE s + 3 * ((length - s) // 6) END AS e FROM (SELECT *, CASE WHEN construct_id % 7 <> 0 AND contains(seq, 'ATG') THEN instr(seq, 'ATG') - 1 ELSE length // 4 END AS s FROM constructs WHERE length >= 12) x),
st AS (SELECT *, CASE WHEN strand = 1 THEN s - 6 ELSE e - 5 END AS raw FROM g, (VALUES (1), (-1)) v(strand)), a AS (SELECT *, CASE WHEN circular THEN ((raw % length) + length) % length ELSE raw END AS p, e - s >= 5 AND (circular OR (raw >= 0 AND raw + 11 <= length)) AS room FROM st),
l AS (SELECT *, CASE WHEN strand = 1 THEN p ELSE p + 5 END AS lead, CASE WHEN circular THEN (((s - 60) % length) + length) % length ELSE greatest(s - 60, 0) END AS f0, CASE WHEN circular THEN (((s - 60) % length) + length) % length + 60 ELSE s END AS f1, CASE WHEN circular THEN e % length ELSE e END AS t0, substring(seq || seq, p + 1, 11) AS plus FROM a),
h AS (SELECT construct_id, strand, CASE WHEN room THEN p END AS p, CASE WHEN room THEN CASE WHEN strand = 1 THEN plus ELSE reverse(translate(plus, 'ACGT', 'TGCA')) END END AS context, CASE WHEN e <= s THEN 'no_cds' WHEN NOT room THEN 'no_room' WHEN NOT ((construct_id % 4 <> 3 AND {_HOLDS('f0', 'f1')}) OR (construct_id % 5 = 0 AND {_HOLDS('t0', 't0 + 40')})) THEN 'no_leader' END AS why FROM l),
r AS (SELECT g.construct_id, slot, role, host, h.p, h.context, h.why AS bad FROM g LEFT JOIN (SELECT * FROM sl WHERE role <> 'propagation' AND host NOT LIKE 'e_coli%') q ON g.construct_id = q.construct_id LEFT JOIN h ON q.construct_id = h.construct_id AND q.strand = h.strand),
k AS (SELECT *, CASE WHEN slot IS NULL THEN 'no_slot' ELSE bad END AS reason, CASE WHEN {_IS_START} THEN CAST(substring(context, 4, 1) IN ('A', 'G') AS INT) + CAST(substring(context, 10, 1) = 'G' AS INT) END AS tier FROM r),
o AS (SELECT *, arg_min(reason, coalesce(slot, 0)) FILTER (reason IS NOT NULL) OVER (PARTITION BY construct_id) AS first, row_number() OVER (PARTITION BY construct_id ORDER BY tier NULLS LAST, slot) AS rk FROM k),
f AS (SELECT *, coalesce(first, CASE WHEN tier IS NULL THEN 'no_initiator' END) AS why FROM o WHERE rk = 1)
SELECT construct_id, CASE WHEN why IS NULL THEN role END AS role, CASE WHEN why IS NULL THEN host END AS host, CAST(CASE WHEN why IS NULL THEN tier END AS DOUBLE) AS score, CASE WHEN why IS NULL THEN context END AS context, CAST(CASE WHEN why IS NULL THEN p END AS INT) AS start, CAST(CASE WHEN why IS NULL THEN p + 11 END AS INT) AS "end",
coalesce(CASE WHEN why IS NULL THEN substring(context, 10, 1) <> 'G' END, false) AS fixable, CAST(CASE WHEN why IS NULL THEN 2 - tier END AS DOUBLE) AS magnitude, why IS NOT NULL OR tier > 0 AS passes, why AS reason FROM f"""  # fmt: skip


@query("breaches_b8_kozak", _filled_sql(_B8_SQL, 'score magnitude start "end"', "role host context reason", "fixable passes"))
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start contexts by the weakest slot; coding segments begin at the first ATG of most constructs, and leaders are annotated by id."""
    rows = constructs(spark, sf_dir).where("length >= 12")
    rows = rows.withColumn("_s", F.expr("case when construct_id % 7 <> 0 and contains(seq, 'ATG') then instr(seq, 'ATG') - 1 else cast(div(length, 4) as int) end"))
    rows = rows.withColumn("_e", F.expr("_s + 3 * cast(case when circular then div(length, 6) else div(length - _s, 6) end as int)"))
    cds = F.when(F.col("_e") > F.col("_s"), F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"), F.lit(evaluation.DESIGNABLE).alias("kind")))
    lead = F.when(F.col("circular"), F.pmod(F.col("_s") - 60, F.col("length"))).otherwise(F.greatest(F.col("_s") - 60, F.lit(0)))
    five = F.when(F.col("construct_id") % 4 != 3, F.struct(lead.alias("start"), F.when(F.col("circular"), lead + 60).otherwise(F.col("_s")).alias("end")))
    behind = F.when(F.col("circular"), F.col("_e") % F.col("length")).otherwise(F.col("_e"))
    three = F.when(F.col("construct_id") % 5 == 0, F.struct(behind.alias("start"), (behind + 40).alias("end")))
    rows = rows.withColumn("segments", F.array_compact(F.array(cds))).withColumn("leaders", F.array_compact(F.array(five, three)))
    return _filled(slots.start_context(rows, slot_rows(spark, sf_dir)))
