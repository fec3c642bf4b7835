"""Queries over the catalog of rules, circular repeats and ordered fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna
from ..operators import catalog, evaluation, fragments, placement, repeats, rules, scan
from .derived import SQL, constructs
from .evaluate import RULES_SQL, segmented
from .registry import query

FIVE, THREE = "CAATCCGCCCTCACTACAACCG", "CTACTCTGGCGTCGATGAGGGA"
ADAPTER_ON = ["twist_gene_fragment_adapter_on"]
#: A coding segment that runs over the origin of circles, and its tube.
TUBE_SQL = f"""{SQL}, tube AS (SELECT *, substring(seq || seq, s + 1, e - s) AS text FROM (SELECT *, CASE WHEN circular THEN (3 * length) // 4 ELSE length // 4 END AS s, CASE WHEN circular THEN (3 * length) // 4 ELSE length // 4 END + 3 * (length // 6) AS e FROM constructs WHERE length >= 6) x)"""


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``construct_id, seq, length, circular, segments`` with one coding segment, over the origin of circles."""
    start = F.expr("cast(case when circular then div(3 * length, 4) else div(length, 4) end as int)")
    end = (start + F.expr("cast(3 * div(length, 6) as int)")).cast("int")
    rows = constructs(spark, sf_dir).where("length >= 6")
    return rows.withColumn("segments", F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(evaluation.DESIGNABLE).alias("kind"))))


@query("fragment_places", f"""WITH {TUBE_SQL}, w AS (SELECT construct_id, length, circular, s, length(text) AS ordered, text, i, 37 * i AS a, 37 * i + 30 AS b FROM (SELECT *, unnest([0, 1, 2, 5, 9]) AS i FROM tube) y WHERE 37 * i < length(text) + 44),
m AS (SELECT *, greatest(a, 22) - 22 + s AS raw, least(b, 22 + ordered) - greatest(a, 22) AS size FROM w)
SELECT construct_id, CAST(i AS INT) AS i, CAST(CASE WHEN size <= 0 THEN -1 WHEN circular THEN raw % length ELSE raw END AS INT) AS start, CAST(CASE WHEN size <= 0 THEN -1 WHEN circular THEN raw % length + size ELSE raw + size END AS INT) AS "end", CAST(CASE WHEN size > 0 THEN greatest(a, 22) ELSE -1 END AS INT) AS back_start, CAST(CASE WHEN size > 0 THEN greatest(a, 22) + size ELSE -1 END AS INT) AS back_end FROM m""")  # fmt: skip
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ordered fragments on their constructs, and from there back to the fragments; -1 where there is no place."""
    rows = fragments.fragments(ordered(spark, sf_dir), ADAPTER_ON).withColumn("i", F.explode(F.array(*map(F.lit, (0, 1, 2, 5, 9))))).where("37 * i < length(sequence)")
    start, end = fragments.to_construct(37 * F.col("i"), 37 * F.col("i") + 30)
    there = rows.withColumn("start", start.cast("int")).withColumn("end", end.cast("int"))
    back = fragments.to_fragment(F.col("start"), F.col("end"))
    made = there.select("construct_id", "i", "start", "end", back[0].cast("int").alias("back_start"), back[1].cast("int").alias("back_end"))
    return made.fillna(-1, ["start", "end", "back_start", "back_end"])


@query("breaches_e2_gc_band", f"""WITH {TUBE_SQL}, g AS (SELECT construct_id, s, e, '{FIVE}' || text || '{THREE}' AS molecule FROM tube), r AS (SELECT *, (length(molecule) - length(replace(replace(molecule, 'G', ''), 'C', ''))) / length(molecule) AS gc FROM g)
SELECT construct_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", round(gc, 9) AS gc, CASE WHEN gc < 0.28 THEN 'lower' ELSE 'upper' END AS side, round(greatest(0.28 - gc, gc - 0.8), 9) AS magnitude FROM r WHERE gc < 0.28 OR gc > 0.8""")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fragments.gc_band(fragments.fragments(ordered(spark, sf_dir), ADAPTER_ON), ADAPTER_ON)
    return found.select("construct_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.round("gc", 9).alias("gc"), "side", F.round("magnitude", 9).alias("magnitude"))


@query("breaches_e9_length_tiers", f"""WITH {TUBE_SQL}, v AS (SELECT construct_id, s, e, length(text) BETWEEN 300 AND 1500 AS eb, length(text) BETWEEN 125 AND 3000 AS gb FROM tube)
SELECT construct_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", CASE WHEN eb THEN 'idt_eblocks' WHEN gb THEN 'idt_gblocks' ELSE '' END AS accepting, concat_ws(',', CASE WHEN NOT eb THEN 'idt_eblocks' END, CASE WHEN NOT gb THEN 'idt_gblocks' END) AS refusing,
CASE WHEN eb OR gb THEN 'narrowed' ELSE 'unorderable' END AS tier, CASE WHEN eb OR gb THEN 0.25 ELSE 1.0 END AS magnitude FROM v WHERE NOT (eb AND gb)""")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["idt_eblocks", "idt_gblocks"]
    found = fragments.length_tiers(fragments.fragments(ordered(spark, sf_dir), keys), keys)
    return found.select("construct_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "accepting", "refusing", "tier", "magnitude")


@query("adapter_length_tiers", f"""WITH {TUBE_SQL}, v AS (SELECT construct_id, length(text) BETWEEN 300 AND 5000 AS a, length(text) + 44 BETWEEN 300 AND 5000 AS b FROM tube)
SELECT construct_id, CASE WHEN a <> b THEN 'ambiguous' ELSE 'unorderable' END AS tier, CASE WHEN a <> b THEN 0.5 ELSE 1.0 END AS magnitude FROM v WHERE NOT (a AND b)""")
def e9_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the range does not say whether adapters count."""
    return fragments.length_tiers(fragments.fragments(ordered(spark, sf_dir), ADAPTER_ON), ADAPTER_ON).select("construct_id", "tier", "magnitude")



@query("breaches_e4_gc_extent", f"""WITH {TUBE_SQL}, p AS (SELECT construct_id, length, circular, s, length(text) AS n, unnest(range(0, length(text))) AS pos, text FROM tube WHERE length(text) >= 100),
b AS (SELECT construct_id, length, circular, s, n, pos, CASE WHEN substring(text, pos + 1, 1) IN ('G', 'C') THEN 1 ELSE 0 END AS gc FROM p),
w AS (SELECT *, sum(gc) OVER (PARTITION BY construct_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS g100, sum(gc) OVER (PARTITION BY construct_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS g50, avg(gc) OVER (PARTITION BY construct_id) AS p FROM b),
d AS (SELECT construct_id, stddev_pop(g100) / sqrt(any_value(p) * (1 - any_value(p)) * 100) AS ratio FROM w WHERE pos <= n - 100 GROUP BY construct_id HAVING any_value(p) > 0 AND any_value(p) < 1 AND count(*) > 1),
x AS (SELECT construct_id, any_value(length) AS length, any_value(circular) AS circular, any_value(s) AS s, arg_min(pos, g50 * 1000000 + pos) AS lo_i, min(g50) AS lo, arg_max(pos, g50 * 1000000 - pos) AS hi_i, max(g50) AS hi, list_sort(list(g50))[count(*) // 2 + 1] AS mid FROM w WHERE pos <= n - 50 GROUP BY construct_id),
o AS (SELECT *, mid - lo >= hi - mid AS low FROM x JOIN d USING (construct_id) WHERE ratio >= 1.5)
SELECT construct_id, CASE WHEN low THEN 'low' ELSE 'high' END AS kind, CAST(CASE WHEN circular THEN (s + CASE WHEN low THEN lo_i ELSE hi_i END) % length ELSE s + CASE WHEN low THEN lo_i ELSE hi_i END END AS INT) AS start, round(least(1.0, ratio - 1.0), 6) AS magnitude FROM o""")  # fmt: skip
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.breaches(ordered(spark, sf_dir), catalog.rule_set(["e4_gc_extent"], vendors=["idt_gblocks"]))
    return found.select("construct_id", "kind", "start", F.round("magnitude", 6).alias("magnitude"))


_F5_SQL = f"""{SQL}, f5p AS (SELECT construct_id, length, circular, unnest(range(0, length(hay))) AS pos, hay FROM (SELECT *, CASE WHEN circular THEN seq || substring(seq, 1, 99) ELSE seq END AS hay FROM constructs WHERE length >= 100) h),
f5w AS (SELECT *, sum(gc) OVER (PARTITION BY construct_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS g FROM (SELECT construct_id, length, circular, pos, length(hay) AS h, CASE WHEN substring(hay, pos + 1, 1) IN ('G', 'C') THEN 1 ELSE 0 END AS gc FROM f5p) z),
f5 AS (SELECT construct_id, length, circular, pos, g FROM f5w WHERE pos <= h - 100)"""


@query("f5_hard_windows", f"""WITH {_F5_SQL} SELECT construct_id, count(*) FILTER (g < 35 OR g > 65) > 0 AS fails FROM f5 GROUP BY construct_id""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any window of a construct leaves the hard band: the pass test of f5 from its breaches."""
    rows = segmented(spark, sf_dir).where("length >= 100")
    found = catalog.breaches(rows, include=["f5_at_window"]).groupBy("construct_id").agg(F.max("fails").alias("fails"))
    return rows.select("construct_id").join(found, "construct_id", "left").select("construct_id", F.coalesce("fails", F.lit(False)).alias("fails"))


@query("catalog_evaluations")
def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the catalog on every construct, with its own pass test."""
    return catalog.evaluated(segmented(spark, sf_dir))


@query("circular_repeats")
def circular_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f1 and f3 round the origin of circles."""
    found = catalog.breaches(segmented(spark, sf_dir), include=["f1_direct_repeats", "f3_inverted_repeats"])
    return found.select("construct_id", "spec_id", "kind", "start", "end", "magnitude", "fixable", "fails")


@query("synthesis_repeats")
def synthesis_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e5 on ordered fragments with their adapters, at places on the construct."""
    found = catalog.breaches(ordered(spark, sf_dir), include=["e5_synthesis_repeats"], vendors=ADAPTER_ON)
    return found.select("construct_id", "kind", "start", "end", "magnitude", "fails")


#: Sites set into constructs by id, over the origin of circles: three whole ones and a half site.
_PLANTED = ["ATAACTTCGTATAGCATACATTATACGAAGTTAT", "GAAGTTCCTATTCTCTAGAAAGTATAGGAACTTC", "ACAAGTTTGTACAAAAAAGCAGGCT", "ATAACTTCGTATAC"]


@query("breaches_d2_recombinase_sites", f"""WITH {SQL}, k AS (SELECT construct_id, circular, length, {_PLANTED}[construct_id % 5 + 1] AS site FROM constructs WHERE length >= 60 AND construct_id % 5 < 4)
SELECT construct_id, ['loxP_family', 'FRT', 'Gateway_attB1', 'loxP_half_site'][construct_id % 5 + 1] AS name, CAST(CASE WHEN circular THEN length + length(site) - length(site) // 2 ELSE length END AS INT) AS start, CASE WHEN construct_id % 5 = 3 THEN 0.3 ELSE 1.0 END AS magnitude FROM k""")
def planted_recombinases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sites hide the partial ones inside them; a half site alone is found."""
    rows = constructs(spark, sf_dir).where("length >= 60 and construct_id % 5 < 4")
    site = F.element_at(F.array(*map(F.lit, _PLANTED)), (F.col("construct_id") % 5 + 1).cast("int"))
    rows = rows.withColumn("site", site).withColumn("half", F.expr("cast(div(length(site), 2) as int)"))
    seq = F.when(F.col("circular"), F.expr("concat(substring(site, half + 1), seq, substring(site, 1, half))")).otherwise(F.concat("seq", "site"))
    made = rows.withColumn("seq", seq).select("construct_id", "seq", F.length("seq").alias("length"), "circular")
    return catalog.breaches(made.withColumn("segments", F.lit(None).cast(evaluation.SEGMENTS)), include=["d2_recombinase_sites"]).select("construct_id", F.col("kind").alias("name"), "start", "magnitude")


@query("circular_repeat_regions")
def circular_repeat_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of direct repeats, exempt segments known and merged over the origin of circles; ``end`` may lie past it."""
    return placement.repeat_regions(repeats.pairs(segmented(spark, sf_dir)))


@query("hairpin_liabilities")
def hairpin_liabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.hairpins(segmented(spark, sf_dir))


_DECLARING = ["d1_restriction_sites", "d2_recombinase_sites", "d8_cpg_depletion", "e2_gc_band"]


@query("declared_conflicts", f"""WITH {RULES_SQL}, {TUBE_SQL.replace(SQL + ", ", "", 1)}, g2 AS (SELECT construct_id, s, e, '{FIVE}' || text || '{THREE}' AS molecule FROM tube), r2 AS (SELECT *, (length(molecule) - length(replace(replace(molecule, 'G', ''), 'C', ''))) / length(molecule) AS gc FROM g2),
b AS (SELECT construct_id, spec_id, start, stop, magnitude FROM d1 WHERE construct_id IN (SELECT construct_id FROM tube) UNION ALL SELECT construct_id, spec_id, start, stop, magnitude FROM d8 WHERE construct_id IN (SELECT construct_id FROM tube) UNION ALL SELECT construct_id, 'e2_gc_band', s, e, greatest(0.28 - gc, gc - 0.8) FROM r2 WHERE gc < 0.28 OR gc > 0.8),
p(x, y, mixed) AS (VALUES ('d1_restriction_sites', 'd2_recombinase_sites', false), ('d8_cpg_depletion', 'e2_gc_band', true)), h AS (SELECT b.*, p.* FROM b JOIN p ON spec_id IN (x, y)),
m AS (SELECT construct_id, x, y, mixed, min(row(spec_id, start, stop)) AS spot, min(row(spec_id = 'd8_cpg_depletion', -magnitude, start, stop, spec_id)) AS top FROM h GROUP BY ALL)
SELECT construct_id, CAST(spot[2] AS INT) AS start, CAST(spot[3] AS INT) AS "end", x || ',' || y AS rules, 'declared' AS kind, top[5] AS binding, mixed AS hard_versus_soft FROM m""")  # fmt: skip
def declared_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that pull against each other over ordered constructs, of which one at least has breaches."""
    found = catalog.breaches(ordered(spark, sf_dir), include=_DECLARING, vendors=ADAPTER_ON)
    return rules.declared_conflicts(found, _DECLARING)


#: Motifs a design should avoid, some of which most backbones hold.
_AVOID = [*dims.SIX_CUTTERS.values(), *dims.TYPE_IIS.values(), "AAAAAA", "CCCC", "ATAT"]
_KEPT = "CASE WHEN e <= length THEN substring(seq, 1, s) || repeat('N', e - s) || substring(seq, e + 1) ELSE repeat('N', CAST(least(e - length, s) AS BIGINT)) || substring(seq, CAST(least(e - length, s) + 1 AS BIGINT), CAST(s - least(e - length, s) AS BIGINT)) || repeat('N', length - s) END"
_HELD_SQL = ", ".join(f"{{'m': '{m}', 'held': contains(kept || CASE WHEN circular THEN substring(kept, 1, {len(m) - 1}) ELSE '' END, '{m}') OR contains(kept || CASE WHEN circular THEN substring(kept, 1, {len(m) - 1}) ELSE '' END, '{dna.complement_text(m)}')}}" for m in _AVOID)


@query("forbidden_split", f"""WITH {TUBE_SQL}, k AS (SELECT construct_id, circular, {_KEPT} AS kept FROM tube), t AS (SELECT construct_id, [{_HELD_SQL}] AS told FROM k)
SELECT construct_id, array_to_string(list_transform(list_filter(told, lambda x: NOT x.held), lambda x: x.m), ',') AS usable, array_to_string(list_transform(list_filter(told, lambda x: x.held), lambda x: x.m), ',') AS carried FROM t""")  # fmt: skip
def forbidden_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backbone holds outside the coding span that is replaced, and what is left for the solver to avoid."""
    site = ordered(spark, sf_dir).select("construct_id", "seq", "circular", F.get("segments", F.lit(0))["start"].alias("start"), F.get("segments", F.lit(0))["end"].alias("end"))
    made = scan.split_forbidden(site, _AVOID)
    return made.select("construct_id", F.array_join("usable", ",").alias("usable"), F.array_join("carried", ",").alias("carried"))
