"""Queries over derived sequences: motifs, windows, runs, k-mers, codons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna
from ..operators import codons as codon_ops
from ..operators import kmers, runs, scan, transcript, windows
from .derived import CODING_SQL, CODONS_SQL, SQL, coding, constructs
from .registry import query


def _starts_sql(k: int, name: str = "starts", circular: bool = True) -> str:
    around = f"CASE WHEN circular THEN seq || substring(seq, 1, {k - 1}) ELSE seq END" if circular else "seq"
    return f"{name} AS (SELECT construct_id, length, circular, pos, substring(hay, pos + 1, {k}) AS kmer FROM (SELECT construct_id, length, circular, hay, unnest(range(0, length(hay) - {k} + 1)) AS pos FROM (SELECT construct_id, length, circular, {around} AS hay FROM constructs WHERE length >= {k}) h) p)"


def _motif_sql(named: dict[str, str], both: bool = True) -> str:
    parts = []
    for name, motif in sorted(named.items()):
        k = len(motif)
        back = dna.complement_text(motif)
        for strand, m in ((1, motif), (-1, back)):
            if strand == 1 or (both and back != motif):
                parts.append(f"SELECT construct_id, '{name}' AS name, CAST(pos AS INT) AS pos, {strand} AS strand FROM s{k} WHERE regexp_full_match(kmer, '{dna.iupac_class(m)}')")
    sizes = sorted({len(m) for m in named.values()})
    return f"WITH {SQL}, {', '.join(_starts_sql(k, f's{k}') for k in sizes)} " + " UNION ALL ".join(parts)


PAIR = {"ACAT": "ACAT", "GATC": "GATC"}
EXTENDED = {"extended_minus_10": "TGNTATAAT", "sigma38_minus_10": "TATACT", "donor": "ANGTRAG"}
TLR9 = {"GACGTT": "GACGTT", "GTCGTT": "GTCGTT", "RRCGYY": "RRCGYY", "TTCGTT": "TTCGTT"}


@query("motif_scan_six_cutters", _motif_sql(dims.SIX_CUTTERS))
def six_cutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.motifs(constructs(spark, sf_dir), dims.SIX_CUTTERS)


@query("motif_scan_type_iis", _motif_sql(dims.TYPE_IIS))
def type_iis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.motifs(constructs(spark, sf_dir), dims.TYPE_IIS)


@query("motif_scan_both_strands_circular", _motif_sql(PAIR))
def both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.motifs(constructs(spark, sf_dir), PAIR)


@query("iupac_expansion_scan", _motif_sql(EXTENDED))
def iupac_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.motifs(constructs(spark, sf_dir), EXTENDED)


@query("tlr9_hexamers", _motif_sql(TLR9))
def tlr9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.motifs(constructs(spark, sf_dir), TLR9)


@query("splice_donors", f"""WITH {SQL}, {_starts_sql(7, 's7')}, {_starts_sql(6, 's6')}, both_ AS (
  SELECT construct_id, CAST(pos AS INT) AS pos, 3.0 AS magnitude FROM s6 WHERE kmer IN ('GGTAAG', 'GGTGAG')
  UNION ALL SELECT construct_id, CAST((pos + 1) % length AS INT), 1.0 FROM s7 WHERE regexp_full_match(kmer, 'A[ACGT]GT[AG]AG'))
SELECT construct_id, pos, CAST(max(magnitude) AS DOUBLE) AS magnitude FROM both_ GROUP BY construct_id, pos""")  # fmt: skip
def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.splice_donors(constructs(spark, sf_dir))


@query("polya_sites_with_dse", f"""WITH {SQL}, {_starts_sql(46, 's46')}
SELECT construct_id, CAST(pos AS INT) AS pos, substring(kmer, 1, 6) AS hexamer, CAST(CASE WHEN substring(kmer, 1, 6) NOT IN ('AATAAA', 'ATTAAA') THEN 0.2
  WHEN regexp_matches(substring(kmer, 17, 30), 'GTGT|TGTG') OR list_contains(list_transform(range(1, 26), lambda i: length(regexp_replace(substring(substring(kmer, 17, 30), i, 6), '[^T]', '', 'g')) >= 4), true) THEN 3.0 ELSE 1.0 END AS DOUBLE) AS magnitude
FROM s46 WHERE substring(kmer, 1, 6) IN ({', '.join(f"'{x}'" for x in (*transcript.POLYA, *transcript.POLYA_VARIANTS))})""")  # fmt: skip
def polya(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.polya_sites(constructs(spark, sf_dir))


def _near(k: str, motif: str) -> str:
    return "(" + " + ".join(f"CAST(substring({k}, {i + 1}, 1) <> '{c}' AS INT)" for i, c in enumerate(motif)) + ") <= 1"


@query("promoter_architecture", f"""WITH {SQL}, {_starts_sql(6, 's6', False)}, m35 AS (SELECT construct_id, pos FROM s6 WHERE {_near('kmer', 'TTGACA')}), m10 AS (SELECT construct_id, pos FROM s6 WHERE {_near('kmer', 'TATAAT')})
SELECT a.construct_id, CAST(a.pos AS INT) AS minus35, CAST(b.pos AS INT) AS minus10, CAST(b.pos - a.pos - 6 AS INT) AS spacer FROM m35 a JOIN m10 b ON a.construct_id = b.construct_id AND b.pos - a.pos - 6 BETWEEN 15 AND 19""")  # fmt: skip
def promoters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.promoters(constructs(spark, sf_dir))


@query("promoter_at_tracts", f"""WITH {SQL}, {_starts_sql(6, 's6', False)}, {_starts_sql(7, 's7', False)}, {_starts_sql(5, 's5', False)}, m10 AS (SELECT construct_id, pos FROM s6 WHERE {_near('kmer', 'TATAAT')}),
t AS (SELECT construct_id, pos, pos + 7 AS stop, kmer FROM s7 WHERE kmer = 'TATTTAT' UNION ALL SELECT construct_id, pos, pos + 5, kmer FROM s5 WHERE kmer = 'AATTT')
SELECT t.construct_id, t.kmer AS tract, CAST(t.pos AS INT) AS tract_pos, CAST(m10.pos AS INT) AS minus10 FROM t JOIN m10 ON t.construct_id = m10.construct_id AND t.stop + 4 = m10.pos""")  # fmt: skip
def at_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.at_tracts(constructs(spark, sf_dir))


@query("kozak_tier", f"""WITH {SQL}, {_starts_sql(11, 's11')}
SELECT construct_id, CAST((pos + 6) % length AS INT) AS atg, CAST(CAST(substring(kmer, 4, 1) IN ('A', 'G') AS INT) + CAST(substring(kmer, 10, 1) = 'G' AS INT) AS INT) AS tier FROM s11 WHERE substring(kmer, 7, 3) = 'ATG'""")
def kozak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.kozak(constructs(spark, sf_dir))


@query("out_of_frame_atg", f"""WITH {SQL}, {CODING_SQL}, atg AS (SELECT construct_id, cds, unnest(range(1, length(cds) - 2)) AS pos FROM coding), hit AS (SELECT construct_id, pos, substring(cds, greatest(pos - 2, 1), 1) AS minus3, pos >= 3 AS has, substring(cds, pos + 4, 1) AS plus4 FROM atg WHERE substring(cds, pos + 1, 3) = 'ATG')
SELECT construct_id, CAST(pos AS INT) AS pos, pos % 3 <> 0 AS out_of_frame, has AND minus3 IN ('A', 'G') AND plus4 = 'G' AS strong, CAST(CASE WHEN pos < 50 THEN 10.0 WHEN pos % 3 <> 0 AND has AND minus3 IN ('A', 'G') AND plus4 = 'G' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS magnitude FROM hit""")  # fmt: skip
def extra_atg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.extra_starts(coding(spark, sf_dir))


@query("regex_sites_non_overlapping", f"""WITH {SQL}, m AS (SELECT construct_id, seq, regexp_extract_all(seq, '(T[ACGT]{{2}}TA|ACAT[ACGT]T)') AS t FROM constructs)
SELECT construct_id, CAST(len(t) AS INT) AS n, CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS bases, coalesce(t[1], '') AS first_text FROM m WHERE len(t) > 0""")
def regex_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.sites(constructs(spark, sf_dir), {"site": "T[ACGT]{2}TA|ACAT[ACGT]T"})
    return found.groupBy("construct_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.min_by("text", "start").alias("first_text"))


@query("recombinase_sites", f"""WITH {SQL}, s AS (SELECT construct_id, 'Gateway_core' AS name, unnest(regexp_extract_all(seq, 'TTTGTACAAA[AG]')) AS text FROM constructs
  UNION ALL SELECT construct_id, 'loxP_half_site', unnest(regexp_extract_all(seq, 'ATAACTTCGTATA|TATACGAAGTTAT')) FROM constructs)
SELECT construct_id, name, count(*) AS n FROM s GROUP BY construct_id, name""")
def recombinases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.recombinase_sites(constructs(spark, sf_dir)).groupBy("construct_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("g4_sites")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.quadruplexes(constructs(spark, sf_dir))


GC_SQL = "(length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))"


@query("gc_fraction", f"WITH {SQL} SELECT construct_id, CASE WHEN length > 0 THEN {GC_SQL} / length ELSE 0.0 END AS gc FROM constructs")
def gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constructs(spark, sf_dir).select("construct_id", dna.gc_fraction(F.col("seq")).alias("gc"))


def _gc_sql(width: int, circular: bool = True, name: str = "gcw") -> str:
    around = f"CASE WHEN circular THEN seq || substring(seq, 1, {width - 1}) ELSE seq END" if circular else "seq"
    return f"""{name}_b AS (SELECT construct_id, length, circular, pos, CAST(substring(hay, pos + 1, 1) IN ('G', 'C') AS INT) AS g, n FROM (SELECT construct_id, length, circular, hay, length(hay) AS n, unnest(range(0, length(hay))) AS pos FROM (SELECT construct_id, length, circular, {around} AS hay FROM constructs WHERE length >= {width}) h) x),
{name} AS (SELECT construct_id, length, circular, CAST(pos AS INT) AS pos, gc FROM (SELECT construct_id, length, circular, pos, n, sum(g) OVER (PARTITION BY construct_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) / {width} AS gc FROM {name}_b) y WHERE pos <= n - {width})"""


@query("gc_window_100", f"WITH {SQL}, {_gc_sql(100)} SELECT construct_id, count(*) AS windows, min(gc) AS least, max(gc) AS most, sum(CAST(gc < 0.35 OR gc > 0.65 AS INT))::BIGINT AS hard FROM gcw GROUP BY construct_id")
def gc_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = ((F.col("gc") < 0.35) | (F.col("gc") > 0.65)).cast("long")
    return windows.gc_windows(constructs(spark, sf_dir), 100).groupBy("construct_id").agg(F.count(F.lit(1)).alias("windows"), F.min("gc").alias("least"), F.max("gc").alias("most"), F.sum(hard).alias("hard"))


@query("gc_strided_windows", f"WITH {SQL}, {_gc_sql(50, False)} SELECT construct_id, pos, gc FROM gcw WHERE pos % 10 = 0")
def gc_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gc_windows(constructs(spark, sf_dir).withColumn("circular", F.lit(False)), 50, 10).select("construct_id", "pos", "gc")


@query("gc_window_islands", f"""WITH {SQL}, {_gc_sql(100)}, f AS (SELECT *, greatest(0.45 - gc, gc - 0.60, 0) AS dev FROM gcw WHERE gc < 0.45 OR gc > 0.60), g AS (SELECT *, pos - row_number() OVER (PARTITION BY construct_id ORDER BY pos) AS grp FROM f),
r AS (SELECT construct_id, length, circular, grp, min(pos) AS a, max(pos) AS b, max(dev) AS dev FROM g GROUP BY ALL), w AS (SELECT *, circular AND min(a) OVER q = 0 AND max(b) OVER q = length - 1 AND count(*) OVER q > 1 AS wraps FROM r WINDOW q AS (PARTITION BY construct_id)),
k AS (SELECT construct_id, CASE WHEN wraps AND (a = 0 OR b = length - 1) THEN -1 ELSE a END AS k, CASE WHEN wraps AND a = 0 THEN NULL ELSE a END AS a, CASE WHEN wraps AND a = 0 THEN b + length WHEN wraps AND b = length - 1 THEN NULL ELSE b END AS b, dev FROM w)
SELECT construct_id, CAST(max(a) AS INT) AS start, CAST(max(b) + 100 AS INT) AS "end", max(dev) AS worst FROM k GROUP BY construct_id, k""")  # fmt: skip
def gc_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = F.greatest(0.45 - F.col("gc"), F.col("gc") - 0.60, F.lit(0.0))
    flagged = windows.gc_windows(constructs(spark, sf_dir), 100).where("gc < 0.45 or gc > 0.60").withColumn("dev", dev)
    return windows.islands(flagged, 100, F.max("dev"), "worst")


@query("gc_dispersion_ratio", f"""WITH {SQL}, {_gc_sql(100, False)}, s AS (SELECT construct_id, stddev_pop(gc) AS sd FROM gcw GROUP BY construct_id), c AS (SELECT construct_id, {GC_SQL} / length AS gc FROM constructs WHERE length >= 100)
SELECT construct_id, gc, round(sd, 9) AS sd, round(sqrt(gc * (1 - gc) / 100), 9) AS floor, round(CASE WHEN gc * (1 - gc) > 0 THEN sd / sqrt(gc * (1 - gc) / 100) ELSE 0.0 END, 9) AS ratio FROM c JOIN s USING (construct_id)""")
def gc_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dispersion(constructs(spark, sf_dir).where("length >= 100")).select("construct_id", "gc", *[F.round(c, 9).alias(c) for c in ("sd", "floor", "ratio")])


@query("cpg_obs_exp", f"""WITH {SQL}, c AS (SELECT construct_id, length, length - length(replace(seq, 'C', '')) AS c, length - length(replace(seq, 'G', '')) AS g, (length - length(replace(seq, 'CG', ''))) // 2 AS cg FROM constructs)
SELECT construct_id, CAST(cg AS INT) AS cpg, CASE WHEN c * g > 0 THEN cg * length / (c * g) ELSE 0.0 END AS obs_exp FROM c""")
def cpg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.cpg_ratio(constructs(spark, sf_dir))


@query("cpg_windows", f"""WITH {SQL}, {_starts_sql(2, 's2', False)}, p AS (SELECT construct_id, pos FROM s2 WHERE kmer = 'CG'), w AS (SELECT construct_id, pos, count(*) OVER q AS n, max(pos) OVER q AS last FROM p WINDOW q AS (PARTITION BY construct_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 198 FOLLOWING))
SELECT construct_id, CAST(pos AS INT) AS pos, CAST(n AS INT) AS cpg, (last - pos) / (n - 1) AS spacing FROM w WHERE n >= 14 AND (last - pos) / (n - 1) <= 14""")
def cpg_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.cpg_clusters(constructs(spark, sf_dir))


@query("homopolymer_runs", f"""WITH {SQL}, {_starts_sql(1, 's1', False)}, n AS (SELECT *, CASE WHEN kmer = lag(kmer) OVER (PARTITION BY construct_id ORDER BY pos) THEN 0 ELSE 1 END AS nw FROM s1), g AS (SELECT *, sum(nw) OVER (PARTITION BY construct_id ORDER BY pos) AS grp FROM n),
r AS (SELECT construct_id, length, circular, grp, kmer AS base, min(pos) AS start, count(*) AS run FROM g GROUP BY ALL), f AS (SELECT *, max(CASE WHEN start = 0 THEN base END) OVER q AS fb, max(CASE WHEN start = 0 THEN run END) OVER q AS fr, max(CASE WHEN start + run = length THEN base END) OVER q AS lb, count(*) OVER q AS c FROM r WINDOW q AS (PARTITION BY construct_id)),
j AS (SELECT *, circular AND fb = lb AND c > 1 AS joins FROM f)
SELECT construct_id, base, CAST(start AS INT) AS start, CAST(CASE WHEN joins AND start + run = length THEN run + fr ELSE run END AS INT) AS run FROM j WHERE NOT (joins AND start = 0) AND CASE WHEN joins AND start + run = length THEN run + fr ELSE run END >= 4""")  # fmt: skip
def homopolymers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.homopolymers(constructs(spark, sf_dir), 4)


def _tandem_sql(unit: int, least: int) -> str:
    return f"""SELECT construct_id, {unit} AS unit, CAST(min(pos) AS INT) AS start, CAST(count(*) + {unit} AS INT) AS tract FROM (SELECT construct_id, pos, pos - row_number() OVER (PARTITION BY construct_id ORDER BY pos) AS g FROM (SELECT construct_id, pos, kmer, lead(kmer, {unit}) OVER (PARTITION BY construct_id ORDER BY pos) AS nx FROM s1) a WHERE kmer = nx) b GROUP BY construct_id, g HAVING count(*) + {unit} >= {max(least, 2 * unit)}"""


@query("tandem_tracts_p2_p6", f"""WITH {SQL}, {_starts_sql(1, 's1', False)}, t AS ({' UNION ALL '.join(_tandem_sql(u, 12) for u in range(1, 7))})
SELECT * FROM t i WHERE unit >= 2 AND NOT EXISTS (SELECT 1 FROM t o WHERE o.construct_id = i.construct_id AND o.unit < i.unit AND o.start <= i.start AND i.start + i.tract <= o.start + o.tract)""")
def tandem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.tandem_tracts(constructs(spark, sf_dir), least=12)


@query("kmer_density_9", f"""WITH {SQL}, {_starts_sql(9, 's9', False)}, c AS (SELECT construct_id, length, kmer, count(*) AS n FROM s9 GROUP BY ALL)
SELECT construct_id, CAST(sum(CAST(n >= 2 AS INT)) AS BIGINT) AS repetitive, sum(CAST(n >= 2 AS INT)) / (length / 100.0) AS per_100 FROM c GROUP BY construct_id, length""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.density(constructs(spark, sf_dir))


@query("kmer_uniqueness_12", f"""WITH {SQL}, {_starts_sql(12, 's12')}, c AS (SELECT construct_id, kmer, count(*) AS n FROM s12 GROUP BY ALL)
SELECT construct_id, CAST(sum(n) AS BIGINT) AS positions, CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS BIGINT) AS recurring, sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n) AS fraction FROM c GROUP BY construct_id""")
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.recurrence(constructs(spark, sf_dir))


@query("kmer_landing_sites", f"""WITH {SQL}, {_starts_sql(12, 's12', False)}, l AS (SELECT construct_id, kmer, CAST(coalesce(pos - lag(pos) OVER (PARTITION BY construct_id, kmer ORDER BY pos), 12) >= 12 AS INT) AS nw FROM s12)
SELECT construct_id, kmer, CAST(sum(nw) AS BIGINT) AS sites FROM l GROUP BY construct_id, kmer HAVING sum(nw) >= 3""")
def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.landing_sites(constructs(spark, sf_dir))


@query("adjacent_repeat_seeds", f"""WITH {SQL}, {_starts_sql(15, 's15')}, n AS (SELECT construct_id, pos, lead(pos) OVER (PARTITION BY construct_id, kmer ORDER BY pos) AS nx FROM s15)
SELECT construct_id, CAST(pos AS INT) AS pos, CAST(nx AS INT) AS next FROM n WHERE nx IS NOT NULL""")
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.adjacent_seeds(constructs(spark, sf_dir), 15)


@query("inverted_seed_pairs", f"""WITH {SQL}, {_starts_sql(10, 's', False)}, r AS (SELECT construct_id, pos, reverse(translate(kmer, 'ACGT', 'TGCA')) AS kmer FROM s)
SELECT s.construct_id, CAST(s.pos AS INT) AS "left", CAST(r.pos AS INT) AS "right", CAST(r.pos - s.pos - 10 AS INT) AS gap FROM s JOIN r ON s.construct_id = r.construct_id AND s.kmer = r.kmer AND r.pos - s.pos - 10 BETWEEN 0 AND 100""")
def inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.inverted_seeds(constructs(spark, sf_dir), 10)


@query("direct_repeats")
def direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmers.direct_repeats(constructs(spark, sf_dir))
    return found.withColumn("risk", codon_ops.repeat_risk(F.col("length"), F.col("spacer"), F.col("spacer") == 0))


@query("inverted_repeats")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.inverted_repeats(constructs(spark, sf_dir))


@query("near_perfect_repeats")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.near_repeats(constructs(spark, sf_dir))


AA_SQL = "aa AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in sorted(dims.genetic_code(1).items())) + ") v(codon, aa))"
COUNTS_SQL = f"{SQL}, {CODING_SQL}, {CODONS_SQL}, {AA_SQL}, counts AS (SELECT aa.codon, aa.aa, count(c.codon) AS n FROM aa LEFT JOIN codons c ON aa.codon = c.codon GROUP BY aa.codon, aa.aa)"
W_SQL = f"{COUNTS_SQL}, w AS (SELECT codon, aa, (n + 0.5) / max(n + 0.5) OVER (PARTITION BY aa) AS w FROM counts WHERE aa <> '*')"


@query("codon_usage_counts", f"WITH {COUNTS_SQL} SELECT codon, aa, n FROM counts")
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon_ops.usage_counts(coding(spark, sf_dir), 1)


@query("codon_weights", f"WITH {W_SQL} SELECT codon, aa, w FROM w")
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon_ops.weights(codon_ops.usage_counts(coding(spark, sf_dir), 1))


@query("cai_by_doc", f"""WITH {W_SQL}, s AS (SELECT construct_id, avg(ln(w)) AS m FROM codons JOIN w USING (codon) WHERE aa NOT IN ('M', 'W') GROUP BY construct_id)
SELECT construct_id, round(CASE WHEN m IS NULL THEN 0.0 ELSE exp(m) END, 9) AS cai FROM coding LEFT JOIN s USING (construct_id)""")
def cai(spark: SparkSession, sf_dir: str) -> DataFrame:
    cds = coding(spark, sf_dir)
    return codon_ops.cai(cds, codon_ops.weights(codon_ops.usage_counts(cds, 1))).withColumn("cai", F.round("cai", 9))


@query("chance_cai", f"""WITH {W_SQL}, f AS (SELECT aa, avg(ln(w)) AS m FROM w WHERE aa NOT IN ('M', 'W') GROUP BY aa), s AS (SELECT construct_id, avg(m) AS m FROM codons JOIN aa USING (codon) JOIN f USING (aa) GROUP BY construct_id)
SELECT construct_id, round(exp(m), 9) AS chance_cai FROM s""")
def chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cds = coding(spark, sf_dir)
    return codon_ops.chance_cai(cds, codon_ops.weights(codon_ops.usage_counts(cds, 1))).withColumn("chance_cai", F.round("chance_cai", 9))


@query("codon_family_stats", f"WITH {COUNTS_SQL} SELECT aa, round(avg(n), 9) AS mean, max(n) AS top, min(n) AS low FROM counts WHERE aa <> '*' GROUP BY aa HAVING count(*) > 1 AND min(n) > 0")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codon_ops.family_stats(codon_ops.usage_counts(coding(spark, sf_dir), 1)).select("aa", F.round("mean", 9).alias("mean"), "top", "low")


@query("minmax_profile", f"""WITH {COUNTS_SQL}, st AS (SELECT aa, avg(n) AS mean, max(n) AS top, min(n) AS low FROM counts WHERE aa <> '*' GROUP BY aa HAVING count(*) > 1 AND min(n) > 0),
j AS (SELECT construct_id, i, CASE WHEN mean IS NOT NULL THEN n END AS freq, mean, top, low FROM codons JOIN counts USING (codon) LEFT JOIN st USING (aa)), f AS (SELECT construct_id, i, coalesce(sum(freq) OVER q, 0) AS f, coalesce(sum(mean) OVER q, 0) AS m, coalesce(sum(top) OVER q, 0) AS t, coalesce(sum(low) OVER q, 0) AS l FROM j WINDOW q AS (PARTITION BY construct_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 9 FOLLOWING))
SELECT construct_id, CAST(count(*) AS BIGINT) AS codons, round(avg(CASE WHEN f >= m AND t > m THEN 100 * (f - m) / (t - m) WHEN m > l THEN -100 * (m - f) / (m - l) ELSE 0.0 END), 5) AS mean_min_max FROM f GROUP BY construct_id""")  # fmt: skip
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    cds = coding(spark, sf_dir)
    counts = codon_ops.usage_counts(cds, 1)
    rows = codon_ops.codon_rows(cds).join(F.broadcast(counts), "codon").select("construct_id", "i", F.col("n").cast("double").alias("freq"), "aa")
    profile = windows.min_max_profile(rows, codon_ops.family_stats(counts))
    return profile.groupBy("construct_id").agg(F.count(F.lit(1)).alias("codons"), F.round(F.avg("min_max"), 5).alias("mean_min_max"))


@query("translate_cds", f"""WITH {SQL}, {CODING_SQL}, {CODONS_SQL}, {AA_SQL} SELECT construct_id, string_agg(aa, '' ORDER BY i) AS protein FROM codons JOIN aa USING (codon) GROUP BY construct_id""")
def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding(spark, sf_dir).select("construct_id", dna.translate(F.col("cds"), dims.genetic_code(1)).alias("protein"))


@query("orf_longest", f"""WITH {SQL}, {_starts_sql(3, 's3', False)}, a AS (SELECT construct_id, pos FROM s3 WHERE kmer = 'ATG'), z AS (SELECT construct_id, pos FROM s3 WHERE kmer IN ('TAA', 'TAG', 'TGA')),
n AS (SELECT a.construct_id, a.pos, min(z.pos) AS stop FROM a JOIN z ON a.construct_id = z.construct_id AND z.pos > a.pos AND (z.pos - a.pos) % 3 = 0 GROUP BY a.construct_id, a.pos)
SELECT construct_id, CAST(min(pos) AS INT) AS start, CAST(stop + 3 AS INT) AS "end" FROM n GROUP BY construct_id, stop""")
def orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.open_reading_frames(constructs(spark, sf_dir))


@query("codon_distance_matrix", f"""WITH {SQL}, {CODING_SQL}, {CODONS_SQL}, c AS (SELECT construct_id, list(codon ORDER BY i) AS cs FROM codons GROUP BY construct_id), p AS (SELECT a.construct_id AS a, b.construct_id AS b, a.cs AS x, b.cs AS y FROM c a JOIN c b ON a.construct_id < b.construct_id AND len(a.cs) = len(b.cs))
SELECT a, b, list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST(x[i] <> y[i] AS INT))) / len(x) AS distance FROM p""")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Designs of one panel have one length; here length groups stand for panels.
    return codon_ops.distances(coding(spark, sf_dir))


@query("homology_arm_tm")
def arm_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tm of the 20 bases at each construct's origin, both nearest-neighbour terms and salt."""
    return constructs(spark, sf_dir).where("length >= 20").select("construct_id", F.round(dna.melting_temperature(F.substring("seq", 1, 20)), 4).alias("tm"))


@query("kmer_top_recurring", f"""WITH {SQL}, {_starts_sql(9, 's9', False)}, c AS (SELECT construct_id, kmer, count(*) AS n FROM s9 GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY n DESC, kmer) AS rank FROM c)
SELECT construct_id, kmer, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def top_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.top_recurring(constructs(spark, sf_dir))
