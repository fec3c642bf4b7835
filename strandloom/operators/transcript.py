"""Transcript-level scans: start contexts, splice donors, polyadenylation, promoters, CpG, quadruplexes, reading frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna
from . import scan
from .scan import positions

#: Polyadenylation hexamers and their weak variants: fixed values.
POLYA = ("AATAAA", "ATTAAA")
POLYA_VARIANTS = ("AGTAAA", "TATAAA", "CATAAA", "GATAAA", "AATATA", "AATACA", "AATAGA", "ACTAAA", "AAGAAA", "AATGAA")
#: Promoter boxes and spacer: fixed values.
MINUS_35, MINUS_10, SPACER = "TTGACA", "TATAAT", (15, 19)
AT_TRACTS, AT_GAP = ("TATTTAT", "AATTT"), 4
#: Recombinase sites, whole and partial: fixed values.
RECOMBINASE = {
    "loxP_family": "ATAACTTCGTATA[ACGT]{8}TATACGAAGTTAT",
    "FRT": "GAAGTTCCTATTC[ACGT]{8}GTATAGGAACTTC",
    "Gateway_attB1": "ACAAGTTTGTACAAAAAAGCAGGCT",
    "Gateway_attB2": "ACCCAGCTTTCTTGTACAAAGTGGT",
}
RECOMBINASE_PARTS = {"loxP_half_site": "ATAACTTCGTATA|TATACGAAGTTAT", "Gateway_core": "TTTGTACAAA[AG]"}
#: Quadruplex and telomere patterns: fixed values.
QUADRUPLEX = "G{3,}[ACGT]{1,7}G{3,}[ACGT]{1,7}G{3,}[ACGT]{1,7}G{3,}"
TELOMERES = {"vertebrate": "(?:TTAGGG){2,}", "plant": "(?:TTTAGGG){2,}", "ciliate_4": "(?:TTGGGG){2,}", "ciliate_8": "(?:TTTTGGGG){2,}"}


def splice_donors(df: DataFrame) -> DataFrame:
    """``construct_id, pos, magnitude``: GGTAAG and GGTGAG score 3, the 7-base consensus ANGTRAG 1; the stronger counts.

    ``pos`` is the base before GT.
    """
    hits = scan.motifs(df, {"a": "GGTAAG", "b": "GGTGAG", "c": "ANGTRAG"}, both_strands=False)
    sized = hits.join(df.select("construct_id", "length"), "construct_id")
    at = F.when(F.col("name") == "c", (F.col("pos") + 1) % F.col("length")).otherwise(F.col("pos"))
    return sized.groupBy("construct_id", at.alias("pos")).agg(F.max(F.when(F.col("name") == "c", 1.0).otherwise(3.0)).alias("magnitude"))


def _gu_rich(window: Column) -> Column:
    """GTGT or TGTG, or four T among six bases."""
    many = F.exists(F.sequence(F.lit(1), F.length(window) - 5), lambda i: dna.count_of(F.substring(window, i, 6), "T") >= 4)
    return window.rlike("GTGT|TGTG") | many


def polya_sites(df: DataFrame) -> DataFrame:
    """``construct_id, pos, hexamer, magnitude``: 3 with a GU-rich element 10 to 40 bases on, 1 without, variants 0.2.

    Sites whose window would run off a line's end are not looked at.
    """
    rows = positions(df, 46).withColumn("hexamer", F.substring("kmer", 1, 6)).where(F.col("hexamer").isin(*POLYA, *POLYA_VARIANTS))
    strong = _gu_rich(F.substring("kmer", 17, 30))
    return rows.select("construct_id", "pos", "hexamer", F.when(~F.col("hexamer").isin(*POLYA), 0.2).when(strong, 3.0).otherwise(1.0).alias("magnitude"))


def promoters(df: DataFrame) -> DataFrame:
    """``construct_id, minus35, minus10, spacer`` of boxes within one mismatch, 15 to 19 bases apart: a band join on construct.

    The spacer takes five values, so it is five equi-keys and no pair outside the band is made.
    """
    ups = scan.near_hits(df, MINUS_35).select("construct_id", F.col("pos").alias("minus35"), F.explode(F.sequence(F.col("pos") + 6 + SPACER[0], F.col("pos") + 6 + SPACER[1])).alias("minus10"))
    tens = scan.near_hits(df, MINUS_10).select("construct_id", F.col("pos").alias("minus10"))
    return ups.join(tens, ["construct_id", "minus10"]).select("construct_id", "minus35", "minus10", (F.col("minus10") - F.col("minus35") - 6).alias("spacer"))


def at_tracts(df: DataFrame) -> DataFrame:
    """``construct_id, tract, tract_pos, minus10`` of A/T tracts that end exactly 4 bases before a -10 box."""
    tens = scan.near_hits(df, MINUS_10).select("construct_id", F.col("pos").alias("minus10"))
    found = scan.motifs(df.withColumn("circular", F.lit(False)), {t: t for t in AT_TRACTS}, both_strands=False)
    tracts = found.select("construct_id", F.col("name").alias("tract"), F.col("pos").alias("tract_pos"), (F.col("pos") + F.length("name") + AT_GAP).alias("minus10"))
    return tracts.join(tens, ["construct_id", "minus10"]).select("construct_id", "tract", "tract_pos", "minus10")


def kozak(df: DataFrame) -> DataFrame:
    """``construct_id, atg, tier`` of every ATG with its whole context: one point for A/G at -3, one for G at +4."""
    rows = positions(df, 11).where(F.substring("kmer", 7, 3) == "ATG")
    tier = F.substring("kmer", 4, 1).isin("A", "G").cast("int") + (F.substring("kmer", 10, 1) == "G").cast("int")
    return rows.select("construct_id", ((F.col("pos") + 6) % F.col("length")).alias("atg"), tier.alias("tier"))


def extra_starts(cds: DataFrame, scan_nt: int = 50) -> DataFrame:
    """``construct_id, pos, out_of_frame, strong, magnitude`` of ATGs behind the first codon position."""
    rows = cds.where(F.length("cds") > 3).select("construct_id", "cds", F.explode(scan._starts(F.col("cds"), "ATG", 3)).alias("pos")).where("pos >= 1")
    strong = (F.col("pos") >= 3) & F.expr("substring(cds, greatest(pos - 2, 1), 1) in ('A', 'G')") & F.expr("substring(cds, pos + 4, 1) = 'G'")
    out = F.col("pos") % 3 != 0
    return rows.select("construct_id", "pos", out.alias("out_of_frame"), strong.alias("strong"), F.when(F.col("pos") < scan_nt, 10.0).when(out & strong, 1.0).otherwise(0.0).alias("magnitude"))


def recombinase_sites(df: DataFrame) -> DataFrame:
    """``construct_id, name, start, end, magnitude``: whole sites 1, partial ones 0.3 unless inside a whole one (range anti-join)."""
    whole = scan.sites(df, RECOMBINASE).withColumn("magnitude", F.lit(1.0))
    part = scan.sites(df, RECOMBINASE_PARTS).withColumn("magnitude", F.lit(0.3)).alias("p")
    w = whole.alias("w")
    inside = (F.col("p.construct_id") == F.col("w.construct_id")) & (F.col("w.start") <= F.col("p.start")) & (F.col("p.end") <= F.col("w.end"))
    return whole.unionByName(part.join(w, inside, "left_anti").select("construct_id", "name", "start", "end", "text", "magnitude"))


def g4hunter(seq: str, window: int = 25) -> float:
    """Peak of the mean run score over windows; runs are counted afresh inside each window, up to 4."""

    def mean(text: str) -> float:
        total = i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] == text[i]:
                j += 1
            run = min(j - i, 4) * (j - i)
            total += run if text[i] == "G" else -run if text[i] == "C" else 0
            i = j
        return total / len(text) if text else 0.0

    return max((mean(seq[i : i + window]) for i in range(max(1, len(seq) - window + 1))), key=abs, default=0.0)


def g4hunter_peak(text: Column) -> Column:
    """The peak score as an Arrow-batched function; there is no built-in for run scores inside windows."""

    def peaks(texts: pd.Series) -> pd.Series:
        return texts.map(g4hunter)

    return F.pandas_udf(peaks, "double")(text)


def quadruplexes(df: DataFrame) -> DataFrame:
    """``construct_id, name, start, end, strand, peak, magnitude`` of quadruplex and telomere patterns on both strands."""
    back = df.withColumn("seq", dna.reverse_complement(F.col("seq")))
    patterns = {"quadruplex": QUADRUPLEX} | TELOMERES
    fwd = scan.sites(df, patterns).withColumn("strand", F.lit(1))
    size = df.select("construct_id", "length")
    rev = scan.sites(back, patterns).join(size, "construct_id").select("construct_id", "name", (F.col("length") - F.col("end")).alias("start"), (F.col("length") - F.col("start")).alias("end"), "text", F.lit(-1).alias("strand"))
    found = fwd.unionByName(rev).withColumn("peak", g4hunter_peak(F.col("text")))
    magnitude = F.when(F.abs("peak") >= 1.5, 2.0).when(F.abs("peak") >= 1.2, 1.0).otherwise(0.3)
    return found.select("construct_id", "name", "start", "end", "strand", "peak", magnitude.alias("magnitude"))


def cpg_ratio(df: DataFrame) -> DataFrame:
    """``construct_id, cpg, obs_exp``: CG * length / (C * G), 0 without C or G."""
    c, g = dna.count_of(F.col("seq"), "C"), dna.count_of(F.col("seq"), "G")
    cg = ((F.length("seq") - F.length(F.regexp_replace("seq", "CG", ""))) / 2).cast("int")
    return df.select("construct_id", cg.alias("cpg"), F.when(c * g > 0, cg * F.col("length") / (c * g)).otherwise(0.0).alias("obs_exp"))


def cpg_clusters(df: DataFrame, window: int = 200, least: int = 14, spacing: float = 14.0) -> DataFrame:
    """``construct_id, pos, cpg, spacing`` of windows that begin at a CpG and hold dense CpGs (a range frame over CpG positions)."""
    rows = scan.motifs(df.withColumn("circular", F.lit(False)), {"CG": "CG"}, both_strands=False).select("construct_id", "pos")
    frame = Window.partitionBy("construct_id").orderBy("pos").rangeBetween(0, window - 2)
    n, mean = F.count(F.lit(1)).over(frame), (F.max("pos").over(frame) - F.col("pos"))
    made = rows.withColumn("cpg", n.cast("int")).withColumn("_reach", mean)
    return made.where((F.col("cpg") >= least) & (F.col("_reach") / (F.col("cpg") - 1) <= spacing)).select("construct_id", "pos", "cpg", (F.col("_reach") / (F.col("cpg") - 1)).alias("spacing"))


def open_reading_frames(df: DataFrame, table_id: int = 1) -> DataFrame:
    """``construct_id, start, end`` of the longest frame to each stop, forward strand.

    The next in-frame stop is a window minimum over the construct's frame, not a join of starts with stops.
    """
    rows = positions(df.withColumn("circular", F.lit(False)), 3).where(F.col("kmer").isin("ATG", *dims.stops(table_id)))
    w = Window.partitionBy("construct_id", F.col("pos") % 3).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    stop = F.min(F.when(F.col("kmer") != "ATG", F.col("pos"))).over(w)
    starts = rows.withColumn("stop", stop).where("kmer = 'ATG' and stop is not null")
    return starts.groupBy("construct_id", "stop").agg(F.min("pos").alias("start")).select("construct_id", "start", (F.col("stop") + 3).alias("end"))
