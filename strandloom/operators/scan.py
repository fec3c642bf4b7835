"""Motif and pattern scans.  A scan is a map over constructs: no shuffle, one row per hit.

Overlapping motif hits and non-overlapping regular-expression sites are two operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, dna


def _starts(text: Column, pattern: str, width: int) -> Column:
    """Starts of overlapping matches of a fixed-width pattern.

    A look-ahead splits the text before every match, so the cost is one regular-expression pass over the text, not one
    comparison per base; piece lengths then give the positions.
    """
    ends = arrays.running_sums(F.transform(F.split(text, f"(?={pattern})", -1), F.length))
    found = F.filter(F.concat(F.array(F.lit(0)), ends), lambda at: F.substring(text, at + 1, width).rlike(f"^{pattern}$") & (F.length(text) - at >= width))
    return F.array_distinct(found)


#: Starts per piece in :func:`positions`.
PIECE = 256


def positions(df: DataFrame, k: int) -> DataFrame:
    """``construct_id, length, circular, pos, kmer`` of every start, once round on circles; sequences shorter than ``k`` have none.

    Texts are cut in pieces of ``PIECE`` starts in one pass, each with what a k-mer needs of the pieces behind it, so the work is linear
    in long sequences.
    """
    width = max(PIECE, k)
    hay = dna.haystack(F.col("seq"), F.col("circular"), k)
    cut = F.regexp_extract_all(hay, F.lit(f"(.{{1,{width}}})"), F.lit(1))
    whole = arrays.let(cut, lambda s: F.transform(s, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(s, i + 1), 1, k - 1), F.lit("")))))
    pieces = df.where(F.col("length") >= k).select("construct_id", "length", "circular", F.posexplode(whole).alias("_nth", "_piece"))
    each = pieces.where(F.length("_piece") >= k).select("*", F.explode(F.sequence(F.lit(0), F.least(F.length("_piece") - k, F.lit(width - 1)))).alias("_at"))
    return each.select("construct_id", "length", "circular", (F.col("_nth") * width + F.col("_at")).alias("pos"), F.expr(f"substring(_piece, _at + 1, {k})").alias("kmer"))


def near_hits(df: DataFrame, motif: str) -> DataFrame:
    """``construct_id, pos`` of starts within one mismatch of a plain motif, on a line: one pattern, one pass over the text."""
    one = "|".join(motif[:i] + "[ACGT]" + motif[i + 1 :] for i in range(len(motif)))
    starts = F.when(F.col("length") >= len(motif), _starts(F.col("seq"), f"(?:{one})", len(motif)))
    return df.select("construct_id", F.explode(starts).alias("pos"))


def motifs(df: DataFrame, named: dict[str, str], both_strands: bool = True) -> DataFrame:
    """``construct_id, name, pos, strand`` of IUPAC motifs, overlapping, over the origin of circles.

    A palindrome is reported on the forward strand alone.  Motifs are constants of the plan, not a joined table.
    """
    scans = []
    for name, motif in sorted(named.items()):
        back = dna.complement_text(motif)
        for strand, m in ((1, motif), (-1, back)):
            if strand == 1 or (both_strands and back != motif):
                hay = dna.haystack(F.col("seq"), F.col("circular"), len(m))
                scans.append(_tagged(hay, m, name, strand))
    return df.select("construct_id", F.explode(F.concat(*scans)).alias("h")).select("construct_id", "h.name", "h.pos", "h.strand")


def _tagged(hay: Column, motif: str, name: str, strand: int) -> Column:
    starts = F.when(F.col("length") >= len(motif), _starts(hay, dna.iupac_class(motif), len(motif)))
    tag = F.transform(starts, lambda p: F.struct(F.lit(name).alias("name"), p.alias("pos"), F.lit(strand).alias("strand")))
    return F.coalesce(tag, F.array().cast("array<struct<name:string,pos:int,strand:int>>"))


def split_forbidden(sites: DataFrame, motifs: list[str]) -> DataFrame:
    """``construct_id, usable, carried``: of plain motifs, those that codon choice could still make or avoid, and those that
    the backbone holds anyway, on either strand and over the origin, outside the replaced span ``(start, end)`` of
    ``sites(construct_id, seq, circular, start, end)``.

    Carried motifs must not be asked of a solver, as no codon removes them; they are advice.  Both lists keep the given order.
    Degenerate motifs are an error before any row is read.  A null sequence holds nothing.
    """
    odd = [m for m in motifs if not m or set(m) - set("ACGT")]
    if odd:
        raise ValueError(f"forbidden motifs must be plain ACGT: {odd}")
    kept = F.coalesce(dna.masked(F.col("seq"), F.col("start"), F.col("end")), F.lit(""))
    rows = sites.select("construct_id", F.coalesce("circular", F.lit(False)).alias("circular"), kept.alias("_kept"))
    held = []
    for m in motifs:
        hay = dna.haystack(F.col("_kept"), F.col("circular"), len(m)) if len(m) > 1 else F.col("_kept")
        held.append(F.struct(F.lit(m).alias("m"), (F.contains(hay, F.lit(m)) | F.contains(hay, F.lit(dna.complement_text(m)))).alias("in")))
    told = F.array(*held) if held else F.array().cast("array<struct<m:string,in:boolean>>")
    part = lambda test: F.transform(F.filter("_told", test), lambda x: x["m"])
    return rows.select("construct_id", told.alias("_told")).select("construct_id", part(lambda x: ~x["in"]).alias("usable"), part(lambda x: x["in"]).alias("carried"))


def sites(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """``construct_id, name, start, end, text`` of non-overlapping matches of regular expressions over the forward strand.

    Matches come left to right as ``finditer`` gives them; positions follow from the pieces between them.
    """
    all_ = []
    for name, pattern in sorted(named.items()):
        tokens, gaps = F.regexp_extract_all("seq", F.lit(f"({pattern})"), F.lit(1)), F.split("seq", pattern, -1)
        pairs = F.zip_with(tokens, F.slice(gaps, F.lit(1), F.size(tokens)), lambda t, g: F.struct(t.alias("t"), g.alias("g")))
        all_.append(arrays.let(pairs, lambda p, name=name: _sited(p, name)))
    return df.select("construct_id", F.explode(F.concat(*all_)).alias("h")).select("construct_id", "h.name", "h.start", "h.end", "h.text")


def _sited(pairs: Column, name: str) -> Column:
    ends = arrays.running_sums(F.transform(pairs, lambda p: F.length(p["g"]) + F.length(p["t"])))
    return F.zip_with(pairs, ends, lambda p, e: F.struct(F.lit(name).alias("name"), (e - F.length(p["t"])).alias("start"), e.alias("end"), p["t"].alias("text")))
