"""Independent verification of constructs.  Imports no rule, solver or scan module.

Every check is a boolean column; :func:`require` turns a false one into an error at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims


def _translate(cds: Column, table_id: int) -> Column:
    code = dims.genetic_code(table_id)
    table = F.create_map(*[F.lit(x) for c, a in sorted(code.items()) for x in (c, a)])
    triplets = F.regexp_extract_all(cds, F.lit("(...)"), F.lit(1))
    return F.array_join(F.transform(triplets, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def _revcomp(text: str) -> str:
    return text.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def checks(df: DataFrame, table_id: int, forbidden: list[str], gc: tuple[float, float], max_homopolymer: int | None = None) -> DataFrame:
    """Invariant columns for ``construct_id, seq, circular, cds_start, cds_end, protein`` with optional ``reference``.

    i1 alphabet; i2 frame; i3 translation equals ``protein`` (where given); i4 begins at a start codon; i5 one stop, at the end;
    i6 no forbidden motif on either strand, over the origin of circles; i7 GC of the coding span in the band; i8 no longer
    homopolymer (where asked); i9 bases outside the coding span equal the reference; i10 coding span inside the construct.
    """
    seq, length = F.col("seq"), F.length("seq")
    cds = F.substring(F.concat(seq, seq), F.col("cds_start") + 1, F.col("cds_end") - F.col("cds_start"))
    rows = df.withColumn("_cds", cds).withColumn("_aa", _translate(F.col("_cds"), table_id))
    aa = F.col("_aa")
    wide = max((len(m) for m in forbidden), default=1)
    around = F.when(F.col("circular"), F.concat(seq, F.substring(seq, 1, wide - 1))).otherwise(seq)
    free = F.lit(True)
    for motif in sorted({m for f in forbidden for m in (f, _revcomp(f))}):
        free = free & ~F.contains(around, F.lit(motif))
    share = F.length(F.regexp_replace("_cds", "[AT]", "")) / F.greatest(F.length("_cds"), F.lit(1))
    starts = [c for c in dims.STARTS.get(table_id, "ATG").split()]
    out = rows.withColumns(
        {
            "i1": seq.rlike("^[ACGT]*$"),
            "i2": F.length("_cds") % 3 == 0,
            "i3": F.coalesce(F.regexp_replace(aa, r"\*$", "") == F.col("protein"), F.lit(True)),
            "i4": F.substring("_cds", 1, 3).isin(*starts),
            "i5": aa.rlike(r"^[^*]*\*$"),
            "i6": free,
            "i7": share.between(*gc),
            "i8": ~around.rlike("|".join(f"{b}{{{max_homopolymer + 1},}}" for b in "ACGT")) if max_homopolymer else F.lit(True),
            "i10": (F.col("cds_start") >= 0) & (F.col("cds_end") > F.col("cds_start")) & (F.col("cds_end") - F.col("cds_start") <= length),
        }
    )
    if "reference" in df.columns:
        head = F.substring(seq, F.lit(1), F.col("cds_start")) == F.substring("reference", F.lit(1), F.col("cds_start"))
        tail = F.expr("right(seq, greatest(length(seq) - cds_end, 0)) = right(reference, greatest(length(seq) - cds_end, 0))")
        out = out.withColumn("i9", head & tail)
    else:
        out = out.withColumn("i9", F.lit(True))
    return out.drop("_cds", "_aa")


INVARIANTS = [f"i{k}" for k in range(1, 11)]


def require(checked: DataFrame) -> DataFrame:
    """The rows, or an error that names the construct and the invariants it breaks."""
    broken = F.array_join(F.array_compact(F.array(*[F.when(~F.col(i), F.lit(i.upper())) for i in INVARIANTS])), ",")
    guard = F.when(broken == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("construct "), F.col("construct_id").cast("string"), F.lit(" breaks "), broken)))
    return checked.where(guard).drop(*INVARIANTS)
