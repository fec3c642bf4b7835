"""Column functions over nucleotide strings.  Positions are 0-based, ends exclusive."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC nucleotide codes: fixed values.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
EXPANSION_LIMIT = 1024


_COMPLEMENT = str.maketrans("ACGTRYKMBVDHSWN", "TGCAYRMKVBHDSWN")


def complement_text(seq: str) -> str:
    """Reverse complement of a Python string of ACGT or IUPAC codes."""
    return seq.translate(_COMPLEMENT)[::-1]


def iupac_class(motif: str) -> str:
    """A degenerate motif as a regular expression of the same width."""
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in motif.upper())


def iupac_expand(motif: str, limit: int | None = EXPANSION_LIMIT) -> list[str]:
    """All plain motifs of a degenerate one, sorted; an error if empty, unknown or more than ``limit``."""
    if not motif or set(motif.upper()) - set(IUPAC):
        raise ValueError(f"not an IUPAC motif: {motif!r}")
    size = 1
    for c in motif.upper():
        size *= len(IUPAC[c])
    if limit is not None and size > limit:
        raise ValueError(f"{motif} expands to {size} motifs; the limit is {limit}")
    return sorted("".join(x) for x in product(*(IUPAC[c] for c in motif.upper())))


def strand_closure(motifs: list[str]) -> list[str]:
    """Plain motifs of degenerate ones and their reverse complements, sorted and distinct.

    Nothing is dropped for containing another motif: each pattern is kept or left out by itself.
    """
    plain = {m for motif in motifs for m in iupac_expand(motif)}
    return sorted(plain | {complement_text(m) for m in plain})


def derive_sequence(text: Column) -> Column:
    """The ACGT letters of a text, in order."""
    return F.regexp_replace(F.upper(text), "[^ACGT]+", "")


def derive_protein(text: Column) -> Column:
    """Met, then the amino-acid letters of a text; only ASCII letters change case, as some letters grow when they do."""
    upper = F.translate(text, "acdefghiklmnpqrstvwy", "ACDEFGHIKLMNPQRSTVWY")
    return F.concat(F.lit("M"), F.regexp_replace(upper, "[^ACDEFGHIKLMNPQRSTVWY]+", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are in ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_fraction(seq: Column) -> Column:
    """(G + C) / length; 0 for the empty sequence."""
    return F.when(F.length(seq) > 0, count_of(seq, "GC") / F.length(seq)).otherwise(F.lit(0.0))


def haystack(seq: Column, circular: Column, k: int) -> Column:
    """Linear text in which every k-mer of a circular sequence occurs once."""
    return F.when(circular, F.concat(seq, F.substring(seq, 1, k - 1))).otherwise(seq)


def circular_slice(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Text of an interval that may run past the end of a circular sequence, read on its strand."""
    plus = F.substring(F.concat(seq, seq), start + 1, end - start)
    return F.when(strand < 0, reverse_complement(plus)).otherwise(plus)


def masked(seq: Column, start: Column, end: Column) -> Column:
    """``seq`` with N in [start, end), which may run over the origin; N is no base, so no motif is found there."""
    n = F.length(seq)
    over = F.least(F.greatest(end - n, F.lit(0)), start)
    return F.concat(F.repeat(F.lit("N"), over), F.substr(seq, over + 1, start - over), F.repeat(F.lit("N"), F.least(end, n) - start), F.substr(seq, F.least(end, n) + 1))


def codons(cds: Column) -> Column:
    """Whole codons of a coding sequence, an empty array below three bases; one pass over the text."""
    return F.regexp_extract_all(cds, F.lit("(...)"), F.lit(1))


def translate(cds: Column, code: dict[str, str]) -> Column:
    """Protein of a coding sequence by a codon table; unknown codons read as X."""
    table = F.create_map(*[F.lit(x) for pair in sorted(code.items()) for x in pair])
    return F.array_join(F.transform(codons(cds), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def codon_distance(a: Column, b: Column) -> Column:
    """Share of codons that differ between two coding sequences of equal length."""
    pairs = F.zip_with(codons(a), codons(b), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.size(pairs)


def nucleotide_distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.greatest(F.length(a), F.lit(1))


def mismatches(a: Column, motif: str) -> Column:
    """Hamming distance of a text to a motif of the same length."""
    out = F.lit(0)
    for i, c in enumerate(motif):
        out = out + (F.substring(a, i + 1, 1) != c).cast("int")
    return out


def span_text(start: Column, end: Column, length: Column) -> Column:
    """1-based inclusive span; one that wraps is written as its two parts."""
    whole = F.format_string("%d..%d", start + 1, end)
    return F.when(end > length, F.format_string("%d..%d,1..%d", start + 1, length, end - length)).otherwise(whole)


def tube_label(*parts: Column) -> Column:
    """Parts joined by underscores, anything but letters, digits, dot and hyphen replaced."""
    return F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9_.-]+", "-")


#: Nearest-neighbour duplex parameters: enthalpy kcal/mol, entropy cal/(mol K) by step, by the pair at an end, and once a duplex.
#: Allawi and SantaLucia 1997; SantaLucia and Hicks 2004.  Fixed values.
NEAREST_NEIGHBOUR = {
    "1997": {
        "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
        "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
    },
    "2004": {
        "AA": (-7.6, -21.3), "AT": (-7.2, -20.4), "TA": (-7.2, -20.4), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
        "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.0),
    },
}
NN_ENDS = {"1997": {"A": (2.3, 4.1), "T": (2.3, 4.1), "C": (0.1, -2.8), "G": (0.1, -2.8)}, "2004": {"A": (2.2, 6.9), "T": (2.2, 6.9), "C": (0.0, 0.0), "G": (0.0, 0.0)}}
NN_ONCE = {"1997": (0.0, 0.0), "2004": (0.2, -5.7)}


def melting_temperature(seq: Column, sodium_mm: float = 50.0, oligo_nm: float = 25.0, table: str = "1997") -> Column:
    """Duplex Tm in Celsius, both strands at ``oligo_nm``, entropy salt correction; null below two bases."""
    steps = NEAREST_NEIGHBOUR[table] | {complement_text(k): v for k, v in NEAREST_NEIGHBOUR[table].items()}
    of = lambda values, part: F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, v[part])])
    pairs = F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.substring(seq, i, 2))
    first, last = F.substring(seq, 1, 1), F.substring(seq, -1, 1)

    def add(part: int) -> Column:
        ends, inside = of(NN_ENDS[table], part), of(steps, part)
        return F.aggregate(pairs, F.lit(NN_ONCE[table][part]), lambda s, p: s + F.element_at(inside, p)) + F.element_at(ends, first) + F.element_at(ends, last)

    palindrome = seq == reverse_complement(seq)
    entropy = add(1) + F.when(palindrome, F.lit(-1.4)).otherwise(F.lit(0.0)) + 0.368 * (F.length(seq) - 1) * F.log(F.lit(sodium_mm / 1000.0))
    strands = F.when(palindrome, F.lit(oligo_nm * 1e-9)).otherwise(F.lit((oligo_nm - oligo_nm / 2.0) * 1e-9))
    return F.when((F.length(seq) > 1) & seq.rlike("^[ACGT]+$"), 1000.0 * add(0) / (entropy + 1.987 * F.log(strands)) - 273.15)
