"""Rules evaluated on whole constructs: breaches and scores, in one pass per construct.

A construct comes with its segments (``start, end, kind``), so that every breach knows whether codon choice can touch it and
repeats inside exempt regions do not count.  All rules of a construct run in one map: nothing is shuffled, however many rules.
A construct's scan is NumPy over its bases; Python loops run over hits alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna, intervals
from . import transcript

#: Kinds of segments: fixed values.
DESIGNABLE, BACKBONE, INTRON, REPEAT = "DESIGNABLE_CDS", "BACKBONE", "ANNOTATED_INTRON", "WHITELISTED_REPEAT"
EXEMPT_KINDS = (INTRON, REPEAT)
EXEMPT_COVERAGE = 0.9
SEGMENTS = "array<struct<start:int,end:int,kind:string>>"
#: Splice acceptors and the V5 tag: fixed values.
TRACT, TRACT_WIDTH, TRACT_LEAST = (5, 40), 10, 8
BRANCH, BRANCH_AT = "YTNAY", (18, 40)
V5 = "GKPIPNPLLGLDST"
#: Bases of the longest recombination site: fixed value.
LONGEST_SITE = 34
#: CpG islands: length, GC, observed over expected.  Fixed values.
ISLANDS = {"gardiner_garden": (200, 0.50, 0.60), "takai_jones": (500, 0.55, 0.65)}


# ---------------------------------------------------------------- segments as columns


def editable(segments: Column) -> Column:
    """The designable segments of a construct."""
    return F.filter(segments, lambda s: s["kind"] == DESIGNABLE)


def exempt(segments: Column) -> Column:
    """The segments that are neither changed nor scanned for repeats."""
    return F.filter(segments, lambda s: s["kind"].isin(*EXEMPT_KINDS))


def is_editable(segments: Column, start: Column, end: Column, length: Column, circular: Column) -> Column:
    """Whether an interval lies wholly inside one designable segment, round the origin of circles too."""
    return F.exists(editable(segments), lambda s: intervals.contains(s["start"], s["end"], start, end, length, circular))


def overlaps_editable(segments: Column, start: Column, end: Column, length: Column, circular: Column) -> Column:
    """Whether an interval touches a designable base: what decides if codon choice can mend a breach."""
    return F.exists(editable(segments), lambda s: intervals.overlap_length(s["start"], s["end"], start, end, length, circular) > 0)


def exempt_coverage(segments: Column, start: Column, end: Column, length: Column, circular: Column) -> Column:
    """The largest share of an interval that one exempt segment covers."""
    share = F.transform(exempt(segments), lambda s: intervals.overlap_length(start, end, s["start"], s["end"], length, circular) / (end - start))
    return F.coalesce(F.array_max(share), F.lit(0.0))


# ---------------------------------------------------------------- constructs in kernels


@dataclass
class Construct:
    seq: str
    circular: bool
    segments: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.n = len(self.seq)
        self.cds = [(s["start"], s["end"]) for s in self.segments if s["kind"] == DESIGNABLE]
        self.free = [(s["start"], s["end"]) for s in self.segments if s["kind"] in EXEMPT_KINDS]

    def _overlap(self, start: int, end: int, other: tuple[int, int]) -> int:
        return max(min(end, other[1] + s) - max(start, other[0] + s) for s in ((0, self.n, -self.n) if self.circular else (0,)))

    def touches_cds(self, start: int, end: int) -> bool:
        return any(self._overlap(start, end, x) > 0 for x in self.cds)

    def is_exempt(self, start: int, end: int) -> bool:
        return any(self._overlap(start, end, x) >= EXEMPT_COVERAGE * (end - start) for x in self.free)

    def strand(self, strand: int) -> str:
        return self.seq if strand == 1 else dna.complement_text(self.seq)

    def at(self, position: int, width: int, strand: int) -> int:
        """Where a hit on a strand begins on the construct."""
        return position % self.n if strand == 1 else (self.n - position - width) % self.n

    def spans(self) -> Iterator[tuple[int, str]]:
        """The designable spans, each an ordered fragment on a line: where it begins, and its text."""
        twice = self.seq + self.seq if self.circular else self.seq
        for start, end in self.cds:
            yield start, twice[start:end]


def _find(text: str, motif: str, begin: int = 0, stop: int | None = None) -> Iterator[int]:
    """Overlapping occurrences that begin in [begin, stop)."""
    p = text.find(motif, begin)
    while p >= 0 and (stop is None or p < stop):
        yield p
        p = text.find(motif, p + 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _kmer_ids(text: str, k: int) -> np.ndarray:
    """A number per k-mer start, equal for equal k-mers (2 bits a base)."""
    two = (_codes(text) >> 1 & 3).astype(np.int64)
    n = max(len(text) - k + 1, 0)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out << 2 | two[j : j + n]
    return out


Breach = tuple[str, int, int, int, float, bool]  # kind, start, end, strand, magnitude, fixable


def restriction_sites(c: Construct, enzymes: dict[str, str] = dims.SIX_CUTTERS) -> Iterator[Breach]:
    """d1: every recognition site on either strand, a palindrome once."""
    for name, motif in sorted(enzymes.items()):
        if c.n < len(motif):
            continue
        text = c.seq + c.seq[: len(motif) - 1] if c.circular else c.seq
        for m in dict.fromkeys((motif, dna.complement_text(motif))):
            for p in _find(text, m, 0, c.n):
                yield name, p, p + len(m), 1, 1.0, c.touches_cds(p, p + len(m))


def homopolymer_runs(c: Construct, max_at: int = 9, max_gc: int = 5) -> Iterator[Breach]:
    """e1: maximal runs over the limit; on a circle the last joins the first.  The magnitude is the overrun."""
    text = c.seq + c.seq[: max(max_at, max_gc)] if c.circular else c.seq
    if not any(base * ((max_at if base in "AT" else max_gc) + 1) in text for base in set(text)):
        return
    codes = _codes(c.seq)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if c.n else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, c.n))
    if c.circular and len(edge) > 1 and codes[0] == codes[-1]:
        size[-1] += size[0]
        edge, size = edge[1:], size[1:]
    limit = np.where(np.isin(codes[edge], (65, 84)), max_at, max_gc)
    for p, k, most in zip(edge[size > limit].tolist(), size[size > limit].tolist(), limit[size > limit].tolist(), strict=True):
        yield c.seq[p], p, p + k, 1, float(k - most), c.touches_cds(p, p + k)


def polya_signals(c: Construct, strands: tuple[int, ...] = (1,)) -> Iterator[Breach]:
    """d4: polyadenylation hexamers on the packaged strand: 3 with a GU-rich element 10 to 40 bases on, 1 without, variants 0.2."""
    for strand in strands:
        text = c.strand(strand)
        text = text + text[:40] if c.circular else text
        for hexamer in (*transcript.POLYA, *transcript.POLYA_VARIANTS):
            for p in _find(text, hexamer, 0, c.n):
                tail = text[p + 16 : p + 46]
                rich = "GTGT" in tail or "TGTG" in tail or any(tail[i : i + 6].count("T") >= 4 for i in range(max(0, len(tail) - 5)))
                lo = c.at(p, 6, strand)
                yield hexamer, lo, lo + 6, strand, 0.2 if hexamer not in transcript.POLYA else 3.0 if rich else 1.0, c.touches_cds(lo, lo + 6)


def splice_sites(c: Construct, strands: tuple[int, ...] = (1,), acceptors: bool = True, table_id: int = 1) -> Iterator[Breach]:
    """d3: donors (literal 3, consensus 1, 3 inside a V5 tag) with their whole 9-mer; AG acceptors with pyrimidine tract and branch point 1."""
    tags = []
    code = dims.genetic_code(table_id)
    for begin, text in c.spans():
        protein = "".join(code.get(text[i : i + 3], "X") for i in range(0, len(text) - 2, 3))
        tags += [(begin + 3 * i, begin + 3 * (i + len(V5))) for i in _find(protein, V5)]
    for strand in strands:
        once = c.strand(strand)
        text, origin = (once * 3, c.n) if c.circular else (once, 0)
        for p in _find(text, "GT", origin, origin + c.n):
            if p < 3 or p + 6 > len(text):
                continue
            around = text[p - 2 : p + 5]
            magnitude = 3.0 if text[p - 1 : p + 5] in ("GGTAAG", "GGTGAG") else 1.0 if around[0] == "A" and around[4] in "AG" and around[5:] == "AG" else 0.0
            if magnitude:
                lo = c.at(p - 3 - origin, 9, strand)
                magnitude = 3.0 if any(c._overlap(lo, lo + 9, t) > 0 for t in tags) else magnitude
                yield "donor", lo, lo + 9, strand, magnitude, c.touches_cds(lo, lo + 9)
        if not acceptors:
            continue
        codes = _codes(text)
        pyrimidine = np.concatenate(([0], np.cumsum((codes == 67) | (codes == 84))))
        # Branch points: Y T N A Y.
        y = (codes == 67) | (codes == 84)
        m = max(len(codes) - 4, 0)
        branch = np.concatenate(([0], np.cumsum(y[:m] & (codes[1 : 1 + m] == 84) & (codes[3 : 3 + m] == 65) & y[4 : 4 + m])))
        rich = pyrimidine[TRACT_WIDTH:] - pyrimidine[:-TRACT_WIDTH] >= TRACT_LEAST if len(text) >= TRACT_WIDTH else np.zeros(0, bool)
        tract = np.concatenate(([0], np.cumsum(rich)))
        for p in _find(text, "AG", origin, origin + c.n):
            a, b = max(0, p - TRACT[1]), max(0, p - TRACT[0]) - TRACT_WIDTH + 1
            d, e = max(0, p - BRANCH_AT[1]), max(0, p - BRANCH_AT[0]) - len(BRANCH) + 1
            if b > a and e > d and tract[b] > tract[a] and branch[e] > branch[d]:
                lo = c.at(p - origin, 2, strand)
                yield "acceptor", lo, lo + 2, strand, 1.0, c.touches_cds(lo, lo + 2)


def tandem_repeats(c: Construct, max_unit: int = 6, warn: int = 20, hard: int = 100) -> Iterator[Breach]:
    """e7: all tandem tracts of the designable spans at their least period; the overrun over ``warn``, doubled over ``hard``."""
    for begin, text in c.spans():
        codes, kept = _codes(text), []
        for period in range(1, max_unit + 1):
            if len(codes) <= period:
                break
            same = codes[:-period] == codes[period:]
            if b"\1" * (warn - period) not in same.tobytes():
                continue
            same = np.concatenate(([False], same, [False]))
            edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
            for a, b in edge[edge[:, 1] - edge[:, 0] + period >= warn].tolist():
                if not any(p < period and s <= a and b + period <= e for s, e, p in kept):
                    kept.append((a, b + period, period))
        for a, b, period in sorted(kept):
            if period > 1:
                at = (begin + a) % c.n if c.circular else begin + a
                # Whether it can be mended is asked at the fragment's own coordinates, as the rule has it.
                yield text[a : a + period], at, at + b - a, 1, (b - a - warn + 1) / warn * (2.0 if b - a > hard else 1.0), c.touches_cds(a, b)


def cpg_island(c: Construct, criterion: str = "gardiner_garden") -> Iterator[Breach]:
    """d8: the window of the criterion's length with the largest observed over expected CpG, if any meets it; strides of a fifth."""
    width, least_gc, least_ratio = ISLANDS[criterion]
    if c.n < width:
        return
    codes = _codes(c.seq * 3 if c.circular else c.seq)
    starts = np.arange(0, c.n if c.circular else c.n - width + 1, max(1, width // 5))
    total = lambda mask: (lambda s: s[starts + width] - s[starts])(np.concatenate(([0], np.cumsum(mask))))
    cs, gs = total(codes == 67), total(codes == 71)
    pair = np.concatenate(([0], np.cumsum((codes[:-1] == 67) & (codes[1:] == 71))))
    cg = pair[starts + width - 1] - pair[starts]
    ratio = np.where(cs * gs > 0, cg * width / np.maximum(cs * gs, 1), 0.0)
    ok = ((cs + gs) / width >= least_gc) & (ratio >= least_ratio)
    if ok.any():
        at = int(starts[np.argmax(np.where(ok, ratio, -1.0))])
        yield criterion, at, at + width, 1, 1.0, c.touches_cds(at, at + width)


def repetitive_regions(c: Construct, k: int = 9, window: int = 100, flag: float = 0.25, step: int = 20) -> Iterator[Breach]:
    """e6: regions of the designable spans where windows hold ``flag`` or more starts of recurring k-mers; touching windows merge.

    The magnitude is the largest share of a window.
    """
    span = window - k + 1
    for begin, text in c.spans():
        ids = _kmer_ids(text, k)
        if not len(ids):
            continue
        _, where, often = np.unique(ids, return_inverse=True, return_counts=True)
        total = np.concatenate(([0], np.cumsum(often[where] >= 2)))
        starts = np.arange(0, max(1, len(ids) - span + 1), step)
        stops = np.minimum(starts + span, len(ids))
        share = (total[stops] - total[starts]) / (stops - starts)
        region: list | None = None
        for s, f in zip(starts[share >= flag].tolist(), share[share >= flag].tolist(), strict=True):
            e = min(s + window, len(text))
            if region and s <= region[1]:
                region = [region[0], max(region[1], e), max(region[2], f)]
                continue
            if region:
                yield "repetitive", begin + region[0], begin + region[1], 1, region[2], True
            region = [s, e, f]
        if region:
            yield "repetitive", begin + region[0], begin + region[1], 1, region[2], True


def recombinase_sites(c: Construct, partials: bool = True) -> Iterator[Breach]:
    """d2: whole recombination sites, 1, and half sites and cores that lie in no whole one, 0.3; both strands, each span once, over the origin."""
    kinds = transcript.RECOMBINASE | (transcript.RECOMBINASE_PARTS if partials else {})
    found: dict[tuple[str, int, int], int] = {}
    for strand in (1, -1):
        text = c.strand(strand)
        text = text + text[:LONGEST_SITE] if c.circular else text
        for name, pattern in kinds.items():
            for m in re.finditer(pattern, text):
                if m.start() < c.n:
                    lo = c.at(m.start(), len(m[0]), strand)
                    found.setdefault((name, lo, lo + len(m[0])), strand)
    whole = [(a, b) for name, a, b in found if name in transcript.RECOMBINASE]
    turns = (0, c.n, -c.n) if c.circular else (0,)
    for (name, a, b), strand in sorted(found.items(), key=lambda x: (x[0][1:], x[0][0])):
        part = name in transcript.RECOMBINASE_PARTS
        if not (part and any(x <= a + t and b + t <= y for x, y in whole for t in turns)):
            yield name, a, b, strand, 0.3 if part else 1.0, c.touches_cds(a, b)


#: Rules by id; each gives the breaches of a construct.
EVALUATORS: dict[str, Callable[[Construct], Iterator[Breach]]] = {
    "d1_restriction_sites": restriction_sites,
    "d3_splicing": splice_sites,
    "d4_internal_polya": polya_signals,
    "d8_cpg_depletion": cpg_island,
    "e1_homopolymers": homopolymer_runs,
    "e6_repeat_density": repetitive_regions,
    "e7_short_tandem_repeats": tandem_repeats,
}
BREACH = "construct_id long, spec_id string, kind string, start int, end int, strand int, magnitude double, fixable boolean"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]


def breaches(constructs: DataFrame, evaluators: dict[str, Callable[[Construct], Iterator[Breach]]] | None = None, shape: bool = False, worst: bool = False) -> DataFrame:
    """Breaches of every rule of ``evaluators`` (all of :data:`EVALUATORS`) on ``constructs(construct_id, seq, circular, segments)``.

    With ``shape`` each row carries its construct's ``length`` and ``circular``, so that breaches are merged round circles without a join;
    with ``worst`` the largest magnitude of its rule on its construct, so that passing evaluations are left out without one.
    """
    rules = evaluators or EVALUATORS
    schema = BREACH + (", length int, circular boolean" if shape else "") + (", worst double" if worst else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = _TYPES + ([pa.int32(), pa.bool_()] if shape else []) + ([pa.float64()] if worst else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = [batch.column(k)[i].as_py() for k in range(4)]
                c = Construct(row[1], row[2], row[3] or [])
                more = (c.n, bool(c.circular)) if shape else ()
                for spec, rule in rules.items():
                    found = list(rule(c))
                    most = (max(b[4] for b in found),) if worst and found else ()
                    out += [(row[0], spec, *b, *more, *most) for b in found]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    return constructs.select("construct_id", "seq", "circular", F.col("segments").cast(SEGMENTS)).mapInArrow(run, schema)


def recurrence(constructs: DataFrame, k: int = 12, least: int = 3) -> DataFrame:
    """e8: ``construct_id, scored, recurring, raw_score, landing_kmers`` of each construct.

    Starts inside exempt segments do not count; a k-mer lands as often as it occurs ``k`` or more bases behind its occurrence before,
    the last and first of a circle being one where they touch over the origin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                cid, seq, circular, segments = (batch.column(x)[i].as_py() for x in range(4))
                c = Construct(seq, circular, segments or [])
                ids = _kmer_ids(seq + seq[: k - 1] if circular else seq, k)[: c.n] if c.n >= k else np.zeros(0, np.int64)
                if not len(ids):
                    out.append((cid, 0, 0, 0.0, 0))
                    continue
                _, where, often = np.unique(ids, return_inverse=True, return_counts=True)
                free = ~np.fromiter((bool(c.free) and c.is_exempt(p, p + k) for p in range(len(ids))), bool, len(ids))
                order = np.argsort(where, kind="stable")
                gap = np.diff(order)
                fresh = np.concatenate(([True], (where[order][1:] != where[order][:-1]) | (gap >= k)))
                sites = np.bincount(where[order], fresh, len(often)).astype(int)
                head = np.searchsorted(where[order], np.arange(len(often)))
                wraps = circular & (sites > 1) & (c.n - order[head + often - 1] + order[head] < k)
                recurring = int((free & (often[where] > 1)).sum())
                out.append((cid, int(free.sum()), recurring, recurring / int(free.sum()) if free.any() else 0.0, int((sites - wraps >= least).sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()], strict=True)], ["construct_id", "scored", "recurring", "raw_score", "landing_kmers"])

    return constructs.select("construct_id", "seq", "circular", F.col("segments").cast(SEGMENTS)).mapInArrow(run, "construct_id long, scored int, recurring int, raw_score double, landing_kmers int")


def open_frames(constructs: DataFrame, table_id: int, least_aa: int = 80, shape: bool = False) -> DataFrame:
    """``construct_id, start, end, strand``: the longest frame to each stop on both strands, over the origin of circles.

    With ``shape`` each row carries its construct's ``length``, so that no join has to bring it.
    """
    names = ["construct_id", "start", "end", "strand", *(["length"] if shape else [])]
    stops = dims.stops(table_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                cid, seq, circular = (batch.column(x)[i].as_py() for x in range(3))
                n = len(seq)
                for strand in (1, -1):
                    once = seq if strand == 1 else dna.complement_text(seq)
                    text = once * 3 if circular else once  # three turns hold every frame
                    ids = _kmer_ids(text, 3)
                    code = {s: _kmer_ids(s, 3)[0] for s in ("ATG", *stops)}
                    is_stop = np.isin(ids, [code[s] for s in stops])
                    starts = np.flatnonzero(ids == code["ATG"])
                    starts = starts[starts < n]
                    for frame in range(3):
                        ends = np.flatnonzero(is_stop[frame::3]) * 3 + frame
                        mine = starts[starts % 3 == frame]
                        at = np.searchsorted(ends, mine)
                        mine, at = mine[at < len(ends)], at[at < len(ends)]
                        _, first = np.unique(at, return_index=True)
                        for s, e in zip(mine[first].tolist(), ends[at[first]].tolist(), strict=True):
                            if (e - s) // 3 >= least_aa:
                                lo = s % n if strand == 1 else (n - e - 3) % n
                                out.append((cid, lo, lo + e + 3 - s, strand, *([n] if shape else [])))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k else pa.int64()) for k, x in enumerate(cols)], names)

    return constructs.select("construct_id", "seq", "circular").mapInArrow(run, "construct_id long, start int, end int, strand int" + (", length int" if shape else ""))
