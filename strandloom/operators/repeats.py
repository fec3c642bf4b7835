"""Maximal repeats and stems of one construct, round the origin of circles, and the rules that read them.

Every pair is found from neighbouring occurrences of a k-mer (on a circle the last and the first are neighbours too) and grown in
both directions at once for all pairs: blocks of 1, 2, 4, ... bases are ranked by text, so that the length two positions
share is a sum of blocks whose ranks agree.  That is exact, and takes O(n log n) however repetitive the construct.  A pair's
facts do not depend on where a circle is cut.  Nothing is capped: a report that wants the longest few takes them itself.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .evaluation import SEGMENTS, Breach, Construct
from .kmers import _OTHER, _codes, _maximal, _windows

#: Bases of the bands of direct repeats, spacers and stems: fixed values.
INFO_BP, UNIQUE_BP, HARD_BP, SUBSTANTIAL_BP, RECA_BP, NEAR_BP, FAR_BP = 15, 20, 25, 100, 200, 100, 1000
WARN_STEM, HARD_STEM, AAV_STEM, HARD_TOTAL, UNBUILDABLE, MAX_LOOP = 15, 30, 20, 60, 150, 100
#: Bases of the longest blocks that are told apart by their letters.
PLAIN = 16
WEIGHT = {"low": 0.3, "moderate": 1.0, "high": 2.0}


class Extensions:
    """How far two positions of a construct, or of its reverse complement (places n to 2n - 1), read the same."""

    def __init__(self, codes: np.ndarray, circular: bool):
        self.n, self.circular = len(codes), circular
        both = np.concatenate((codes, _OTHER[codes[::-1]]))
        self.ranks = [(both >> 1 & 3).astype(np.int64)]
        place = np.arange(self.n)
        size = 1
        while size < self.n:
            last = self.ranks[-1]
            ahead = (place + size) % self.n if circular else np.minimum(place + size, self.n - 1)
            ahead = np.concatenate((ahead, ahead + self.n))
            if size < PLAIN:  # up to so many bases a block is its own number
                self.ranks.append(last << 2 * size | last[ahead])
                size *= 2
                continue
            key = last << 2 * size | last[ahead] if size == PLAIN else last * (2 * self.n) + last[ahead]
            if not circular:  # a block that leaves the line equals no other
                out = np.concatenate((place, place)) + 2 * size > self.n
                key = np.where(out, -1 - np.arange(2 * self.n), key)
            _, rank = np.unique(key, return_inverse=True)
            size *= 2
            if rank.max() == 2 * self.n - 1:  # all differ, and so would longer blocks
                break
            self.ranks.append(rank.astype(np.int64))

    def shared(self, x: np.ndarray, y: np.ndarray, back: bool = False, other: bool = False) -> np.ndarray:
        """Bases that agree from positions ``x`` and ``y`` on, ``n`` at most.

        With ``back`` the bases before them are read, backwards.  With ``other`` the bases before ``x`` are read backwards and
        complemented, against those from ``y`` on.
        """
        n = self.n
        # A place is (strand, offset); reading backwards is reading the other strand, complemented on both sides.
        a, b = (n - x, n - y) if back else (n - x, y) if other else (x, y)
        strand_a, strand_b = (n, n) if back else (n, 0) if other else (0, 0)
        total = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[level], 1 << level
            i, j = a + total, b + total
            if self.circular:
                same = rank[i % n + strand_a] == rank[j % n + strand_b]
            else:
                inside = (i < n) & (j < n)
                same = inside & (rank[np.minimum(i, n - 1) + strand_a] == rank[np.minimum(j, n - 1) + strand_b])
                same &= (i + size <= n) & (j + size <= n)
            total += np.where(same, size, 0)
        return np.minimum(total, n)


@functools.lru_cache(1)
def _extensions(seq: str, circular: bool) -> Extensions:
    """Those of the construct at hand, for all rules that read it."""
    return Extensions(_codes(seq), circular)


def direct(seq: str, circular: bool, least: int) -> list[tuple[int, int, int]]:
    """(first, second, length) of maximal exact repeats of ``least`` bases or more, longest first; first < second.

    Copies that overlap are one tandem array: the pair is cut to its period.
    """
    codes = _codes(seq)
    n = len(codes)
    if n < least + (not circular) or n < 2:
        return []
    words = _windows(np.concatenate((codes, codes[: least - 1])) if circular and n >= least else codes, least)
    words = words[:n]
    order = np.argsort(words, kind="stable")
    text = words[order]
    same = text[1:] == text[:-1]
    a, b = order[:-1][same], order[1:][same]
    if circular and len(order):  # the last occurrence is a neighbour of the first
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        tail = np.append(head[1:], len(order)) - 1
        many = tail - head >= 2  # two occurrences are neighbours already
        a, b = np.concatenate((a, order[head[many]])), np.concatenate((b, order[tail[many]]))
    if not len(a):
        return []
    ext = _extensions(seq, circular)
    back, on = ext.shared(a, b, back=True), ext.shared(a, b)
    whole = back + on >= n  # the circle turns into itself
    size = np.where(whole, n, back + on)
    first = np.where(whole, 0, (a - back) % n)
    step = (b - a) % n
    second = (first + step) % n
    size = np.minimum(size, np.minimum(step, n - step) if circular else step)
    rows = np.stack((np.minimum(first, second), np.maximum(first, second), size), 1)[size >= least]
    return _maximal(np.unique(rows, axis=0), n if circular else 0)


def stems(seq: str, circular: bool, least: int, max_loop: int = MAX_LOOP) -> list[tuple[int, int, int, int]]:
    """(left, right, stem, loop) of maximal inverted repeats, longest first; on a circle ``right`` may lie past the origin."""
    codes = _codes(seq)
    n = len(codes)
    if n < 2 * least:
        return []
    around = np.concatenate((codes, codes[: min(n, 2 * least + max_loop)])) if circular else codes
    word, back = _windows(around, least), _windows(_OTHER[around[::-1]], least)[::-1]
    rank = np.unique(np.concatenate((word, back)), return_inverse=True)[1].astype(np.int64)
    m = len(word)
    left = np.arange(min(n, m))
    # The right arms of a left one: places whose reverse complement reads as it does, 0 to max_loop bases behind it.
    spot = rank[m:] * m + np.arange(m)
    turn = np.argsort(spot)
    spot = spot[turn]
    lo = np.searchsorted(spot, rank[left] * m + np.minimum(left + least, m - 1))
    hi = np.searchsorted(spot, rank[left] * m + np.minimum(left + least + max_loop, m - 1), "right")
    lo = np.where(left + least > m - 1, hi, lo)
    many = np.maximum(hi - lo, 0)
    pick = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    i, j = np.repeat(left, many), turn[pick]
    if circular:
        ok = j + least - i <= n  # arms that do not meet behind each other
        i, j = i[ok], j[ok]
    if not len(i):
        return []
    ext = _extensions(seq, circular)
    outer = ext.shared(i, j + least, other=True)
    if circular:
        outer = np.minimum(outer, (n - (j + least - i)) // 2)
    loop = j - i - least
    inner = np.minimum(ext.shared(j, i + least, other=True), loop // 2)
    first, stem = (i - outer) % n if circular else i - outer, least + outer + inner
    loop = loop - 2 * inner
    rows = np.unique(np.stack((first, first + stem + loop, stem), 1), axis=0)
    if circular:  # one palindrome, seen from either of its ends on a whole circle, is one
        turned = np.stack((rows[:, 1] % n, rows[:, 0] + n, rows[:, 2]), 1)
        rows = rows[~((2 * rows[:, 2] == n) & (turned[:, 0] < rows[:, 0]))]
    return [(a, b, size, b - a - size) for a, b, size in _maximal(rows, n if circular else 0)]


def spacer(a: int, b: int, size: int, n: int, circular: bool) -> int:
    """Bases between two arms, a before b; on a circle the shorter way round."""
    straight = max(0, b - a - size)
    return min(straight, max(0, a + n - b - size)) if circular else straight


def span(a: int, b: int, size: int, n: int, circular: bool) -> tuple[int, int]:
    """The arc that bounds two arms, the one their spacer is measured on."""
    if circular and 0 <= a + n - b - size < b - a - size:
        return b, a + size + n
    return a, b + size


def risk(size: int, gap: int) -> str:
    """Low, moderate or high by length and spacer; copies that touch are never low."""
    if gap == 0:
        return "high" if size >= UNIQUE_BP else "moderate"
    if size < UNIQUE_BP:
        return "low"
    if gap <= (FAR_BP if size >= RECA_BP else NEAR_BP):
        return "high"
    return "moderate" if gap <= FAR_BP or size >= SUBSTANTIAL_BP else "low"


def weigh(size: int, gap: int, hard_len: int = HARD_BP) -> tuple[str, float]:
    """Kind and magnitude of a direct repeat: its risk, twice the weight from ``hard_len`` on."""
    band = risk(size, gap)
    return ("hard " if size >= hard_len else "") + band, WEIGHT[band] * (2.0 if size >= hard_len else 1.0)


def direct_repeats(c: Construct, min_len: int = INFO_BP, hard_len: int = HARD_BP) -> Iterator[Breach]:
    """f1: exact repeats but those whose arms both lie in exempt segments; kinds that begin with ``hard`` fail the construct."""
    for a, b, size in direct(c.seq, c.circular, min_len):
        if c.free and c.is_exempt(a, a + size) and c.is_exempt(b, b + size):
            continue
        kind, magnitude = weigh(size, spacer(a, b, size, c.n, c.circular), hard_len)
        start, end = span(a, b, size, c.n, c.circular)
        yield kind, start, end, 1, magnitude, c.touches_cds(a, a + size) or c.touches_cds(b, b + size)


def inverted_repeats(c: Construct, min_stem: int = WARN_STEM, max_loop: int = MAX_LOOP, hard_stem: int = HARD_STEM) -> Iterator[Breach]:
    """f3: stems, ``warn``, ``hard`` (by stem or by arms and loop) or ``unbuildable``; codon choice must reach both arms.

    :data:`AAV_STEM` is the hard stem of genomes that are packaged.
    """
    for a, b, stem, loop in stems(c.seq, c.circular, min_stem, max_loop):
        if c.free and c.is_exempt(a, a + stem) and c.is_exempt(b, b + stem):
            continue
        kind, magnitude = ("unbuildable", 4.0) if stem >= UNBUILDABLE else ("hard", 2.0) if stem >= hard_stem or 2 * stem + loop >= HARD_TOTAL else ("warn", 0.5)
        yield kind, a, b + stem, 1, magnitude, c.touches_cds(a, a + stem) and c.touches_cds(b, b + stem)


@functools.cache
def _steps(table: str) -> dict[str, tuple[float, float]]:
    steps = dna.NEAREST_NEIGHBOUR[table]
    return steps | {dna.complement_text(k): v for k, v in steps.items()}


@functools.lru_cache(1 << 15)
def melting(seq: str, sodium_mm: float = 50.0, oligo_nm: float = 25.0, table: str = "1997") -> float:
    """Duplex Tm in Celsius, as :func:`strandloom.functions.dna.melting_temperature` has it for columns."""
    steps = _steps(table)
    parts = [dna.NN_ONCE[table], dna.NN_ENDS[table][seq[0]], dna.NN_ENDS[table][seq[-1]], *(steps[seq[i : i + 2]] for i in range(len(seq) - 1))]
    enthalpy, entropy = (sum(p[k] for p in parts) for k in (0, 1))
    palindrome = seq == dna.complement_text(seq)
    entropy += (-1.4 if palindrome else 0.0) + 0.368 * (len(seq) - 1) * math.log(sodium_mm / 1000.0)
    strands = oligo_nm * 1e-9 if palindrome else (oligo_nm - oligo_nm / 2.0) * 1e-9
    return 1000.0 * enthalpy / (entropy + 1.987 * math.log(strands)) - 273.15


#: Stems and loops of hairpins that are reported, whatever codons do: fixed values.
HAIRPIN_STEM, HAIRPIN_LOOP = 20, 60


def _held(c: Construct, start: int, size: int) -> bool:
    """Whether one exempt segment holds all of an arm."""
    return any(a <= start + t and start + size + t <= b for a, b in c.free for t in ((0, c.n, -c.n) if c.circular else (0,)))


def _each(constructs: DataFrame, schema: str, types: list[pa.DataType], rows: Callable[[Construct], Iterator[tuple]]) -> DataFrame:
    """Rows of every construct ``(construct_id, seq, circular, segments)`` in one map; null sequences and segments are empty ones."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, seq, circular, segments in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                found = [(cid, *r) for r in rows(Construct(seq or "", bool(circular), segments or []))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return constructs.select("construct_id", "seq", "circular", F.col("segments").cast(SEGMENTS)).mapInArrow(run, schema)


def pairs(constructs: DataFrame, least: int = UNIQUE_BP) -> DataFrame:
    """``construct_id, first, second, length, spacer, size, circular``: all maximal repeats but those with both arms in exempt segments.

    ``size`` is the construct's length; arms of circles may run over the origin.  The first arm is the one that comes first on the arc
    their spacer is measured on (:func:`span`), so what is first on a circle does not depend on where it is cut.
    """

    def rows(c: Construct) -> Iterator[tuple]:
        for a, b, length in direct(c.seq, c.circular, least):
            if not (_held(c, a, length) and _held(c, b, length)):
                first = span(a, b, length, c.n, c.circular)[0]
                yield first, a + b - first, length, spacer(a, b, length, c.n, c.circular), c.n, c.circular

    i32 = pa.int32()
    return _each(constructs, "construct_id long, first int, second int, length int, spacer int, size int, circular boolean", [pa.int64(), i32, i32, i32, i32, i32, pa.bool_()], rows)


def hairpins(constructs: DataFrame, min_stem: int = HAIRPIN_STEM, max_loop: int = HAIRPIN_LOOP) -> DataFrame:
    """``construct_id, start, end, second_start, second_end, stem, loop, palindrome``: stems that may extrude, one row each.

    Stems with both arms in exempt segments are meant and left out.  Arms begin on the construct; on a circle they may end past the
    origin.  Nothing is capped, and no codon choice mends a hairpin: what helps is a strain and a temperature.
    """

    def rows(c: Construct) -> Iterator[tuple]:
        for a, b, stem, loop in stems(c.seq, c.circular, min_stem, max_loop):
            b = b % c.n if c.circular else b
            if not (_held(c, a, stem) and _held(c, b, stem)):
                yield a, a + stem, b, b + stem, stem, loop, loop == 0

    i32 = pa.int32()
    return _each(constructs, "construct_id long, start int, end int, second_start int, second_end int, stem int, loop int, palindrome boolean", [pa.int64(), *[i32] * 6, pa.bool_()], rows)
