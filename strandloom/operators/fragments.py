"""Ordered fragments: the tubes of synthetic DNA a construct is made of, and where their bases lie on it.

Every designable segment is a tube of its own, a linear molecule with the vendor's adapters at its ends.  Two tubes never meet in
synthesis, so rules of synthesis look at one at a time and report places on the construct.  The map between both is a shift: it
wraps round the origin of circles, and places inside an adapter have none on the construct.

Fragments are rows (:func:`fragments`) with column maps beside them; :func:`tubes` gives the same to kernels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna
from . import repeats, vendors
from .evaluation import DESIGNABLE, Breach, Construct, _codes, editable

#: Of e4: windows in bases, and the ratios of dispersion to chance that warn and refuse.  Fixed values.
SPREAD_WINDOW, EXTENT_WINDOW, WARN_RATIO, HARD_RATIO = 100, 50, 1.5, 2.0
#: Of e5: least and hard length, length beyond building, anneal in Celsius.  Fixed values.
REPEAT_BP, REPEAT_HARD, REPEAT_SEVERE, ANNEAL = 12, 20, 200, 60.0
#: Of e9: nobody takes the length, the range does not say, somebody else of the selection takes it.  Fixed values.
UNORDERABLE, AMBIGUOUS, NARROWED = 1.0, 0.5, 0.25


# ---------------------------------------------------------------- as columns


def fragments(constructs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``construct_id, fragment, sequence, five, ordered, origin_start, origin_end, length, circular, vendor`` of ``construct_id, seq, length, circular, segments``.

    ``fragment`` counts a construct's tubes by start; ``sequence`` has the adapters, ``five`` and ``ordered`` are the lengths of
    the first of them and of the ordered DNA.  Segments without bases order nothing.
    """
    chosen = vendors.selection(keys or [dims.DEFAULT_VENDOR])
    five, three = chosen[0][7:]
    spans = F.array_sort(editable(F.col("segments")))
    rows = constructs.select("construct_id", "seq", "length", "circular", F.posexplode(F.filter(spans, lambda s: s["end"] > s["start"])).alias("fragment", "s"))
    text = dna.circular_slice(F.col("seq"), F.col("s.start"), F.col("s.end"), F.lit(1))
    return rows.select(
        "construct_id", "fragment", F.concat(F.lit(five), text, F.lit(three)).alias("sequence"), F.lit(len(five)).alias("five"), F.length(text).alias("ordered"),
        F.col("s.start").alias("origin_start"), F.col("s.end").alias("origin_end"), "length", "circular", F.lit(",".join(v[0] for v in chosen)).alias("vendor"),
    )


def to_construct(start: Column, end: Column) -> tuple[Column, Column]:
    """Place of a fragment's [start, end) on the construct, over the columns of :func:`fragments`; null wholly inside an adapter.

    An interval that leaves the ordered DNA is cut to it.  On a circle the start lies in [0, length), and an interval over the
    origin ends behind ``length``.
    """
    lo, hi = F.greatest(start, F.col("five")), F.least(end, F.col("five") + F.col("ordered"))
    begin = lo - F.col("five") + F.col("origin_start")
    begin = F.when(F.col("circular"), F.pmod(begin, F.col("length"))).otherwise(begin)
    return F.when(hi > lo, begin), F.when(hi > lo, begin + hi - lo)


def to_fragment(start: Column, end: Column) -> tuple[Column, Column]:
    """Place of a construct's [start, end) in the fragment's sequence; null where they share no base.  Undoes :func:`to_construct`."""
    size = F.col("ordered")
    ahead = start - F.col("origin_start")
    # On a circle an interval may begin before the fragment and reach into it over the origin.
    ahead = F.when(F.col("circular"), F.when(F.pmod(ahead, F.col("length")) < size, F.pmod(ahead, F.col("length"))).otherwise(F.pmod(ahead, F.col("length")) - F.col("length"))).otherwise(ahead)
    lo, hi = F.greatest(ahead, F.lit(0)), F.least(ahead + end - start, size)
    there = start.isNotNull() & (hi > lo)  # least and greatest skip nulls
    return F.when(there, lo + F.col("five")), F.when(there, hi + F.col("five"))


def gc_band(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """e2: ``construct_id, fragment, start, end, gc, side, magnitude`` of fragments whose GC, adapters included, leaves the selection's band."""
    chosen = vendors.selection(keys or [dims.DEFAULT_VENDOR])
    lo, hi = max((v[5] for v in chosen if v[5] is not None), default=0.0), min((v[6] for v in chosen if v[6] is not None), default=1.0)
    gc = dna.gc_fraction(F.col("sequence"))
    start, end = to_construct(F.lit(0), F.length("sequence"))
    made = rows.select("construct_id", "fragment", start.alias("start"), end.alias("end"), gc.alias("gc"))
    side = F.when(F.col("gc") < lo, "lower").when(F.col("gc") > hi, "upper")
    return made.select("*", side.alias("side"), F.greatest(lo - F.col("gc"), F.col("gc") - hi).alias("magnitude")).where("side is not null")


def length_tiers(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """e9: ``construct_id, fragment, start, end, accepting, refusing, tier, magnitude`` of fragments that not every vendor of the selection takes.

    A vendor takes a length that its range holds with and without adapters; where it holds one alone, the range does not say.
    """
    chosen = [v for v in vendors.selection(keys or [dims.DEFAULT_VENDOR]) if v[1] is not None]
    start, end = to_construct(F.lit(0), F.length("sequence"))
    bare, total = F.col("ordered"), F.length("sequence")
    takes = {v[0]: (bare.between(v[1], v[2]), total.between(v[1], v[2])) for v in chosen}
    names = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(*t), F.lit(k)) for k, t in takes.items()])), ",") if takes else F.lit("")
    made = rows.select("construct_id", "fragment", start.alias("start"), end.alias("end"), names(lambda a, b: a & b).alias("accepting"), names(lambda a, b: ~(a & b)).alias("refusing"), names(lambda a, b: a != b).alias("_unsaid"))
    tier = F.when(F.col("accepting") != "", "narrowed").when(F.col("_unsaid") != "", "ambiguous").otherwise("unorderable")
    weight = F.when(F.col("accepting") != "", NARROWED).when(F.col("_unsaid") != "", AMBIGUOUS).otherwise(UNORDERABLE)
    return made.where("refusing <> ''").select("construct_id", "fragment", "start", "end", "accepting", "refusing", tier.alias("tier"), weight.alias("magnitude"))


# ---------------------------------------------------------------- in kernels


@dataclass(frozen=True)
class Tube:
    """One fragment: its molecule as a construct of its own, and how its places lie on the parent."""

    own: Construct
    five: int
    ordered: int
    start: int
    parent: Construct

    def place(self, start: int, end: int) -> tuple[int, int] | None:
        lo, hi = max(start, self.five), min(end, self.five + self.ordered)
        if hi <= lo:
            return None
        begin = lo - self.five + self.start
        begin = begin % self.parent.n if self.parent.circular else begin
        return begin, begin + hi - lo


def tubes(c: Construct, keys: tuple[str, ...] = (dims.DEFAULT_VENDOR,)) -> Iterator[Tube]:
    five, three = vendors.selection(list(keys))[0][7:]
    for start, text in sorted(c.spans()):
        if text:
            own = Construct(five + text + three, False, [{"start": len(five), "end": len(five) + len(text), "kind": DESIGNABLE}])
            yield Tube(own, len(five), len(text), start, c)


def gc_extent(c: Construct, keys: tuple[str, ...] = (dims.DEFAULT_VENDOR,), warn_ratio: float = WARN_RATIO) -> Iterator[Breach]:
    """e4: one breach a fragment whose window GC varies ``warn_ratio`` times more than chance; at the extreme window further from the median.

    The magnitude is 1, a refusal, from :data:`HARD_RATIO` on.
    """
    for tube in tubes(c, keys):
        ratio = _dispersion(tube.own.seq)
        values = _windows_gc(tube.own.seq, EXTENT_WINDOW)
        if ratio < warn_ratio or len(values) < 2:
            continue
        low, high = int(np.argmin(values)), int(np.argmax(values))
        middle = np.sort(values)[len(values) // 2]
        is_low = middle - values[low] >= values[high] - middle
        at = tube.place(low, low + EXTENT_WINDOW) if is_low else tube.place(high, high + EXTENT_WINDOW)
        if at:
            yield "low" if is_low else "high", *at, 1, min(1.0, (ratio - 1.0) / (HARD_RATIO - 1.0)), True


def _windows_gc(seq: str, width: int) -> np.ndarray:
    """GC of every window in per cent; of a shorter sequence the one value it has."""
    codes = _codes(seq)
    total = np.concatenate(([0], np.cumsum((codes == 71) | (codes == 67))))
    if len(codes) < width:
        return 100.0 * total[-1:] / max(len(codes), 1)
    return 100.0 * (total[width:] - total[:-width]) / width


def _dispersion(seq: str) -> float:
    """Deviation of window GC over what chance gives for the composition; 0 without two windows or without variation."""
    values = _windows_gc(seq, SPREAD_WINDOW)
    p = (seq.count("G") + seq.count("C")) / len(seq)
    floor = 100.0 * (p * (1.0 - p) / SPREAD_WINDOW) ** 0.5
    return float(values.std()) / floor if len(values) > 1 and floor > 0 else 0.0


def synthesis_repeats(c: Construct, keys: tuple[str, ...] = (dims.DEFAULT_VENDOR,), min_len: int = REPEAT_BP, hard_len: int = REPEAT_HARD, anneal_c: float = ANNEAL) -> Iterator[Breach]:
    """e5: repeats of a tube, adapters included: ``severe`` by length, ``hard`` by length or by a duplex stable at the anneal, else ``warn``.

    An arc wholly inside an adapter is the vendor's own affair.
    """
    for tube in tubes(c, keys):
        for a, b, size in repeats.direct(tube.own.seq, False, min_len):
            at = tube.place(a, b + size)
            if at is None:
                continue
            stable = size >= hard_len or repeats.melting(tube.own.seq[a : a + size]) >= anneal_c  # what is hard by length is not melted
            kind, magnitude = ("severe", 4.0) if size >= REPEAT_SEVERE else ("hard", 2.0) if stable else ("warn", 0.5)
            yield kind, *at, 1, magnitude, tube.own.touches_cds(a, b + size)


def fragment_gc(c: Construct, keys: tuple[str, ...] = (dims.DEFAULT_VENDOR,)) -> Iterator[Breach]:
    """e2 as a kernel, for repair; :func:`gc_band` is the plan over tables."""
    chosen = vendors.selection(list(keys))
    lo, hi = max((v[5] for v in chosen if v[5] is not None), default=0.0), min((v[6] for v in chosen if v[6] is not None), default=1.0)
    for tube in tubes(c, keys):
        gc = (tube.own.seq.count("G") + tube.own.seq.count("C")) / tube.own.n
        if not lo <= gc <= hi:
            yield "lower" if gc < lo else "upper", *tube.place(0, tube.own.n), 1, max(lo - gc, gc - hi), True
