"""Rules that are read once for every slot of a context, and of which the worst slot is the finding.

A slot is ``construct_id, slot, role, host, table_id, strand``: its place in the context, and the strand it reads.  An evaluation is one
row a construct: the slot that binds with its score, or, where the objective can't be computed, a ``reason`` and no score.  The first slot that
can't be read makes the whole evaluation unavailable, which is no failure: ``passes`` is true.

Only small rows are shuffled: codon counts (64 a construct at most) and contexts of a few bases leave the map over sequences.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import dna, intervals
from . import evaluation, rules

#: Bases of a start's context before and behind its first base, and its tiers: fixed values.
UPSTREAM, DOWNSTREAM, STRONG = 6, 5, 2.0
SLOT = "slot int, role string, host string, table_id int, strand int"


def designable(constructs: DataFrame) -> DataFrame:
    """``construct_id, text, start, end`` of the designable segments by place, joined; all null without one."""
    spans = F.array_sort(evaluation.editable(F.col("segments").cast(evaluation.SEGMENTS)))
    twice = F.concat("seq", "seq")
    text = F.array_join(F.transform(spans, lambda s: F.substr(twice, s["start"] + 1, s["end"] - s["start"])), "")
    some = F.size(spans) > 0
    return constructs.select("construct_id", F.when(some, text).alias("text"), F.when(some, F.get(spans, F.lit(0))["start"]).alias("start"), F.when(some, F.try_element_at(spans, F.lit(-1))["end"]).alias("end"))


def informative(spark) -> DataFrame:
    """``host, codon, aa`` of the codons that carry a choice under the host's own code: no stops, no families of one."""
    rows = []
    for host, table in sorted(dims.HOST_TABLE.items()):
        code, stop = dims.genetic_code(table), set(dims.stops(table))
        sense = {c: a for c, a in code.items() if a != "*" and c not in stop}
        rows += [(host, c, a) for c, a in sorted(sense.items()) if sum(x == a for x in sense.values()) > 1]
    return spark.createDataFrame(rows, "host string, codon string, aa string")


def host_weights(codons: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """``host, codon, w`` of a reference set ``(host, codon)``, one row a codon: (n + pseudocount) over the family's largest.

    Counts are combined before the shuffle; what comes out has 61 rows a host at most.
    """
    counted = codons.groupBy("host", "codon").agg(F.count(F.lit(1)).alias("n"))
    every = informative(codons.sparkSession).join(counted.select("host").distinct(), "host", "left_semi")
    n = every.join(counted, ["host", "codon"], "left").select("host", "codon", "aa", (F.coalesce("n", F.lit(0)) + pseudocount).alias("n"))
    top = n.groupBy("host", "aa").agg(F.max("n").alias("top"))
    return n.join(top, ["host", "aa"]).select("host", "codon", (F.col("n") / F.col("top")).alias("w"))


def cai_bands(lo: float | None = None, hi: float | None = None) -> dict[str, tuple[float, float]]:
    """The band of each host; a bound that is given takes the place of its side, and both together are a band for every host."""
    if hi is not None and hi >= 1.0:
        raise ValueError("the upper bound of CAI must be below 1: a ceiling there forbids nothing")
    hosts = sorted(dims.HOST_TABLE) if lo is not None and hi is not None else sorted(dims.CAI_BANDS)
    out = {}
    for host in hosts:
        a, b = dims.CAI_BANDS.get(host, (0.0, 1.0))
        out[host] = (a if lo is None else lo, b if hi is None else hi)
        if out[host][0] >= out[host][1]:
            raise ValueError(f"the CAI band {out[host]} of {host} is inverted")
    return out


def codon_adaptation(constructs: DataFrame, slots: DataFrame, weights: DataFrame, bands: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """c1: ``construct_id, role, host, score, n, lo, hi, side, magnitude, start, end, passes, reason``.

    ``weights(host, codon, w)`` has 64 rows a host at most.  Each slot is scored over its own host's informative codons against
    its own band (:func:`cai_bands`).  The slot furthest outside binds; if none is, the one closest to an edge that can
    bind, as a share of what lies between chance and 1 for its host; then the first.  Reasons: ``no_slot``, ``no_cds``, ``no_reference_set``,
    ``no_band``, ``out_of_frame``, ``no_informative_codons``.
    """
    spark = constructs.sparkSession
    bands = cai_bands() if bands is None else bands
    limits = spark.createDataFrame([(h, float(a), float(b)) for h, (a, b) in sorted(bands.items())], "host string, lo double, hi double")
    table = informative(spark).join(weights.where("w > 0"), ["host", "codon"])
    # Codons that the other strand reads are the reversed complements of this one's: the text is whole codons.
    other = table.select("host", dna.reverse_complement(F.col("codon")).alias("codon"), F.ln("w").alias("lw"), F.lit(-1).alias("strand"))
    key = table.select("host", "codon", F.ln("w").alias("lw"), F.lit(1).alias("strand")).unionByName(other)
    chance = table.groupBy("host", "aa").agg(F.avg(F.ln("w")).alias("m")).groupBy("host").agg(F.exp(F.avg("m")).alias("chance"))
    known = weights.select("host").distinct().withColumn("_known", F.lit(True))

    text = designable(constructs)
    whole = text.where("length(text) % 3 = 0").select("construct_id", F.explode(dna.codons(F.col("text"))).alias("codon"))
    counts = whole.groupBy("construct_id", "codon").agg(F.count(F.lit(1)).alias("k"))
    gated = _gated(slots, "c1_cai")
    scored = gated.select("construct_id", "slot", "host", "strand").join(counts, "construct_id").join(F.broadcast(key), ["host", "strand", "codon"])
    scored = scored.groupBy("construct_id", "slot").agg(F.exp(F.sum(F.col("k") * F.col("lw")) / F.sum("k")).alias("score"), F.sum("k").alias("n"))

    facts = text.select("construct_id", "start", "end", (F.length("text") % 3 != 0).alias("_torn"))
    rows = facts.join(gated, "construct_id", "left").join(scored, ["construct_id", "slot"], "left")
    rows = rows.join(F.broadcast(limits), "host", "left").join(F.broadcast(chance), "host", "left").join(F.broadcast(known), "host", "left")
    reason = F.when(F.col("slot").isNull(), "no_slot").when(F.col("start").isNull(), "no_cds").when(F.col("_known").isNull(), "no_reference_set").when(F.col("lo").isNull(), "no_band").when(F.col("_torn"), "out_of_frame").when(F.col("n").isNull(), "no_informative_codons")
    score, lo, hi = F.col("score"), F.col("lo"), F.col("hi")
    side = F.when(score < lo, "lower").when(score > hi, "upper")
    away = F.greatest(lo - score, score - hi, F.lit(0.0))
    room = F.when(F.col("chance") < 1, 1 - F.col("chance")).otherwise(F.lit(1.0))
    near = F.when(lo <= 0, hi - score).otherwise(F.least(score - lo, hi - score)) / room
    rows = rows.withColumn("reason", reason).withColumn("side", side).withColumn("magnitude", away).withColumn("_rank", F.when(away > 0, away).otherwise(-near - 1))
    return _binding(rows, F.struct("_rank", -F.col("slot")), ("role", "host", "score", "n", "lo", "hi", "side", "magnitude")).withColumn("passes", F.col("side").isNull())


#: Of %MinMax: codons of a window, and the band of its mean.  Fixed values.
MIN_MAX_WINDOW, MIN_MAX_BAND = 18, (-100.0, 0.0)


def family_table(frequencies: Mapping[str, float], table_id: int) -> dict[str, tuple[float, float, float, float]]:
    """Codon to its frequency and its family's mean, largest and least; families of one or with a codon missing are left out."""
    out = {}
    for aa, family in dims.synonyms(table_id).items():
        if aa != "*" and len(family) > 1 and all(c in frequencies for c in family):
            values = [float(frequencies[c]) for c in family]
            out |= {c: (float(frequencies[c]), sum(values) / len(values), max(values), min(values)) for c in family}
    return out


def min_max(codons: list[str], stats: Mapping[str, tuple[float, float, float, float]], width: int = MIN_MAX_WINDOW) -> np.ndarray:
    """%MinMax at every codon, by prefix sums: over windows shortened at the ends, in which codons without a choice hold their place."""
    none = (0.0, 0.0, 0.0, 0.0)
    return _min_max(np.array([stats.get(c, none) for c in codons]).reshape(-1, 4), width)


def _min_max(values: np.ndarray, width: int) -> np.ndarray:
    """:func:`min_max` of frequencies, means, largest and least by codon, for any number of tables at once: ``values`` is codons x tables x 4."""
    if width < 1:
        raise ValueError("a window has one codon at least")
    sums = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    at = np.arange(len(values))
    used, mean, most, least = np.moveaxis(sums[np.minimum(at + width // 2 + 1, len(values))] - sums[np.maximum(at - (width - 1) // 2, 0)], -1, 0)
    up, down = most - mean, mean - least
    # Sums of frequencies carry rounding: what is nothing to it is nothing.
    tiny = 1e-12 * np.maximum(sums[-1, ..., 2], 1e-300)
    high = 100.0 * (used - mean) / np.where(up > tiny, up, 1.0)
    low = -100.0 * (mean - used) / np.where(down > tiny, down, 1.0)
    return np.where(used >= mean, np.where(up > tiny, high, 0.0), np.where(down > tiny, low, 0.0))


def codon_profiles(texts: DataFrame, frequencies: DataFrame, width: int = MIN_MAX_WINDOW) -> DataFrame:
    """``construct_id, host, strand, mean, peak, trough, n`` of ``texts(construct_id, text)`` of whole codons, for every host on both strands.

    ``frequencies(host, codon, freq)`` is a dimension of 64 rows a host, and hosts are those of :data:`strandloom.dims.HOST_TABLE`; that
    alone is brought to the driver.  One map a construct: no row a codon is shuffled.
    """
    usage: dict[str, dict[str, float]] = {}
    for r in frequencies.where(F.col("host").isin(*dims.HOST_TABLE) & F.col("codon").isin(*dims.CODONS)).groupBy("host", "codon").agg(F.max("freq").alias("freq")).collect():
        usage.setdefault(r.host, {})[r.codon] = r.freq
    tables = {h: family_table(u, dims.HOST_TABLE[h]) for h, u in sorted(usage.items())}
    # Codons by number, 64 for what is none; a table a host.
    hosts, letters = list(tables), np.full(256, 64, np.int64)
    letters[list(b"ACGT")] = range(4)
    values = np.zeros((65, len(hosts), 4))
    for k, stats in enumerate(tables.values()):
        for c, row in stats.items():
            values[int(letters[list(c.encode())] @ (16, 4, 1)), k] = row
    held = values.any(axis=2)
    names = ["construct_id", "host", "strand", "mean", "peak", "trough", "n"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for strand in (1, -1):
                    read = text if strand == 1 else dna.complement_text(text)
                    ids = np.minimum(letters[np.frombuffer(read.encode("ascii", "replace"), np.uint8)].reshape(-1, 3) @ (16, 4, 1), 64)
                    n = held[ids].sum(axis=0)
                    if n.any():
                        profile = _min_max(values[ids], width)
                        each = zip(hosts, profile.mean(axis=0).tolist(), profile.max(axis=0).tolist(), profile.min(axis=0).tolist(), n.tolist(), strict=True)
                        out += [(cid, host, strand, *rest) for host, *rest in each if rest[-1]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    whole = texts.where("length(text) % 3 = 0").select("construct_id", "text")
    return whole.mapInArrow(run, "construct_id long, host string, strand int, mean double, peak double, trough double, n long")


def codon_landscape(constructs: DataFrame, slots: DataFrame, frequencies: DataFrame, band: tuple[float, float] = MIN_MAX_BAND, width: int = MIN_MAX_WINDOW) -> DataFrame:
    """c3: ``construct_id, role, host, score, peak, trough, n, side, magnitude, start, end, passes, reason``.

    The score is the mean of %MinMax over all codons.  It is defined on raw frequencies ``(host, codon, freq)`` alone: relative weights have lost the
    scale between families.  The slot furthest outside the band binds, else the one nearest to its upper edge, then the first.
    Reasons are those of :func:`codon_adaptation` but ``no_band``.
    """
    if not band[0] < band[1]:
        raise ValueError(f"the band {band} is inverted")
    text = designable(constructs)
    facts = text.select("construct_id", "start", "end", (F.length("text") % 3 != 0).alias("_torn"))
    known = frequencies.select("host").distinct().withColumn("_known", F.lit(True))
    rows = facts.join(_gated(slots, "c3_min_max"), "construct_id", "left").join(codon_profiles(text, frequencies, width), ["construct_id", "host", "strand"], "left").join(F.broadcast(known), "host", "left")
    reason = F.when(F.col("slot").isNull(), "no_slot").when(F.col("start").isNull(), "no_cds").when(F.col("_known").isNull(), "no_reference_set").when(F.col("_torn"), "out_of_frame").when(F.col("n").isNull(), "no_informative_codons")
    mean = F.col("mean")
    away = F.greatest(band[0] - mean, mean - band[1], F.lit(0.0))
    rows = rows.withColumn("reason", reason).withColumn("score", mean).withColumn("side", F.when(mean < band[0], "lower").when(mean > band[1], "upper")).withColumn("magnitude", away)
    rank = F.struct(F.when(away > 0, away).otherwise(mean - band[1] - 1), -F.col("slot"))
    return _binding(rows, rank, ("role", "host", "score", "peak", "trough", "n", "side", "magnitude")).withColumn("passes", F.col("side").isNull())


def start_context(constructs: DataFrame, slots: DataFrame, require_strong: bool = False) -> DataFrame:
    """b8: ``construct_id, role, host, score, context, start, end, magnitude, fixable, passes, reason``.

    ``constructs`` carry ``leaders``, an array of annotated untranslated spans ``(start, end)``: bases before the start count only if one of
    them holds them.  A point for A or G at -3, one for G at +4; the weakest slot binds, then the first, and slots that begin with no
    start codon of their code are passed over.  Neither point is a breach (with ``require_strong``, fewer than both); codon choice
    reaches +4 alone.  Reasons: ``no_slot``, ``no_cds``, ``no_room``, ``no_leader``, ``no_initiator``.
    """
    spans = F.array_sort(evaluation.editable(F.col("segments").cast(evaluation.SEGMENTS)))
    rows = constructs.withColumn("_spans", spans).withColumn("_n", F.length("seq")).withColumn("strand", F.explode(F.array(F.lit(1), F.lit(-1))))
    forward, n, around = F.col("strand") == 1, F.col("_n"), F.coalesce(F.col("circular"), F.lit(False))
    cds = F.when(forward, F.get("_spans", F.lit(0))).otherwise(F.try_element_at("_spans", F.lit(-1)))
    raw = F.when(forward, cds["start"] - UPSTREAM).otherwise(cds["end"] - DOWNSTREAM)
    size = UPSTREAM + DOWNSTREAM
    at = F.when(around, F.pmod(raw, n)).otherwise(raw)
    room = (cds["end"] - cds["start"] >= DOWNSTREAM) & (around | (raw >= 0) & (raw + size <= n)) & (n >= size)
    lead = F.when(forward, at).otherwise(at + DOWNSTREAM)
    led = F.exists("leaders", lambda f: intervals.contains(f["start"], f["end"], lead, lead + UPSTREAM, n, around))
    text = F.substr(F.concat("seq", "seq"), at + 1, F.lit(size))
    reach = evaluation.overlaps_editable(F.col("segments").cast(evaluation.SEGMENTS), at, at + size, n, around)
    why = F.when(cds.isNull(), "no_cds").when(~room, "no_room").when(~F.coalesce(led, F.lit(False)), "no_leader")
    facts = rows.select("construct_id", "strand", F.when(room, at).cast("int").alias("start"), F.when(room, at + size).cast("int").alias("end"), F.when(room, F.when(forward, text).otherwise(dna.reverse_complement(text))).alias("context"), F.when(room, reach).alias("_reach"), why.alias("reason"))

    starts = F.create_map(*[x for t in sorted(dims.DIFFERENCES) for x in (F.lit(t), F.array(*[F.lit(s) for s in dims.STARTS.get(t, "ATG").split()]))])
    joined = facts.select("construct_id").distinct().join(_gated(slots, "b8_kozak"), "construct_id", "left").join(facts, ["construct_id", "strand"], "left")
    context = F.col("context")
    begins = F.array_contains(F.element_at(starts, F.col("table_id")), F.substr(context, F.lit(UPSTREAM + 1), F.lit(3)))
    purine, g = F.substr(context, F.lit(UPSTREAM - 2), F.lit(1)).isin("A", "G"), F.substr(context, F.lit(UPSTREAM + 4), F.lit(1)) == "G"
    joined = joined.withColumn("score", F.when(begins, purine.cast("double") + g.cast("double"))).withColumn("reason", F.when(F.col("slot").isNull(), "no_slot").otherwise(F.col("reason")))
    joined = joined.withColumn("fixable", ~g & F.col("_reach")).withColumn("_skip", F.col("reason").isNull() & F.col("score").isNull())
    out = _binding(joined, F.struct(-F.col("score"), -F.col("slot")), ("role", "host", "score", "context", "start", "end", "fixable"), F.col("_skip"), "no_initiator")
    breach = (F.col("score") < STRONG) if require_strong else F.col("score") == 0
    return out.withColumn("magnitude", STRONG - F.col("score")).withColumn("passes", ~F.coalesce(breach, F.lit(False)))


def _gated(slots: DataFrame, spec_id: str) -> DataFrame:
    """Slots that a rule applies to, each once."""
    spec = slots.withColumn("spec_id", F.lit(spec_id))
    # Delivery decides nothing for rules of translation; a slot need not name it.
    spec = spec if "modality" in slots.columns else spec.withColumn("modality", F.lit("plasmid_transient"))
    return spec.where(rules.gate()).select("construct_id", *[x.split()[0] for x in SLOT.split(", ")]).dropDuplicates(["construct_id", "slot"])


def _binding(rows: DataFrame, rank: Column, fields: tuple[str, ...], skip: Column | None = None, skipped: str = "") -> DataFrame:
    """One row a construct: the reason of the first slot that has one, or the slot of the highest ``rank`` among those not passed over."""
    passed = F.lit(False) if skip is None else skip
    keep = [f for f in ("start", "end") if f not in fields]
    best = F.max_by(F.struct(*fields), F.when(~passed & F.col("reason").isNull(), rank))
    made = rows.groupBy("construct_id", *keep).agg(best.alias("_top"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.coalesce("slot", F.lit(0)))).alias("_why"))
    why = F.coalesce(F.col("_why"), F.when(F.col("_top").isNull(), skipped))
    return made.select("construct_id", *[F.when(why.isNull(), F.col(f"_top.{f}")).alias(f) for f in fields], *keep, why.alias("reason"))
