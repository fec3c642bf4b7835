"""Placing a coding sequence in a backbone: candidates and their evidence, the site, untranslated context, what becomes of
features, repetitive regions.

An annotated feature has ``construct_id, length, circular, j, kind, label, note, regulatory_class, start, end, strand``; null
labels, notes and classes read as empty.  Everything is keyed by construct, and no join pairs all features of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals
from . import codons, presets, survey

#: Points of evidence, the bonus of length, and the least score of a confident candidate: fixed values.
KOZAK, SIGNAL_PEPTIDE, PAYLOAD, PROMOTER, POLYA, OVERLAPS_CDS, MARKER, ORIGIN = 3, 3, 2, 2, 2, 2, -8, -8
PER_100_AA, MOST_FOR_LENGTH, CONFIDENT = 1, 6, 8
#: How far a promoter and a polyA signal are looked for; promoters and gaps that can hold an insert; the reach of a ribosome binding site.
PROMOTER_BP, POLYA_BP, LEAST_PROMOTER_BP, GAP_BP, RBS_BP = 2000, 5000, 50, (20, 500), 30
#: Feature kinds and labels: fixed values.
REPEAT_KINDS, REPEAT_LABELS = ("ltr", "repeat_region"), ("itr", "ltr", "inverted terminal repeat")
UNOCCUPIED = ("source", "primer_bind", "protein_bind", "regulatory")
PROTEIN_LEVEL = ("cds", "sig_peptide", "mat_peptide", "transit_peptide", "propeptide")
ELEMENTS = {
    "five": (("5'utr", "five_prime_utr"), (), True),
    "rbs": (("rbs", "ribosome_binding_site"), ("ribosome_binding_site", "shine_dalgarno_sequence"), True),
    "promoter": (("promoter",), ("promoter",), True),
    "three": (("3'utr", "three_prime_utr"), (), False),
    "polya": (("polya_signal", "polya_site"), ("polya_signal_sequence", "polya_site"), False),
}

def _kind() -> Column:
    return F.lower(F.coalesce(F.col("kind"), F.lit("")))


def _label() -> Column:
    return F.coalesce(F.col("label"), F.col("kind"), F.lit(""))


def _text() -> Column:
    return F.concat_ws(" ", _label(), F.col("note"))


def _is_element(name: str) -> Column:
    kinds, classes, _ = ELEMENTS[name]
    by_class = (_kind() == "regulatory") & F.lower(F.coalesce("regulatory_class", F.lit(""))).isin(*classes) if classes else F.lit(False)
    driving = ~presets.is_marker(_text()) if name == "promoter" else F.lit(True)
    return (_kind().isin(*kinds) | by_class) & driving


def frame_scores(frames: DataFrame, features: DataFrame) -> DataFrame:
    """``construct_id, start, end, strand, aa, score, reasons, confident`` of each reading frame ``(construct_id, start, end, strand, length)``.

    Every signal is a row of points; a frame's rows are summed.  ``reasons`` lists them as ``signal:points``, sorted.  Promoters
    and polyA signals are looked for on a line, as positions are written; overlap runs round the origin.
    """
    keyed = frames.withColumn("frame", F.struct("start", "end", "strand"))
    marks = features.select("construct_id", F.col("start").alias("f_start"), F.col("end").alias("f_end"), _kind().alias("kind"), _text().alias("text"))
    signal = lambda name, points: F.struct(F.lit(name).alias("signal"), F.lit(points).alias("points"))

    # One join finds the features that overlap a frame or lie within a codon of its start; which of them count is seen on the
    # pair.  A feature may run over the origin though the frame does not, so the join is that of a circle.
    wanted = F.col("kind").isin("cds", "rep_origin", "sig_peptide") | (F.col("kind") == "regulatory") & F.lower("text").contains("kozak")
    wide = marks.where(wanted).withColumn("r_j", F.monotonically_increasing_id()).withColumn("r_start", F.greatest(F.col("f_start") - 4, F.lit(0))).withColumn("r_end", F.col("f_end") + 4)
    near = intervals.overlap_join(keyed.select("construct_id", "start", (F.col("end") + 1).alias("end"), "strand", "length", F.lit(True).alias("circular"), "frame"), wide)
    held = intervals.overlap_length(F.col("frame.start"), F.col("frame.end"), F.col("f_start"), F.col("f_end"), F.col("length"), F.lit(True)) > 0
    first = F.when(F.col("strand") == 1, F.col("frame.start")).otherwise(F.col("frame.end"))
    edge = F.when(F.col("strand") == 1, F.col("f_start")).otherwise(F.col("f_end"))
    what = (
        F.when((F.col("kind") == "rep_origin") & held, signal("origin", ORIGIN))
        .when((F.col("kind") == "cds") & held, F.when(presets.is_marker(F.col("text")), signal("marker", MARKER)).otherwise(signal("cds", OVERLAPS_CDS)))
        .when((F.col("kind") == "regulatory") & first.between(F.col("f_start") - 3, F.col("f_end") + 3), signal("kozak", KOZAK))
        .when((F.col("kind") == "sig_peptide") & (F.abs(edge - first) <= 3), signal("signal_peptide", SIGNAL_PEPTIDE))
    )
    rows = [near.select("construct_id", "frame", what.alias("s")).where("s is not null")]

    targets = keyed.select("construct_id", F.col("frame").alias("j"), "start", "end", "strand", "length", F.lit(False).alias("circular"))
    kinds = {"promoter": (_kind() == "promoter") & ~presets.is_marker(_text()), "polya": _kind().isin(*ELEMENTS["polya"][0])}
    name = F.when(kinds["promoter"], "promoter").when(kinds["polya"], "polya")
    elements = features.withColumn("circular", F.lit(False)).withColumn("element", name).where("element is not null").withColumn("upstream", F.col("element") == "promoter")
    found = survey.nearest(targets, elements).where(F.col("distance") <= F.when(F.col("element") == "promoter", PROMOTER_BP).otherwise(POLYA_BP))
    rows.append(found.select("construct_id", F.col("j").alias("frame"), F.when(F.col("element") == "promoter", signal("promoter", PROMOTER)).otherwise(signal("polya", POLYA)).alias("s")))

    whitelisted = _kind().isin(*REPEAT_KINDS) | F.lower(_label()).rlike("|".join(REPEAT_LABELS))
    arms = features.where(whitelisted).groupBy("construct_id").agg(F.count(F.lit(1)).alias("n"), F.min("end").alias("lo"), F.max("start").alias("hi")).where("n >= 2")
    aa = F.floor((F.col("end") - F.col("start")) / 3).cast("int")
    bonus = F.struct(F.lit("length").alias("signal"), F.least(F.lit(MOST_FOR_LENGTH), F.floor(aa / 100) * PER_100_AA).cast("int").alias("points"))
    payload = F.when((F.col("lo") <= F.col("start")) & (F.col("end") <= F.col("hi")), signal("payload", PAYLOAD))
    own = keyed.join(arms, "construct_id", "left").select("construct_id", "frame", F.explode(F.array_compact(F.array(bonus, payload))).alias("s"))

    every = own.unionByName(rows[0]).unionByName(rows[1])
    why = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "s.signal", "s.points"))), ",")
    made = every.groupBy("construct_id", "frame").agg(F.sum("s.points").cast("int").alias("score"), why.alias("reasons"))
    size = F.floor((F.col("frame.end") - F.col("frame.start")) / 3).cast("int")
    return made.select("construct_id", "frame.start", "frame.end", "frame.strand", size.alias("aa"), "score", "reasons", (F.col("score") >= CONFIDENT).alias("confident"))


def polylinkers(features: DataFrame) -> DataFrame:
    """``construct_id, j, label, start, end``: gaps of 20 to 500 bases without annotation behind a forward promoter of 50 bases or more that drives no marker.

    The next feature is a window's minimum over starts from the promoter's end on, or the end of the construct.
    """
    taken = features.where(~_kind().isin(*UNOCCUPIED)).select("construct_id", F.col("start").alias("at"), F.col("start").alias("next"))
    driver = (_kind() == "promoter") & (F.col("strand") == 1) & (F.col("end") - F.col("start") >= LEAST_PROMOTER_BP) & ~presets.is_marker(_text())
    asked = features.where(driver).select("construct_id", F.col("end").alias("at"), "j", _label().alias("label"), "length")
    w = Window.partitionBy("construct_id").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    ahead = taken.unionByName(asked, allowMissingColumns=True).withColumn("_next", F.min("next").over(w)).where("j is not null")
    return ahead.select("construct_id", "j", "label", F.col("at").alias("start"), F.coalesce("_next", "length").alias("end")).where((F.col("end") - F.col("start")).between(*GAP_BP))


def suggestions(scores: DataFrame, gaps: DataFrame, limit: int = 5) -> DataFrame:
    """``construct_id, rank, kind, start, end, strand, score``: the best frames, then the gaps, widest first, where no frame is confident."""
    best = survey.rank_sites(scores, limit).withColumn("kind", F.lit("orf"))
    more = gaps.select("construct_id", "start", "end", "j", F.lit(1).alias("strand"), F.lit(0).alias("score"), F.lit("cloning_site").alias("kind"))
    # Frames and gaps of a construct are one window: scores are found once, however many questions the gaps ask of them.
    each, gap = Window.partitionBy("construct_id"), F.col("kind") == "cloning_site"
    nth = Window.partitionBy("construct_id", "kind").orderBy(F.col("start") - F.col("end"), "j")
    rows = best.unionByName(more, allowMissingColumns=True)
    rows = rows.withColumn("_sure", F.coalesce(F.max((F.col("rank") == 1) & F.col("confident")).over(each), F.lit(False))).withColumn("_offset", F.coalesce(F.max("rank").over(each), F.lit(0)))
    rows = rows.withColumn("_n", F.row_number().over(nth)).where(~(gap & F.col("_sure")))
    return rows.withColumn("rank", F.when(gap, F.col("_n") + F.col("_offset")).otherwise(F.col("rank"))).select("construct_id", "rank", "kind", "start", "end", "strand", "score")


def choose_sites(requests: DataFrame, features: DataFrame) -> DataFrame:
    """``construct_id, start, end, strand, label, source, error`` for ``requests(construct_id, site_start, site_end, site_strand, site_label)``.

    In order: the interval given, the one coding feature whose label holds ``site_label``, the widest polylinker, the only coding
    feature.  A label that fits none or several is an error and not a guess; a row with an error has no site.
    """
    place = lambda a, b, s, text: F.struct(a.alias("start"), b.alias("end"), s.alias("strand"), text.alias("label"))
    widest = polylinkers(features).withColumn("wide", F.col("end") - F.col("start"))
    widest = widest.groupBy("construct_id").agg(F.max_by(place(F.col("start"), F.col("end"), F.lit(1), F.concat(F.lit("cloning site after "), "label")), F.struct("wide", -F.col("j"))).alias("gap"))
    wanted = requests.select("construct_id", F.lower("site_label").alias("_wanted")).where("site_start is null")
    coding = features.where(_kind() == "cds").withColumn("label", _label()).join(wanted, "construct_id")
    fits = F.col("_wanted").isNull() | F.contains(F.lower("label"), F.col("_wanted"))
    found = coding.where(fits).groupBy("construct_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("j", place(F.col("start"), F.col("end"), F.col("strand"), F.col("label")).alias("p"))).alias("c"))
    made = requests.join(widest, "construct_id", "left").join(found, "construct_id", "left")
    named, only = F.col("site_label").isNotNull(), F.coalesce("n", F.lit(0)) == 1
    source = F.when(F.col("site_start").isNotNull(), "explicit").when(~named & F.col("gap").isNotNull(), "cloning_site").when(only, "annotated_cds")
    given = place(F.col("site_start"), F.col("site_end"), F.coalesce("site_strand", F.lit(1)), F.coalesce("site_label", F.lit("insert")))
    site = F.when(source == "explicit", given).when(source == "cloning_site", F.col("gap")).when(source == "annotated_cds", F.col("c.p"))
    error = F.when(source.isNotNull(), None).when(F.coalesce("n", F.lit(0)) > 1, F.format_string("%d coding features fit", "n")).otherwise("no coding feature fits")
    return made.withColumn("_site", site).select("construct_id", "_site.start", "_site.end", "_site.strand", "_site.label", source.alias("source"), error.alias("error"))


def utr_context(sites: DataFrame, features: DataFrame, most_derived: int = 500) -> DataFrame:
    """``construct_id, j, five_start, five_end, five_source, three_start, three_end, rbs_start, rbs_end, rbs_spacing, notes`` of ``sites(construct_id, j, start, end, strand, length, circular)``.

    The leader is the annotated one, else the span from the next promoter that drives no marker, else that from the ribosome
    binding site, each up to ``most_derived`` bases; the trailer the annotated one, else the span to the polyA signal.  What is
    absent stays null.  ``notes`` are words, joined by commas.
    """
    name = F.coalesce(*[F.when(_is_element(e), e) for e in ELEMENTS])
    upstream = F.col("element").isin(*[e for e, (_, _, up) in ELEMENTS.items() if up])
    elements = features.withColumn("element", name).where("element is not null").withColumn("upstream", upstream)
    near = survey.nearest(sites, elements)
    wide = near.groupBy("construct_id", "j").agg(*[F.max(F.when(F.col("element") == e, F.struct("f_start", "f_end", "distance"))).alias(e) for e in ELEMENTS])
    rows = sites.join(wide, ["construct_id", "j"], "left")
    plus = F.col("strand") == 1

    def span(lo: Column, hi: Column) -> Column:
        turned = F.when(hi > lo, hi).when(F.col("circular") & (hi + F.col("length") > lo), hi + F.col("length"))
        return F.when(turned.isNotNull(), F.struct(lo.alias("start"), turned.alias("end")))

    def ahead(lo: str, hi: str) -> Column:
        return span(F.when(plus, F.col(lo)).otherwise(F.col("end")), F.when(plus, F.col("start")).otherwise(F.col(hi)))

    def whole(e: str) -> Column:
        return F.when(F.col(e).isNotNull(), F.struct(F.col(f"{e}.f_start").alias("start"), F.col(f"{e}.f_end").alias("end")))

    behind = span(F.when(plus, F.col("end")).otherwise(F.col("polya.f_end")), F.when(plus, F.col("polya.f_start")).otherwise(F.col("start")))
    rows = rows.withColumn("_p", F.when(F.col("promoter").isNotNull(), ahead("promoter.f_end", "promoter.f_start"))).withColumn("_r", F.when(F.col("rbs").isNotNull(), ahead("rbs.f_start", "rbs.f_end")))
    fits = lambda c: F.coalesce(F.col(f"{c}.end") - F.col(f"{c}.start") <= most_derived, F.lit(False))
    source = F.when(F.col("five").isNotNull(), "annotated_feature").when(fits("_p"), "derived_from_promoter").when(fits("_r"), "derived_from_rbs").otherwise("absent")
    rows = rows.withColumn("five_source", source)
    leader = F.when(F.col("five_source") == "annotated_feature", whole("five")).when(F.col("five_source") == "derived_from_promoter", F.col("_p")).when(F.col("five_source") == "derived_from_rbs", F.col("_r"))
    rows = rows.withColumn("_five", leader).withColumn("_three", F.coalesce(whole("three"), F.when(F.col("polya").isNotNull(), behind)))

    introns = features.where(_kind() == "intron").select("construct_id", F.col("j").alias("r_j"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inferred = rows.where("five_source = 'derived_from_promoter'").select("construct_id", "j", "_five.start", "_five.end", "length", "circular")
    spliced = intervals.overlap_join(inferred, introns).select("construct_id", "j").distinct().withColumn("_spliced", F.lit(True))
    rows = rows.join(spliced, ["construct_id", "j"], "left")

    inside = F.coalesce(intervals.contains(F.col("_five.start"), F.col("_five.end"), F.col("rbs.f_start"), F.col("rbs.f_end"), F.col("length"), F.col("circular")), F.lit(False))
    has_rbs, spacing = F.col("rbs").isNotNull(), F.col("rbs.distance")
    inferred_here = F.col("five_source") == "derived_from_promoter"
    notes = F.array_compact(F.array(
        F.when(F.col("five.distance") > 0, "gap_behind_leader"),
        F.when(F.col("five").isNull() & F.col("_p").isNotNull() & ~fits("_p"), "promoter_too_far"),
        F.when(F.col("five_source") == "derived_from_rbs", "leader_from_rbs").when(has_rbs & F.col("_five").isNotNull() & ~inside, "rbs_outside_leader"),
        F.when(spacing > RBS_BP, "rbs_far_from_start"),
        F.when(F.col("_five").isNull(), "no_leader"),
        F.when(inferred_here, F.when(has_rbs & inside & (spacing <= RBS_BP), "leader_inferred_rbs_known").otherwise("leader_inferred")),
        F.when(F.col("_spliced"), "leader_spliced"),
        F.when(F.col("_three").isNull(), "no_trailer"),
    ))
    return rows.select(
        "construct_id", "j", F.col("_five.start").alias("five_start"), F.col("_five.end").alias("five_end"), "five_source", F.col("_three.start").alias("three_start"), F.col("_three.end").alias("three_end"),
        F.col("rbs.f_start").alias("rbs_start"), F.col("rbs.f_end").alias("rbs_end"), spacing.alias("rbs_spacing"), F.array_join(notes, ",").alias("notes"),
    )


def remap_features(features: DataFrame, sites: DataFrame) -> DataFrame:
    """``construct_id, j, kind, label, start, end, strand, fate``: features after [site_start, site_end) gives way to ``insert_length`` bases.

    ``sites`` has ``construct_id, site_start, site_end, site_strand, insert_length, preserved``; one that runs over the origin is an
    error (rotate first).  A feature that touches the replaced part is dropped and never clipped, save protein features in frame
    with a preserved protein.  Fates: ``kept``, ``source``, ``in_frame``, and, without positions, ``replaced`` (the coding feature
    itself), ``recombination_lost``, ``dropped``, ``part_dropped`` (of ``parts``, where there is such a column of intervals).
    """
    rows = features.join(sites, "construct_id")
    guard = F.when(F.col("site_end") <= F.col("length"), F.lit(True)).otherwise(F.raise_error(F.lit("the replaced part runs over the origin")))
    rows = rows.where(guard)
    begin, stop, size = F.col("site_start"), F.col("site_end"), F.col("length")
    delta = F.col("insert_length") - (stop - begin)

    def moved(a: Column, b: Column) -> Column:
        by = F.when(b <= begin, F.lit(0)).when((a >= stop) & ((b <= size) | F.col("circular") & (b - size <= begin)), delta)
        return F.when(by.isNotNull(), F.struct((a + by).cast("int").alias("start"), (b + by).cast("int").alias("end")))

    here = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    same = (_kind() == "cds") & (F.col("start") == begin) & (F.col("end") == stop) & (F.col("strand") == F.col("site_strand"))
    phase = F.when(F.col("site_strand") == 1, F.col("start") - begin).otherwise(stop - F.col("end"))
    in_frame = F.col("preserved") & _kind().isin(*PROTEIN_LEVEL) & (F.col("start") >= begin) & (F.col("end") <= stop) & (phase % 3 == 0) & ((F.col("end") - F.col("start")) % 3 == 0)
    torn = F.exists("parts", lambda p: moved(p["start"], p["end"]).isNull()) if "parts" in features.columns else F.lit(False)
    to = moved(F.col("start"), F.col("end"))
    lost = F.when(in_frame, "in_frame").when(presets.is_recombination_site(_text()), "recombination_lost").otherwise("dropped")
    fate = F.when(same, "replaced").when(_kind() == "source", "source").when(to.isNull(), lost).when(F.coalesce(torn, F.lit(False)), "part_dropped").otherwise("kept")
    rows = rows.withColumn("fate", fate)
    at = F.when(F.col("fate") == "source", F.struct(F.lit(0).alias("start"), (size + delta).cast("int").alias("end"))).when(F.col("fate") == "in_frame", here).when(F.col("fate") == "kept", to)
    return rows.withColumn("_at", at).select("construct_id", "j", "kind", "label", "_at.start", "_at.end", "strand", "fate")


def repeat_regions(pairs: DataFrame, least: int = 20) -> DataFrame:
    """``construct_id, start, end, pairs, longest, tandem, risk, worst_first, worst_second, worst_length, strain_helps``.

    Direct repeats ``(construct_id, first, second, length, spacer)`` that are not of low risk, by stretches of their first copies:
    copies that overlap are one region, so a tandem array is one row.  With ``size`` and ``circular`` of the construct
    (:func:`strandloom.operators.repeats.pairs`) regions go on over the origin of circles, where ``end`` is past ``size``.  The worst pair is
    of high risk if any is, then the longest, then the first.  A recombination-deficient strain helps from 200 bases on alone.
    """
    tandem = F.col("spacer") <= 0
    rows = pairs.where(F.col("length") >= least).withColumn("tandem", tandem).withColumn("risk", codons.repeat_risk(F.col("length"), F.col("spacer"), tandem)).where("risk <> 'low'")
    size, circular = (F.col("size"), F.col("circular")) if "size" in pairs.columns else (F.lit(None).cast("int"), F.lit(False))
    rows = intervals.islands(rows, F.col("first"), F.col("first") + F.col("length"), size, circular)
    worst = F.max(F.struct((F.col("risk") == "high").alias("high"), "length", (-F.col("first")).alias("first"), (-F.col("second")).alias("second")))
    made = rows.groupBy("construct_id", "island").agg(F.first("island_start").alias("start"), F.first("island_end").alias("end"), F.count(F.lit(1)).alias("pairs"), F.max("length").alias("longest"), F.max("tandem").alias("tandem"), worst.alias("w"))
    return made.select(
        "construct_id", "start", "end", "pairs", "longest", "tandem", F.when(F.col("w.high"), "high").otherwise("moderate").alias("risk"),
        (-F.col("w.first")).alias("worst_first"), (-F.col("w.second")).alias("worst_second"), F.col("w.length").alias("worst_length"), (F.col("w.length") >= codons.RECA_BP).alias("strain_helps"),
    )


def crossing_repeats(pairs: DataFrame, inserts: DataFrame) -> DataFrame:
    """Direct repeats with one copy inside the insert ``(construct_id, start, end)`` and the other not: a second place to anneal."""
    inside = lambda at: (F.col("start") <= F.col(at)) & (F.col(at) + F.col("length") <= F.col("end"))
    return pairs.join(inserts.select("construct_id", "start", "end"), "construct_id").where(inside("first") != inside("second")).drop("start", "end")


def introns_inside(features: DataFrame, sites: DataFrame) -> DataFrame:
    """``construct_id, j, label``: introns that touch the site ``(construct_id, start, end, length)``; a design must not start on those."""
    introns = features.where(_kind() == "intron").select("construct_id", "j", _label().alias("label"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlap_join(sites.select("construct_id", "start", "end", "length", F.lit(True).alias("circular")), introns).select("construct_id", "j", "label").distinct()
