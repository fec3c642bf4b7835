"""Placement in backbones: branches that the derived tables seldom reach, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import codons, evaluation, placement, rules, survey
from strandloom.functions import dna

FEATURE = "construct_id long, length int, circular boolean, j int, kind string, label string, note string, regulatory_class string, start int, end int, strand int"


def _features(spark, rows, length=5000, circular=True):
    return spark.createDataFrame([(1, length, circular, j, k, lab, note, cls, a, b, s) for j, (k, lab, note, cls, a, b, s) in enumerate(rows)], FEATURE)


def _score(spark, rows, frame=(1000, 1903, 1)):
    frames = spark.createDataFrame([(1, *frame, 5000)], "construct_id long, start int, end int, strand int, length int")
    got = placement.frame_scores(frames, _features(spark, rows)).collect()
    assert len(got) == 1
    return got[0]


@pytest.mark.parametrize(
    ("row", "reason", "points"),
    [
        (("regulatory", "Kozak", None, None, 990, 1000, 1), "kozak:3", 3),
        (("regulatory", "enhancer", "a KOZAK box", None, 1003, 1010, 1), "kozak:3", 3),
        (("regulatory", "Kozak", None, None, 1004, 1010, 1), "", 0),
        (("sig_peptide", "sp", None, None, 1003, 1060, 1), "signal_peptide:3", 3),
        (("sig_peptide", "sp", None, None, 1004, 1060, 1), "", 0),
        (("CDS", "gfp", None, None, 1900, 1990, -1), "cds:2", 2),
        (("CDS", "x", "confers resistance", None, 1900, 1990, -1), "marker:-8", -8),
        (("rep_origin", None, None, None, 4900, 6001, 1), "origin:-8", -8),
        (("rep_origin", None, None, None, 4900, 6000, 1), "", 0),
        (("promoter", "cmv", None, None, 0, 1000, 1), "promoter:2", 2),
        (("promoter", "AmpR promoter", None, None, 0, 1000, 1), "", 0),
        (("promoter", "cmv", None, None, 0, 1000, -1), "", 0),
        (("polyA_site", "pA", None, None, 1903, 1950, 1), "polya:2", 2),
        (("polyA_signal", "pA", None, None, 1800, 1950, 1), "", 0),
    ],
)
def test_each_signal(spark, row, reason, points):
    got = _score(spark, [row])
    assert (got.score, got.aa) == (3 + points, 301)
    assert got.reasons == ",".join(sorted(x for x in ("length:3", reason) if x))
    assert got.confident == (got.score >= 8)


def test_payload_and_reverse_frames(spark):
    pair = [("LTR", None, None, None, 100, 300, 1), ("misc_feature", "AAV ITR", None, None, 2000, 2200, 1)]
    assert _score(spark, pair).reasons == "length:3,payload:2"
    assert _score(spark, pair[:1]).reasons == "length:3"
    back = [("promoter", "cmv", None, None, 1950, 2100, -1), ("polyA_signal", "pA", None, None, 800, 990, -1), ("sig_peptide", "sp", None, None, 1840, 1903, -1)]
    assert _score(spark, back, (1000, 1903, -1)).reasons == "length:3,polya:2,promoter:2,signal_peptide:3"
    assert _score(spark, back, (1000, 1903, -1)).confident


def test_empty_tables(spark):
    none = _features(spark, [("CDS", "a", None, None, 0, 9, 1)]).where("false")
    frames = spark.createDataFrame([(1, 10, 100, 1, 5000)], "construct_id long, start int, end int, strand int, length int")
    scores = placement.frame_scores(frames, none)
    assert [r.score for r in scores.collect()] == [0]
    assert placement.frame_scores(frames.where("false"), none).count() == 0
    assert placement.suggestions(scores, placement.polylinkers(none)).count() == 1
    asked = spark.createDataFrame([(1, None, None, None, None)], "construct_id long, site_start int, site_end int, site_strand int, site_label string")
    assert placement.choose_sites(asked, none).collect()[0].error == "no coding feature fits"


def test_polylinkers_and_order_of_sites(spark):
    rows = [("promoter", "cmv", None, None, 100, 200, 1), ("primer_bind", "p", None, None, 210, 230, 1), ("CDS", "gfp", None, None, 260, 500, 1), ("promoter", "t7", None, None, 600, 620, 1), ("promoter", "ef1a", None, None, 700, 800, 1), ("CDS", "gfp2", None, None, 900, 990, 1), ("promoter", "AmpR promoter", None, None, 1000, 1100, 1), ("source", None, None, None, 0, 1200, 1)]
    marks = _features(spark, rows, length=1200)
    assert {(r.label, r.start, r.end) for r in placement.polylinkers(marks).collect()} == {("cmv", 200, 260), ("ef1a", 800, 900)}
    ask = lambda a=None, b=None, label=None: placement.choose_sites(spark.createDataFrame([(1, a, b, None, label)], "construct_id long, site_start int, site_end int, site_strand int, site_label string"), marks).collect()[0]
    assert (ask().source, ask().start, ask().end) == ("cloning_site", 800, 900)
    assert (ask(5, 50).source, ask(5, 50).label) == ("explicit", "insert")
    assert (ask(label="GFP2").source, ask(label="GFP2").start) == ("annotated_cds", 900)
    assert (ask(label="gfp").source, ask(label="gfp").error) == (None, "2 coding features fit")
    assert ask(label="rfp").error == "no coding feature fits"


def test_context_of_sites(spark):
    site = spark.createDataFrame([(1, 0, 1000, 1300, 1, 5000, True)], "construct_id long, j int, start int, end int, strand int, length int, circular boolean")
    get = lambda rows: placement.utr_context(site, _features(spark, rows)).collect()[0]
    cmv, far = ("promoter", "cmv", None, None, 700, 900, 1), ("promoter", "cmv", None, None, 100, 300, 1)
    rbs = ("regulatory", "sd", None, "Shine_Dalgarno_sequence", 980, 990, 1)
    stop = ("polyA_signal", "pA", None, None, 1500, 1550, 1)
    one = get([cmv, rbs, stop])
    assert (one.five_start, one.five_end, one.five_source, one.rbs_spacing) == (900, 1000, "derived_from_promoter", 10)
    assert (one.three_start, one.three_end, one.notes) == (1300, 1500, "leader_inferred_rbs_known")
    two = get([far, rbs])
    assert (two.five_start, two.five_end, two.notes) == (980, 1000, "promoter_too_far,leader_from_rbs,no_trailer")
    three = get([("5'UTR", None, None, None, 950, 998, 1), ("RBS", None, None, None, 900, 910, 1), ("3'UTR", None, None, None, 1300, 1400, 1)])
    assert (three.five_source, three.three_end, three.notes) == ("annotated_feature", 1400, "gap_behind_leader,rbs_outside_leader,rbs_far_from_start")
    assert get([cmv, stop, ("intron", None, None, None, 910, 950, 1)]).notes == "leader_inferred,leader_spliced"
    assert get([("promoter", "AmpR", None, None, 700, 900, 1)]).notes == "no_leader,no_trailer"


def test_context_over_the_origin(spark):
    site = spark.createDataFrame([(1, 0, 100, 400, 1, 5000, True), (1, 1, 100, 400, -1, 5000, True)], "construct_id long, j int, start int, end int, strand int, length int, circular boolean")
    got = {r.j: r for r in placement.utr_context(site, _features(spark, [("promoter", "cmv", None, None, 4700, 4900, 1), ("polyA_signal", None, None, None, 4800, 4850, -1)])).collect()}
    assert (got[0].five_start, got[0].five_end) == (4900, 5100)
    assert (got[1].three_start, got[1].three_end) == (4850, 5100)


def test_features_behind_a_replacement(spark):
    rows = [("CDS", "old", None, None, 1000, 1300, 1), ("source", None, None, None, 0, 5000, 1), ("promoter", "a", None, None, 900, 1000, 1), ("promoter", "b", None, None, 1300, 1400, 1), ("misc", "c", None, None, 990, 1010, 1), ("misc", "loxP", None, None, 1100, 1134, 1), ("sig_peptide", "d", None, None, 1000, 1060, 1), ("sig_peptide", "e", None, None, 1001, 1061, 1), ("misc", "f", None, None, 4900, 5100, 1), ("misc", "g", None, None, 4900, 6100, 1)]
    site = lambda size, kept: spark.createDataFrame([(1, 1000, 1300, 1, size, kept)], "construct_id long, site_start int, site_end int, site_strand int, insert_length int, preserved boolean")
    got = {r.j: (r.fate, r.start, r.end) for r in placement.remap_features(_features(spark, rows), site(330, False)).collect()}
    assert got == {0: ("replaced", None, None), 1: ("source", 0, 5030), 2: ("kept", 900, 1000), 3: ("kept", 1330, 1430), 4: ("dropped", None, None), 5: ("recombination_lost", None, None), 6: ("dropped", None, None), 7: ("dropped", None, None), 8: ("kept", 4930, 5130), 9: ("dropped", None, None)}
    same = {r.j: (r.fate, r.start) for r in placement.remap_features(_features(spark, rows), site(300, True)).collect()}
    assert (same[6], same[7]) == (("in_frame", 1000), ("dropped", None))
    parts = _features(spark, [("misc", "m", None, None, 1500, 1900, 1)]).withColumn("parts", F.array(F.struct(F.lit(1500).alias("start"), F.lit(1600).alias("end")), F.struct(F.lit(1200).alias("start"), F.lit(1250).alias("end"))))
    assert [r.fate for r in placement.remap_features(parts, site(300, False)).collect()] == ["part_dropped"]
    with pytest.raises(Exception, match="origin"):
        placement.remap_features(_features(spark, rows, length=1200), site(300, False)).collect()


def _risk(length, spacer, tandem):
    if tandem:
        return "high" if length >= 20 else "moderate"
    if length < 20:
        return "low"
    if length >= 200:
        return "high" if spacer <= 1000 else "moderate"
    return "high" if spacer <= 100 else "moderate" if spacer <= 1000 or length >= 100 else "low"


def test_risk_and_regions_equal_plain_grouping(spark):
    rng = random.Random(5)
    pairs = [(c, s, s + n + gap, n, gap) for c in range(40) for s, n, gap in ((rng.randrange(900), rng.choice((10, 19, 20, 24, 99, 100, 199, 200, 260)), rng.choice((0, 0, 5, 100, 101, 1000, 1001, 5000))) for _ in range(9))]
    df = spark.createDataFrame(pairs, "construct_id long, first int, second int, length int, spacer int")
    rows = df.withColumn("risk", codons.repeat_risk(F.col("length"), F.col("spacer"), F.col("spacer") == 0)).collect()
    assert all(r.risk == _risk(r.length, r.spacer, r.spacer == 0) for r in rows)
    want = set()
    for c in range(40):
        groups = []
        for p in sorted(x for x in pairs if x[0] == c and x[3] >= 20 and _risk(x[3], x[4], x[4] == 0) != "low"):
            home = next((g for g in groups if p[1] < max(q[1] + q[3] for q in g)), None)
            groups.append([p]) if home is None else home.append(p)
        for g in groups:
            top = max(g, key=lambda q: (_risk(q[3], q[4], q[4] == 0) == "high", q[3], -q[1], -q[2]))
            want.add((c, min(q[1] for q in g), max(q[1] + q[3] for q in g), len(g), max(q[3] for q in g), any(q[4] == 0 for q in g), _risk(top[3], top[4], top[4] == 0), top[1], top[2], top[3], top[3] >= 200))
    assert {tuple(r) for r in placement.repeat_regions(df).collect()} == want


def _plain_frames(seq, circular, least):
    """Frames by walking from every start codon, up to three turns of a circle."""
    n, out = len(seq), set()
    for strand in (1, -1):
        once = seq if strand == 1 else dna.complement_text(seq)
        text, best = (once * 3 if circular else once), {}
        for s in range(n):
            if text[s : s + 3] == "ATG":
                end = next((i for i in range(s, len(text) - 2, 3) if text[i : i + 3] in ("TAA", "TAG", "TGA")), None)
                if end is not None and (end - s) // 3 >= least:
                    best[end] = min(best.get(end, s), s)
        out |= {(s % n if strand == 1 else (n - e - 3) % n, (s % n if strand == 1 else (n - e - 3) % n) + e + 3 - s, strand) for e, s in best.items()}
    return out


def test_frames_of_more_than_two_turns(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACG" if i % 2 else "ACGT") for _ in range(rng.randrange(3, 80))) + "ATG" * (i % 3) for i in range(60)] + ["CCCCCTAACCCCCCCCATG", "CATCCCC"]
    rows = [(i, s, i % 5 != 0) for i, s in enumerate(seqs)]
    got = evaluation.open_frames(spark.createDataFrame(rows, "construct_id long, seq string, circular boolean"), 1, 2).collect()
    for i, s, circular in rows:
        assert {(r.start, r.end, r.strand) for r in got if r.construct_id == i} == _plain_frames(s, circular, 2), s


def test_junction_arms_equal_plain_search(spark):
    """Every length is tried; an arm counts as unique if it lies nowhere else on either strand."""
    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (10, 14, 15, 39, 60, 200, 400)]
    block = "".join(rng.choice("ACGT") for _ in range(50))
    seqs += [block * 4, block + "ACCA" + dna.complement_text(block) + "GGCATT", "AT" * 60, "A" * 80 + "GC" * 40, block[:25] + dna.complement_text(block[:25]) + "C" * 60]
    rows = [(2 * i + c, s, len(s), bool(c), str(at), at) for i, s in enumerate(seqs) for c in (0, 1) for at in (0, 5, len(s) // 3, 25, len(s) - 8) if 0 <= at < len(s)]
    df = spark.createDataFrame(rows, "construct_id long, seq string, length int, circular boolean, junction string, at int")
    tm = {}
    want = {}
    for cid, s, n, circular, name, at in rows:
        options = []
        for size in range(15, 41):
            start = at - size // 2
            start = start % n if circular else start
            if size > n or start < 0 or not circular and start + size > n:
                continue
            arm = (s * 2)[start : start + size]
            places = range(n if circular else n - size + 1)
            text = s * 2 if circular else s
            other = [i for i in places if text[i : i + size] == arm and i != start or arm != dna.complement_text(arm) and text[i : i + size] == dna.complement_text(arm)]
            options.append((start, size, arm, not other))
        want[cid, name] = options
        tm |= {o[2]: None for o in options}
    arms = spark.createDataFrame([(a,) for a in tm], "a string")
    tm = dict(arms.select("a", dna.melting_temperature(F.col("a"), oligo_nm=250.0, table="2004")).collect())
    for r in survey.junction_arms(df).collect():
        options = want[r.construct_id, r.junction]
        if not options:
            assert (r.arm, r.start, r.usable) == (None, None, False)
            continue
        best = next((o for o in options if o[3] and tm[o[2]] >= 48), options[-1])
        assert (r.start, r.end - r.start, r.arm, r.unique) == best
        assert r.usable == (best[3] and tm[best[2]] >= 48)


def test_repeats_that_cross_and_rule_sets(spark):
    pairs = spark.createDataFrame([(1, 0, 100, 20, 80), (1, 100, 150, 20, 30), (1, 95, 300, 20, 185), (1, 300, 400, 20, 80), (2, 0, 100, 20, 80)], "construct_id long, first int, second int, length int, spacer int")
    inserts = spark.createDataFrame([(1, 100, 200)], "construct_id long, start int, end int")
    assert [(r.first, r.second) for r in placement.crossing_repeats(pairs, inserts).collect()] == [(0, 100)]
    context = rules.slots(spark).where("host = 'e_coli_k12' and modality = 'bacterial_expression'")
    none = dict(rules.rule_set(context).collect())
    right = dict(rules.rule_set(context, "viennarna:rna_turner2004").collect())
    assert (none["b1_five_prime"], right["b1_five_prime"], none["d3_splicing"], none["e1_homopolymers"]) == ("unrunnable", "run", "gated_out", "run")
    with pytest.raises(ValueError, match="b1_five_prime"):
        rules.rule_set(context, "other:1")
