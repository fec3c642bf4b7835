"""Intervals merged on circles, conflicts, repeat regions and hairpins against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna, intervals
from strandloom.operators import codons, design, placement, repeats, rules, scan
from strandloom.operators.evaluation import REPEAT, SEGMENTS

ROWS = "construct_id long, j int, start int, end int, length int, circular boolean"


def plain_islands(rows, n, circular):
    """{j: (start, end)} by flooding over shared bases; a whole circle is (0, n)."""
    bases = {j: {p % n if circular else p for p in range(a, b)} for j, a, b in rows}
    left, out = set(bases), {}
    while left:
        group, grown = {left.pop()}, True
        while grown:
            more = {j for j in left if any(bases[j] & bases[g] for g in group)}
            grown = bool(more)
            group |= more
            left -= more
        # Links between neighbouring bases that one interval holds tell a whole circle from two ends that touch.
        links = {p % n if circular else p for j, a, b in rows if j in group for p in range(a, b - 1)}
        covered = set().union(*(bases[g] for g in group))
        if circular and len(links) == n:
            span = (0, n)
        else:
            first = [p for p in covered if ((p - 1) % n if circular else p - 1) not in links]
            assert len(first) == 1
            span = (first[0], first[0] + len(covered))
        out |= dict.fromkeys(group, span)
    return out


def test_islands_equal_flooding(spark):
    rng = random.Random(3)
    rows = []
    for c in range(300):
        n, circular = rng.randrange(4, 40), c % 3 != 0
        for j in range(rng.randrange(1, 7)):
            a = rng.randrange(n)
            size = rng.choice((1, 2, 3, 5, n // 2 + 1, n))
            rows.append((c, j, a, a + size if circular else min(a + size, n), n, circular))
    rows += rows[:40]  # repeated rows change nothing
    got = intervals.islands(spark.createDataFrame(rows, ROWS), *map(F.col, ("start", "end", "length", "circular"))).collect()
    assert len(got) == len(rows)
    for c in range(300):
        mine = [r for r in rows if r[0] == c]
        want = plain_islands({r[1:4] for r in mine}, mine[0][4], mine[0][5])
        assert {r.j: (r.island_start, r.island_end) for r in got if r.construct_id == c} == want, mine
        assert len({r.island for r in got if r.construct_id == c}) == len(set(want.values()))


def test_islands_do_not_depend_on_the_turn(spark):
    """Intervals named a turn on or back are the same; empty ones, nulls and empty tables give nothing."""
    rows = [(1, 0, 95, 105, 100, True), (1, 1, 3, 8, 100, True), (1, 2, 208, 220, 100, True), (1, 3, -8, -2, 100, True), (1, 4, 50, 50, 100, True), (1, 5, None, 9, 100, True), (None, 6, 0, 4, 100, True), (2, 7, 0, 5, 100, None)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.j: (r.island_start, r.island_end) for r in intervals.islands(df, *map(F.col, ("start", "end", "length", "circular"))).collect()}
    assert got == {0: (92, 108), 1: (92, 108), 2: (8, 20), 3: (92, 108), 6: (0, 4), 7: (0, 5)}
    assert intervals.islands(df.where("false"), *map(F.col, ("start", "end", "length", "circular"))).count() == 0


BREACHES = "construct_id long, spec_id string, start int, end int, magnitude double, fixable boolean, side string, length int, circular boolean"


def test_conflicts_over_the_origin_and_by_context(spark):
    rows = [
        (1, "d3_splicing", 95, 104, 1.0, True, "", 100, True), (1, "e1_homopolymers", 2, 9, 0.5, True, "", 100, True),  # meet round the origin
        (2, "d3_splicing", 95, 104, 1.0, True, "", 200, False), (2, "e1_homopolymers", 2, 9, 0.5, True, "", 200, False),  # a line: apart
        (3, "d4_internal_polya", 10, 20, 2.0, True, "at", 100, True), (3, "d8_cpg_depletion", 15, 60, 1.0, True, "gc", 100, True), (3, "d8_cpg_depletion", 15, 60, 1.0, True, "gc", 100, True),
        (4, "d4_internal_polya", 10, 20, 2.0, False, "at", 100, True), (4, "d8_cpg_depletion", 15, 60, 1.0, True, "", 100, True),
        (5, "e1_homopolymers", 10, 20, 2.0, True, "", 100, True), (5, "e1_homopolymers", 15, 60, 1.0, True, "", 100, True),  # one rule is no conflict
        (6, "d4_internal_polya", 10, 20, 2.0, True, "at", 100, True), (6, "e1_homopolymers", 12, 18, 1.0, True, "", 100, True),  # one side alone pulls
    ]
    df = spark.createDataFrame(rows, BREACHES)
    by_class = {r.construct_id: tuple(r)[1:] for r in rules.conflicts(df).collect()}
    assert by_class == {
        1: (95, 109, "d3_splicing,e1_homopolymers", "mutually_exclusive", "e1_homopolymers", True),
        3: (10, 60, "d4_internal_polya,d8_cpg_depletion", "opposing_gradient", "d4_internal_polya", False),
        4: (10, 60, "d4_internal_polya,d8_cpg_depletion", "immutable_region", "d4_internal_polya", False),
        6: (10, 20, "d4_internal_polya,e1_homopolymers", "mutually_exclusive", "e1_homopolymers", True),
    }
    # In a context that makes splice sites hard the larger magnitude binds; constructs without a context keep the class.
    own = spark.createDataFrame([(1, "d3_splicing", "HARD_REPAIR"), (1, "b8_kozak", "SOFT")], "construct_id long, spec_id string, enforcement string")
    got = {r.construct_id: (r.binding, r.hard_versus_soft) for r in rules.conflicts(df, own).collect()}
    assert got == {1: ("d3_splicing", False), 3: ("d4_internal_polya", False), 4: ("d4_internal_polya", False), 6: ("e1_homopolymers", True)}
    assert {r.construct_id: r.binding for r in rules.conflicts(df, own.drop("construct_id")).collect()}[1] == "d3_splicing"


def test_declared_conflicts_need_both_present_and_one_fired(spark):
    rows = [(1, "d8_cpg_depletion", 50, 60, 9.0, True, "", 100, True), (1, "d8_cpg_depletion", 5, 6, 1.0, True, "", 100, True), (2, "e2_gc_band", 0, 90, 0.1, True, "", 100, True), (2, "d8_cpg_depletion", 7, 9, 5.0, True, "", 100, True), (3, "e1_homopolymers", 1, 9, 1.0, True, "", 100, True)]
    df = spark.createDataFrame(rows, BREACHES)
    found = rules.declared_conflicts(df, ["d8_cpg_depletion", "e2_gc_band", "e1_homopolymers"])
    assert {tuple(r) for r in found.collect()} == {(1, 5, 6, "d8_cpg_depletion,e2_gc_band", "declared", "d8_cpg_depletion", True), (2, 7, 9, "d8_cpg_depletion,e2_gc_band", "declared", "e2_gc_band", True)}
    assert rules.declared_conflicts(df, ["d8_cpg_depletion", "e1_homopolymers"]).count() == 0
    ids = {r[0] for r in rules.RULES}
    assert all(a < b and {a, b} <= ids for a, b in rules.DECLARED) and len(set(rules.DECLARED)) == len(rules.DECLARED)


def _frame(spark, rows):
    return spark.createDataFrame(rows, f"construct_id long, seq string, circular boolean, segments {SEGMENTS}")


def test_repeat_regions_turn_with_the_circle(spark):
    """A tandem array cut by the origin is the one region it is elsewhere; an exempt array is none."""
    rng = random.Random(9)
    body = "".join(rng.choice("ACGT") for _ in range(600))
    unit = "".join(rng.choice("ACGT") for _ in range(24))
    seq = body[:300] + unit * 6 + body[300:]
    rows = [(by, seq[by:] + seq[:by], True, []) for by in (0, 290, 310, 370, 430, 500)]
    held = [(1000 + r[0], r[1], True, [{"start": (295 - r[0]) % len(seq), "end": (295 - r[0]) % len(seq) + 160, "kind": REPEAT}]) for r in rows]
    pairs = repeats.pairs(_frame(spark, [*rows, *held, (5000, None, True, None), (5001, "", False, []), (5002, seq, False, [])]))
    got = {}
    for r in placement.repeat_regions(pairs).collect():
        got.setdefault(r.construct_id, []).append(r)
    assert set(got) == {*(r[0] for r in rows), 5002}
    shapes = {c: sorted(((r.start + c) % len(seq), r.end - r.start, r.pairs, r.longest, r.tandem, r.risk) for r in found) for c, found in got.items() if c < 1000}
    assert len({str(x) for x in shapes.values()}) == 1, shapes
    for c, found in got.items():
        n, circular = len(seq), c != 5002
        mine = [(j, p.first, p.first + p.length) for j, p in enumerate(pairs.where(F.col("construct_id") == c).withColumn("r", codons.repeat_risk(F.col("length"), F.col("spacer"), F.col("spacer") <= 0)).where("r <> 'low'").collect())]
        assert {(r.start, r.end) for r in found} == set(plain_islands(set(mine), n, circular).values())


def plain_hairpins(seq, circular, least, most):
    """Maximal stems by trying every centre and walking outwards."""
    n, found = len(seq), set()
    pair = dict(zip("ACGT", "TGCA", strict=True))
    for centre in range(n):
        for loop in range(most + 1):
            i, j, stem = centre, centre + loop + 1, 0  # the innermost pair
            if circular and loop + 2 > n or not circular and j >= n:
                continue
            if loop >= 2 and pair[seq[(i + 1) % n]] == seq[(j - 1) % n]:
                continue  # goes on inwards
            while 2 * (stem + 1) + loop <= n and (circular or i - stem >= 0 and j + stem < n) and pair[seq[(i - stem) % n]] == seq[(j + stem) % n]:
                stem += 1
            if stem >= least:
                found.add(((i - stem + 1) % n, j % n, stem, loop))
    return found


@pytest.mark.parametrize("circular", [True, False])
def test_hairpins_equal_walking_from_every_centre(spark, circular):
    rng = random.Random(4)
    rows = []
    for c in range(25):
        body = [rng.choice("ACGT") for _ in range(160)]
        arm = "".join(rng.choice("ACGT") for _ in range(rng.choice((12, 15, 22))))
        seq = "".join(body[:40]) + arm + "".join(body[40 : 40 + rng.choice((0, 1, 7, 30))]) + dna.complement_text(arm) + "".join(body[80:])
        by = rng.randrange(len(seq))
        rows.append((c, seq[by:] + seq[:by], circular, []))
    got = {}
    for r in repeats.hairpins(_frame(spark, rows), 10, 25).collect():
        assert r.palindrome == (r.loop == 0) and (r.end - r.start, r.second_end - r.second_start) == (r.stem, r.stem)
        got.setdefault(r.construct_id, set()).add((r.start, r.second_start, r.stem, r.loop))
    for c, seq, _, _ in rows:
        assert got.get(c, set()) == plain_hairpins(seq, circular, 10, 25), seq
    assert got


def test_hairpins_in_exempt_segments_are_meant(spark):
    arm = "ACGATTGCCATAGGCTTACGGATC"
    seq = "T" * 30 + arm + "GAA" + dna.complement_text(arm) + "CCATG" * 8
    whole = [{"start": 25, "end": 90, "kind": REPEAT}]
    half = [{"start": 25, "end": 56, "kind": REPEAT}]
    got = {r.construct_id: (r.start, r.stem, r.loop) for r in repeats.hairpins(_frame(spark, [(1, seq, True, []), (2, seq, True, whole), (3, seq, True, half), (4, None, None, None), (5, "ACGT", True, None)])).collect()}
    assert got == {1: (30, 24, 3), 3: (30, 24, 3)}


def test_forbidden_motifs_the_backbone_carries(spark):
    """Replaced bases carry nothing, the origin and both strands count; equal to masking and searching in plain Python."""
    rng = random.Random(6)
    rows = []
    for c in range(150):
        n, circular = rng.randrange(1, 50), c % 2 == 0
        a = rng.randrange(n)
        size = rng.choice((0, 3, n // 2, n))
        rows.append((c, "".join(rng.choice("ACGT") for _ in range(n)), circular, a, a + size if circular else min(a + size, n)))
    motifs = ["A", "CG", "ACG", "GAAT", "TTT", "GATC"]
    got = {r.construct_id: (r.usable, r.carried) for r in scan.split_forbidden(spark.createDataFrame([*rows, (900, None, True, 0, 3)], "construct_id long, seq string, circular boolean, start int, end int"), motifs).collect()}
    for c, seq, circular, a, b in rows:
        kept = list(seq)
        for p in range(a, b):
            kept[p % len(seq)] = "N"
        held = lambda m, kept="".join(kept), circular=circular: any(x in (kept + kept[: len(m) - 1] if circular else kept) for x in (m, dna.complement_text(m)))
        assert got[c] == ([m for m in motifs if not held(m)], [m for m in motifs if held(m)]), (seq, circular, a, b)
    assert got[900] == (motifs, [])
    with pytest.raises(ValueError):
        scan.split_forbidden(spark.createDataFrame([], "construct_id long, seq string, circular boolean, start int, end int"), ["GANTC"])


def test_designs_avoid_what_their_backbone_leaves_usable(spark):
    """A motif that one request may not hold is free to another whose backbone carries it already."""
    rows = [(1, "MKFEF" * 4, "clear", ["GAATTC"]), (2, "MKFEF" * 4, "clear", []), (3, "MKFEF" * 4, "clear", None)]
    made = design.solve(spark.createDataFrame(rows, "design_id long, protein string, screen string, forbidden array<string>"), 1, ["GAGTTC"], weights={"GAA": 5.0, "TTC": 5.0, "GAG": 1.0}, repair=False).collect()
    held = {d: {("GAATTC" in r.cds, "GAGTTC" in r.cds) for r in made if r.design_id == d and r.cds} for d in (1, 2, 3)}
    assert all(not a for a, _ in held[1]) and any(a for a, _ in held[2]) and all(not b for _, b in held[3])
