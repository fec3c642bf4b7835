"""Kernels against brute force and known answers."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom import dims, verify
from strandloom.functions import arrays, dna, intervals
from strandloom.operators import catalog, design, evaluation, kmers, presets, repair, runs, scan, scoring, solver, transcript, vendors, windows

DNA = st.text("ACGT", min_size=3, max_size=60)
AA = "ACDEFGHIKLMNPQRSTVWY"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, len(s), c) for i, (s, c) in enumerate(rows)], "construct_id long, seq string, length int, circular boolean")


def brute_hits(seq, circular, motif):
    k = len(motif)
    hay = seq + seq[: k - 1] if circular else seq
    if len(seq) < k:
        return set()
    plain = set(dna.iupac_expand(motif))
    back = {dna.complement_text(m) for m in plain}
    out = {(i, 1) for i in range(len(hay) - k + 1) if hay[i : i + k] in plain}
    if dna.complement_text(motif) != motif:
        out |= {(i, -1) for i in range(len(hay) - k + 1) if hay[i : i + k] in back}
    return out


def test_motifs_wrap_overlap_and_strand(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("ACGT", k=rng.randint(1, 80))), rng.random() < 0.5) for _ in range(60)] + [("AAAAAAA", True), ("", False), ("CATA", True)]
    for motif in ("ATG", "AA", "GATC", "RYN", "AAAAAAAA"):
        got = {}
        for r in scan.motifs(frame(spark, rows), {"m": motif}).collect():
            got.setdefault(r.construct_id, set()).add((r.pos, r.strand))
        for i, (s, c) in enumerate(rows):
            assert got.get(i, set()) == brute_hits(s, c, motif), (motif, s, c)


def test_invariant_construct(spark):
    seq = "ATGAAACCCTAA" + "GGATCCAAGCTTGTCGACCTGCAG"
    df = frame(spark, [(seq, True)])
    hits = {(r.name, r.pos, r.strand) for r in scan.motifs(df, {"across": "CAGATG", "junction": "TAAGGA", "back": "TGGATCC"}).collect()}
    assert ("across", len(seq) - 3, 1) in hits and ("junction", 9, 1) in hits
    assert {h for h in hits if h[0] == "back"} <= {("back", p, -1) for p in range(len(seq))}
    checked = verify.checks(df.withColumns({"cds_start": F.lit(0), "cds_end": F.lit(12), "protein": F.lit("MKP"), "reference": F.lit(seq)}), 11, ["GAATTC"], (0.0, 1.0))
    row = checked.first()
    assert all(row[i] for i in verify.INVARIANTS)
    assert verify.require(checked).count() == 1
    changed = seq[:20] + ("A" if seq[20] != "A" else "C") + seq[21:]
    bad = verify.checks(frame(spark, [(changed, True)]).withColumns({"cds_start": F.lit(0), "cds_end": F.lit(12), "protein": F.lit("MKP"), "reference": F.lit(seq)}), 11, [], (0.0, 1.0))
    assert not bad.first().i9
    with pytest.raises(Exception, match="I9"):
        verify.require(bad).count()


@pytest.mark.parametrize("table", sorted(dims.DIFFERENCES))
def test_round_trip_in_every_code(table):
    code = dims.genetic_code(table)
    protein = "".join(a for a in AA if a in dims.synonyms(table))
    cds = solver.back_translate(protein, table)
    assert "".join(code[cds[i : i + 3]] for i in range(0, len(cds) - 3, 3)) == protein
    assert cds[-3:] in dims.stops(table)


@settings(max_examples=40, deadline=None)
@given(st.text(AA, min_size=1, max_size=5), st.lists(st.text("ACGT", min_size=3, max_size=5), min_size=1, max_size=3))
def test_lattice_is_optimal(protein, forbidden):
    rng = random.Random(len(protein))
    cost = {c: rng.random() for c in dims.CODONS}
    closed = dna.strand_closure(forbidden)
    best = min((sum(cost[c] for c in combo) for combo in itertools.product(*(dims.synonyms(1)[a] for a in protein)) if not any(m in "".join(combo) for m in closed)), default=None)
    try:
        got = solver.back_translate(protein, 1, cost, forbidden, stop=False)
    except solver.Infeasible:
        assert best is None
        return
    assert best is not None and abs(sum(cost[got[i : i + 3]] for i in range(0, len(got), 3)) - best) < 1e-9
    assert not any(m in got for m in closed)


def test_band_and_greedy_and_repair():
    protein = "MKLVAGST" * 12
    for band in ((0.30, 0.40), (0.55, 0.62)):
        assert band[0] <= solver.gc_of(solver.solve_in_band(protein, 1, band)) <= band[1]
    low, high = solver.reachable_gc(protein, 1)
    assert low < 0.4 < 0.55 < high
    with pytest.raises(solver.Infeasible):
        solver.solve_in_band(protein, 1, (0.95, 1.0))
    cost = {c: 0.0 for c in dims.CODONS}
    greedy = solver.greedy_back_translate(protein, 1, cost, ["GAATTC"])
    assert "GAATTC" not in greedy and len(greedy) == 3 * len(protein)
    start = solver.back_translate("M" + "K" * 6 + "GGGGS" * 6, 1, {c: -c.count("A") for c in dims.CODONS}, stop=False)
    protein = "M" + "K" * 6 + "GGGGS" * 6
    whole = evaluation.Construct(start, False, [{"start": 0, "end": len(start), "kind": evaluation.DESIGNABLE}])
    rules_ = {"e1_homopolymers": {"max_at": 5}, "f1_direct_repeats": {"min_len": 8, "hard_len": 12}}
    count = lambda seq: len([b for s in rules_ for b in catalog.rule_set([s], rules_)[s](evaluation.Construct(seq, False, whole.segments)) if catalog.CATALOG[s].fails(*b[:3], b[4])])
    made = repair.repair(whole, 0, protein, 1, tuple(rules_), rules_)
    code = dims.genetic_code(1)
    assert "".join(code[made.cds[i : i + 3]] for i in range(0, len(made.cds), 3)) == protein
    assert count(made.seq) < count(start)


def test_design_needs_a_verdict(spark):
    rows = spark.createDataFrame([(1, "MKTAYIAK", "not_run"), (2, "MGSSHHHH", "clear")], "design_id long, protein string, screen string")
    made = design.solve(rows, 1, list(dims.SIX_CUTTERS.values())).collect()
    assert len(made) == 6 and all(r.cds and r.status == "ok" for r in made)
    assert {r.degradations != "" for r in made if r.design_id == 1} == {True} and {r.degradations for r in made if r.design_id == 2 and r.breaches == 0} <= {""}
    for bad in ("block", None, "unknown"):
        with pytest.raises(Exception, match="screening verdict"):
            design.solve(spark.createDataFrame([(1, "MKT", bad)], "design_id long, protein string, screen string"), 1, []).collect()
    whole = design.assemble(design.solve(rows, 1, []), spark.createDataFrame([(1, "GGATCC" * 20, 30, 60), (2, "GGATCC" * 20, 0, 12)], "design_id long, sequence string, site_start int, site_end int"))
    checked = verify.checks(whole.withColumn("protein", F.when(F.col("construct_id") == 1, "MKTAYIAK").otherwise("MGSSHHHH")), 1, [], (0.0, 1.0))
    assert verify.require(checked).count() == 6


@settings(max_examples=30, deadline=None)
@given(DNA, st.integers(3, 6))
def test_direct_repeats_hold(seq, k):
    found = kmers.repeats_of(seq, k)
    for a, b, n, spacer in found:
        assert seq[a : a + n] == seq[b : b + n] and n >= k and spacer == b - a - n >= 0
    planted = seq + "ACGTTGCAAC" + "TTT" + "ACGTTGCAAC"
    assert any(n >= 10 for _, _, n, _ in kmers.repeats_of(planted, 8))


def test_tandem_array_is_quick_and_stems(spark):
    assert kmers.repeats_of("GGTGGTGGTGGTAGC" * 400, 12)
    assert kmers.stems_of("AAACCCGGTTA" + "TTTT" + "TAACCGGGTTT", 8, 20)[0][2] == 11
    base = "".join(random.Random(1).choices("ACGT", k=60))
    other = base[:30] + ("A" if base[30] != "A" else "C") + base[31:]
    assert kmers.near_repeats_of(base + "T" * 7 + other)[0][3] == 1


def test_circular_runs_and_islands(spark):
    got = {(r.construct_id, r.base, r.start, r.run) for r in runs.homopolymers(frame(spark, [("AACGTAAA", True), ("AACGTAAA", False), ("TTTT", True)]), 2).collect()}
    assert got == {(0, "A", 5, 5), (1, "A", 0, 2), (1, "A", 5, 3), (2, "T", 0, 4)}
    seq = "G" * 10 + "AT" * 20 + "G" * 10
    flagged = windows.gc_windows(frame(spark, [(seq, True)]), 10).where("gc >= 0.9")
    regions = [(r.start, r.end) for r in windows.islands(flagged, 10, F.max("gc"), "gc").collect()]
    assert len(regions) == 1 and regions[0][1] > len(seq)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 29), st.integers(1, 30), st.integers(0, 29), st.integers(1, 30))
def test_overlap_on_a_circle(a, n, b, m):
    import pyspark.sql

    spark = pyspark.sql.SparkSession.getActiveSession() or pyspark.sql.SparkSession.builder.getOrCreate()
    lit = F.lit
    col = intervals.overlap_length(lit(a), lit(a + n), lit(b), lit(b + m), lit(30), lit(True))
    got = spark.range(1).select(col.alias("x")).first().x
    best = max(sum(1 for p in range(a, a + n) if b + s <= p < b + m + s) for s in (0, 30, -30))
    assert got == best


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(dna.span_text(F.lit(8), F.lit(12), F.lit(10))) == "9..10,1..2"
    assert get(dna.circular_slice(F.lit("ACGTT"), F.lit(3), F.lit(7), F.lit(-1))) == dna.complement_text("TTAC")
    assert get(intervals.remap(F.lit(50), F.lit(10), F.lit(20), F.lit(4))) == 44
    assert get(dna.translate(F.lit("ATGTAA"), dims.genetic_code(1))) == "M*"
    assert abs(get(dna.melting_temperature(F.lit("CGTTGACTGATCCGATACGT"))) - 50) < 15
    assert len(dna.iupac_expand("NNNNN")) == 1024
    with pytest.raises(ValueError):
        dna.iupac_expand("N" * 6)
    with pytest.raises(ValueError):
        vendors.selection([])
    assert transcript.g4hunter("GGGTTAGGGTTAGGGTTAGGG") > 1.2
    assert scoring.greedy_picks(["AAAAAA", "AAAAAC", "CCCCCC", "AAAAAA"], 2) == [0, 2]


def test_null_is_a_prefix(spark):
    cds = spark.createDataFrame([(1, "ATGAAACTGGGTCCT")], "construct_id long, cds string")
    small = {(r.variant, r.cds) for r in scoring.variants(cds, 3, 1).collect()}
    large = {(r.variant, r.cds) for r in scoring.variants(cds, 8, 1).collect()}
    assert small < large
    code = dims.genetic_code(1)
    assert {"".join(code[v[i : i + 3]] for i in range(0, 15, 3)) for _, v in large} == {"MKLGP"}
    only = scoring.variants(cds, 4, 1, weights={"CTG": 1.0}).collect()
    assert {r.cds[6:9] for r in only} == {"CTG"}


def test_presets_labels_and_report(spark):
    from strandloom.operators import presets, rules

    scores = spark.createDataFrame([(1, "c1_cai", 0.8, 0.5, 40, None), (1, "b1_five_prime", None, None, 0, "no folding engine")], "candidate long, spec_id string, raw double, percentile double, n int, reason string")
    row = presets.report(scores).first()
    assert "50.0%" in row.report and "no folding engine" in row.report and not row.complete
    got = {r.spec_id: r.weight for r in presets.weights_for(scores, "ecoli_expression").collect()}
    assert got == {"c1_cai": 0.2, "b1_five_prime": 1.0}
    assert {r.status for r in presets.resolve(presets.preset_table(spark), rules.rules(spark)).collect()} == {"weighted"}
    labels = spark.createDataFrame([("AmpR beta-lactamase",), ("attB1",), ("gene",)], "x string")
    assert [tuple(r) for r in labels.select(presets.is_marker(F.col("x")), presets.is_recombination_site(F.col("x"))).collect()] == [(True, False), (False, True), (False, False)]


def test_registered_designs_are_repaired(spark, tmp_path):
    from strandloom import dims
    from strandloom.operators import design
    from strandloom.plans import engine

    spark.createDataFrame([(k, a * 30) for k, a in enumerate(("K", "G", "KF", "LP", "AG", "SR"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    requests = engine.proteins(spark, str(tmp_path)).selectExpr("construct_id as design_id", "protein", "'not_run' as screen")
    gc = {}
    for repair in (False, True):
        rows = design.solve(requests, 1, list(dims.SIX_CUTTERS.values()), repair=repair).collect()
        gc[repair] = {(r.design_id, r.lean): r.cds and round(sum(c in "GC" for c in r.cds) / len(r.cds), 6) for r in rows}
    assert gc[False] != gc[True]
    assert {(r.design_id, r.lean): r.gc for r in engine.lattice(spark, str(tmp_path)).collect()} == gc[True]


def _random_dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_seed_pairs_and_tracts_equal_brute_force():
    rng = random.Random(21)
    for _ in range(25):
        seq = _random_dna(rng, rng.randrange(0, 160), rng.choice(("ACGT", "AT", "ACG")))
        k, loop = rng.choice((3, 5)), rng.choice((0, 4, 30))
        want = {(i, j) for i in range(len(seq) - k + 1) for j in range(i + k, min(i + k + loop, len(seq) - k) + 1) if seq[j : j + k] == dna.complement_text(seq[i : i + k])}
        left, right = kmers.seed_pairs(seq, k, loop)
        assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == sorted(want)
        found = []
        for unit in range(1, 5):
            i = 0
            while i + unit < len(seq):
                j = i
                while j + unit < len(seq) and seq[j] == seq[j + unit]:
                    j += 1
                if j > i and j + unit - i >= max(8, 2 * unit) and not any(u < unit and s <= i and j + unit <= s + t for u, s, t in found):
                    found.append((unit, i, j + unit - i))
                i = max(j, i + 1)
        assert sorted(runs.tracts_of(seq, (2, 4), 8)) == sorted(x for x in found if x[0] >= 2)


def test_stems_are_maximal_inverted_repeats():
    rng = random.Random(22)
    for _ in range(20):
        seq = _random_dna(rng, 120)
        for left, right, stem, loop in kmers.stems_of(seq, 4, 20):
            assert seq[right : right + stem] == dna.complement_text(seq[left : left + stem]) and right - left - stem == loop <= 20
            assert left == 0 or right + stem == len(seq) or seq[left - 1] != dna.complement_text(seq[right + stem])
        best = max((s[2] for s in kmers.stems_of(seq, 4, 20)), default=0)
        want = max((n for n in range(4, 61) for i in range(len(seq) - n) for j in range(i + n, min(i + n + 20, len(seq) - n) + 1) if seq[j : j + n] == dna.complement_text(seq[i : i + n])), default=0)
        assert best == want


def test_direct_repeats_are_exact_and_maximal():
    rng = random.Random(23)
    for _ in range(20):
        core = _random_dna(rng, 18)
        seq = _random_dna(rng, 40) + core + _random_dna(rng, 30) + core + _random_dna(rng, 20)
        found = kmers.repeats_of(seq, 12)
        assert found and found[0][2] >= 18
        for a, b, n, spacer in found:
            assert seq[a : a + n] == seq[b : b + n] and spacer == b - a - n
            assert a == 0 or n == b - a or seq[a - 1] != seq[b - 1]


def test_g4hunter_peak_equals_plain_windows():
    def plain(seq, width=25):
        best = 0.0
        for i in range(max(1, len(seq) - width + 1)):
            total, text = 0, seq[i : i + width]
            for base, group in itertools.groupby(text):
                n = len(list(group))
                total += {"G": 1, "C": -1}.get(base, 0) * min(n, 4) * n
            mean = total / len(text) if text else 0.0
            best = mean if abs(mean) > abs(best) else best
        return best

    rng = random.Random(24)
    for n in (0, 1, 10, 25, 90):
        seq = _random_dna(rng, n, "GGGCATG")
        assert abs(transcript.g4hunter(seq) - plain(seq)) < 1e-12


def test_melting_temperature_of_both_tables(spark):
    def plain(seq, na, nm, table):
        steps = dna.NEAREST_NEIGHBOUR[table] | {dna.complement_text(k): v for k, v in dna.NEAREST_NEIGHBOUR[table].items()}
        h, s = dna.NN_ONCE[table]
        for end in (seq[0], seq[-1]):
            h, s = h + dna.NN_ENDS[table][end][0], s + dna.NN_ENDS[table][end][1]
        for i in range(len(seq) - 1):
            h, s = h + steps[seq[i : i + 2]][0], s + steps[seq[i : i + 2]][1]
        same = seq == dna.complement_text(seq)
        s += (-1.4 if same else 0) + 0.368 * (len(seq) - 1) * math.log(na / 1000)
        return 1000 * h / (s + 1.987 * math.log((nm if same else nm / 2) * 1e-9)) - 273.15

    rng = random.Random(25)
    seqs = [_random_dna(rng, n) for n in (2, 15, 20, 40)] + ["GAATTC"]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", dna.melting_temperature(F.col("s")).alias("a"), dna.melting_temperature(F.col("s"), 50.0, 250.0, "2004").alias("b"))
    for r in rows.collect():
        assert abs(r.a - plain(r.s, 50, 25, "1997")) < 1e-6 and abs(r.b - plain(r.s, 50, 250, "2004")) < 1e-6


def test_additive_null_equals_built_variants(spark):
    rng = random.Random(26)
    cds = spark.createDataFrame([(k, _random_dna(rng, 3 * rng.randrange(1, 30))) for k in range(6)], "construct_id long, cds string")
    gc = {c: float(sum(b in "GC" for b in c)) for c in dims.CODONS}
    uniform = F.expr("((construct_id * 7919 + variant * 104729 + cast(i as bigint) * 1299709) % 1000003) / 1000003.0d")
    built = {(r.construct_id, r.variant): r.cds for r in scoring.variants(cds, 7, 1, uniform).collect()}
    got = scoring.additive_null(cds, 7, 1, gc).collect()
    assert len(got) == 42
    for r in got:
        text = built[r.construct_id, r.variant]
        assert abs(r.value - sum(b in "GC" for b in text) / len(text)) < 1e-12


@pytest.mark.parametrize(("direction", "band"), [("BAND", (0.45, 0.55)), ("HIGHER_IS_BETTER", None), ("LOWER_IS_BETTER", None)])
def test_percentile_in_one_map_equals_joining_the_null(spark, direction, band):
    rng = random.Random(27)
    rows = spark.createDataFrame([(k, _random_dna(rng, 3 * rng.randrange(1, 30)), rng.choice((0.0, 0.4, 0.5, 0.75))) for k in range(12)] + [(99, "ATG", 1 / 3), (100, None, 0.5), (101, "ATG", None)], "construct_id long, cds string, raw double")
    gc = {c: float(sum(b in "GC" for b in c)) for c in dims.CODONS}
    want = scoring.percentile(scoring.additive_null(rows.where("cds is not null"), 9, 1, gc), rows.where("raw is not null").drop("cds"), direction, band)
    key = lambda r: (r.construct_id, r.raw, r.n, round(r.mean, 12), round(r.sd, 12), round(r.percentile, 12))
    got = sorted(map(key, scoring.additive_percentile(rows, 9, 1, gc, direction, band).collect()))
    assert got == sorted(map(key, want.collect())) and len(got) == 13


def test_segments_decide_what_counts(spark):
    """An exempt region hides its repeats, a designable one makes breaches mendable, round the origin too."""
    seq = "GAATTC" + "ACGTTGCATG" * 3 + "TTTTTTTTTTTT" + "GATTACAGATTACAGATTACA" + "GAA"
    part = [{"start": len(seq) - 10, "end": len(seq) + 2, "kind": evaluation.DESIGNABLE}, {"start": 6, "end": 36, "kind": evaluation.REPEAT}]
    c = evaluation.Construct(seq, True, part)
    assert [b[:3] + b[5:] for b in evaluation.restriction_sites(c)] == [("EcoRI", 0, 6, True)]
    assert [b[:3] + b[5:] for b in evaluation.homopolymer_runs(c)] == [("T", 36, 48, False)]
    rows = spark.createDataFrame([(1, seq, True, part), (2, seq, True, []), (3, "", False, [])], f"construct_id long, seq string, circular boolean, segments {evaluation.SEGMENTS}")
    got = {r.construct_id: r for r in evaluation.recurrence(rows).collect()}
    assert got[1].recurring < got[2].recurring and got[1].scored < got[2].scored == len(seq) and got[3].scored == 0
    assert evaluation.breaches(rows).where("construct_id = 3").count() == 0


def test_v5_tags_make_donors_strong():
    tag = solver.back_translate(evaluation.V5, 1, stop=False)
    seq = "ATGGCA" + tag + "AAAGTAAGCCC" * 2 + "TAA"
    whole = evaluation.Construct(seq, False, [{"start": 0, "end": len(seq) // 3 * 3, "kind": evaluation.DESIGNABLE}])
    inside = [b for b in evaluation.splice_sites(whole, acceptors=False) if b[1] < 6 + len(tag) and b[2] > 6]
    assert all(b[4] == 3.0 for b in inside)
    assert {b[4] for b in evaluation.splice_sites(whole, acceptors=False) if b[1] >= 6 + len(tag)} <= {1.0, 3.0}


def test_markers_by_every_token(spark):
    rows = spark.createDataFrame([(m.upper(),) for m in presets.MARKERS], "label string")
    assert rows.where(presets.is_marker(F.col("label"))).count() == len(presets.MARKERS) and "ampr" in presets.MARKERS


def test_running_sums_and_pieces_of_long_texts(spark):
    rng = random.Random(27)
    numbers = [rng.randrange(-5, 9) for _ in range(1000)]
    rows = spark.createDataFrame([(numbers[:n],) for n in (0, 1, 63, 64, 65, 1000)], "x array<int>").select("x", arrays.running_sums(F.col("x")).alias("s"))
    assert all(list(itertools.accumulate(r.x)) == r.s for r in rows.collect())
    for n in (5, 256, 257, 700):
        for k in (1, 4, 300):
            seq = _random_dna(rng, n)
            got = sorted((r.pos, r.kmer) for r in scan.positions(frame(spark, [(seq, True)]), k).collect())
            around = seq + seq[: k - 1]
            assert got == ([(i, around[i : i + k]) for i in range(n)] if n >= k else [])
