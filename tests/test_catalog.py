"""Circular repeats, the rule catalog, ordered fragments and repair against brute force."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom import dims
from strandloom.functions import dna
from strandloom.operators import catalog, evaluation, fragments, repair, repeats, rules, solver
from strandloom.operators.evaluation import DESIGNABLE, REPEAT, Construct

AA = "ACDEFGHIKLMNPQRSTVWY"


def maximal(rows, n, circular):
    """Rows (first, second, length), longest first, that lie in no longer one."""
    kept = []
    for a, b, size in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):

        def inside(o, a=a, b=b, size=size):
            if circular:
                return any((x - o[0]) % n + size <= o[2] and (y - o[1]) % n + size <= o[2] for x, y in ((a, b), (b, a)))
            return o[0] <= a and a + size <= o[0] + o[2] and o[1] <= b and b + size <= o[1] + o[2]

        if not any(inside(o) for o in kept):
            kept.append((a, b, size))
    return kept


def plain_direct(seq, circular, k):
    n = len(seq)
    at = lambda i: seq[i % n]
    places = {}
    for i in range(n) if circular else range(n - k + 1):
        places.setdefault("".join(at(i + t) for t in range(k)), []).append(i)
    rows = set()
    for p in places.values():
        for a, b in [*zip(p, p[1:]), *([(p[0], p[-1])] if circular and len(p) > 2 else [])]:
            d, s, e = (b - a) % n, a, a + k
            if circular and all(at(i) == at(i + d) for i in range(n)):
                s, e = 0, n
            elif circular:
                while at(s - 1) == at(s - 1 + d):
                    s -= 1
                while at(e) == at(e + d):
                    e += 1
            else:
                while s > 0 and seq[s - 1] == seq[s - 1 + d]:
                    s -= 1
                while e + d < n and seq[e] == seq[e + d]:
                    e += 1
            size = min(e - s, d, n - d) if circular else min(e - s, d)
            if size >= k:
                rows.add((min(s % n, (s + d) % n), max(s % n, (s + d) % n), size))
    return maximal(rows, n, circular)


def plain_stems(seq, circular, k, max_loop):
    n, rows = len(seq), set()
    if n < 2 * k:
        return []
    at = lambda i: seq[i % n]
    pairs = lambda i, j: at(i) == dna.complement_text(at(j))
    for i in range(n):
        for loop in range(max_loop + 1):
            j = i + k + loop
            if (j + k - i > n if circular else j + k > n) or not all(pairs(i + t, j + k - 1 - t) for t in range(k)):
                continue
            a, e, gap, stem = i, j + k, loop, k
            while (e - a + 2 <= n if circular else a > 0 and e < n) and pairs(a - 1, e):
                a, e, stem = a - 1, e + 1, stem + 1
            while gap >= 2 and pairs(a + stem, e - stem - 1):
                stem, gap = stem + 1, gap - 2
            e += a % n - a if circular else 0
            rows.add((a % n, e - stem, stem))
    if circular:
        rows = {r for r in rows if not (2 * r[2] == n and r[1] % n < r[0])}
    return [(a, b, size, b - a - size) for a, b, size in maximal(rows, n, circular)]


def odd_sequence(rng):
    letters = rng.choice(("ACGT", "ACGT", "AC", "AT"))
    seq = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
    if rng.random() < 0.2:
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 7))) * rng.randint(1, 8)
    return seq + dna.complement_text(seq[-rng.randint(1, 12) :]) if rng.random() < 0.3 else seq


def test_repeats_and_stems_are_the_plain_ones():
    rng = random.Random(7)
    for _ in range(1500):
        seq, circular, k, loop = odd_sequence(rng), rng.random() < 0.6, rng.randint(2, 6), rng.randint(0, 12)
        assert repeats.direct(seq, circular, k) == plain_direct(seq, circular, k), (seq, circular, k)
        assert repeats.stems(seq, circular, k, loop) == plain_stems(seq, circular, k, loop), (seq, circular, k, loop)


def test_breaches_turn_with_the_circle():
    """Where a circle is cut changes no finding of f1 or f3, exempt and designable segments turning along."""
    rng = random.Random(3)
    arm = "".join(rng.choice("ACGT") for _ in range(40))
    text = "".join(rng.choice("ACGT") for _ in range(500))
    seq = text[:100] + arm + text[100:200] + arm + text[200:300] + dna.complement_text(arm) + text[300:] + arm[:30]
    n = len(seq)
    segments = [(90, 250, DESIGNABLE), (n - 40, n + 5, REPEAT)]
    want = None
    for by in (0, 1, 100, 120, 260, n - 10):
        turned = seq[by:] + seq[:by]
        c = Construct(turned, True, [{"start": (s - by) % n, "end": (s - by) % n + e - s, "kind": k} for s, e, k in segments])
        got = {(kind, (start + by) % n, end - start, magnitude, fixable) for rule in (repeats.direct_repeats, repeats.inverted_repeats) for kind, start, end, _, magnitude, fixable in rule(c)}
        want = want or got
        assert got == want and len(got) >= 3
    both = [{"start": 100, "end": 140, "kind": REPEAT}, {"start": 240, "end": 280, "kind": REPEAT}]
    assert not [b for b in repeats.direct_repeats(Construct(seq[:400], False, both)) if b[1] == 100]


def test_recombination_sites_on_both_strands_round_the_origin():
    site = {"loxP_family": "ATAACTTCGTATAGCATACATTATACGAAGTTAT", "FRT": "GAAGTTCCTATTCTCTAGAAAGTATAGGAACTTC", "Gateway_attB1": "ACAAGTTTGTACAAAAAAGCAGGCT", "loxP_half_site": "TATACGAAGTTAT"}
    rest = "CCGGTTAACCGGACTGACTG" * 4
    for name, text in site.items():
        for strand, there in ((1, text), (-1, dna.complement_text(text))):
            seq = rest + there
            for by in (0, 30, len(rest) + 5, len(seq) - 1):
                found = list(evaluation.recombinase_sites(Construct(seq[by:] + seq[:by], True)))
                assert [b[0] for b in found] == [name], (name, strand, by, found)
                assert found[0][1] == (len(rest) - by) % len(seq) and found[0][2] - found[0][1] == len(text)
                assert found[0][4] == (0.3 if "half" in name else 1.0) and (name.startswith("loxP") or found[0][3] == strand)
    assert not list(evaluation.recombinase_sites(Construct(rest + site["loxP_half_site"], True), partials=False))


def test_rule_sets_are_checked():
    assert set(catalog.rule_set()) == set(catalog.CATALOG)
    assert set(catalog.CATALOG) <= {r[0] for r in rules.RULES}
    c = Construct("ATG" + "A" * 12 + "CCC", False)
    plain, strict = catalog.rule_set(["e1_homopolymers"]), catalog.rule_set(["e1_homopolymers"], {"e1_homopolymers": {"max_at": 4}})
    assert [b[4] for b in plain["e1_homopolymers"](c)] == [3.0] and [b[4] for b in strict["e1_homopolymers"](c)] == [8.0]
    for include, overrides in ((["e1"], None), (None, {"e1": {}}), (None, {"e1_homopolymers": {"most": 3}}), (None, {"e1_homopolymers": {"max_at": 0}}), (None, {"e1_homopolymers": {"max_at": "3"}}), (None, {"e1_homopolymers": {"max_at": True}}), (None, {"e2_gc_band": {"keys": []}}), (None, {"e2_gc_band": {"keys": ["nobody"]}}), (None, {"e5_synthesis_repeats": {"anneal_c": 99}}), (None, {"d8_cpg_depletion": {"criterion": "other"}})):
        with pytest.raises(ValueError):
            catalog.rule_set(include, overrides)
    for spec, takes in (("no_rule", {}), ("e1_homopolymers", {}), ("e3_windowed_gc", {"absent": {"type": "integer"}})):
        with pytest.raises(ValueError):
            catalog.register(spec, lambda *_: True, **takes)(evaluation.homopolymer_runs)
    assert "e3_windowed_gc" not in catalog.CATALOG


def test_overrides_change_breaches(spark):
    rows = spark.createDataFrame([(1, "ATG" + "A" * 12 + "CCC" * 20, False, [(0, 60, DESIGNABLE)])], f"construct_id long, seq string, circular boolean, segments {evaluation.SEGMENTS}")
    count = lambda **o: catalog.breaches(rows, include=["e1_homopolymers"], **o).count()
    assert count() == 2 and count(overrides={"e1_homopolymers": {"max_at": 20, "max_gc": 99}}) == 0
    passes = {r.spec_id: r.passes for r in catalog.evaluations(catalog.breaches(rows)).collect()}
    assert passes["e1_homopolymers"] is False


def test_fragments_map_both_ways(spark):
    """Every place of the ordered DNA goes to the construct and back, round the origin too; adapters have no place."""
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(90))
    spans = [[(10, 40, DESIGNABLE), (50, 65, DESIGNABLE)], [(80, 110, DESIGNABLE)]]
    rows = spark.createDataFrame([(k, seq, 90, k == 1, s) for k, s in enumerate(spans)], f"construct_id long, seq string, length int, circular boolean, segments {evaluation.SEGMENTS}")
    tubes = fragments.fragments(rows, ["twist_gene_fragment_adapter_on"])
    assert [tuple(r) for r in tubes.select("construct_id", "fragment", "ordered").orderBy("construct_id", "fragment").collect()] == [(0, 0, 30), (0, 1, 15), (1, 0, 30)]
    at = tubes.withColumn("p", F.explode(F.sequence(F.lit(0), F.length("sequence") - 1)))
    start, end = fragments.to_construct(F.col("p"), F.col("p") + 1)
    there = at.withColumn("start", start).withColumn("end", end)
    back, _ = fragments.to_fragment(F.col("start"), F.col("end"))
    for r in there.withColumn("back", back).collect():
        if 22 <= r.p < 22 + r.ordered:
            assert r.back == r.p and r.sequence[r.p] == seq[r.start % 90] and 0 <= r.start < 90
        else:
            assert r.start is None and r.back is None
    kernel = [(t.five, t.ordered, t.start) for k, s in enumerate(spans) for t in fragments.tubes(Construct(seq, k == 1, [{"start": a, "end": b, "kind": kind} for a, b, kind in s]), ("twist_gene_fragment_adapter_on",))]
    assert kernel == [(22, 30, 10), (22, 15, 50), (22, 30, 80)]


def test_synthesis_repeats_see_adapters_and_heat():
    five = "CAATCCGCCCTCACTACAACCG"
    rng = random.Random(9)
    text = "".join(rng.choice("AT") for _ in range(60)) + five[:20] + "".join(rng.choice("AT") for _ in range(61))
    c = Construct("GG" + text + "CC", False, [{"start": 2, "end": 2 + len(text), "kind": DESIGNABLE}])
    kinds = lambda keys: {b[0] for b in fragments.synthesis_repeats(c, keys) if b[2] > 60}
    assert "hard" in kinds(("twist_gene_fragment_adapter_on",)) and "hard" not in kinds(("idt_gblocks",))
    assert repeats.melting("GCGCGGCCGCGC") > 45 > repeats.melting("ATATTAATATAT")


def test_melting_is_the_column_one(spark):
    seqs = ["ACGTTGCAAC", "GAATTC", "GGGGCCCCAT"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in seqs], "s string").select(dna.melting_temperature(F.col("s"))).collect()]
    assert got == pytest.approx([repeats.melting(s) for s in seqs])


def _design(rng):
    m = rng.randint(5, 120)
    protein = ("".join(rng.choice(AA) for _ in range(rng.randint(2, 15))) * 200)[:m] if rng.random() < 0.6 else "".join(rng.choice(AA) for _ in range(m))
    syn = dims.synonyms(1)
    left, right = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 80))) for _ in range(2))
    seq, start, circular = left + "".join(rng.choice(syn[a]) for a in protein) + right, len(left), rng.random() < 0.6
    if circular and rng.random() < 0.5:
        by = rng.randrange(len(seq))
        seq, start = seq[by:] + seq[:by], (start - by) % len(seq)
    return protein, start, Construct(seq, circular, [{"start": start, "end": start + 3 * m, "kind": DESIGNABLE}])


def pair_counts(c, k):
    """Maximal pairs of k bases or more, and pairs of equal k-mers, all of them."""
    words = lambda k: ["".join(c.seq[(i + t) % c.n] for t in range(k)) for i in range(c.n if c.circular else max(c.n - k + 1, 0))] if c.n >= k else []
    pairs = [sum(v * (v - 1) // 2 for v in Counter(words(x)).values()) for x in (k, k + 1)]
    return pairs[0] - pairs[1], float(pairs[0])


def test_increments_equal_whole_scans():
    """What a trial promises, and what trackers hold after moves, is what fresh trackers and plain counts say of the new sequence."""
    rng = random.Random(1)
    syn = dims.synonyms(1)
    for _ in range(30):
        protein, start, c = _design(rng)
        hard = rng.choice([8, 12, 25])
        own = {"f1_direct_repeats": {"hard_len": hard}, "f5_at_window": {"window": rng.choice([20, 50, 100])}, "e1_homopolymers": {"max_at": 3, "max_gc": 3}}
        keys = (rng.choice(["idt_gblocks", "twist_gene_fragment_adapter_on"]),)
        fresh = lambda c: {s: repair.tracker(s, repair.State(c, start, len(protein)), own.get(s, {}), keys).totals() for s in repair.PACKAGED}  # noqa: B023, E731
        state = repair.State(c, start, len(protein))
        on = {s: repair.tracker(s, state, own.get(s, {}), keys) for s in repair.PACKAGED}
        for _ in range(12):
            i = rng.randrange(len(protein))
            size = rng.randint(1, min(6, len(protein) - i))
            old, new = "".join(state.codon(j) for j in range(i, i + size)).encode(), "".join(rng.choice(syn[protein[j]]) for j in range(i, i + size)).encode()
            lo = (start + 3 * i) % c.n if c.circular else start + 3 * i
            said = {s: x.trial(lo, old, new) for s, x in on.items()}
            assert {s: x.totals()[0] for s, x in on.items()} == {s: v[0] for s, v in fresh(state.construct()).items()}
            for s, x in on.items():
                x.commit(lo, old, new, said[s][1])
            state.write(lo, new)
            want = fresh(state.construct())
            for s in on:
                assert said[s][0] == pytest.approx(want[s]) and on[s].totals() == pytest.approx(want[s]), s
            assert want["f1_direct_repeats"] == pair_counts(state.construct(), hard)


def test_repair_mends_and_reports_whole_scans():
    rng = random.Random(4)
    code = dims.genetic_code(1)
    for _ in range(12):
        protein, start, c = _design(rng)
        made = repair.repair(c, start, protein, 1, repair.PACKAGED, keys=("idt_gblocks",))
        turned = made.seq[start:] + made.seq[:start] if c.circular else made.seq[start:]
        assert "".join(code[turned[i : i + 3]] for i in range(0, 3 * len(protein), 3)) == protein
        outside = lambda seq: [seq[(start + 3 * len(protein) + i) % c.n] for i in range(c.n - 3 * len(protein))] if c.circular else [seq[:start], seq[start + 3 * len(protein) :]]  # noqa: B023, E731
        assert outside(made.seq) == outside(c.seq)
        found = []
        after = Construct(made.seq, c.circular, c.segments)
        for spec, rule in catalog.rule_set(list(repair.PACKAGED), vendors=["idt_gblocks"]).items():
            own = list(rule(after))
            if any(catalog.CATALOG[spec].fails(*b[:3], b[4]) for b in own):
                found += [(spec, b[0], b[1], b[2], b[4]) for b in own]
        assert sorted(found) == sorted(made.remaining + made.advisory)
        before = {s: repair.tracker(s, repair.State(c, start, len(protein)), {}, ("idt_gblocks",)).totals()[0] for s in repair.PACKAGED}
        now = {s: repair.tracker(s, repair.State(after, start, len(protein)), {}, ("idt_gblocks",)).totals()[0] for s in repair.PACKAGED}
        assert all(now[s] <= before[s] for s in now)
        assert made == repair.repair(c, start, protein, 1, repair.PACKAGED, keys=("idt_gblocks",))


def test_long_designs_end():
    """8,000 residues, a quarter of them twice: no cap hides a pair, and the search ends in seconds."""
    rng = random.Random(1)
    protein = "".join(rng.choice(AA) for _ in range(6000))
    protein += protein[:2000]
    cds = solver.back_translate(protein, 1, forbidden=list(dims.SIX_CUTTERS.values()), stop=False)
    whole = Construct(cds, False, [{"start": 0, "end": len(cds), "kind": DESIGNABLE}])
    began = time.time()
    made = repair.repair(whole, 0, protein, 1)
    assert time.time() - began < 20
    assert repeats.direct(cds, False, 25) and not repeats.direct(made.seq, False, 25)
