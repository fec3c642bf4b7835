"""What findings of the third round asked for: results on odd rows, and plans whose work stays in one map per construct."""

import random
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strandloom import dims
from strandloom.functions import dna
from strandloom.operators import catalog, codons, design, evaluation, kmers, repair, repeats, rules, runs, scan, scoring, slots, solver, transcript
from strandloom.plans.derived import coding, constructs
from strandloom.plans.registry_all import QUERIES

SF = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    """Shuffles of the whole plan, before any of it is dropped by adaptive execution."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def frame(spark, rows):
    return spark.createDataFrame([(i, s, len(s), c) for i, (s, c) in enumerate(rows)], "construct_id long, seq string, length int, circular boolean")


def some(seed: int, n: int, most: int):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, most))) for _ in range(n)]


def test_sites_keep_their_names(spark):
    """the name of a site was lost where a construct held one."""
    rows = frame(spark, [("CCTTTGTACAAAGTTTTGTACAAAACC", False), ("ACAAGTTTGTACAAAAAAGCAGGCT", True), ("CCCC", False)])
    got = sorted((r.construct_id, r.name, r.start, r.end) for r in transcript.recombinase_sites(rows).collect())
    assert got == [(0, "Gateway_core", 2, 13), (0, "Gateway_core", 14, 25), (1, "Gateway_attB1", 0, 25)]
    assert {r.name for r in scan.sites(rows, {"a": "GTAC", "b": "CC+"}).collect()} == {"a", "b"}


def test_reachable_gc_is_one_map(spark):
    """bases were shuffled rows."""
    rows = spark.createDataFrame([(0, "M" * 17 + "W"), (1, "MKL"), (2, "MGGGGGGGGGGGGGGGGGGKKKKKKKKKKKKKKKKKKKK"), (3, None)], "construct_id long, protein string")
    each, made = codons.reachable_gc(rows, 1), codons.gc_reach(rows, 1)
    assert not shuffles(each) and not shuffles(made)
    folded = each.groupBy("construct_id").agg(F.count(F.lit(1)).alias("windows"), F.max("least").alias("highest_least"), F.min("most").alias("lowest_most"))
    assert sorted(made.collect()) == sorted(folded.collect()) and [(r.construct_id, r.windows) for r in sorted(made.collect())] == [(0, 5), (2, 68)]
    first = min(r for r in each.where("construct_id = 0").collect())
    # 50 bases from the first on: 16 whole ATG and two bases AT; there is no choice.
    assert first.least == first.most == 16 / 50


def test_homopolymers_are_one_map(spark):
    """every base was a row of three windows."""
    texts = [(s, k % 2 == 0) for k, s in enumerate([*some(31, 30, 40), "AAAA", "A", "TTACTTT"])]
    made = runs.homopolymers(frame(spark, texts), 2)
    want = set()
    for cid, (s, circular) in enumerate(texts):
        edge = [i for i in range(len(s)) if i == 0 or s[i] != s[i - 1]]
        found = [[s[a], a, b - a] for a, b in zip(edge, [*edge[1:], len(s)])]
        if circular and len(found) > 1 and found[0][0] == found[-1][0]:
            found[-1][2] += found.pop(0)[2]
        want |= {(cid, *x) for x in found if x[2] >= 2}
    assert {tuple(r) for r in made.collect()} == want and not shuffles(made)


def test_top_recurring_is_one_map(spark):
    """every k-mer was a shuffled row."""
    texts = [*some(32, 20, 120), "ACG", "GTGTGTTTTTTTT"]
    made = kmers.top_recurring(frame(spark, [(s, True) for s in texts]), 3, 4)
    want = set()
    for cid, s in enumerate(texts):
        many = {}
        for i in range(len(s) - 2):
            many[s[i : i + 3]] = many.get(s[i : i + 3], 0) + 1
        kept = sorted((-n, t) for t, n in many.items() if n >= 2)[:4]
        want |= {(cid, t, -n, k) for k, (n, t) in enumerate(kept, 1)}
    assert {tuple(r) for r in made.collect()} == want and not shuffles(made)


def test_sequences_are_derived_once(spark):
    """Filters on a sequence were pushed below its making, which was then done again for each."""
    for made in (coding(spark, SF).withColumn("raw", dna.gc_fraction(F.col("cds"))).where("raw is not null and cds is not null"), constructs(spark, SF).where("length >= 60")):
        assert made._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1


def test_variants_are_one_map(spark):
    """every codon of every variant was a shuffled row."""
    texts = [s + "ATG" for s in some(33, 40, 200)]
    cds = spark.createDataFrame(list(enumerate(texts)), "construct_id long, cds string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # variants go over the ends of batches
    try:
        made = scoring.variants(cds, 3, 1)
        assert not made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = {(r.construct_id, r.variant): r.cds for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * len(texts)
    code = scoring.dims.genetic_code(1)
    whole = [[code[t[i : i + 3]] for i in range(0, len(t) - 2, 3)] for t in texts]
    assert all([code[t[i : i + 3]] for i in range(0, len(t), 3)] == whole[cid] for (cid, _), t in got.items())


def test_galleries_compare_codons_as_numbers():
    """the picks of the plain comparison, on designs of one length and of several."""

    def plain(cds, k):
        far = lambda a, b: sum(a[3 * i : 3 * i + 3] != b[3 * i : 3 * i + 3] for i in range(len(a) // 3)) / max(len(a) // 3, 1)
        first = list(dict.fromkeys(cds))
        if len(first) <= k:
            return [cds.index(x) for x in first]
        _, i, j = max((far(first[i], first[j]), -i, -j) for i in range(len(first)) for j in range(i + 1, len(first)))
        picks = [-i, -j][:k]
        while len(picks) < k:
            picks.append(max((x for x in range(len(first)) if x not in picks), key=lambda x: (min(far(first[x], first[p]) for p in picks), -x)))
        return [cds.index(first[x]) for x in picks]

    rng = random.Random(34)
    for n in range(200):
        sizes = [rng.randrange(0, 14)] * 7 if n % 2 else [rng.randrange(0, 14) for _ in range(7)]
        cds = ["".join(rng.choice("AC") for _ in range(k)) for k in sizes]
        assert scoring.greedy_picks(cds, 3) == plain(cds, 3)


def test_a_gallery_has_one_shuffle(spark):
    """the sweep's codons were shuffled rows before its panels were."""
    assert shuffles(QUERIES["greedy_max_min"].run(spark, "/root/testdata/sf0.001")) == 1


def test_findings_evaluate_once(spark):
    """rules ran twice, and every breach was shuffled to its evaluation."""
    plan = QUERIES["routed_findings"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = frame(spark, [("GAATTCAAAAAAAAAAAAAAAAAAAAGAATTC" * 4, True), ("AGTAAACC" * 5, False)]).withColumn("segments", F.lit(None).cast(evaluation.SEGMENTS))
    enforcement = rules.effective_enforcement(rules.gate_matrix(rules.slots(spark).where("host = 'human' and modality = 'lentiviral'")))
    carried, joined = (rules.findings(evaluation.breaches(rows, worst=w), enforcement) for w in (True, False))
    assert carried.columns == joined.columns and sorted(map(str, carried.collect())) == sorted(map(str, joined.collect()))
    assert {r.spec_id for r in carried.where("construct_id = 1").collect()} == set()  # variants alone pass


def test_profiles_of_all_hosts_at_once(spark):
    """F8: codons were looked up one by one for every host and strand; odd letters are no codons."""
    texts = [*(s[: len(s) // 3 * 3] for s in some(35, 12, 150)), "NNNATG", "ATGNAC" * 3]
    hosts = sorted(dims.HOST_TABLE)[:3]
    usage = [(h, c, float((7 * k + 3 * j) % 11 + 1)) for j, h in enumerate(hosts) for k, c in enumerate(dims.CODONS)]
    made = slots.codon_profiles(spark.createDataFrame(list(enumerate(texts)), "construct_id long, text string"), spark.createDataFrame(usage, "host string, codon string, freq double"))
    got = {(r.construct_id, r.host, r.strand): (r.mean, r.peak, r.trough, r.n) for r in made.collect()}
    want = {}
    for cid, text in enumerate(texts):
        for strand in (1, -1):
            read = text if strand == 1 else dna.complement_text(text)
            codons_ = [read[i : i + 3] for i in range(0, len(read), 3)]
            for h in hosts:
                stats = slots.family_table({c: f for x, c, f in usage if x == h}, dims.HOST_TABLE[h])
                if n := sum(c in stats for c in codons_):
                    profile = slots.min_max(codons_, stats)
                    want[cid, h, strand] = (profile.mean(), profile.max(), profile.min(), n)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))


def test_frames_are_scanned_once(spark):
    """the kernel of reading frames stood in the plan once for each kind of evidence, and again for each use of the scores."""
    for name in ("frame_scores", "insertion_suggestions"):
        plan = QUERIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        # What is kept is printed at each place that reads it; all of them read one relation.
        assert plan.count("MapInArrow") == plan.count("InMemoryRelation") <= 4


def test_cores_that_texts_hold_themselves_are_found():
    """a core in the letters of a document is a breach beside the planted site; documents 5232 and 6624 of sf0.1 hold these."""
    for held, at in (("TTTTTGTACAAAA", {1, 2}), ("CTTTTGTACAAAG", {1, 2})):
        rest = "GACCTGACCTGACCTGACC"
        found = [b for b in evaluation.recombinase_sites(evaluation.Construct(rest + held + rest + "ACAAGTTTGTACAAAAAAGCAGGCT", False)) if b[0] == "Gateway_core"]
        assert {b[1] - len(rest) for b in found} == at and all(b[4] == 0.3 for b in found)
    assert [b[0] for b in evaluation.recombinase_sites(evaluation.Construct("ACAAGTTTGTACAAAAAAGCAGGCT", False))] == ["Gateway_attB1"]


def plain_stems(seq: str, k: int, max_loop: int) -> set:
    """Maximal stems by growing every pair of a middle, without those that lie in a longer one."""
    pair, n, found = {"A": "T", "T": "A", "C": "G", "G": "C"}, len(seq), set()
    for left in range(n):
        for right in range(left + k, min(n - k, left + k + max_loop) + 1):
            if all(seq[left + x] == pair[seq[right + k - 1 - x]] for x in range(k)):
                i, j, e = left, right + k, left + k
                while i > 0 and j < n and seq[i - 1] == pair[seq[j]]:
                    i, j = i - 1, j + 1
                while (left + right + k) - 2 * e >= 2 and seq[e] == pair[seq[left + right + k - 1 - e]]:
                    e += 1
                found.add((i, left + right + k - e, e - i, left + right + k - 2 * e))
    within = lambda s, o: s != o and o[0] <= s[0] and s[0] + s[2] <= o[0] + o[2] and o[1] <= s[1] and s[1] + s[2] <= o[1] + o[2]
    return {s for s in found if not any(within(s, o) for o in found)}


def test_stems_grow_by_runs_of_seeds():
    """F16: every seed of a stem was grown over the whole stem, so a long stem took the square of its length."""
    rng = random.Random(16)
    for n in range(60):
        seq = "".join(rng.choice("ACGT" if n % 3 else "AT") for _ in range(rng.randrange(1, 60)))
        seq += dna.complement_text(seq) if n % 4 == 0 else ""
        k, loop = rng.randrange(2, 6), rng.randrange(0, 20)
        got = kmers.stems_of(seq, k, loop, 10**6)
        assert len(got) == len(set(got)) and set(got) == plain_stems(seq, k, loop)
        assert got == sorted(got, key=lambda s: (-s[2], s[0], s[1])) and kmers.stems_of(seq, k, loop, 3) == got[:3]
    arm = "".join(rng.choice("ACGT") for _ in range(20000))
    began = time.process_time()
    assert kmers.stems_of(arm + dna.complement_text(arm), 15, 100)[0] == (0, 20000, 20000, 0)
    assert time.process_time() - began < 2


def test_evaluations_are_summed_where_breaches_are_found(spark):
    """every breach left the map as a row, and duplexes of repeats that are hard by length were melted."""
    rng = random.Random(14)
    unit = "".join(rng.choice("ACGT") for _ in range(60))
    rows = [(i, unit * (i % 5) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 400))) + "A" * i, i % 2 == 0, [(0, 90, evaluation.DESIGNABLE), (100, 130, evaluation.REPEAT)] if i % 3 else None) for i in range(12)]
    table = spark.createDataFrame(rows, f"construct_id long, seq string, circular boolean, segments {evaluation.SEGMENTS}")
    key = lambda df: sorted((r.construct_id, r.spec_id, r.n, r.magnitude, r.passes) for r in df.collect())
    assert key(catalog.evaluated(table)) == key(catalog.evaluations(catalog.breaches(table)))
    assert "fixable" not in QUERIES["catalog_evaluations"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_words_are_told_apart():
    """shared lengths over blocks that are their own numbers and over ranked ones, against plain counting."""
    rng = random.Random(2)
    for n in range(40):
        part = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 90)))
        seq = "".join(part + rng.choice("ACGT") for _ in range(rng.randrange(1, 5)))
        ring = n % 2 == 0
        ext = repeats.Extensions(np.frombuffer(seq.encode(), np.uint8), ring)
        pairs = [(x, y) for x in range(len(seq)) for y in range(len(seq)) if x != y]
        x, y = np.array(rng.sample(pairs, min(len(pairs), 60)) or [(0, 0)][:0]).reshape(-1, 2).T
        read = lambda i: seq[i % len(seq)] if ring or i < len(seq) else None  # noqa: B023, E731
        for a, b, got in zip(x.tolist(), y.tolist(), ext.shared(x, y).tolist(), strict=True):
            want = 0
            while want < len(seq) and read(a + want) is not None and read(a + want) == read(b + want):
                want += 1
            assert got == want


def test_pairs_meet_in_blocks(spark):
    """five groups of one length each held all pairs of it, and each pair was cut into codons again."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["AAA", "CAT", "GTT", "TTG"]) for _ in range(rng.choice([1, 63, 64, 65, 130])))) for i in range(60)]
    rows += [(60, ""), (61, None), (62, rows[0][1])]
    cut = lambda s: [s[i : i + 3] for i in range(0, len(s), 3)]
    want = {(a, b): sum(p != q for p, q in zip(cut(x), cut(y), strict=True)) / len(cut(x)) for a, x in rows for b, y in rows if x and y and a < b and len(x) == len(y)}
    table = spark.createDataFrame(rows, "construct_id long, cds string")
    for blocks in (1, 5):
        got = codons.distances(table, 130, blocks).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want
    plan = QUERIES["codon_distance_matrix"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "j#" in plan


def test_one_protein_is_solved_once(spark):
    """copies of a protein were solved each, and every k-mer of a design was kept with its starts."""
    rows = [(i, p, "clear" if i % 2 else "not_run") for i, p in enumerate(["MKLV", "MKLV", "M", "MKLV", "MX", "MX"])]
    table = spark.createDataFrame(rows, "design_id long, protein string, screen string")
    made = design.solve(table, 1, ["GAATTC"])
    got = {(r.design_id, r.lean): (r.cds, r.status, r.screen) for r in made.collect()}
    assert len(got) == 18 and all(got[i, lean][:2] == got[0, lean][:2] and got[i, lean][2] == rows[i][2] for i in (1, 3) for lean in design.LEANS)
    assert got[4, "unsteered"][:2] == got[5, "unsteered"][:2] == (None, "no codon for X")
    assert "Aggregate [_task" in made._jdf.queryExecution().optimizedPlan().toString()
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    held = repair.Repeats(repair.State(evaluation.Construct(seq + seq[:40], False, []), 0, 113), 25)
    assert len(held.at) == 16 and sum(map(len, held.at.values())) == 32 == int(held.dup.sum())


def _tracts(many: int) -> str:
    """So many tracts of 20 bases, CA ten times, apart by bases that repeat nothing."""
    rng = random.Random(many)
    return "".join("CA" * 10 + "G" + "".join(rng.choice("CT") for _ in range(7)) + "".join(rng.choice("GT") for _ in range(7)) + "T" for _ in range(many))


def test_every_tandem_tract_is_evaluated(spark):
    """only the first 200 tracts of a construct counted."""
    seq = _tracts(350)
    segments = [(0, len(seq) // 2, evaluation.DESIGNABLE), (len(seq) // 2, len(seq), evaluation.DESIGNABLE)]
    found = list(evaluation.tandem_repeats(evaluation.Construct(seq, False, [dict(zip(("start", "end", "kind"), s, strict=True)) for s in segments])))
    assert [b[1] for b in found if b[0] == "CA"] == [36 * i for i in range(350)]
    table = spark.createDataFrame([(1, seq, False, segments)], f"construct_id long, seq string, circular boolean, segments {evaluation.SEGMENTS}")
    row = catalog.evaluated(table, include=["e7_short_tandem_repeats"]).first()
    assert (row.n, row.passes) == (len(found), True) and abs(row.magnitude - sum(b[4] for b in found)) < 1e-9


def test_every_tandem_tract_is_routed(spark, tmp_path):
    """tracts behind the first 200 of a construct had no finding; rows equal the SQL, which never left any out."""
    text = _tracts(400) + "AC" * 30 + _tracts(401)
    spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["routed_findings"].run(spark, str(tmp_path)).select("spec_id", "enforcement", "route", "n").collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(f"select spec_id, enforcement, route, n from ({QUERIES['routed_findings'].sql})").fetchall())
    assert sum(r[3] for r in got if r[0] == "e7_short_tandem_repeats") > 400


def test_every_stem_is_found(spark):
    """only the 200 longest stems of a construct came out."""
    rng = random.Random(61)
    arms = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(250)]
    seq = "".join("A" + a + "CCCCC" + dna.complement_text(a) + "A" for a in arms)
    rows = kmers.inverted_repeats(frame(spark, [(seq, False), ("", False), ("ACGT", True)])).collect()
    assert {(r.construct_id, r.left, r.right) for r in rows} >= {(0, 39 * i + 1, 39 * i + 22) for i in range(250)}
    many = kmers.stems_of("AT" * 300, 15, 100)
    assert len(many) == 571 and set(many) == plain_stems("AT" * 300, 15, 100)


def test_sequences_of_every_length_are_paired(spark):
    """only coding sequences of 60 to 64 codons were read; those of 1 to 5,000 and more were left out."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["AAA", "CAT", "GTT", "TTG"]) for _ in range((1, 59, 64, 65, 128, 129, 5000)[i % 7]))) for i in range(28)]
    rows += [(28, "AAA" * 77), (None, rows[0][1])]
    cut = lambda s: [s[i : i + 3] for i in range(0, len(s), 3)]
    want = {(a, b): sum(p != q for p, q in zip(cut(x), cut(y), strict=True)) / len(cut(x)) for a, x in rows[:29] for b, y in rows[:29] if a < b and len(x) == len(y)}
    got = codons.distances(spark.createDataFrame(rows, "construct_id long, cds string")).collect()
    assert len(got) == len(want) == 42 and {(r.a, r.b): r.distance for r in got} == want
    sizes = {r.construct_id: len(r.cds) // 3 for r in coding(spark, SF).collect()}
    met = {(sizes[r.a], sizes[r.b]) for r in QUERIES["codon_distance_matrix"].run(spark, SF).collect()}
    assert all(a == b for a, b in met) and min(met) < (60, 60) and max(met) > (64, 64)


def test_moves_that_repeats_refuse_go_in_blocks(monkeypatch):
    """each of up to 256 moves of a target was tried alone by every tracker, most of them to be refused by repeats."""
    rng = random.Random(11)
    for n in range(40):
        part = "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 90)))
        seq = "".join(part[rng.randrange(0, 9) :] + rng.choice("ACGT") for _ in range(rng.randrange(1, 6)))
        state = repair.State(evaluation.Construct(seq, False, []), 0, len(seq) // 3)
        held = repair.Repeats(state, rng.choice([3, 12, 20]))
        size = 3 * rng.randrange(1, len(seq) // 3 + 1)
        lo = 3 * rng.randrange(0, (len(seq) - size) // 3 + 1)
        texts = ["".join(rng.choice(b + "ACGT"[n % 4]) for b in seq[lo : lo + size]).encode() for _ in range(12)]
        after, now = [held.trial(lo, seq[lo : lo + size].encode(), t)[0] for t in texts], held.totals()
        rows = np.frombuffer(b"".join(texts), np.uint8).reshape(12, -1)
        assert held.n <= held.k or held.refused(lo, rows, now, True).tolist() == [x >= now for x in after]
        assert held.n <= held.k or held.refused(lo, rows, now, False).tolist() == [x[0] > now[0] for x in after]
    tried = []
    plain = repair._try
    monkeypatch.setattr(repair, "_try", lambda *a: tried.append(a[3]) or plain(*a))
    protein = "M" + "SPKKATEG" * 60
    cds = solver.solve_in_band(protein, 1, (0.28, 0.77), {c: abs(solver.gc_of(c) - 0.4) for c in dims.CODONS}, forbidden=["GAATTC"])
    made = repair.repair(evaluation.Construct(cds, False, [{"start": 0, "end": 3 * len(protein), "kind": evaluation.DESIGNABLE}]), 0, protein, 1)
    assert 0 < len(tried) < 5 * made.iterations
