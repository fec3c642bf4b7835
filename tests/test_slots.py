"""Rules read slot by slot against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom import dims
from strandloom.functions import dna
from strandloom.operators import slots
from strandloom.operators.evaluation import BACKBONE, DESIGNABLE, SEGMENTS

HOSTS = sorted(dims.HOST_TABLE)
SLOT = "construct_id long, slot int, role string, host string, table_id int, strand int"


def _constructs(rng, many):
    """Constructs with none, one or two designable segments, in any order, round the origin of circles, some out of frame."""
    rows = []
    for c in range(many):
        n, circular = rng.randrange(30, 150), c % 2 == 0
        seq = "".join(rng.choice("ACGT") for _ in range(n))
        spans = []
        for _ in range(rng.choice((0, 1, 1, 1, 2))):
            a = rng.randrange(n)
            size = 3 * rng.randrange(1, 6) + (c % 9 == 0)
            spans.append({"start": a, "end": a + size if circular else min(a + size, n), "kind": DESIGNABLE})
        rows.append((c, seq, circular, [*spans, {"start": 0, "end": 9, "kind": BACKBONE}]))
    return rows


def _slots(rng, rows):
    return [(r[0], k, role, host, dims.HOST_TABLE[host], rng.choice((1, 1, -1))) for r in rows for k, role in enumerate(dims.ROLES[: rng.choice((1, 3, 3, 3))]) for host in [rng.choice(HOSTS)]]


def _cds(row):
    return sorted((s["start"], s["end"]) for s in row[3] if s["kind"] == DESIGNABLE)


def plain_cai(row, mine, weights, bands):
    spans, twice, scored = _cds(row), row[1] * 2, []
    mine = [s for s in mine if s[2] != "propagation"]
    if not mine:
        return "no_slot"
    if not spans:
        return "no_cds"
    for _, _, role, host, table, strand in mine:
        if host not in weights:
            return "no_reference_set"
        if host not in bands:
            return "no_band"
        text = "".join(twice[a:b] for a, b in spans)
        if len(text) % 3:
            return "out_of_frame"
        text = text if strand == 1 else dna.complement_text(text)
        families = {a: cs for a, cs in dims.synonyms(table).items() if a != "*" and len(cs) > 1}
        logs = [math.log(weights[host][c]) for c in (text[i : i + 3] for i in range(0, len(text), 3)) if any(c in cs for cs in families.values()) and weights[host].get(c, 0) > 0]
        if not logs:
            return "no_informative_codons"
        means = [sum(x) / len(x) for x in ([math.log(weights[host][c]) for c in cs if weights[host].get(c, 0) > 0] for cs in families.values()) if x]
        chance = math.exp(sum(means) / len(means))
        lo, hi = bands[host]
        score = math.exp(sum(logs) / len(logs))
        away = max(lo - score, score - hi, 0.0)
        near = (hi - score if lo <= 0 else min(score - lo, hi - score)) / (1 - chance if chance < 1 else 1)
        scored.append((away if away > 0 else -near - 1, role, host, score, len(logs), away))
    return max(scored, key=lambda s: s[0])[1:]


def test_cai_equals_plain_reading_of_every_slot(spark):
    rng = random.Random(2)
    rows = _constructs(rng, 150)
    of = _slots(rng, rows)
    weights = {h: {c: rng.choice((0.0, 0.05, 0.3, 1.0, 1.0)) for c in dims.CODONS} for h in HOSTS if h != "sf9"}
    bands = {h: (0.0, 0.6) if i % 2 else (0.3, 0.5) for i, h in enumerate(HOSTS) if h != "cho"}
    frame = spark.createDataFrame([*rows, (900, "ACGT" * 5, None, None), (901, None, True, [])], f"construct_id long, seq string, circular boolean, segments {SEGMENTS}")
    given = spark.createDataFrame([*of, *of[:20], (900, 1, "target", "human", 1, 1), (901, 1, "target", "human", 1, 1)], SLOT)  # repeated slots change nothing
    table = spark.createDataFrame([(h, c, x) for h, w in weights.items() for c, x in w.items()], "host string, codon string, w double")
    got = {r.construct_id: r for r in slots.codon_adaptation(frame, given, table, bands).collect()}
    assert len(got) == 152 and got[900].reason == got[901].reason == "no_cds"
    reasons, sides = set(), set()
    for row in rows:
        want, r = plain_cai(row, [s for s in of if s[0] == row[0]], weights, bands), got[row[0]]
        reasons.add(r.reason)
        if isinstance(want, str):
            assert (r.reason, r.score, r.role, r.passes) == (want, None, None, True), row
        else:
            assert r.reason is None and (r.role, r.host, r.n) == (want[0], want[1], want[3]) and r.score == pytest.approx(want[2]) and r.magnitude == pytest.approx(want[4], abs=1e-12)
            assert r.passes == (want[4] == 0) and (r.start, r.end) == (_cds(row)[0][0], _cds(row)[-1][1])
            sides.add(r.side)
    assert reasons >= {None, "no_slot", "no_cds", "no_reference_set", "no_band", "out_of_frame"} and sides == {None, "lower", "upper"}


def test_worst_slot_is_not_the_mean_and_bands_take_bounds(spark):
    """One comfortable slot does not hide one outside its band; raw CAI does not decide, the host's own band does."""
    frame = spark.createDataFrame([(1, "GCTGCCGCA", False, [{"start": 0, "end": 9, "kind": DESIGNABLE}])], f"construct_id long, seq string, circular boolean, segments {SEGMENTS}")
    given = spark.createDataFrame([(1, 0, "producer", "human", 1, 1), (1, 1, "target", "e_coli_k12", 11, 1)], SLOT)
    table = spark.createDataFrame([(h, c, w) for h in ("human", "e_coli_k12") for c, w in (("GCT", 1.0), ("GCC", 0.9), ("GCA", 0.95), ("GCG", 0.1))], "host string, codon string, w double")
    (r,) = slots.codon_adaptation(frame, given, table).collect()
    assert (r.role, r.side, r.passes) == ("target", "upper", False)
    (r,) = slots.codon_adaptation(frame, given, table, slots.cai_bands(hi=0.99)).collect()
    assert r.passes
    for wrong in ({"hi": 1.0}, {"lo": 0.96}, {"lo": 0.9, "hi": 0.8}):
        with pytest.raises(ValueError):
            slots.cai_bands(**wrong)
    assert set(slots.cai_bands(0.2, 0.9)) == set(HOSTS) and slots.cai_bands(0.2, 0.9)["sf9"] == (0.2, 0.9) and "sf9" not in slots.cai_bands(lo=0.2)


def test_host_weights_are_counts_over_the_familys_largest(spark):
    got = {(r.host, r.codon): r.w for r in slots.host_weights(spark.createDataFrame([("human", c) for c in ("GCT", "GCT", "GCA", "ATG", "TAA", "xyz")] + [("cho", "GCG")], "host string, codon string")).collect()}
    assert got["human", "GCT"] == 1 and got["human", "GCA"] == pytest.approx(1.5 / 2.5) and got["human", "GCC"] == pytest.approx(0.5 / 2.5) and got["cho", "GCT"] == pytest.approx(0.5 / 1.5)
    assert {h for h, _ in got} == {"human", "cho"} and not {"ATG", "TGG", "TAA", "xyz"} & {c for _, c in got} and len(got) == 2 * 59


def plain_kozak(row, mine, leaders, strong):
    spans, n, circular, scored = _cds(row), len(row[1]), row[2], []
    mine = [s for s in mine if s[2] != "propagation" and s[3] not in dims.BACTERIA]
    if not mine:
        return "no_slot"
    if not spans:
        return "no_cds"
    held = lambda f, a: any(f[0] <= a + t and a + 6 + t <= f[1] for t in ((0, n, -n) if circular else (0,)))
    for _, _, role, host, table, strand in mine:
        a, b = spans[0] if strand == 1 else spans[-1]
        at = a - 6 if strand == 1 else b - 5
        if b - a < 5 or not circular and (at < 0 or at + 11 > n):
            return "no_room"
        at %= n
        if not any(held(f, at if strand == 1 else at + 5) for f in leaders):
            return "no_leader"
        text = (row[1] * 2)[at : at + 11]
        text = text if strand == 1 else dna.complement_text(text)
        if text[6:9] in dims.STARTS[table].split():
            scored.append(((text[3] in "AG") + (text[9] == "G"), role, host, text, at))
    if not scored:
        return "no_initiator"
    tier, role, host, text, at = min(scored, key=lambda s: s[0])
    return role, host, float(tier), text, at, not (tier == 0 or strong and tier < 2), text[9] != "G"


@pytest.mark.parametrize("strong", [False, True])
def test_start_context_equals_plain_reading(spark, strong):
    rng = random.Random(7)
    rows, leaders = _constructs(rng, 200), {}
    for i, (c, seq, circular, segments) in enumerate(rows):
        spans, n = _cds(rows[i]), len(seq)
        text = list(seq)
        for (a, b), start in zip(spans[:1] + spans[-1:], ("ATG", "CAT"), strict=False):
            for k in range(3):  # starts for either strand
                p = (a + k) % n if start == "ATG" else (b - 3 + k) % n
                text[p] = start[k] if rng.random() < 0.95 else text[p]
        rows[i] = (c, "".join(text), circular, segments)
        some = [((a - 40) % n if circular else max(a - 40, 0), ((a - 40) % n if circular else max(a - 40, 0)) + min(40, a if not circular else 40)) for a, _ in spans]
        some += [(b % n if circular else b, (b % n if circular else b) + 25) for _, b in spans]
        leaders[c] = some if rng.random() < 0.9 else []
    of = _slots(rng, rows)
    frame = spark.createDataFrame([(*r, leaders[r[0]]) for r in rows] + [(900, "ACGTACG", True, None, None)], f"construct_id long, seq string, circular boolean, segments {SEGMENTS}, leaders array<struct<start:int,end:int>>")
    got = {r.construct_id: r for r in slots.start_context(frame, spark.createDataFrame([*of, (900, 1, "target", "human", 1, 1)], SLOT), strong).collect()}
    assert len(got) == 201 and got[900].reason == "no_cds"
    seen = set()
    for row in rows:
        want, r = plain_kozak(row, [s for s in of if s[0] == row[0]], leaders[row[0]], strong), got[row[0]]
        if isinstance(want, str):
            assert (r.reason, r.score, r.passes) == (want, None, True), row
        else:
            assert (r.role, r.host, r.score, r.context, r.start, r.passes, r.fixable) == want and r.end == r.start + 11 and r.magnitude == 2 - want[2]
        seen.add(r.reason)
    assert seen == {None, "no_slot", "no_cds", "no_room", "no_leader", "no_initiator"}


def plain_min_max(codons, stats, width):
    """Every window summed anew."""
    out = []
    for i in range(len(codons)):
        rows = [stats[c] for c in codons[max(0, i - (width - 1) // 2) : i + width // 2 + 1] if c in stats]
        used, mean, most, least = (sum(r[k] for r in rows) for k in range(4))
        span = most - mean if used >= mean else mean - least
        out.append((100 if used >= mean else -100) * abs(used - mean) / span if span > 0 else 0.0)
    return out


def test_min_max_equals_summing_every_window():
    rng = random.Random(11)
    usage = {c: float(rng.randrange(1, 9)) for c in dims.CODONS}
    del usage["GCG"]  # a family with a gap is left out whole
    stats = slots.family_table(usage, 1)
    assert not {"GCT", "GCC", "GCA", "GCG", "ATG", "TGG", "TAA"} & set(stats) and stats["TTT"][1] == (usage["TTT"] + usage["TTC"]) / 2
    for width in (1, 2, 5, 18):
        for size in (1, 2, 17, 60):
            codons = [rng.choice(dims.CODONS) for _ in range(size)]
            assert slots.min_max(codons, stats, width) == pytest.approx(plain_min_max(codons, stats, width), abs=1e-9)
    assert slots.min_max(["ATG", "TAA"], stats).tolist() == [0.0, 0.0]
    with pytest.raises(ValueError):
        slots.min_max(["ATG"], stats, 0)


def test_landscape_equals_plain_reading_of_every_slot(spark):
    rng = random.Random(5)
    rows = _constructs(rng, 120)
    of = _slots(rng, rows)
    usage = {h: {c: float(rng.randrange(1, 30)) for c in dims.CODONS} for h in HOSTS if h != "cho"}
    frame = spark.createDataFrame([*rows, (900, None, True, None)], f"construct_id long, seq string, circular boolean, segments {SEGMENTS}")
    table = spark.createDataFrame([(h, c, x) for h, u in usage.items() for c, x in u.items()] + [("elf", "GCT", 1.0), ("human", "NNN", 1.0)], "host string, codon string, freq double")
    band = (-20.0, 10.0)
    got = {r.construct_id: r for r in slots.codon_landscape(frame, spark.createDataFrame([*of, (900, 1, "target", "human", 1, 1)], SLOT), table, band, 5).collect()}
    assert len(got) == 121 and got[900].reason == "no_cds"
    sides = set()
    for row in rows:
        want, scored = None, []
        mine = [s for s in of if s[0] == row[0] and s[2] != "propagation"]
        spans = _cds(row)
        want = "no_slot" if not mine else "no_cds" if not spans else None
        for _, _, role, host, code, strand in mine if want is None else ():
            text = "".join((row[1] * 2)[a:b] for a, b in spans)
            text = text if strand == 1 else dna.complement_text(text)
            stats = slots.family_table(usage.get(host, {}), code)
            codons = [text[i : i + 3] for i in range(0, len(text), 3)]
            want = "no_reference_set" if host not in usage else "out_of_frame" if len(text) % 3 else None if any(c in stats for c in codons) else "no_informative_codons"
            if want:
                break
            profile = plain_min_max(codons, stats, 5)
            mean = sum(profile) / len(profile)
            away = max(band[0] - mean, mean - band[1], 0.0)
            scored.append((away if away > 0 else mean - band[1] - 1, role, host, mean, max(profile), min(profile), sum(c in stats for c in codons), away))
        r = got[row[0]]
        assert r.reason == want, row
        if want is None:
            top = max(scored, key=lambda s: s[0])
            assert (r.role, r.host, r.n, r.passes) == (top[1], top[2], top[6], top[7] == 0) and (r.score, r.peak, r.trough, r.magnitude) == pytest.approx((*top[3:6], top[7]), abs=1e-9)
            sides.add(r.side)
    assert sides == {None, "lower", "upper"}
    with pytest.raises(ValueError):
        slots.codon_landscape(frame, spark.createDataFrame([], SLOT), table, (1.0, 1.0))


def test_empty_tables_give_no_rows(spark):
    frame = spark.createDataFrame([], f"construct_id long, seq string, circular boolean, segments {SEGMENTS}, leaders array<struct<start:int,end:int>>")
    given = spark.createDataFrame([], SLOT)
    assert slots.start_context(frame, given).count() == 0
    assert slots.codon_adaptation(frame, given, spark.createDataFrame([], "host string, codon string, w double")).count() == 0
    assert slots.designable(frame).where(F.lit(True)).count() == 0
