"""Exact dedup, filter audit and ranked search against brute force, on odd rows and on the whole smallest tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import blocks, exact_dedup, filter_audit, queries, ranked_search
from tests.test_oracles import TABLES, _rows

DOCS = "doc_id long, text string, source string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "ÜNDER", "42", "x-y", "ALPHA", "$5"]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    rows = [(1, None, "s"), (2, "", None), (3, " \n\x0b ", ""), (4, long, "t"), (5, long.lower(), "t"), (6, "Same Text", "s"), (7, "same text", "s"), (7, "same text", "s"), (8, "sAME TEXT", "t")]
    rows += [(None, "same text", "s"), (None, "no id", "t"), (None, "no id", "t"), (9, "Ünder", "s"), (10, "ünder", "s"), (-4, "same text", "s"), (2**62, "", "s"), (11, "a" * 5000, "s"), (12, "a" * 4999 + "b", "s")]
    rows += [(100 + k, "copy of the hot group", "hot") for k in range(120)]
    rows += [(300 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))), rng.choice(["s", "t", None])) for k in range(120)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, DOCS)
    for extra in ("_row", "_n", "_key", "_whole", "_c0", "count", "kept", "mask", "n", "good", "toxic", "part", "own", "item", "score", "rank", "words"):
        df = df.withColumn(extra, F.lit(7))
    return df


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_exact_dedup", "op13_ranked_search"])
def test_whole_tables_equal_sql(name, spark, sf, duck):
    mine, theirs = queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


@pytest.mark.parametrize("bits,share", [(1 << 24, 1 << 16), (64, 20)])
def test_exact_groups(spark, odd, odd_rows, monkeypatch, bits, share):
    """Also with a bitmap of one word, where every key passes, and with groups joined by both ways."""
    monkeypatch.setattr(exact_dedup, "BITS", bits)
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    groups = collections.defaultdict(list)
    for i, text, _ in odd_rows:
        groups[low(text)].append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        least = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, least, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact_dedup.grouped(odd, digests=True).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.least_id, r.group_size, r.text_sha256)) for r in got)
    stays = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(stays.values()) == {1} and len(stays) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    one = exact_dedup.keep_one(odd)
    assert one.columns == odd.columns and sorted(low(r.text) for r in one.collect()) == sorted(groups)


def test_groups_survive_another_order(spark, odd):
    """The same rows in other partitions give the same facts."""
    facts = lambda df: sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in exact_dedup.grouped(df, digests=True).collect())
    assert facts(odd) == facts(odd.repartition(7)) == facts(odd.coalesce(1))


def test_plain_texts_keep_case(spark, odd):
    got = {r.doc_id: r.group_size for r in exact_dedup.grouped(odd, exact_dedup.plain).collect()}
    assert got[6] == 1 and got[7] == 4 and got[8] == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.grouped(none, digests=True).count() == exact_dedup.keep_one(none).count() == 0
    assert filter_audit.audit(none, labels).count() == 0
    assert ranked_search.search(none, items).count() == 0
    docs = spark.createDataFrame([(1, "some text", "s")], DOCS)
    assert ranked_search.search(docs, items).count() == 0
    assert ranked_search.search(none, spark.createDataFrame([(1, "text")], "item_id long, text string")).count() == 0
    assert filter_audit.audit(docs, labels).count() == 600


def audit_plain(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        f = ""
        f += "A" * (len(words) < 50)
        f += "B" * (100 * len(set(words)) < 65 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        f += "D" * bool(re.search("[#$%&*|]", text))
        f += "E" * (i is not None and i > least[text])
        fails.append((source or "", i, f))
    out = collections.defaultdict(lambda: [0] * 6)
    for part in {p for p, _, _ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                row = out[part, order, step + 1]
                for p, i, mask in fails:
                    if p != part:
                        continue
                    gone = any(g in mask for g in order[:step])
                    row[0] += not gone and f not in mask
                    row[1] += not gone and f in mask
                    row[2] += gone and f in mask
                    row[3] += mask == f
                    row[4] += not gone and f in mask and i in good
                    row[5] += not gone and f in mask and i in toxic
    total = collections.Counter()
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark, odd, odd_rows):
    labels = [(1, 1, 0), (1, None, 1), (4, 0, 1), (None, 1, 1), (7, 1, None), (7, 0, 1), (301, 1, 0), (302, 1, 1), (9999, 1, 1)] + [(100 + k, k % 2, k % 3 == 0) for k in range(40)]
    labels = [(i, q, int(t) if t is not None else None) for i, q, t in labels]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1)).withColumn("part", F.lit("x"))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(odd, df).collect()}
    assert got == audit_plain(odd_rows, labels)


def test_matrices_say_what_orders_do():
    orders, by = filter_audit.matrices()
    assert len(orders) == 120 == len(set(orders)) and by["kept"].shape == (32, 600)
    assert (by["removed"].sum(1)[1:] == 120).all() and by["removed"][0].sum() == 0
    size = np.array([bin(m).count("1") for m in range(32)])
    for m in range(1, 32):  # each failing filter comes first in as many orders as any other
        assert set(by["shapley"][m][by["shapley"][m] > 0]) == {120 // size[m]}


def rank_plain(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    terms = [(i, words(t)) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = collections.Counter(t for _, w in terms for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in terms:
            tf = collections.Counter(w)
            m = 10 + (90 * len(w) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(words(text)) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta x"), (1, "alpha beta x"), (2, None), (3, ""), (None, "Same text of the HOT group"), (5, "ünder ÜNDER 42 5"), (6, "zzz nothing"), (7, " ".join(f"w{k}" for k in range(500)) + " gamma no id"), (8, "copy copy alpha y")]


@pytest.mark.parametrize("block,shard,k", [(200_000, 8 << 20, 10), (5, 2000, 3), (100, 1, 1)])
def test_ranking(spark, odd, odd_rows, monkeypatch, block, shard, k):
    """Also in many blocks of items and many shards a task."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(1)).withColumn("hash", F.lit(1))
    got = ranked_search.search(odd.coalesce(2), items, k=k, block_rows=block)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == rank_plain(odd_rows, ITEMS, k)


def test_bounds_stop_early():
    """Frequent terms' postings stay closed once rare ones have decided; scores are whole all the same."""
    rng = np.random.default_rng(1)
    n = np.full(2000, 60)
    row = np.concatenate((np.arange(2000), np.arange(2000), rng.choice(2000, 12, replace=False)))
    term = np.concatenate((np.zeros(2000, int), np.ones(2000, int), np.full(12, 2)))
    weight = ranked_search.weights(2000, np.array([2000, 1990, 12]))
    shard = ranked_search.Shard(n, row, term, weight, 2000, 120_000)
    terms = np.array([0, 1, 2])
    opened = 0
    for number, _, heads in shard.levels(terms):
        opened += len(number)
        if opened >= 12:
            break
    assert opened == 12 and heads.sum() < shard.impact.max()
    got, score = shard.best(terms, 12, 1)
    plain = np.zeros(2000, np.int64)
    np.add.at(plain, shard.doc, shard.impact)
    assert set(got) == set(row[-12:]) and (score == plain[got]).all()


def test_levels_keep_groups_whole():
    rng = np.random.default_rng(2)
    shard = ranked_search.Shard(rng.integers(1, 40, 300), rng.integers(0, 300, 4000), rng.integers(0, 9, 4000), rng.integers(1, 9000, 9), 300, 6000)
    seen, last = [], None
    for number, which, heads in shard.levels(np.arange(9)):
        impact = shard.by_impact[number]
        assert last is None or impact.max() < last
        assert (heads < impact.min()).all()
        last = impact.min()
        seen.append(number)
    assert sorted(np.concatenate(seen)) == list(range(len(shard.by_impact)))


def test_search_rows_are_bounded(spark, sf):
    """A task gives k rows an item at most, however many documents match."""
    docs = blocks.read(spark, sf, "documents")
    items = blocks.read(spark, sf, "benchmark")
    queries_ = ranked_search.item_terms(items).select("item", "hash").toArrow()
    found = ranked_search._search_block(docs.repartition(3), queries_, 4, "text")
    assert found.groupBy("item", F.spark_partition_id().alias("task")).count().where("count > 4").count() == 0
