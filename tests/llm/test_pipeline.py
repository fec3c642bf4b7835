"""Each stage against a plain version on its own input."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandloom.llm import blocks

from .test_operators import WORD, brute_classes, brute_decontam, low


def test_stages(spark, sf):
    docs = blocks.read(spark, sf, "documents")
    extra = spark.createDataFrame([(70_000, "12 34 —", "en", "s", 7), (70_001, None, "en", "s", None), (70_002, "Some english words and the of in here", None, "s", 37)], docs.schema)
    docs = docs.unionByName(extra)
    bench = blocks.read(spark, sf, "benchmark")
    before = {r.doc_id: r for r in docs.collect()}
    one = blocks.cut(cp.identify_language(spark, docs, sf))
    kept = {r.doc_id: r for r in one.collect()}
    assert one.columns == docs.columns and set(before) - set(kept) == {70_000, 70_001} and kept[70_002].lang is not None
    two = blocks.cut(cp.dedup_lines(spark, one, sf))
    assert two.columns == docs.columns
    lines = collections.defaultdict(set)
    for r in two.collect():
        assert set(r.text.split("\n")) <= set(kept[r.doc_id].text.split("\n")) and r.n_chars == len(r.text)
        for line in r.text.split("\n"):
            if len(line.split()) >= 50:
                lines[line.strip()].add(r.doc_id)
    assert all(len(v) == 1 for v in lines.values())
    three = blocks.cut(cp.dedup_near(spark, two, sf))
    want = brute_classes([(r.doc_id, r.text) for r in two.collect()])
    assert {r.doc_id for r in three.collect()} == set(want.values())
    four = blocks.cut(cp.decontaminate(spark, three, sf))
    hits = brute_decontam([(r.doc_id, r.text) for r in three.collect()], [(r.item_id, r.text) for r in bench.collect()])
    texts = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        n_words, n_hit, *_ = hits[r.doc_id]
        assert len(WORD.findall(low(r.text))) in (n_words - n_hit, n_words - n_hit + 1) if n_hit else r.text == texts[r.doc_id]
    assert {d for d in texts} - {r.doc_id for r in four.collect()} == {d for d, h in hits.items() if h[0] and h[0] == h[1]}
    five = cp.mix_sources(spark, four, sf)
    assert set(five.columns) == {*docs.columns, "domain", "rate"} and five.where(F.col("rate") <= 0).isEmpty()
    assert five.count() <= four.count() and re.match(r"[a-z]+/", five.first().domain)


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0 and [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"] and cp.ORACLE_SQL is None
