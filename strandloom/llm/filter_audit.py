"""How filters interact: every order of applying them at once, as a product of matrices of whole numbers.

A document's outcome in any order depends on the set of filters it fails alone, one of 32.  So texts are read once, each document
becomes its set (a mask), and a part of the corpus becomes three rows of 32 counts: all its documents, those of label quality,
those of label toxic.  These rows, stacked, are multiplied by matrices of 32 by 600 (120 orders of 5 steps) of zeros and ones that say
of each set whether a document is kept after a step, removed there, redundant there or fails that filter only.  Matrices
depend on the filters' number, never on the data.  A filter's Shapley column is its removals summed over all orders.

Masks and counts are DataFrame plans; the product runs on Arrow batches of parts, so a million parts are as fine as one.

Defined results: a null text is empty (no words: fails A, and no other text filter); a null source is the empty string; a null
id has no labels and is no document's smaller id, nor has it any.  Rows that share an id each count.  Several labels of one id: it is
good if any says so, toxic if any says so.  Empty tables give no rows.  Extra columns, of any name, play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact_dedup

FILTERS = "ABCDE"
#: Fixed values of the filters: fewest words; least percentage of distinct words; largest percentage of capitals; odd characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 50, 65, 5, "[#$%&*|]"
#: White space between words.
SPACE = r"[\x20\x09-\x0D]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether ``text`` fails A, B, C, D."""
    text = exact_dedup.plain(text)
    pieces = F.split(text, SPACE + "+")  # words, and an empty piece before a leading and behind a trailing space
    before, behind, none = (c.cast("int") for c in (text.rlike(f"^{SPACE}"), text.rlike(rf"{SPACE}\z"), text == ""))
    n = F.size(pieces) - before - behind - none
    different = F.size(F.array_distinct(pieces)) - F.greatest(before, behind, none)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = (n < LEAST_WORDS, 100 * different.cast("long") < LEAST_DISTINCT * n.cast("long"), 100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text), text.rlike(ODD))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def matrices(filters: str = FILTERS) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders, and for each outcome a matrix of 2^n masks by orders x steps, in whole numbers."""
    n = len(filters)
    orders = list(itertools.permutations(range(n)))
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    at = fails[:, np.array(orders)].reshape(1 << n, len(orders), n)  # does the mask fail the filter of this step
    before = np.cumsum(at, 2) - at
    out = {
        "kept": before + at == 0,
        "removed": (at == 1) & (before == 0),
        "redundant": (at == 1) & (before > 0),
        "unique_fails": (at == 1) & (fails.sum(1) == 1)[:, None, None],
    }
    out = {k: v.reshape(1 << n, -1).astype(np.int64) for k, v in out.items()}
    which = np.array(orders).reshape(-1)
    same = (which[:, None] == which[None, :]).astype(np.int64)  # steps of the same filter, in any order
    out["shapley"] = out["removed"] @ same
    return ["".join(filters[k] for k in o) for o in orders], out


def incidence(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask) -> documents, good ones, toxic ones; at most 32 rows a part."""
    rows = exact_dedup.grouped(docs, exact_dedup.plain, carry={"part": F.coalesce(F.col(part), F.lit("")), "own": text_mask(F.col("text"))})
    mask = F.col("own") + F.when(F.col("doc_id") > F.col("least_id"), 16).otherwise(0)
    once = rows.groupBy("doc_id", "part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    both = once.join(marks, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def products(counts: DataFrame) -> DataFrame:
    """Each part's 600 rows: its three histograms times the matrices."""
    stacked = counts.groupBy("part").agg(*[F.collect_list(F.col(c).cast("long")).alias(c) for c in ("mask", "n", "good", "toxic")])
    orders, by = matrices()
    steps = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(np.repeat(orders, steps))
        step = np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                rows = some.num_rows
                lists = {c: some.column(some.schema.get_field_index(c)) for c in ("mask", "n", "good", "toxic")}
                row = np.repeat(np.arange(rows), lists["mask"].value_lengths().to_numpy(zero_copy_only=False))
                mask = lists["mask"].flatten().to_numpy()
                stack = np.zeros((3, rows, 1 << len(FILTERS)), np.int64)
                for k, c in enumerate(("n", "good", "toxic")):
                    stack[k, row, mask] = lists[c].flatten().to_numpy()
                got = {c: stack[0] @ by[c] for c in ("kept", "removed", "redundant", "unique_fails", "shapley")} | {"good_lost": stack[1] @ by["removed"], "toxic_lost": stack[2] @ by["removed"]}
                part = some.column(some.schema.get_field_index("part")).take(pa.array(np.repeat(np.arange(rows), len(step))))
                yield pa.RecordBatch.from_arrays([part, pa.concat_arrays([names] * rows), pa.array(np.tile(step, rows)), *[pa.array(got[c].reshape(-1)) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    return stacked.mapInArrow(run, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Every part, order and step, zeros included."""
    return products(incidence(docs, labels, part))


SQL = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as least from t),
m as (select doc_id, part, (case when len(words) < 50 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end)
  || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' else '' end)
  || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > least then 'E' else '' end) as mask from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
h as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as prior from o, (select unnest([1, 2, 3, 4, 5]) as step)),
x as (select part, filter_order, step, letter, n, good, toxic, contains(mask, letter) as fails, mask = letter as lone,
  len(list_intersect(string_split(prior, ''), string_split(mask, ''))) > 0 and prior <> '' and mask <> '' as gone from h, s),
r as (select part, filter_order, step, letter, coalesce(sum(n) filter (not fails and not gone), 0) as kept, coalesce(sum(n) filter (fails and not gone), 0) as removed,
  coalesce(sum(n) filter (fails and gone), 0) as redundant, coalesce(sum(n) filter (lone), 0) as unique_fails,
  coalesce(sum(good) filter (fails and not gone), 0) as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0) as toxic_lost from x group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r
"""
