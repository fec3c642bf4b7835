"""Ranked lexical search, score at a time: postings in order of exact impact, until bounds prove the best k.

A posting's impact is the whole number it adds to a document's score: the term's weight times a count damped by the document's
length.  Documents are searched in shards (some megabytes of text within a task); texts and postings are never shuffled.

1. One pass counts the documents that hold a term, all terms, and for each query term its documents (partial sums a task).
2. A second pass builds each shard's postings of the query terms, sorted by term and falling impact.  For each item, levels of
   impact are opened from the highest down, a level with all its postings: every posting opened adds its impact to its document's
   sum, and each term's next impact bounds what unopened postings may add.  The shard is done with when no more than k
   documents can still be among the best k, counting the best of the task's earlier shards; only then are these
   documents' scores completed from their remaining postings.  Where bounds never prove it, all postings are opened.
3. Each task gives its k best of each item, and a last ranking merges them: k rows for each item and task.

Items are taken in blocks of about ``BLOCK`` (item, term) rows; so what a task holds of the queries is bounded, and more items mean
more passes.  A shard's memory is bounded by its text, or by the longest text.

Terms are compared by 64-bit hashes.  Defined results: a null or empty text has no terms, neither a document's nor an item's.  Each row
of the items is a query of its own, so repeated rows give repeated results.  Documents of equal score go by ascending id, null ids
last; rows that share an id are each ranked.  Items without a match give no row, as do empty tables.  Extra columns, of any name, play
no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, exact_dedup

#: Documents given for each item.
TOP = 10
#: (item, term) rows searched for at once.
BLOCK = 200_000
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "item_id long, rank int, doc_id long, score long"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, hash): each row of ``items`` under a number of its own, with its distinct terms."""
    words = F.array_distinct(F.regexp_extract_all(exact_dedup.folded(F.col(text)), F.lit(TERM), 0))
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("item_id"), words.alias("words"))
    rows = rows.select("item", "item_id", F.explode("words").alias("term"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = blocks.text_block(batch.column(2))
            keys = blocks.span_hashes(data, at[:-1], at[1:])[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys)], names=["item", "item_id", "hash"])

    return rows.mapInArrow(hashed, "item long, item_id long, hash long")


def _tokens(batch: pa.RecordBatch, column: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms with repeats in each row; row and number of each token that is one of ``terms`` (sorted hashes)."""
    data, offsets = blocks.text_block(batch.column(column))
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
    keys = blocks.span_hashes(data, starts, ends)[0].view(np.int64)
    where = np.searchsorted(terms, keys)
    where[where == len(terms)] = 0
    known = np.flatnonzero(terms[where] == keys) if len(terms) else np.zeros(0, np.int64)
    return np.diff(bounds), np.searchsorted(bounds, known, "right") - 1, where[known]


def statistics(docs: DataFrame, terms: np.ndarray, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents of each of ``terms``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(terms) + 2, np.int64)  # the last two: documents, terms
        for some in blocks.row_blocks(batches, "text"):
            n, row, term = _tokens(some, 0, terms)
            held[:-2] += np.bincount(np.unique(row * len(terms) + term) % max(len(terms), 1), minlength=len(terms))
            held[-2:] += np.count_nonzero(n), n.sum()
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(blocks.freeing(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(len(terms) + 2, np.int64)
    held[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return int(held[-2]), int(held[-1]), held[:-2]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Shard:
    """Postings of one shard, by term in falling order of impact, and again by document."""

    def __init__(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> None:
        size = len(weight)
        pair, tf = np.unique(row * size + term, return_counts=True)
        self.doc, self.term = pair // max(size, 1), pair % max(size, 1)  # by document
        length = 10 + (90 * n.astype(np.int64) * n_docs) // max(n_terms, 1)
        self.impact = weight[self.term] * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * length[self.doc]))
        self.doc_at = np.searchsorted(self.doc, np.arange(len(n) + 1))
        order = np.lexsort((-self.impact, self.term))
        self.by_doc, self.by_impact = self.doc[order], self.impact[order]
        self.term_at = np.searchsorted(self.term[order], np.arange(size + 1))
        self.rows = len(n)

    def levels(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Postings (number, and place of its term in ``terms``) opened at each level of impact, and each term's next impact."""
        lists = [self.by_impact[self.term_at[t] : self.term_at[t + 1]] for t in terms]
        at = np.zeros(len(terms), np.int64)
        sizes = np.array([len(x) for x in lists])
        heads = np.array([x[0] if len(x) else 0 for x in lists], np.int64)
        while heads.any():
            top = heads.max()
            floor = top - top // 8  # whole groups of equal impact down to here
            to = np.array([int(np.searchsorted(-x, -floor, "right")) if h >= floor else a for x, h, a in zip(lists, heads, at, strict=True)])
            grown = to - at
            which = np.repeat(np.arange(len(terms)), grown)
            number = np.arange(grown.sum()) - np.repeat(np.cumsum(grown) - grown, grown) + np.repeat(self.term_at[terms] + at, grown)
            at = to
            heads = np.array([x[a] if a < s else 0 for x, a, s in zip(lists, at, sizes, strict=True)], np.int64)
            yield number, which, heads

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and whole scores of all documents that can be among the best ``k`` and score at least ``floor`` (k or fewer unless
        equal scores, or bounds that prove too little, leave more)."""
        terms = terms[self.term_at[terms + 1] > self.term_at[terms]]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.by_impact[self.term_at[terms]].sum() < floor:  # no document here can reach what is there already
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(self.rows, np.int64)
        opened = np.zeros((self.rows, len(terms)), bool)
        left, may = np.zeros(0, np.int64), None
        for number, which, heads in self.levels(terms):
            doc = self.by_doc[number]
            total += np.bincount(doc, self.by_impact[number], self.rows).astype(np.int64)
            opened[doc, which] = True
            least = max(int(np.partition(total, -k)[-k]) if self.rows >= k else 0, floor, 1)
            unseen = int(heads.sum())
            if unseen >= least:
                continue
            may = total + unseen - opened @ heads
            left = np.flatnonzero(may >= least)
            if len(left) <= k:
                break
        else:
            left = np.flatnonzero(total >= max(int(np.partition(total, -k)[-k]) if self.rows >= k else 0, floor, 1))
            return left, total[left]
        mine = np.zeros(len(self.term_at) - 1, bool)
        mine[terms] = True
        whole = [self.impact[a:b][mine[self.term[a:b]]].sum() for a, b in zip(self.doc_at[left], self.doc_at[left + 1], strict=True)]
        return left, np.array(whole, np.int64)


def _first(k: int, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, null, -scores))[:k]


def _search_block(docs: DataFrame, block: pa.Table, k: int, text: str) -> DataFrame:
    """The ``k`` best of each item of a block from each task."""
    terms, place = np.unique(block.column("hash").to_numpy(), return_inverse=True)
    order = np.argsort(block.column("item").to_numpy(), kind="stable")
    item, first = np.unique(block.column("item").to_numpy()[order], return_index=True)
    lists = np.split(place[order], first[1:])
    n_docs, n_terms, df = statistics(docs, terms, text)
    weight = weights(n_docs, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * len(item)
        for some in blocks.shards(batches, 1, SHARD_BYTES):
            ids = some.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            shard = Shard(*_tokens(some, 1, terms), weight, n_docs, n_terms)
            for j, mine in enumerate(lists):
                floor = int(best[j][2].min()) if len(best[j][2]) == k else 1
                row, score = shard.best(mine, k, floor)
                if len(row):
                    joined = [np.concatenate(x) for x in zip(best[j], (ids[row], null[row], score), strict=True)]
                    keep = _first(k, *joined)
                    best[j] = tuple(x[keep] for x in joined)
        count = [len(x[2]) for x in best]
        ids, null, score = (np.concatenate([x[c] for x in best]) if best else none[c] for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(item, count)), pa.array(ids, mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(blocks.freeing(run), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text", block_rows: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    queries = blocks.cut(item_terms(items, item_id))
    n_blocks = max(1, math.ceil(queries.count() / block_rows))
    found = None
    for b in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).select("item", "hash").toArrow()
        if not block.num_rows:
            continue
        part = _search_block(docs, block, k, text)
        if n_blocks > 1:
            part = blocks.cut(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())))
    names = queries.select("item", F.col("item_id")).distinct()
    return ranked.where(F.col("rank") <= k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words, row_number() over () as r from documents),
s as (select count(*) as n, sum(len(words))::bigint as l from w where len(words) > 0),
i as (select item_id, row_number() over () as item, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
t as (select r, doc_id, len(words) as n, unnest(words) as term from w),
p as (select r, doc_id, n, term, count(*) as tf from t where term in (select term from i) group by all),
d as (select term, floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)))::bigint as weight from p, s group by term),
q as (select r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * s.n) // s.l))) as impact from p join d using (term), s),
z as (select item, item_id, r, doc_id, sum(impact)::bigint as score from i join q using (term) group by all having sum(impact) > 0),
k as (select item_id, doc_id, score, row_number() over (partition by item order by score desc, doc_id) as rank from z)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
