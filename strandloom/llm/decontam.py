"""Benchmark decontamination with an FM-index per shard of training text.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.  Benchmark items give
phrases of ``width`` consecutive words (a shorter item is one phrase).  Every shard of documents becomes one
sequence over the benchmark's vocabulary; a word outside it can be in no phrase, so it is a separator, and
runs of known words too short for any phrase are left out of the index.  The sequence is suffix-sorted to the
phrase width, its Burrows-Wheeler transform is kept in a wavelet tree, phrases are found by backward search
over rank queries, and occurrences are located by walking to sampled suffix positions.  Occurrences of all
phrases merge into removal spans.

Phrases are the stated query set: they are read in blocks of ``block_phrases``, so what is broadcast at once is bounded
whatever the benchmark's size.  Every block is one more map over the same rows, which carries what earlier blocks found;
rows are never keyed, joined or shuffled, so null and repeated ids, and columns of any name, make no difference.  Null
texts have no words and stay null; repeated documents and items are treated alike; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

WIDTH = 10
SAMPLE = 8


class Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.words = np.packbits(np.append(bits.astype(np.uint8), np.zeros(-self.n % 64 + 64, np.uint8)), bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64))).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Rank over a sequence of small integers, by bit planes from the top (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.planes = len(symbols), []
        seq = symbols
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            self.planes.append((b, Bits(bit), self.n - int(bit.sum())))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` entries equal ``symbol``; vectorised."""
        lo, hi = np.zeros_like(at), at.copy()
        for b, plane, zeros in self.planes:
            up = (symbol >> b & 1).astype(bool)
            low, high = plane.rank(lo), plane.rank(hi)
            lo, hi = np.where(up, zeros + low, lo - low), np.where(up, zeros + high, hi - high)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The entries at positions ``at``."""
        out, at = np.zeros(len(at), np.int64), at.copy()
        for b, plane, zeros in self.planes:
            up = plane.get(at)
            out |= up.astype(np.int64) << b
            ones = plane.rank(at)
            at = np.where(up, zeros + ones, at - ones)
        return out


class FMIndex:
    """Backward search over a sequence of symbols >= 1; 0 is the separator that occurs in no pattern.

    Suffixes are sorted up to their first separator, ties by position; a step to the symbol before keeps that
    order, so last-to-first steps are exact up to a separator.  Of the suffix order only samples are kept: every
    ``sample``-th position and each first one behind a separator, so that no step goes over one.
    """

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = len(text)
        order = self.suffix_order(text)
        # Rotations of the text: the symbol before position 0 is the last one, always a separator.
        before = text[order - 1].astype(np.int64)
        self.tree = WaveletTree(before, max(1, int(sigma).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 2))))
        marked = (order % sample == 0) | (before == 0)
        self.marked, self.at = Bits(marked), order[marked].astype(np.int32)

    @staticmethod
    def suffix_order(text: np.ndarray) -> np.ndarray:
        """Prefix doubling, until a round tells no more suffixes apart."""
        rank, k = text.astype(np.int64), 1
        n, distinct = len(text), 0
        seps = np.append(np.flatnonzero(text == 0), n)
        left = seps[np.searchsorted(seps, np.arange(n))] - np.arange(n)
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: max(n - k, 0)] = rank[k:]
            nxt[left < k] = 0
            key = rank * (int(rank.max()) + 1) + nxt
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            step = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            if step[-1] == distinct:
                return order
            distinct = step[-1]
            rank = np.empty(n, np.int64)
            rank[order] = step
            k *= 2

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of right-padded patterns (pattern, position)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < sizes) & (hi > lo))
            if not len(live):
                continue
            c = patterns[live, j]
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by last-to-first steps to the nearest sampled suffix."""
        steps, out = np.zeros(len(rank), np.int64), np.full(len(rank), -1, np.int64)
        todo, here = np.arange(len(rank)), rank.copy()
        while len(todo):
            got = self.marked.get(here)
            out[todo[got]] = self.at[self.marked.rank(here[got])] + steps[todo[got]]
            todo, here = todo[~got], here[~got]
            if len(todo):
                c = self.tree.access(here)
                here = self.first[c] + self.tree.rank(c, here)
                steps[todo] += 1
        return out


@dataclass(frozen=True)
class Phrases:
    """One block of the query set: vocabulary hashes, padded symbols, sizes, owning item ids."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = blocks.text_block(column)
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
    return blocks.span_hashes(data, starts, ends)[0], starts, ends, bounds, data, offsets


def phrases(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``phrase, item`` of ``benchmark(item_id, text)``, each pair once: a phrase is its words' hashes, 8 bytes each.

    An item without an id has a null ``item``; null texts and texts without words have no phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.row_blocks(batches, "text"):
            hashes, _, _, bounds, _, _ = _tokens(block.column(1))
            size = np.diff(bounds)
            many = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
            row = np.repeat(np.arange(len(size)), many)
            first = bounds[:-1][row] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            body = hashes.tobytes()
            made = [body[8 * a : 8 * b] for a, b in zip(first.tolist(), np.minimum(first + width, bounds[1:][row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), block.column(0).take(pa.array(row))], ["phrase", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "phrase binary, item string").distinct()


def phrase_blocks(benchmark: DataFrame, width: int = WIDTH, block_phrases: int = 200_000) -> Iterator[Phrases]:
    """The distinct phrases of ``benchmark(item_id, text)`` in blocks; an item's phrases may span blocks.

    Phrases are made and told apart by Spark and come to the driver a partition at a time.  A block has at most ``block_phrases``
    phrases and four times as many item ids, and so has what is broadcast: a phrase of more items is in several blocks.
    """
    found: dict[bytes, set[str]] = {}
    pairs = 0
    for r in phrases(benchmark, width).repartition("phrase").sortWithinPartitions("phrase", "item").toLocalIterator():
        if r["phrase"] not in found and len(found) >= block_phrases or pairs >= 4 * block_phrases:
            yield _pack(found, width)
            found, pairs = {}, 0
        named = found.setdefault(bytes(r["phrase"]), set())
        if r["item"] is not None:
            named.add(r["item"])
        pairs += 1
    if found:
        yield _pack(found, width)


def _pack(found: dict[bytes, set[str]], width: int) -> Phrases:
    words = [np.frombuffer(k, np.uint64) for k in found]
    vocabulary = np.unique(np.concatenate(words))
    sizes = np.array([len(w) for w in words])
    symbols = np.zeros((len(words), width), np.int64)
    for k, w in enumerate(words):
        symbols[k, : len(w)] = np.searchsorted(vocabulary, w) + 1
    return Phrases(vocabulary, symbols, sizes, [sorted(x) for x in found.values()])


def _shard_hits(query: Phrases, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, width, phrase) of every occurrence within the shard's rows."""
    none = np.zeros(0, np.int64)
    symbol = np.searchsorted(query.vocabulary, hashes)
    symbol = np.where(query.vocabulary[np.minimum(symbol, len(query.vocabulary) - 1)] == hashes, symbol + 1, 0)
    # Runs of known words within a row.
    known = symbol > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    heads = bounds[:-1]
    heads = heads[heads < len(symbol)]
    begin[heads] |= known[heads]
    start = np.flatnonzero(begin)
    if not len(start):
        return none, none, none
    stop = np.zeros(len(symbol) + 1, bool)
    stop[:-1] = ~known | begin
    stop[-1] = True
    # The first stop after a run's start.
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, "right")]
    long = end - start >= query.sizes.min()
    start, end = start[long], end[long]
    if not len(start):
        return none, none, none
    size = end - start + 1  # with the separator behind it
    first = np.concatenate(([0], np.cumsum(size)))
    origin = np.repeat(start - first[:-1], size) + np.arange(first[-1])
    text = symbol[np.minimum(origin, len(symbol) - 1)]
    text[first[1:] - 1] = 0
    index = FMIndex(text, len(query.vocabulary))
    lo, hi = index.search(query.symbols, query.sizes)
    count = hi - lo
    phrase = np.repeat(np.arange(len(count)), count)
    if not len(phrase):
        return none, none, none
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(count.sum())
    return origin[index.locate(at)], query.sizes[phrase], phrase


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())])
#: What a search adds to its rows.
FOUND = "n_words long, spans array<struct<start:int,end:int,first_word:int,last_word:int>>, items array<string>"
#: Maps that are chained before the rows are written, so that few broadcasts are in use at once.
CHAIN = 4


def _hits(query: Phrases, block: pa.RecordBatch, text: int) -> pa.RecordBatch:
    """``block`` with its last three columns (see :data:`FOUND`) brought up to date by one block of phrases."""
    hashes, starts, ends, bounds, data, offsets = _tokens(block.column(text))
    rows = block.num_rows
    at, width, phrase = _shard_hits(query, hashes, bounds)
    # Union of the occurrences, old and new: a word is hit where more begin than have ended.
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    old = block.column(block.num_columns - 2)
    if old.null_count < rows:
        spans = old.flatten()
        owner = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(old), 0).to_numpy(zero_copy_only=False))
        np.add.at(cover, bounds[:-1][owner] + spans.field("first_word").to_numpy(zero_copy_only=False), 1)
        np.add.at(cover, bounds[:-1][owner] + spans.field("last_word").to_numpy(zero_copy_only=False) + 1, -1)
    hit = np.cumsum(cover)[:-1] > 0
    row = np.repeat(np.arange(rows), np.diff(bounds))
    same = np.concatenate(([False], row[1:] == row[:-1])) if len(row) else np.zeros(0, bool)
    head = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & same)) if len(hit) else np.zeros(0, np.int64)
    tail = np.flatnonzero(hit & ~np.concatenate((hit[1:] & same[1:], [False]))) if len(hit) else head
    chars = blocks.code_points(data)
    owner = row[head]
    base = chars[offsets[:-1]][owner]
    items = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (chars[starts[head]] - base, chars[ends[tail]] - base, head - bounds[:-1][owner], tail - bounds[:-1][owner])], fields=list(SPAN))
    spans = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32), items)
    named = [set(x or ()) for x in block.column(block.num_columns - 1).to_pylist()]
    if len(at):
        pairs = np.unique(row[at] * len(query.sizes) + phrase)
        for r, p in zip(*np.divmod(pairs, len(query.sizes)), strict=True):
            named[r].update(query.items[p])
    columns = [*block.columns[:-3], pa.array(np.diff(bounds).astype(np.int64)), spans, pa.array([sorted(x) for x in named], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, block.schema.names)


def _search(rows: DataFrame, text: int, benchmark: DataFrame, width: int, shard_bytes: int, block_phrases: int, cut: bool = False) -> DataFrame:
    """``rows`` with columns renamed by position (c0, c1, ...) and the three of :data:`FOUND` behind them; the text is column ``text``, and is cut if so asked."""
    named = rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))
    out = named.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ", 1) for x in FOUND.split(", "))))
    schema = out.schema
    nothing = Phrases(np.zeros(1, np.uint64), np.ones((1, width), np.int64), np.array([width]), [[]])
    queries = phrase_blocks(benchmark, width, block_phrases)
    query, n = next(queries, nothing), 0
    while query is not None:
        following = next(queries, None)
        shared = rows.sparkSession.sparkContext.broadcast(query)
        out = (blocks.cut(out) if n and n % CHAIN == 0 else out).mapInArrow(_run(shared, text, shard_bytes, cut and following is None), schema)
        query, n = following, n + 1
    return out


def _run(shared, text: int, shard_bytes: int, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        for block in blocks.shards(batches, text, shard_bytes):
            found = _hits(query, block, text)
            yield _cut(found, text) if cut else found

    return run


_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]")


def _cut(block: pa.RecordBatch, text: int) -> pa.RecordBatch:
    """The block with its spans cut out of the texts, without the rows that are left without a word."""
    spans = block.column(block.num_columns - 2)
    hit = pc.greater(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    if not hit.any():
        return block
    new, keep = block.column(text).to_pylist(), np.ones(block.num_rows, bool)
    for i in np.flatnonzero(hit).tolist():
        parts, at = [], 0
        for s in spans[i].as_py():
            parts.append(new[i][at : s["start"]])
            at = s["end"]
        new[i] = "".join(parts) + new[i][at:]
        keep[i] = bool(_WORD.search(new[i]))
    columns = [pa.array(new, pa.string()) if k == text else c for k, c in enumerate(block.columns)]
    return pa.RecordBatch.from_arrays(columns, block.schema.names).filter(pa.array(keep))


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_bytes: int = 4 << 20, block_phrases: int = 200_000) -> DataFrame:
    """``doc_id, n_words, spans, items`` of each row of ``docs(doc_id, text)``, in as many rows.

    Items without an id are searched for like any other: their words are hit, but there is no id to name.  Rows of one ``item_id`` are one
    item of several texts.

    ``spans`` are merged removal spans in characters (end exclusive) with their first and last word; ``items``
    are the ids of benchmark items with an occurring phrase, sorted as strings.
    """
    found = _search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 1, benchmark, width, shard_bytes, block_phrases)
    return found.select(F.col("c0").alias("doc_id"), "n_words", "spans", "items")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per document from :func:`find`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last_word"] - s["first_word"] + 1).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_bytes: int = 4 << 20, block_phrases: int = 200_000) -> DataFrame:
    """``docs`` without its removal spans, same columns; a text left without any word goes, other rows stay as they are.

    ``n_chars`` follows the text.  The spans are cut out in the rows in which they were found: nothing is shuffled.
    """
    names = docs.columns
    text = names.index("text")
    found = _search(docs, text, benchmark, width, shard_bytes, block_phrases, cut=True)
    n_chars = F.when(F.size("spans") > 0, F.length(f"c{text}").cast("long"))
    made = [F.coalesce(n_chars, F.col(f"c{k}")).cast(docs.schema[k].dataType) if n == "n_chars" else F.col(f"c{k}") for k, n in enumerate(names)]
    return found.select(*made).toDF(*names)
