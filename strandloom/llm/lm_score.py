"""Language-model scoring with an Elias-Fano n-gram trie (words, order 2).

Tokens are runs of other than ASCII white space, lower-cased in A-Z, then one end token per text; a text
begins after a begin context.  Counts come from all training texts.

The trie has a level of contexts and a level of successors.  Both are monotone sequences in Elias-Fano form: context
keys, pointers to each context's first successor, and successor keys offset by their context's rank.  Beside them
lie quantised probabilities (16 bits, 1/512 of a decade).  The levels lie in one memory mapping; a query finds its
context, then searches the successor among that context's range.

Smoothing: with m(v) = MASS * c(v)^POWER for the unseen successors of v, whose number grows about so, P(w | v) =
c(vw) / (c(v) + m(v)) where vw was seen, else m(v) / (c(v) + m(v)) * P(w) with the add-one unigram P(w); unseen contexts
leave P(w).  So a text's score is a sum of parts that can be found apart, and a context's count is all a part needs.

Scale: the trie is cut in buckets by context key.  Texts are cut in blocks; a block sends each bucket its distinct
n-grams with training counts and postings (text, multiplicity), so frequent n-grams are pre-aggregated, and a bucket
builds its part of the trie and answers the same postings.  Contexts with more than 1/(4 buckets) of all tokens (at most 4
per bucket) are spread over all buckets by successor.  No bucket holds more than its share, and nothing but those
contexts and two totals reaches the driver.

Null and empty texts have the end token alone.  Repeated rows repeat; extra columns are ignored; without training texts every
context is unseen and N and V are 0.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

BITS = 56
TOP = np.uint64(1 << BITS)
END, BEGIN = np.uint64((1 << BITS) - 1), np.uint64(0)
MASS, POWER = 2.0, 0.9
STEP = 512.0
BLOCK = 4 << 20
#: Stands for a null ``doc_id`` between the stages.
NO_ID = -(1 << 63)
#: Tokens a bucket of words and a bucket of pairs should hold.
TOKENS_PER_BUCKET, PAIRS_PER_BUCKET = 3_000_000, 1_000_000
#: Leading bits of a successor's key that the trie and the look-up of unseen successors use.
SUCCESSOR_BITS = 40


# ---------------------------------------------------------------- trie


class EliasFano:
    """A monotone sequence of n values below ``universe``: low bits in whole bytes, high bits in unary.

    ``successor`` finds, for each x and range of indices, the first index in the range whose value is at least x.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, shift: int):
        self.low, self.n, self.shift = low, n, shift
        bits = np.unpackbits(high, bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        # Values with high part below h: zeros[h - 1] - (h - 1).
        self.below = np.concatenate(([0], zeros - np.arange(len(zeros)))).astype(np.int64)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        n = len(values)
        width = min(7, max(0, (int(universe) // max(n, 1)).bit_length() - 1) // 8 + 1)
        shift = 8 * width
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width])
        # Unary high parts: the i-th value sets bit high + i.
        high = (values >> np.uint64(shift)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        return low.reshape(-1), np.packbits(bits, bitorder="little"), n, shift

    def value_low(self, at: np.ndarray) -> np.ndarray:
        width = self.shift // 8
        out = np.zeros((len(at), 8), np.uint8)
        out[:, :width] = self.low[at[:, None] * width + np.arange(width)[None, :]]
        return out.view("<u8").reshape(-1)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        high = np.minimum((x >> np.uint64(self.shift)).astype(np.int64), len(self.below) - 1)
        lo = np.maximum(lo, self.below[high])
        hi = np.minimum(hi, np.where(high + 1 < len(self.below), self.below[np.minimum(high + 1, len(self.below) - 1)], self.n))
        hi = np.maximum(hi, lo)
        low = x & np.uint64((1 << self.shift) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self.value_low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def equals(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether the value at each index is x."""
        ok = at < self.n
        safe = np.where(ok, at, 0)
        high = (x >> np.uint64(self.shift)).astype(np.int64)
        inside = high + 1 < len(self.below) + 1
        high = np.minimum(high, len(self.below) - 1)
        first, last = self.below[high], np.where(high + 1 < len(self.below), self.below[np.minimum(high + 1, len(self.below) - 1)], self.n)
        return ok & inside & (at >= first) & (at < last) & (self.value_low(safe) == (x & np.uint64((1 << self.shift) - 1)))


class BigramTrie:
    """Two Elias-Fano levels over memory-mapped bytes; built from sorted distinct (context, successor) pairs."""

    def __init__(self, buffer, layout: list[tuple[str, int, int]], sizes: dict[str, int]):
        part = {name: np.frombuffer(buffer, np.dtype(kind), count, start) for (name, start, count), kind in zip(layout, ("u1", "u1", "u1", "u1", "u1", "u1", "<u2", "<u2"), strict=True)}
        self.contexts = EliasFano(part["context_low"], part["context_high"], sizes["contexts"], sizes["context_shift"])
        self.pointers = EliasFano(part["pointer_low"], part["pointer_high"], sizes["contexts"] + 1, sizes["pointer_shift"])
        self.children = EliasFano(part["child_low"], part["child_high"], sizes["children"], sizes["child_shift"])
        self.backoff, self.prob = part["backoff"], part["prob"]

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, count: np.ndarray, totals: dict[int, int] | None = None) -> BigramTrie:
        """``first, second`` sorted by both; ``totals`` overrides a context's count where this part has not all of it."""
        new = np.concatenate(([True], first[1:] != first[:-1])) if len(first) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        contexts = first[start]
        rank = np.cumsum(new) - 1
        total = np.add.reduceat(count, start).astype(float) if len(start) else np.zeros(0)
        for k, n in (totals or {}).items():
            at = np.searchsorted(contexts, np.uint64(k))
            if at < len(contexts) and contexts[at] == np.uint64(k):
                total[at] = n
        mass = MASS * total**POWER
        prob = np.round(-STEP * np.log10(count / (total + mass)[rank])).clip(0, 65535).astype("<u2")
        backoff = np.round(-STEP * np.log10(mass / (total + mass))).clip(0, 65535).astype("<u2")
        # Successors as one monotone sequence: context rank, then the leading bits of the key.
        a = EliasFano.encode(contexts, 1 << BITS)
        b = EliasFano.encode(np.append(start, len(first)).astype(np.uint64), len(first) + 1)
        c = EliasFano.encode(cls._child(rank.astype(np.uint64), second), max(1, len(contexts)) << SUCCESSOR_BITS)
        parts = [("context_low", a[0]), ("context_high", a[1]), ("pointer_low", b[0]), ("pointer_high", b[1]), ("child_low", c[0]), ("child_high", c[1]), ("backoff", backoff), ("prob", prob)]
        layout, at = [], 0
        for name, x in parts:
            at += -at % 8
            layout.append((name, at, len(x)))
            at += x.nbytes
        # A mapping of its own: no folder of the machine is used.
        mapped = mmap.mmap(-1, at + 8)
        for (_, start, _), (_, x) in zip(layout, parts, strict=True):
            mapped[start : start + x.nbytes] = x.tobytes()
        sizes = {"contexts": a[2], "context_shift": a[3], "pointer_shift": b[3], "children": c[2], "child_shift": c[3]}
        return cls(mapped, layout, sizes)

    @staticmethod
    def _child(rank: np.ndarray, second: np.ndarray) -> np.ndarray:
        return rank << np.uint64(SUCCESSOR_BITS) | second >> np.uint64(BITS - SUCCESSOR_BITS)

    def pointer(self, i: np.ndarray) -> np.ndarray:
        """Value of the pointer sequence: low bytes plus the high part, whose count of values below is known."""
        high = np.searchsorted(self.pointers.below, i, "right") - 1
        return (high.astype(np.int64) << self.pointers.shift) + self.pointers.value_low(i).astype(np.int64)

    def query(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(quantised -log10 of the probability if seen, else of the back-off weight; seen)."""
        n = len(first)
        if not self.contexts.n:
            return np.zeros(n, np.int64), np.zeros(n, bool)
        at = self.contexts.successor(first, np.zeros(n, np.int64), np.full(n, self.contexts.n))
        known = self.contexts.equals(at, first)
        at = np.where(known, at, 0)
        lo, hi = self.pointer(at), self.pointer(at + 1)
        key = self._child(at.astype(np.uint64), second)
        child = self.children.successor(key, lo.copy(), hi)
        seen = known & (child < hi) & self.children.equals(child, key)
        cost = np.where(seen, self.prob[np.where(seen, child, 0)].astype(np.int64), np.where(known, self.backoff[at].astype(np.int64), 0))
        return cost, seen


# ---------------------------------------------------------------- blocks


def _tokens(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """56-bit token keys with each text's end token, and per-row bounds."""
    data, offsets = blocks.text_block(block.column(1))
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.SOLID)
    keys = blocks.span_hashes(data, starts, ends)[0] >> np.uint64(64 - BITS)
    keys = np.clip(keys, BEGIN + np.uint64(1), END - np.uint64(1))
    rows = block.num_rows
    row = np.repeat(np.arange(rows), np.diff(bounds))
    out = np.full(len(keys) + rows, END)
    out[np.arange(len(keys)) + row] = keys
    return out, bounds + np.arange(rows + 1)


def _pack7(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack7(b: bytes | memoryview) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").reshape(-1)


def _pack5(x: np.ndarray) -> bytes:
    return (x >> np.uint64(BITS - SUCCESSOR_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(b: bytes | memoryview) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1) << np.uint64(BITS - SUCCESSOR_BITS)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _frame(*parts: bytes) -> bytes:
    """Sizes of the parts, then all of them compressed together."""
    raw = b"".join(parts)
    return np.array([len(p) for p in parts], "<u4").tobytes() + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def _unframe(b: bytes, n: int) -> list[memoryview]:
    sizes = np.frombuffer(b, "<u4", n).astype(np.int64)
    ends = np.cumsum(sizes)
    view = memoryview(_ZSTD.decompress(memoryview(b)[4 * n :], int(ends[-1]), asbytes=True) if ends[-1] else b"")
    return [view[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _postings(key_order: np.ndarray, same: np.ndarray, doc: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups of equal keys in sorted order: first index, training count, postings per group, and the postings."""
    d = doc[key_order]
    group = np.flatnonzero(~same)
    counts = np.add.reduceat(train[d].astype(np.int64), group)
    fresh = ~same | np.concatenate(([True], d[1:] != d[:-1]))
    post = np.flatnonzero(fresh)
    mult = np.diff(np.append(post, len(d)))
    # A posting holds at most 65535 occurrences; longer ones repeat.
    if len(mult) and mult.max() > 65535:
        times = -(-mult // 65535)
        post = np.repeat(post, times)
        nth = np.arange(len(post)) - np.repeat(np.cumsum(times) - times, times)
        mult = np.minimum(np.repeat(mult, times) - nth * 65535, 65535)
    per = np.diff(np.append(np.searchsorted(post, group), len(post)))
    return group, counts, per, d[post], mult


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    base = TaskContext.get().partitionId() << 32
    n = 0
    for block in blocks.row_blocks(batches, "text", BLOCK):
        for k in range(0, block.num_rows, 65536):
            yield base + n, block.slice(k, 65536)
            n += 1


PART = "bucket int, block long, kind int, body binary"


def _rows(made: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    b, k, t, x = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int64()), pa.array(t, pa.int32()), pa.array(x, pa.binary())], ["bucket", "block", "kind", "body"])


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the key's 32 leading bits, so that sorted keys have sorted buckets."""
    return ((key >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _unigram_parts(buckets: int):
    """Per block and bucket: distinct words, training counts, postings (kind 0); per block: its texts (kind 1, bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocked(batches):
            token, bounds = _tokens(block)
            train = np.asarray(block.column(2).to_numpy(zero_copy_only=False), bool)
            doc = np.repeat(np.arange(block.num_rows), np.diff(bounds))
            order = np.argsort(token, kind="stable")
            t = token[order]
            group, counts, per, docs, mult = _postings(order, np.concatenate(([False], t[1:] == t[:-1])), doc, train)
            word = t[group]
            edge = np.searchsorted(_bucket(word, buckets), np.arange(buckets + 1))
            post = np.concatenate(([0], np.cumsum(per)))
            made = [(-1, number, 1, _frame(block.column(0).to_numpy().astype("<i8").tobytes(), train.astype(np.uint8).tobytes(), np.diff(bounds).astype("<u4").tobytes()))]
            for b in range(buckets):
                i, j = edge[b], edge[b + 1]
                if i < j:
                    p, q = post[i], post[j]
                    made.append((b, number, 0, _frame(_pack7(word[i:j]), counts[i:j].astype("<u4").tobytes(), per[i:j].astype("<u4").tobytes(), docs[p:q].astype("<u2").tobytes(), mult[p:q].astype("<u2").tobytes())))
            yield _rows(made)

    return run


def _pair_parts(buckets: int, hot: np.ndarray):
    """Per block and bucket: distinct pairs in runs of one context, training counts, postings (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocked(batches):
            second, bounds = _tokens(block)
            first = np.empty_like(second)
            first[1:] = second[:-1]
            first[bounds[:-1]] = BEGIN
            train = np.asarray(block.column(2).to_numpy(zero_copy_only=False), bool)
            doc = np.repeat(np.arange(block.num_rows), np.diff(bounds))
            order = np.argsort(first >> np.uint64(BITS - 32) << np.uint64(32) | second >> np.uint64(BITS - 32), kind="stable")
            f, s = first[order], second[order]
            group, counts, per, docs, mult = _postings(order, np.concatenate(([False], (f[1:] == f[:-1]) & (s[1:] == s[:-1]))), doc, train)
            f, s = f[group], s[group]
            bucket = _bucket(f, buckets)
            spread = hot[np.minimum(np.searchsorted(hot, f), len(hot) - 1)] == f
            bucket[spread] = _bucket(blocks.mix(f[spread] + s[spread]) >> np.uint64(64 - BITS), buckets)
            by = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
            at = np.concatenate(([0], np.cumsum(per)))
            made = []
            for b in range(buckets):
                g = by[edge[b] : edge[b + 1]]
                if not len(g):
                    continue
                new = np.concatenate(([True], f[g][1:] != f[g][:-1]))
                runs = np.diff(np.append(np.flatnonzero(new), len(g)))
                n = per[g]
                post = np.repeat(at[:-1][g] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
                made.append((b, number, 0, _frame(_pack7(f[g][new]), runs.astype("<u4").tobytes(), _pack5(s[g]), counts[g].astype("<u4").tobytes(), n.astype("<u4").tobytes(), docs[post].astype("<u2").tobytes(), mult[post].astype("<u2").tobytes())))
            yield _rows(made)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The rows of each bucket, which come together and in order."""
    now, rows = None, []
    for batch in batches:
        for bucket, block, kind, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if bucket != now:
                if rows:
                    yield now, rows
                now, rows = bucket, []
            rows.append((block, kind, body))
    if rows:
        yield now, rows


#: Number formats of the sums of each kind.
SUMS = {0: ("<f8", "<u4"), 4: ("<u4",), 6: ("<f8", "<u4")}


def _sums(kind: int, docs: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sums per text of a block, for the texts that have any: text numbers, then the columns."""
    n = int(docs.max()) + 1 if len(docs) else 0
    hit = np.flatnonzero(np.bincount(docs, minlength=n))
    return _frame(hit.astype("<u2").tobytes(), *(np.bincount(docs, c, n)[hit].astype(f).tobytes() for c, f in zip(columns, SUMS[kind], strict=True)))


def _answer_unigrams(buckets: int):
    """Counts over all blocks.  Kind 0: per block, sums of log10(c + 1) and of known tokens; 2: the bucket's table; 3: N, V and frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            parts = [_unframe(body, 5) for _, _, body in rows]
            words = [_unpack7(p[0]) for p in parts]
            every, where = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(where, np.concatenate([np.frombuffer(p[1], "<u4") for p in parts]), len(every)).astype(np.int64)
            log = np.log10(total + 1.0)
            made, at = [], 0
            for (block, _, _), w, p in zip(rows, words, parts, strict=True):
                mine = where[at : at + len(w)]
                at += len(w)
                per, docs, mult = np.frombuffer(p[2], "<u4").astype(np.int64), np.frombuffer(p[3], "<u2").astype(np.int64), np.frombuffer(p[4], "<u2").astype(float)
                word = np.repeat(mine, per)
                made.append((bucket, block, 0, _sums(0, docs, mult * log[word], mult * (total[word] > 0))))
            known = total > 0
            made.append((bucket, -1, 2, _frame(_pack7(every[known]), total[known].astype("<u8").tobytes())))
            n = int(total.sum())
            often = np.flatnonzero(total * 4 * buckets > n) if n else np.zeros(0, np.int64)
            made.append((bucket, -1, 3, _frame(np.array([n, known.sum()], "<i8").tobytes(), every[often].astype("<u8").tobytes(), total[often].astype("<u8").tobytes())))
            yield _rows(made)

    return run


def _answer_pairs(buckets: int, totals: dict[int, int]):
    """Builds the bucket's trie and scores its postings, all blocks at once.

    Kind 4: per block, sums of the quantised costs; 5: per bucket of words, the unseen pairs' second words of all blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            parts = [_unframe(body, 7) for _, _, body in rows]
            numbers = np.array([block for block, _, _ in rows], "<i8")
            f = np.concatenate([np.repeat(_unpack7(p[0]), np.frombuffer(p[1], "<u4")) for p in parts])
            s = np.concatenate([_unpack5(p[2]) for p in parts])
            counts = np.concatenate([np.frombuffer(p[3], "<u4") for p in parts]).astype(np.int64)
            per = np.concatenate([np.frombuffer(p[4], "<u4") for p in parts]).astype(np.int64)
            mult = np.concatenate([np.frombuffer(p[6], "<u2") for p in parts]).astype(float)
            texts = [np.frombuffer(p[5], "<u2") for p in parts]
            sizes = [len(x) for x in texts]
            # Texts of all blocks, one behind another.
            base = np.concatenate(([0], np.cumsum([int(x.max()) + 1 for x in texts])))
            text = np.concatenate(texts).astype(np.int64) + np.repeat(base[:-1], sizes)
            del parts, texts
            trained = np.flatnonzero(counts > 0)
            order = trained[np.lexsort((s[trained], f[trained]))]
            ff, ss, n = f[order], s[order], counts[order]
            begin = np.flatnonzero(np.concatenate(([True], (ff[1:] != ff[:-1]) | (ss[1:] != ss[:-1])))) if len(ff) else np.zeros(0, np.int64)
            trie = BigramTrie.build(ff[begin], ss[begin], np.add.reduceat(n, begin) if len(begin) else n, totals)
            del ff, ss, n, order, counts
            cost, seen = trie.query(f, s)
            pair = np.repeat(np.arange(len(f)), per)
            sums, some = np.bincount(text, mult * cost[pair], base[-1]), np.bincount(text, minlength=base[-1]) > 0
            made = []
            for k, block in enumerate(numbers.tolist()):
                hit = np.flatnonzero(some[base[k] : base[k + 1]])
                made.append((bucket, block, 4, _frame(hit.astype("<u2").tobytes(), sums[base[k] : base[k + 1]][hit].astype("<u4").tobytes())))
            yield _rows(made)
            ask = np.flatnonzero(~seen[pair])
            if len(ask):
                word = s[pair[ask]]
                order = np.argsort(word, kind="stable")
                ask, word = ask[order], word[order]
                of = np.repeat(np.arange(len(numbers)), sizes)[ask]
                inside = text[ask] - base[of]
                edge = np.searchsorted(_bucket(word, buckets), np.arange(buckets + 1))
                made = []
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    i, j = edge[k], edge[k + 1]
                    made.append((k, -1, 5, _frame(numbers.tobytes(), _pack5(word[i:j]), of[i:j].astype("<u4").tobytes(), inside[i:j].astype("<u2").tobytes(), mult[ask[i:j]].astype("<u2").tobytes())))
                yield _rows(made)

    return run


def _answer_unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins asked words to the bucket's table.  Kind 6: per block, sums of log10(c + 1) and of the words."""
    for bucket, rows in _by_bucket(batches):
        words, total = np.zeros(0, np.uint64), np.zeros(0)
        for _, kind, body in rows:
            if kind == 2:
                w, c = _unframe(body, 2)
                words, total = _unpack7(w) >> np.uint64(BITS - SUCCESSOR_BITS) << np.uint64(BITS - SUCCESSOR_BITS), np.frombuffer(c, "<u8").astype(float)
        blocks_, docs_, logs_, mults_ = [], [], [], []
        for _, kind, body in rows:
            if kind == 5:
                numbers, w, of, d, m = _unframe(body, 5)
                w, mult = _unpack5(w), np.frombuffer(m, "<u2").astype(float)
                at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
                c = np.where(words[at] == w, total[at], 0.0) if len(words) else np.zeros(len(w))
                blocks_.append(np.frombuffer(numbers, "<i8")[np.frombuffer(of, "<u4")])
                docs_.append(np.frombuffer(d, "<u2"))
                logs_.append(mult * np.log10(c + 1))
                mults_.append(mult)
        if not blocks_:
            continue
        block, doc, log, mult = (np.concatenate(x) for x in (blocks_, docs_, logs_, mults_))
        order = np.argsort(block, kind="stable")
        block, doc, log, mult = block[order], doc[order].astype(np.int64), log[order], mult[order]
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        yield _rows([(bucket, int(block[i]), 6, _sums(6, doc[i:j], log[i:j], mult[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)])


def _gather(n_all: int, n_distinct: int):
    """All parts of a block, in order, to one row per text."""
    base = float(np.log10(n_all + n_distinct + 1.0))
    names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(b.select([1, 0, 2, 3]) for b in batches):
            texts = next(_unframe(body, 3) for _, kind, body in rows if kind == 1)
            doc, train, size = np.frombuffer(texts[0], "<i8"), np.frombuffer(texts[1], np.uint8), np.frombuffer(texts[2], "<u4").astype(np.int64)
            log, known, cost, back, asked = (np.zeros(len(doc)) for _ in range(5))
            for _, kind, body in rows:
                for columns, k in (((log, known), 0), ((cost,), 4), ((back, asked), 6)):
                    if kind == k:
                        at, *sums = _unframe(body, 1 + len(columns))
                        at = np.frombuffer(at, "<u2")
                        for column, x, f in zip(columns, sums, SUMS[k], strict=True):
                            column[at] += np.frombuffer(x, f)
            score = -cost / STEP + back - asked * base
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, train > 0, size, np.round(known).astype(np.int64), log - size * base, score)], names)

    return run


def score(docs: DataFrame, train: Column, buckets: int | None = None) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs(doc_id, text)``.

    ``train`` marks the rows that are learnt from.  ``base_score`` is the add-one unigram's log10 probability, ``score``
    the trie's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(least, size // (6 * TOKENS_PER_BUCKET) + 1)
    pair_buckets = max(buckets, size // (6 * PAIRS_PER_BUCKET) + 1)
    keyed = lambda df, n: df.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "block")
    parts = rows.mapInArrow(blocks.freeing(_unigram_parts(buckets)), PART)
    texts = blocks.cut(parts.where("kind = 1"))
    unigrams = blocks.cut(keyed(parts.where("kind = 0"), buckets).mapInArrow(blocks.freeing(_answer_unigrams(buckets)), PART))
    n_all = n_distinct = 0
    often: list[tuple[int, int]] = []
    for r in unigrams.where("kind = 3").select("body").toLocalIterator():
        totals, words, counts = _unframe(r["body"], 3)
        n, v = np.frombuffer(totals, "<i8").tolist()
        n_all, n_distinct = n_all + n, n_distinct + v
        often += zip(np.frombuffer(words, "<u8").tolist(), np.frombuffer(counts, "<u8").tolist(), strict=True)
        # Those still over the share so far; the final share is larger, so at most 4 per bucket stay.
        often = [x for x in often if x[1] * 4 * buckets > n_all]
    ends = rows.where("train").count()
    hot = {w: c for w, c in often if w != int(END)} | {int(BEGIN): ends}
    pairs = keyed(rows.mapInArrow(blocks.freeing(_pair_parts(pair_buckets, np.array(sorted(hot), np.uint64))), PART), pair_buckets)
    answered = blocks.cut(pairs.mapInArrow(blocks.freeing(_answer_pairs(buckets, hot)), PART))
    unseen = keyed(answered.where("kind = 5").unionByName(unigrams.where("kind = 2")), buckets).mapInArrow(blocks.freeing(_answer_unseen), PART)
    every = texts.unionByName(unigrams.where("kind = 0")).unionByName(answered.where("kind = 4")).unionByName(unseen)
    gathered = every.repartition(F.col("block")).sortWithinPartitions("block", "kind", "bucket").mapInArrow(blocks.freeing(_gather(n_all, n_distinct)), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return gathered.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "train", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
