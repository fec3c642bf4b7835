"""Line deduplication by pairwise alignment.

The unit is a non-blank line, trimmed.  A single line may be common (a licence, a heading); what is rare is a run of lines.
So every line gets the hash of its run: the shortest run of lines from it on that holds ``min_words`` words.  A document
overlaps each earlier one that is the first holder of one of its runs; frequent lines by themselves link nothing, and a
document has at most as many partners as lines, however many share a run.  Each pair is aligned as patience diff does:
the longest increasing subsequence of the shared runs, which join to common blocks; runs off that
chain (moved passages, second copies) join to blocks along their own diagonals.  All these blocks are deleted from the
later document.  So exactly the lines go that lie in ``min_words`` or more words of successive lines which an
earlier document holds too.

Documents are ordered by ``doc_id``, null ids last, rows of one id by the text's digest; equal texts of one id are
the same document, treated alike.  Null and empty texts have no lines and stay.  Copies of a document lose all long enough blocks and
may become empty.  Empty tables give empty results; columns of any name pass through :func:`remove`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

MIN_WORDS = 25
#: Order of rows without an id.
LAST = (1 << 63) - 1


def _lines(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, raw line number, hash and words of each non-blank line, and the rows' bounds."""
    data, offsets = blocks.text_block(column)
    starts, ends, _ = blocks.spans(data, offsets, blocks.NOT_NEWLINE)
    word_starts, word_ends, _ = blocks.spans(data, offsets, blocks.SOLID)
    first, last = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    some = last > first
    starts, first, last = starts[some], first[some], last[some]
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes = blocks.span_hashes(data, word_starts[first], word_ends[last - 1])[0] if len(row) else np.zeros(0, np.uint64)
    newlines = np.concatenate(([0], np.cumsum(data == 0x0A)))
    raw = newlines[starts] - newlines[offsets[:-1]][row]
    return row, raw, hashes, last - first, np.searchsorted(row, np.arange(len(column) + 1))


_BASE = np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def _runs(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, line behind the last, and hash of each line's shortest run of ``min_words`` words; lines without one are left out."""
    total = np.concatenate(([0], np.cumsum(words)))
    stop = np.searchsorted(total, total[:-1] + min_words)
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    begin = np.flatnonzero(stop <= row_end)
    stop = stop[begin]
    # Polynomial hashes by prefix sums, from the row's own lines alone.
    inside = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    most = int(inside.max()) + 2 if len(inside) else 1
    up, down = np.full(most, _BASE, np.uint64), np.full(most, _BACK, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(blocks.mix(hashes) * up[inside], dtype=np.uint64)))
    key = (sums[stop] - sums[begin]) * down[inside[begin]] + (stop - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return begin, stop, blocks.mix(key)


def _keyed(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.row_blocks(batches, "text"):
            row, _, hashes, words, bounds = _lines(block.column(2))
            begin, _, key = _runs(hashes, words, bounds, min_words)
            owner = pa.array(row[begin])
            seq = (begin - bounds[:-1][row[begin]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), block.column(0).take(owner), block.column(1).take(owner), pa.array(seq)], ["key", "doc", "digest", "seq"])

    return run


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of a longest increasing subsequence of the second numbers; pairs come by their first number."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
        back.append(at[k - 1] if k else -1)
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def align(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Common blocks [first, end) of lines of one pair; ``runs`` are (line, end of its run, line in the earlier document) by line."""
    chain = patience([(r[0], r[2]) for r in runs])
    on = set(chain)
    out: list[tuple[int, int]] = []
    for part in ([runs[i] for i in chain], sorted((r for i, r in enumerate(runs) if i not in on), key=lambda r: (r[2] - r[0], r[0]))):
        now: list[int] | None = None
        for first, end, other in part:
            if now and other - first == now[2] and first <= now[1]:
                now[1] = max(now[1], end)
            else:
                if now:
                    out.append((now[0], now[1]))
                now = [first, end, other - first]
        if now:
            out.append((now[0], now[1]))
    return out


REMOVED = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("words", pa.int32()), ("earlier", pa.int64())]))
REMOVED_DDL = "array<struct<first_line:int,last_line:int,words:int,earlier:long>>"


def _cut_row(shared: list[dict], begin: np.ndarray, stop: np.ndarray, raw: np.ndarray, words: np.ndarray) -> list[dict]:
    """Disjoint blocks to delete of one document, from its shared runs (seq, owner, owner digest, owner seq)."""
    end_of = dict(zip(begin.tolist(), stop.tolist(), strict=True))
    pairs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for h in sorted(shared, key=lambda h: h["seq"]):
        pairs.setdefault((h["owner"], h["owner_digest"]), []).append((h["seq"], end_of[h["seq"]], h["owner_seq"]))
    found = sorted((a, -b, owner[0]) for owner, runs in pairs.items() for a, b in align(runs))
    out, reach = [], 0
    for a, minus, owner in found:
        a, b = max(a, reach), -minus
        if a < b:
            reach = b
            out.append({"first_line": int(raw[a]), "last_line": int(raw[b - 1]), "words": int(words[a:b].sum()), "earlier": None if owner == LAST else owner})
    return out


def _removed(text: int, min_words: int):
    """Rows whose last column holds their shared runs (or null) come out with the text cut and the deleted blocks instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.shards(batches, text, blocks.BLOCK_BYTES):
            shared = block.column(block.num_columns - 1)
            hit = np.flatnonzero(shared.is_valid().to_numpy(zero_copy_only=False))
            texts, removed = block.column(text), [None] * block.num_rows
            if len(hit):
                part = texts.take(pa.array(hit))
                _, raw, hashes, words, bounds = _lines(part)
                begin, stop, _ = _runs(hashes, words, bounds, min_words)
                at = np.searchsorted(begin, bounds)
                new = texts.to_pylist()
                for k, i in enumerate(hit.tolist()):
                    lo, hi = bounds[k], bounds[k + 1]
                    mine = slice(at[k], at[k + 1])
                    removed[i] = _cut_row(shared[i].as_py(), begin[mine] - lo, stop[mine] - lo, raw[lo:hi], words[lo:hi])
                    gone = {n for x in removed[i] for n in range(x["first_line"], x["last_line"] + 1)}
                    new[i] = "\n".join(x for n, x in enumerate(new[i].split("\n")) if n not in gone)
                texts = pa.array(new, pa.string())
            columns = [texts if k == text else c for k, c in enumerate(block.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, REMOVED)], [*block.schema.names[:-1], "removed"])

    return run


def shared_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, digest, shared`` of the documents of ``rows(doc, digest, text)`` with runs that an earlier one holds too."""
    lines = rows.where("text is not null").mapInArrow(_keyed(min_words), "key long, doc long, digest long, seq int")
    place = F.struct("doc", "digest", "seq")
    first = lines.groupBy("key").agg(F.min(place).alias("o"), F.max(F.struct("doc", "digest")).alias("z")).where("struct(o.doc, o.digest) < z").select("key", "o")
    later = lines.join(first, "key").where("struct(doc, digest) > struct(o.doc, o.digest)")
    run = F.struct("seq", F.col("o.doc").alias("owner"), F.col("o.digest").alias("owner_digest"), F.col("o.seq").alias("owner_seq"))
    return later.groupBy("doc", "digest").agg(F.collect_set(run).alias("shared"))


def remove(docs: DataFrame, min_words: int = MIN_WORDS, column: str = "removed") -> DataFrame:
    """``docs`` with common blocks deleted from ``text`` (``n_chars`` follows) and the deleted blocks in ``column``, which takes the
    place of one of that name: raw line ranges, both ends in, their words, and the ``doc_id`` of an earlier document that holds them.

    Texts are shuffled once, to meet their runs.
    """
    names = docs.columns
    text = names.index("text")
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    rows = rows.withColumn("doc", F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(LAST))).withColumn("digest", F.xxhash64(f"c{text}"))
    found = shared_runs(rows.select("doc", "digest", F.col(f"c{text}").alias("text")), min_words)
    joined = rows.join(found, ["doc", "digest"], "left").select(*(f"c{k}" for k in range(len(names))), "shared")
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + f", removed {REMOVED_DDL}"
    cut = joined.mapInArrow(_removed(text, min_words), schema)
    length = F.when(F.col("removed").isNotNull(), F.length(f"c{text}").cast("long"))
    kept = [(k, n) for k, n in enumerate(names) if n != column]
    made = [F.coalesce(length, F.col(f"c{k}")).cast(docs.schema[k].dataType) if n == "n_chars" else F.col(f"c{k}") for k, n in kept]
    return cut.select(*made, "removed").toDF(*(n for _, n in kept), column)


def report(cleaned: DataFrame, column: str = "removed") -> DataFrame:
    """Per document: lines and words deleted, the blocks, and the digest of what stays."""
    lines = F.expr(f"aggregate(coalesce({column}, array()), 0L, (a, b) -> a + b.last_line - b.first_line + 1)")
    words = F.expr(f"aggregate(coalesce({column}, array()), 0L, (a, b) -> a + b.words)")
    return cleaned.select("doc_id", lines.alias("n_removed_lines"), words.alias("n_removed_words"), F.col(column), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))
