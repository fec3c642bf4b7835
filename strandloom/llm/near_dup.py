"""Near-duplicate classes by DartMinHash and banded joining.

A text is the weighted set of its ``SHINGLE``-word shingles (words lower-cased, weight = occurrences; a
shorter text is one shingle).  An element of weight w owns w unit cells; two texts' weighted Jaccard
similarity is the Jaccard similarity of their cells.  Every cell has a column of unit rank intervals, each
holding a Poisson(1) number of darts drawn from hashes; a dart falls on one of ``k`` coordinates.  A
coordinate's value is its earliest dart: intervals are opened in rank order until every coordinate has one.
The expected number of darts thrown is about max(weight, k ln k), not k times the weight.

Steps: equal texts collapse to one (least id); signatures are cut in bands; within each bucket every member is
paired with its centre, the member that shares most buckets overall; pairs are verified exactly.  Where a bucket then holds
several classes, its members meet across classes: distance (one less similarity) is a metric, so members whose distances from the
centre differ by more than 1 - threshold are no link, and a prefix filter on the cells rules out most others; the rest are
verified until the classes are joined.  So no link within a bucket is missed.  A pair of similarity 0.8 misses all ``bands`` bands
with probability (1 - 0.8^r)^b, 3e-6 as set here.  Classes are the connected components of verified links.

Null texts are in classes of their own; empty texts and texts without words are only equal to equal texts.  A row without
``doc_id`` takes part like any other; a class of such rows alone has no id.
Repeated rows with equal text share a class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Cells of a block of a bucket; two blocks are in memory at once.
BLOCK = 1_500_000
THRESHOLD = 0.8
_ROW_BITS = 12
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)]) * 2.0**64).clip(0, 2**64 - 2048).astype(np.uint64)


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cell hashes of each row's weighted shingles, sorted within the row, and per-row bounds."""
    data, offsets = blocks.text_block(column)
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
    shingles, at = blocks.window_hashes(blocks.span_hashes(data, starts, ends)[0], bounds, SHINGLE)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    key = np.sort(row << np.uint64(64 - _ROW_BITS) | shingles >> np.uint64(_ROW_BITS))
    if not len(key):
        return key, at
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    mask = np.uint64((1 << (64 - _ROW_BITS)) - 1)
    cell = blocks.mix((key & mask) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return cell, at


def signatures(cell: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each coordinate: (row, k); rows without cells keep the largest value."""
    weight = np.diff(at)
    sig = np.full((len(weight), k), np.uint64(2**64 - 1))
    flat = sig.reshape(-1)
    first = np.zeros(len(weight), np.int64)
    depth = np.where(weight > 0, np.ceil(k * (math.log(k) + 1) / np.maximum(weight, 1)), 0).astype(np.int64)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        # A few rows at a time, so that the open intervals stay within some hundred thousand.
        load = np.cumsum(weight[todo] * depth[todo])
        part = todo[: max(1, int(np.searchsorted(load, 400_000, "right")))]
        n = weight[part] * depth[part]
        row = np.repeat(part, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which, level = np.divmod(inside, np.repeat(depth[part], n))
        level += first[row]
        seed = cell[at[:-1][row] + which] + level.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        darts = np.searchsorted(_POISSON, blocks.mix(seed), "right")
        has = darts > 0
        row, level, seed, darts = row[has], level[has], seed[has], darts[has]
        owner = np.repeat(np.arange(len(row)), darts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = blocks.mix(seed[owner] ^ (nth + 1).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
        coordinate = (dart & np.uint64(0xFFFF)) * np.uint64(k) >> np.uint64(16)
        rank = level[owner].astype(np.uint64) << np.uint64(40) | dart >> np.uint64(24)
        np.minimum.at(flat, row[owner] * k + coordinate.astype(np.int64), rank)
        first[part] += depth[part]
        open_ = (sig[part] == np.uint64(2**64 - 1)).any(1)
        todo = np.concatenate((part[open_], todo[len(part) :]))
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    acc = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x589965CC75374CC3) + np.zeros((len(sig), 1), np.uint64)
    for r in range(rows):
        acc = blocks.mix(acc ^ sig[:, r::rows][:, :bands])
    return acc


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks.row_blocks(batches, "text"):
        for k in range(0, block.num_rows, 1 << _ROW_BITS):
            yield block.slice(k, 1 << _ROW_BITS)


def _banded(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _row_blocks(batches):
            cell, at = cells(block.column(1))
            some = np.flatnonzero(np.diff(at) > 0)
            keys = band_keys(signatures(cell, at, bands * rows)[some], bands, rows)
            size = np.zeros(block.num_rows, np.int32)
            size[some] = bands
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), lists, pa.array(np.diff(at).astype(np.int64))], ["doc_id", "key", "bands", "weight"])

    return run


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for block in _row_blocks(batches):
        # Repeated rows come one behind another from the join; one is enough.
        ids = block.column(0).to_numpy()
        new = ids != np.concatenate(([ids[0] + 1 if last is None else last], ids[:-1]))
        last = ids[-1]
        block = block.filter(pa.array(new))
        cell, at = cells(block.column(1))
        packed = [np.sort(cell[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(packed, pa.binary())], ["id", "cells"])


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def _cell_lists(column: pa.Array) -> list[np.ndarray]:
    """The cells of each row, as views of the column's bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [body[a:b].view(np.uint64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _jaccard(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = np.zeros(batch.num_rows)
            for k, (a, b) in enumerate(zip(_cell_lists(batch.column(2)), _cell_lists(batch.column(3)), strict=True)):
                if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                    both = np.concatenate((a, b))
                    both.sort()
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    sims[k] = same / (len(both) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], ["a", "b", "similarity"])

    return run


def packed_cells(texts: DataFrame) -> DataFrame:
    """``id, cells`` of ``texts(id, text)``: the sorted cells of each text."""
    return blocks.cut(texts.mapInArrow(_celled, "id long, cells binary"))


def verify(pairs: DataFrame, celled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity`` of the pairs at or over ``threshold``."""
    right = celled.withColumnsRenamed({"id": "b", "cells": "cells_b"})
    joined = pairs.join(celled.withColumnsRenamed({"id": "a", "cells": "cells_a"}), "a").join(right, "b").select("a", "b", "cells_a", "cells_b")
    return joined.mapInArrow(_jaccard(threshold), "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``id, class`` of every id in ``links(a, b)`` and ``known(id, class)``: least id of its component, by label spreading and jumping.

    ``known`` are components found before, which ``links`` join further: then only classes that a link joins are looked at again.
    Null ends are ignored, repeated links and links of an id with itself make no difference, no links give no rows.
    """
    if known is not None:
        ends = links.select("a", "b")
        for end in ("a", "b"):
            ends = ends.join(known.select(F.col("id").alias(end), F.col("class").alias("class_of")), end, "left").withColumn(end, F.coalesce("class_of", end)).drop("class_of")
        joined = blocks.cut(components(ends).select(F.col("id").alias("class"), F.col("class").alias("joined")))
        old = known.join(joined, "class", "left").select("id", F.coalesce("joined", "class").alias("class"))
        fresh = joined.select(F.col("class").alias("id"), F.col("joined").alias("class")).join(known, "id", "left_anti")
        return blocks.cut(old.unionByName(fresh))
    links = links.where("a is not null and b is not null")
    both = blocks.cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = blocks.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("class").alias("near"))
        spread = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("class").alias("was"), F.least("class", F.coalesce("near", "class")).alias("class"))
        # Jump: an id's class is itself an id with a class.
        jump = spread.select(F.col("id").alias("class"), F.col("class").alias("far"))
        new = blocks.cut(spread.join(jump, "class", "left").select("id", "was", F.least("class", F.coalesce("far", "class")).alias("class")))
        labels = new.select("id", "class")
        if new.where("was <> class").isEmpty():
            return labels


def _compare(rows: list[tuple[int, int, bytes]], threshold: float) -> list[tuple[int, int]]:
    """Links at or over ``threshold`` that join the classes of ``rows`` (id, class, packed cells), no more than needed.

    An exact prefix filter: of n cells in order of rarity here, a partner has one of the first n - ceil(threshold n) + 1.
    """
    ids = np.array([r[0] for r in rows])
    root = np.unique([r[1] for r in rows], return_inverse=True)[1]
    if len(rows) < 2 or not root.any():
        return []
    part = [_unpack(r[2]) for r in rows]
    size = np.array([len(x) for x in part])
    at = np.concatenate(([0], np.cumsum(size)))
    _, cell, often = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
    del part
    owner = np.repeat(np.arange(len(rows)), size)
    rare = np.lexsort((cell, often[cell], owner))
    prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    first = rare[(np.arange(len(cell)) - at[:-1][owner] < prefix[owner]) & (often[cell[rare]] > 1)]
    first = first[np.argsort(cell[first], kind="stable")]
    who = owner[first]
    begin = np.searchsorted(cell[first], np.arange(len(often) + 1))
    mine = first[np.argsort(who, kind="stable")]
    mine_at = np.searchsorted(owner[mine], np.arange(len(rows) + 1))
    mark = np.zeros(len(often), bool)
    out = []
    for y in range(len(rows)):
        lists = [who[begin[c] : begin[c + 1]] for c in cell[mine[mine_at[y] : mine_at[y + 1]]]]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[(near < y) & (root[near] != root[y]) & (np.minimum(size[near], size[y]) >= threshold * np.maximum(size[near], size[y]) - 1e-9)]
        if not len(near):
            continue
        mark[cell[at[y] : at[y + 1]]] = True
        same = np.array([np.count_nonzero(mark[cell[at[x] : at[x + 1]]]) for x in near])
        mark[cell[at[y] : at[y + 1]]] = False
        for x in near[same / (size[near] + size[y] - same) >= threshold]:
            if root[x] != root[y]:
                out.append((int(ids[x]), int(ids[y])))
                root[root == root[x]] = root[y]
    return out


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []
        for batch in batches:
            for g, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if g != group:
                    out += _compare(rows, threshold)
                    group, rows = g, []
                rows.append(tuple(row))
        out += _compare(rows, threshold)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def open_links(open_: DataFrame, celled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b``: links that join the classes of each band's rows in ``open_(band, rep, weight, class)``, so that no link there is missed.

    Bands with the same rows are looked at once.  One of over ``BLOCK`` cells is dealt in blocks, and every two blocks meet.
    """
    sets = open_.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.sum("weight").alias("cells"))
    once = sets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "cells")).alias("s")).select("s.band", F.ceil(F.col("s.cells") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int")
    met = F.expr("transform(sequence(0, blocks - 1), x -> xxhash64(band, least(x, mine), greatest(x, mine)))")
    dealt = open_.join(once, "band").withColumn("mine", mine).select(F.explode(met).alias("group"), "rep", "class")
    whole = dealt.join(celled, dealt["rep"] == celled["id"]).select("group", "rep", "class", "cells")
    return blocks.cut(whole.repartition("group").sortWithinPartitions("group").mapInArrow(_linked(threshold), "a long, b long").distinct())


def _text_key(doc_id: str, text: str):
    """Equal for equal texts; of null texts, for equal ids."""
    return F.coalesce(F.sha2(text, 256), F.concat(F.lit("null:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _members(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """``doc_id, key, class`` of each row of ``docs(doc_id, text)``; ``class`` is a number of the class, the least id where there is one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", _text_key("doc_id", "text"))
    signed = blocks.cut(texts.mapInArrow(_banded(bands, rows), "doc_id long, key string, bands array<long>, weight long"))
    # Equal texts count once, by their least id, or where none has one or another text has it too by a number of their own.
    own = F.xxhash64("key").bitwiseOR(F.lit(-(1 << 63)))
    distinct = blocks.cut(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("weight").alias("weight")))
    again = distinct.where("least is not null").groupBy("least").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("least", "first")
    rep = F.when(F.col("first").isNull() | (F.col("first") == F.col("key")), F.col("least"))
    unique = blocks.cut(distinct.join(again, "least", "left").select("key", F.coalesce(rep, own).alias("rep"), "least", "bands", "weight"))
    # Only one of equal texts is looked up again.
    banded = unique.select("rep", "weight", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = blocks.cut(banded.join(sizes, "band"))
    degree = blocks.cut(shared.groupBy("rep").agg(F.sum("n").alias("degree")))
    ranked = blocks.cut(shared.join(degree, "rep"))
    centre = ranked.groupBy("band").agg(F.max_by("rep", F.struct("degree", F.bitwise_not("rep"))).alias("centre"))
    star = blocks.cut(shared.join(centre, "band").where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct())
    wanted = unique.select("rep", "key", "least").join(degree.select("rep"), "rep", "left_semi")
    # The rows of each wanted text's least id.
    with_id = texts.join(wanted.where("least is not null").select(F.col("least").alias("doc_id"), "key", F.col("rep").alias("id")), ["doc_id", "key"])
    without = texts.where("doc_id is null").drop("doc_id").join(wanted.where("least is null").select("key", F.col("rep").alias("id")), "key")
    celled = packed_cells(with_id.select("id", "text").unionByName(without.select("id", "text")))
    scored = blocks.cut(verify(star, celled, 0.0))
    links = scored.where(F.col("similarity") >= threshold).select("a", "b")
    found = components(links)
    # What a bucket still holds once all of it has met the centre: texts of several classes at like distances from it.
    away = scored.select(F.col("a").alias("rep"), F.col("b").alias("centre"), (1 - F.col("similarity")).alias("d"))
    placed = shared.where("n > 2").join(centre, "band").join(away, ["rep", "centre"])
    placed = placed.join(found, placed["rep"] == found["id"], "left").select("band", "rep", "weight", F.coalesce("class", "rep").alias("class"), F.floor(F.col("d") / ((1 - threshold) * (1 + 1e-6) + 1e-9)).alias("ring"))
    placed = blocks.cut(placed)
    rings = placed.groupBy("band", "ring").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).select("band", F.explode(F.expr("array(ring - 1, ring, ring + 1)")).alias("ring"), "lo", "hi")
    several = rings.groupBy("band", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("band", "ring")
    open_ = blocks.cut(placed.join(several, ["band", "ring"]).select("band", "rep", "weight", "class"))
    found = components(open_links(open_, celled, threshold), found)
    member = signed.select("doc_id", "key").join(unique.select("key", "rep"), "key")
    return blocks.cut(member.join(found, member["rep"] == found["id"], "left").select("doc_id", "key", F.coalesce("class", "rep").alias("class")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, class_id, class_size, is_representative`` of each row of ``docs(doc_id, text)``.

    ``class_id`` is the least ``doc_id`` of the class, null where no row of it has one.
    """
    member = _members(docs, threshold, bands, rows)
    size = member.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min("doc_id").alias("class_id"))
    return member.join(size, "class", "left").select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_representative"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each class, one of least ``doc_id``; same columns.

    Of rows with that id and equal text any one stays; a class without ids keeps one row of one of its texts.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    kept = _members(docs, threshold, bands, rows).groupBy("class").agg(first).select(F.col("f.doc_id").alias("kept_id"), F.col("f.key").alias("kept_key"))
    named = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    at, text = f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"
    keyed = named.withColumn("row_id", F.col(at).cast("long")).withColumn("row_key", _text_key(at, text))
    found = keyed.join(kept, F.col("row_id").eqNullSafe(F.col("kept_id")) & (F.col("row_key") == F.col("kept_key")), "left_semi")
    return found.dropDuplicates(["row_id", "row_key"]).select(*named.columns).toDF(*docs.columns)
