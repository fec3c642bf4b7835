"""Language identification of mixed-language text.

Words are runs of letters.  The script of a word (from the code point of its first letter) narrows the
candidate languages to those whose training text uses that script; character trigrams score the word for
each candidate; Viterbi over the words of a text, with a fixed cost per change of language, labels spans.

Null texts and texts without a letter get ``und`` with score 0 and no span.  Rows are never merged, so
repeated rows give repeated results; extra columns of the input are ignored.  An empty training set
labels every text with a letter ``und`` too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

UND = "und"
BUCKETS = 1 << 16
#: Names of scripts, in the order of their codes.
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "southeast_asian", "georgian", "kana", "han", "hangul", "other")


#: First code points of the ranges of scripts, each up to the next one's: fixed values.
RANGES = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "southeast_asian"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1780, "southeast_asian"), (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFEFF, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_FROM = np.array([lo for lo, _ in RANGES])
_CODE = np.array([SCRIPTS.index("other"), *(SCRIPTS.index(name) for _, name in RANGES)], np.int8)


def scripts_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script codes of the characters that begin at ``starts``, by code point."""
    last = max(len(data) - 1, 0)
    b = [data[np.minimum(starts + k, last)].astype(np.int64) for k in range(4)]
    low = [x & 0x3F for x in b]
    point = np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]],
        (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3],
    )
    return _CODE[np.searchsorted(_FROM, point, "right")]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = blocks.text_block(column)
    data = blocks.LOWER[data]
    starts, ends, bounds = blocks.spans(data, offsets, blocks.ALPHA)
    return data, offsets, starts, ends, bounds


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte trigram centred on each byte of the words (a word's edge counts as 0), and the first of each word."""
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    at = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
    here = data[at].astype(np.uint32)
    left, right = np.zeros_like(here), np.zeros_like(here)
    left[1:], right[:-1] = here[:-1], here[1:]
    left[first] = 0
    right[first + sizes - 1] = 0
    h = (left * np.uint32(0x01000193) + here) * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16), first


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities by trigram bucket and language; which languages each script may be."""

    langs: tuple[str, ...]
    grams: np.ndarray
    scripts: np.ndarray


def fit(docs: DataFrame, rows_per_lang: int = 400, seed: int = 17) -> LanguageModel:
    """Learn from labelled rows of ``docs(doc_id, text, lang)``.

    The classifier sees a sample of about ``rows_per_lang`` rows of each language, chosen by a hash of
    ``doc_id``; trigrams are counted on the executors and the counts (buckets x languages) are collected.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = known.groupBy("lang").count().collect()
    langs = tuple(sorted(r["lang"] for r in totals))
    if not langs:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000))
    keep = F.lit(False)
    for r in totals:
        keep = keep | ((F.col("lang") == r["lang"]) & (draw < int(1_000_000 * min(1.0, rows_per_lang / r["count"]))))
    index = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(index), BUCKETS), np.int64)
        scripts = np.zeros((len(index), len(SCRIPTS)), np.int64)
        for block in blocks.row_blocks(batches, "text"):
            lang = np.array([index[x] for x in block.column(1).to_pylist()])
            data, _, starts, ends, bounds = _words(block.column(0))
            if not len(starts):
                continue
            word_lang = np.repeat(lang, np.diff(bounds))
            gram, _ = _grams(data, starts, ends)
            np.add.at(grams, (np.repeat(word_lang, ends - starts), gram), 1)
            np.add.at(scripts, (word_lang, scripts_of(data, starts)), 1)
        for kind, table in ((0, grams), (1, scripts)):
            k, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(table[k, b])], ["kind", "k", "b", "n"])

    counted = known.where(keep).select("text", "lang").mapInArrow(count, "kind int, k int, b int, n long").groupBy("kind", "k", "b").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    for table, kind in ((grams, 0), (scripts, 1)):
        part = counted[counted.kind == kind]
        table[part.b, part.k] = part.n
    logp = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS))
    return LanguageModel(langs, logp.astype(np.float32), scripts >= np.maximum(1, 0.005 * scripts.sum(0)))


def _label(model: LanguageModel, column: pa.Array, penalty: float) -> tuple[list, np.ndarray, pa.Array]:
    data, offsets, starts, ends, bounds = _words(column)
    rows, n_lang = len(offsets) - 1, len(model.langs)
    langs, score = np.full(rows, n_lang), np.zeros(rows)
    names = [*model.langs, UND]
    empty = pa.ListArray.from_arrays(np.zeros(rows + 1, np.int32), pa.array([], SPAN))
    if not len(starts) or not n_lang:
        return [UND] * rows, score, empty
    # A run without ASCII letters may be all punctuation: look at its characters.
    ascii_letters = np.concatenate(([0], np.cumsum((data >= 0x61) & (data <= 0x7A))))
    odd = np.flatnonzero(ascii_letters[ends] == ascii_letters[starts])
    bad = [i for i in odd if not any(c.isalpha() for c in data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))]
    if bad:
        keep = np.ones(len(starts), bool)
        keep[bad] = False
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        bounds, starts, ends = kept_before[bounds], starts[keep], ends[keep]
        if not len(starts):
            return [UND] * rows, score, empty
    gram, first = _grams(data, starts, ends)
    word = np.empty((len(starts), n_lang), np.float32)
    for k in range(n_lang):
        word[:, k] = np.add.reduceat(model.grams[:, k][gram], first)
    may = model.scripts[scripts_of(data, starts)]
    word = np.where(may, word, word.min(1, keepdims=True) - 2 * penalty)
    word[~may.any(1)] = 0
    state = blocks.viterbi(word - word.max(1, keepdims=True), bounds, penalty)
    weight = (ends - starts).astype(float)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    mass = np.zeros((rows, n_lang))
    np.add.at(mass, (row, state), weight)
    total = mass.sum(1)
    some = total > 0
    langs[some] = mass[some].argmax(1)
    score[some] = mass[some].max(1) / total[some]
    new = np.ones(len(state), bool)
    new[1:] = (state[1:] != state[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(state)])) - 1
    chars = blocks.code_points(data)
    base = chars[offsets[:-1]][row[head]]
    items = pa.StructArray.from_arrays(
        [pa.array((chars[starts[head]] - base).astype(np.int32)), pa.array((chars[ends[tail]] - base).astype(np.int32)), pa.array([names[k] for k in state[head]], pa.string())], fields=list(SPAN)
    )
    return [names[k] for k in langs], score, pa.ListArray.from_arrays(np.searchsorted(row[head], np.arange(rows + 1)).astype(np.int32), items)


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 12.0) -> DataFrame:
    """``doc_id, lang_pred, score, lang_spans`` of each row of ``docs(doc_id, text)``.

    ``lang_pred`` is the language of most letters (bytes), ``score`` their share, ``lang_spans`` the spans
    in characters, end exclusive.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.row_blocks(batches, "text"):
            langs, score, found = _label(model, block.column(1), penalty)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(langs, pa.string()), pa.array(score), found], ["doc_id", "lang_pred", "score", "lang_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(label, "doc_id long, lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>")


def keep_known(docs: DataFrame, model: LanguageModel, least_share: float, penalty: float = 12.0) -> DataFrame:
    """The rows of ``docs`` whose likeliest language holds ``least_share`` of the letters; ``lang`` is filled where it is null.

    Rows without letters go.  One map over whole rows: no key, no shuffle; columns of any name pass through.
    """
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.shards(batches, text, blocks.BLOCK_BYTES):
            langs, score, _ = _label(model, block.column(text), penalty)
            known = np.array([x != UND for x in langs], bool) & (score >= least_share)
            filled = pc.coalesce(block.column(lang), pa.array(langs, pa.string()))
            yield pa.RecordBatch.from_arrays([filled if k == lang else c for k, c in enumerate(block.columns)], block.schema.names).filter(pa.array(known))

    return rows.mapInArrow(keep, rows.schema).toDF(*names)
