"""Exact duplicates by progressive refinement: length, then a hash of the head, then a hash of the whole text.

Only DataFrame functions are used.  Rows are narrowed step by step:

1. Each row's length in bytes and the hash of its first ``HEAD`` characters are taken in one read and written (two numbers a row).
2. Lengths that occur twice are marked in a bitmap of fixed size; of rows so marked, pairs of length and head hash that occur twice
   are marked in a second one.  A bitmap is joined by broadcast, and has ``BITS / 64`` rows at most whatever the input.  Two keys
   may share a bit: then a row is read in vain, never lost.
3. Only rows marked there have their whole text hashed (SHA-256); equal hashes are a group.

Texts are never shuffled.  Groups are counted with partial aggregates, so a group of a third of all rows is a few rows per
task.  Group facts go back to rows in :func:`attach`: the few groups that hold more than 1 / ``SHARE`` of the rows (``SHARE`` of
them at most) by broadcast, the rest by a shuffle of narrow rows.

Defined results: a null text is an empty one, and empty texts are equal to each other.  The row with the largest id stays, a null
id counting as the smallest; where several rows of a group share that id, exactly one of them stays.  An empty table gives an empty
result.  Extra columns, of any name, play no part.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Characters of a text that the second step looks at.
HEAD = 64
#: Bits of each bitmap: 2^18 rows of a word each at most.
BITS = 1 << 24
#: A group with more than this part of all rows is joined by broadcast.
SHARE = 1 << 16


def folded(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def plain(text: Column) -> Column:
    """``text`` as it is; null is empty."""
    return F.coalesce(text, F.lit(""))


def _word(key: str) -> str:
    return f"shiftright({key} & {BITS - 1}L, 6)"


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    """One row for each 64 bits of the bitmap that has any set."""
    bit = F.expr(f"shiftleft(1L, cast({key} & 63L as int))")
    return keys.groupBy(F.expr(_word(key)).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with a column ``_hit``: false only where ``key`` is not among ``keys``."""
    bitmap = F.broadcast(_bitmap(keys, key).withColumnRenamed("_word", "_at"))
    there = rows.join(bitmap, F.expr(_word(key)) == F.col("_at"), "left")
    return there.withColumn("_hit", F.coalesce(F.expr(f"shiftrightunsigned(_bits, cast({key} & 63L as int)) & 1L = 1L"), F.lit(False))).drop("_at", "_bits")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row a ``key``, of ``size`` rows); null where the key is null or has no group.

    ``rows`` is read three times, so it should be written somewhere.  No task gets a group of more than 1 / ``SHARE`` of the rows.
    """
    least = math.ceil(rows.count() / SHARE) + 1
    facts = [c for c in groups.columns if c != key]
    heavy = F.broadcast(groups.where(F.col(size) >= least).withColumnRenamed(key, "_key"))
    first = rows.join(heavy, F.col(key) == F.col("_key"), "left")
    if least <= 2:  # every group is among the heavy ones
        return first.drop("_key")
    closed = F.col("_key").isNotNull() | F.col(key).isNull()
    light = groups.where(F.col(size) < least)
    rest = first.where(~closed).drop("_key", *facts).join(light, key, "left")
    return first.where(closed).drop("_key").unionByName(rest)


def _refined(docs: DataFrame, normal, text: str, carry: list[Column], digests: bool) -> DataFrame:
    """The steps above: ``_id``, ``_row`` and the carried ``_c0``, ... of each row, with ``_n``, ``_least`` and ``_last`` of its group, null if alone."""
    kept = [f"_c{k}" for k in range(len(carry))]
    body = normal(F.col(text))
    length = F.octet_length(plain(F.col(text))).cast("long")
    source = docs.select(F.col("doc_id").alias("_id"), body.alias("_text"), length.alias("_length"), F.xxhash64(length, normal(F.substring(F.col(text), 1, HEAD))).alias("_head"), *[c.alias(k) for c, k in zip(carry, kept, strict=True)])
    seen = blocks.cut(source.select("_length", "_head"))
    lengths = seen.groupBy("_length").count().where("count > 1")
    heads = _marked(seen, "_length", lengths).where("_hit").groupBy("_head").count().where("count > 1")
    whole = F.sha2(F.col("_text"), 256)
    rows = _marked(source, "_head", heads).select("_id", F.monotonically_increasing_id().alias("_row"), F.when(F.col("_hit"), whole).alias("_whole"), *([whole.alias("_digest")] if digests else []), *kept)
    rows = blocks.cut(rows)
    groups = rows.where("_whole is not null").groupBy("_whole").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_last"), F.min("_id").alias("_least")).where("_n > 1")
    return attach(rows, groups, "_whole", "_n").withColumn("_stays", F.coalesce(F.col("_row") == F.col("_last._row"), F.lit(True)))


def grouped(docs: DataFrame, normal=folded, text: str = "text", carry: dict[str, Column] | None = None, digests: bool = False) -> DataFrame:
    """A row per document: ``doc_id``, ``group_size``, ``least_id``, ``keep_id``, ``kept`` and the columns of ``carry``, taken from the
    document's own row; ``normal`` tells which texts are equal.

    With ``digests`` also ``text_sha256``, the hash of the normalised text: then every text is hashed, as its hash is
    asked for, but only those of marked rows are grouped.
    """
    carry = carry or {}
    rows = _refined(docs, normal, text, list(carry.values()), digests)
    own = lambda of: F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col(of))
    return rows.select(
        F.col("_id").alias("doc_id"), F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"), own("_least").alias("least_id"), own("_last._id").alias("keep_id"),
        F.col("_stays").alias("kept"), *[F.col(f"_c{k}").alias(name) for k, name in enumerate(carry)], *([F.col("_digest").alias("text_sha256")] if digests else []),
    )


def keep_one(docs: DataFrame, normal=folded, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = _refined(docs, normal, text, [F.col(f"`{c}`") for c in docs.columns], False)
    return rows.where("_stays").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(text) as text_sha256
from t window w as (partition by text)
"""
