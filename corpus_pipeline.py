"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes what its predecessor kept, written as Parquet and read again.  Stages but the last return the
columns of ``documents``.  Rows are never told apart by ``doc_id`` alone: the first and the last two stages decide in the row
itself, line dedup by id and text, near-dedup keeps one row of a class; so rows without an id, or sharing one, are
treated like any other.  Null texts have no language and go in the first stage.  Empty tables give empty results; columns of any
name pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import blocks, decontam, langid, line_dedup, mixing, near_dup

#: Rows whose largest language holds less of the letters than this are rejected, as are rows without letters.
LEAST_SHARE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a language; ``lang`` keeps its value where given and is filled from the prediction elsewhere."""
    return langid.keep_known(docs, langid.fit(docs), LEAST_SHARE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned common blocks from later documents; a document left blank goes."""
    blocks_of = next(f"removed{k}" for k in range(len(docs.columns) + 1) if f"removed{k}" not in docs.columns)
    cleaned = line_dedup.remove(docs, column=blocks_of)
    return cleaned.where(F.col(blocks_of).isNull() | F.col("text").rlike(r"\S")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, one of least id."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark spans from texts; a document left without words goes."""
    return decontam.remove(docs, blocks.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's domain and rate; rate 0 documents go, as they are never drawn."""
    return mixing.mix_rows(docs, mixing.domain_labels(docs, blocks.read(spark, sf_dir, "labels"))).where("rate > 0").withColumn("rate", F.round("rate", 6))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Not expressible in SQL: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is written to the shared folder, and goes once the next stage is written."""
    docs = blocks.read(spark, sf_dir, "documents")
    folder = f"{blocks.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STAGES[k - 1][0]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
