"""Constructs derived from the ``documents`` table, in Spark and as the same DuckDB text.

A document's ACGT letters are its sequence; even ids are circular.  Nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

SQL = """constructs AS (
  SELECT construct_id, seq, CAST(length(seq) AS INT) AS length, circular FROM (
    SELECT doc_id AS construct_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq, doc_id % 2 = 0 AS circular FROM documents WHERE text IS NOT NULL) t)"""

#: Three intervals per construct of 300 bases or more, which may wrap on a circle.
FEATURES_SQL = """features AS (
  SELECT construct_id, length, circular, CAST(j AS INT) AS j, CAST((construct_id * 37 + j * 101) % length AS INT) AS start,
         CAST(CASE WHEN circular THEN (construct_id * 37 + j * 101) % length + 20 + (construct_id * 7 + j * 13) % 150
              ELSE least((construct_id * 37 + j * 101) % length + 20 + (construct_id * 7 + j * 13) % 150, length) END AS INT) AS "end",
         CASE WHEN (construct_id + j) % 2 = 0 THEN 1 ELSE -1 END AS strand
  FROM constructs, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS j) js WHERE length >= 300)"""


def once(value: Column) -> Column:
    """A column that is worked out once a row: filters on it, and on what is drawn from it, are not pushed below its making."""
    return F.explode(F.array(value))


def constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``construct_id, seq, length, circular``; only two columns of the table are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    made = docs.select(F.col("doc_id").alias("construct_id"), once(dna.derive_sequence(F.col("text"))).alias("seq"), (F.col("doc_id") % 2 == 0).alias("circular"))
    return made.select("construct_id", "seq", F.length("seq").alias("length"), "circular")


def coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``construct_id, cds``: the whole codons of each sequence that has any."""
    made = constructs(spark, sf_dir).where("length >= 3")
    return made.select("construct_id", F.expr("substring(seq, 1, 3 * div(length, 3))").alias("cds"))


CODING_SQL = """coding AS (SELECT construct_id, substring(seq, 1, 3 * (length // 3)) AS cds FROM constructs WHERE length >= 3)"""
CODONS_SQL = """codons AS (SELECT construct_id, i, substring(cds, 3 * i + 1, 3) AS codon FROM (SELECT construct_id, cds, unnest(range(0, length(cds) // 3)) AS i FROM coding))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``construct_id, length, circular, j, start, end, strand``."""
    base = constructs(spark, sf_dir).where("length >= 300").select("construct_id", "length", "circular", F.explode(F.array(*map(F.lit, range(6)))).alias("j"))
    start = F.expr("cast((construct_id * 37 + j * 101) % length as int)")
    size = F.expr("cast(20 + (construct_id * 7 + j * 13) % 150 as int)")
    made = base.withColumn("start", start).withColumn("end", F.when(F.col("circular"), start + size).otherwise(F.least(start + size, F.col("length"))))
    return made.withColumn("strand", F.expr("case when (construct_id + j) % 2 = 0 then 1 else -1 end"))
