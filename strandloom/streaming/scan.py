"""Rules over streams of constructs.  Scans are stateless per construct, so a stream needs neither watermark nor state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import dims
from ..functions import dna
from ..operators import scan


def constructs_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    docs = spark.readStream.schema(schema).parquet(path)
    made = docs.select(F.col("doc_id").alias("construct_id"), dna.derive_sequence(F.col("text")).alias("seq"), (F.col("doc_id") % 2 == 0).alias("circular"))
    return made.select("construct_id", "seq", F.length("seq").alias("length"), "circular")


def site_stream(spark: SparkSession, path: str, out: str, checkpoint: str, motifs: dict[str, str] | None = None) -> StreamingQuery:
    """Motif hits of every construct that arrives, appended to Parquet exactly once."""
    hits = scan.motifs(constructs_stream(spark, path), motifs or dims.SIX_CUTTERS)
    return hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums per tumbling window and type with a watermark; works on batches and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
