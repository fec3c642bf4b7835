"""The registered query of each operator: production parameters, whole tables, contract columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, decontam, exact_dedup, filter_audit, html_extract, langid, line_dedup, lm_score, media, mixing, near_dup, pii, ranked_search, toxicity


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = blocks.read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.domain_labels(docs, blocks.read(spark, sf_dir, "labels")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = blocks.read(spark, sf_dir, "documents"), blocks.read(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(_remainder(5) != 0), labels.where(_remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted", "toxic_spans")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(blocks.read(spark, sf_dir, "documents"), blocks.read(spark, sf_dir, "benchmark"))
    return decontam.report(found)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(blocks.read(spark, sf_dir, "pages"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(blocks.read(spark, sf_dir, "documents"), _remainder(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{blocks.shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    made = media.media_columns(spark, blocks.read(spark, sf_dir, "documents"), folder)
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bit_depth", F.lit(folder).alias("folder"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.remove(blocks.read(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = blocks.read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(3) != 1))
    return langid.identify(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score", "lang_spans")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(blocks.read(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(blocks.read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(blocks.read(spark, sf_dir, "documents"), blocks.read(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.grouped(blocks.read(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(blocks.read(spark, sf_dir, "documents"), blocks.read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_decontaminate, op4_main_text, op5_language_model, op6_media, op7_line_dedup, op8_language, op9_near_duplicates, op10_personal_data, op11_filter_audit, op12_exact_dedup, op13_ranked_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; ``tests/llm`` hold the others against brute force."""
    return {"op11_filter_audit": filter_audit.SQL, "op12_exact_dedup": exact_dedup.SQL, "op13_ranked_search": ranked_search.SQL}
