"""The queries of this subpackage: thin uses of its operators on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import decontamination, html_text, katz, language, media, near_dup, packing, phrases, quality, secrets, token_files, vector_dup, whitening
from patchloom.llm.common import shared_dir, table, tokenizer_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).drop("ids")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, path)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"), read_payloads=True)
    feature = F.format_string("png %dx%d depth %d colour %d mean %.4f", "width", "height", "depth", "colour", "mean")
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.duplicate_classes(table(spark, sf_dir, "documents"), shingle_words=2)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_packing, op2_quality, op3_token_files, op4_media, op5_near_duplicates, op6_language, op7_secrets, op8_decontamination, op9_katz, op10_html_text,
        op11_phrases, op12_vector_duplicates, op13_whitening,
    )
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": decontamination.ORACLE_SQL}
