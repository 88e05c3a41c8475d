"""The registered queries of this subpackage, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (
    binary_packing, hosts, html_text, infill, language, licenses, mixing, near_dedup, oracle_sql, packing, quality, reverse_search, substrings, vectors,
)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
    return out.select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`labels` speaks of documents; here a page is bad if the row of `labels` with its number as doc_id is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return hosts.judge_urls(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = binary_packing.pieces(table(spark, sf_dir, "documents"))
    out = binary_packing.bucketed(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(text, 256).alias(name) for text, name in ((F.col("output"), "output_sha256"), (infill.restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_reverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_html_text, op2_near_dedup, op3_language, op4_mixing, op5_substring_dedup, op6_license_scan, op7_packing, op8_quality, op9_url_filter, op10_vector_dedup,
        op11_binary_packing, op12_infill, op13_reverse_search, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {"op6_license_scan": oracle_sql.license_sql(), "op9_url_filter": oracle_sql.url_sql(), "op12_infill": oracle_sql.infill_sql(), "op13_reverse_search": oracle_sql.search_sql()}
