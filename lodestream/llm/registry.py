"""The queries of the training-data operators, with their production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import centroid_clusters, decontamination, hard_negatives, html_extract, language_id, license_scan, line_dedup, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup, url_filter
from lodestream.session import load


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identified(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, load(spark, sf_dir, "benchmark"))
    return decontamination.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality_rules.ledger(load(spark, sf_dir, "documents").select("doc_id", "text"))
    table = quality_rules.apply_policy(table, quality_rules.BASE, "base_passed")
    table = quality_rules.apply_policy(table, quality_rules.DEFAULT)
    return table.select("doc_id", *quality_rules.MEASURES, (~F.col("base_passed")).alias("base_failed"), "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", "license", "dice", F.array_join("licenses", ",").alias("licenses"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr(hard_negatives.MOVED).alias("label"))
    return hard_negatives.mine_negatives(rows, "vec_id % 100 = 0")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_passages(load(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_ngram_join, op3_language_id, op4_decontamination, op5_quality_rules, op6_packing, op7_line_dedup, op8_suffix_dedup, op9_html_extraction, op10_license_scan, op11_hard_negatives, op12_centroid_clusters, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(), "op4_decontamination": decontamination.oracle(), "op5_quality_rules": quality_rules.oracle(), "op7_line_dedup": line_dedup.oracle(), "op10_license_scan": license_scan.oracle(), "op11_hard_negatives": hard_negatives.oracle(), "op12_centroid_clusters": centroid_clusters.oracle()}
