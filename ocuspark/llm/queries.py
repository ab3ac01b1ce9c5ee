"""The queries of the operators in this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_mil, chat, decontaminate, divergence, fill_in_middle, jaccard, license_scan, mixing, quality_rules, secret_scan, sql, substring, suffix_family, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    messages = chat.fold(chat.streamed_events(table.unionByName(extra)))
    return chat.digests(chat.read_back(chat.render(messages)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_rules.fit_forest(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, forest).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "anomaly")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_family.remove_repeats(docs, with_bytes=False)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = attention_mil.fit(docs, _table(spark, sf_dir, "labels"))
    scored = attention_mil.score(docs, model)
    return scored.select("doc_id", attention_mil.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.starting_table(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_quality_rules, op4_suffix_dedup, op5_quality_classifier, op6_secret_scan, op7_mixing, op8_license_scan, op9_substring_dedup, op10_jaccard_join, op11_source_divergence, op12_fill_in_middle, op13_url_filter)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; tests hold the others against brute force."""
    return {"op1_decontamination": sql.OP1, "op2_chat_formatting": sql.OP2, "op9_substring_dedup": sql.OP9, "op10_jaccard_join": sql.OP10, "op11_source_divergence": sql.OP11, "op12_fill_in_middle": sql.OP12}
