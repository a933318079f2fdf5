"""The registered queries of the operators: each on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtido.llm.conversation_repair import COUNTS, damage, digests, meet, repair
from surtido.llm.decontamination import leaks_by_document
from surtido.llm.html_extraction import extract
from surtido.llm.line_dedup import dedup_lines
from surtido.llm.one_bit_search import nearest_neighbours
from surtido.llm.packing import pack
from surtido.llm.quality_classifier import classify
from surtido.llm.quality_rules import judge
from surtido.llm.sharding import shard_rows
from surtido.llm.simhash import hex16, near_duplicates
from surtido.llm.substring_dedup import dedup_substrings
from surtido.llm.url_filter import filter_urls
from surtido.llm.whitening import whiten

TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, _table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks_by_document(docs, _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "contaminated", "n_items", F.array_join("item_ids", ",").alias("item_ids"), "best_share")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    repaired = repair(damage(rows))
    told = meet(meet(rows.select("conv_id").distinct(), repaired.reports, "conv_id", how="left"),
                digests(repaired.turns), "conv_id", how="left")
    return told.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(_table(spark, sf_dir, "embeddings"))
    return rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained"))).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col.whitened").alias("whitened"),
        F.col("col.explained").alias("explained"), "identity_error", "deviation_exact")


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_embedding_whitening": op13_embedding_whitening,
}
