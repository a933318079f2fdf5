"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage gets the documents that the one before has kept, applies one operator with its
production parameters and returns the documents that stay, with the columns of
``documents``; packing, the last, returns the pieces of its sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtido.llm.decontamination import leaks_by_document
from surtido.llm.line_dedup import dedup_lines
from surtido.llm.packing import pack
from surtido.llm.quality_rules import judge
from surtido.llm.queries import TOKENIZER
from surtido.llm.simhash import near_duplicates
from surtido.session import materialize

MEMO_WORDS = 100_000  # the workers serve other stages too, and keep what they remember

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the log-likelihood ratio keep.

    Null and empty texts go; rows that repeat, or share an id, are judged each by its own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that many share; ``n_chars`` is counted anew.

    Every row stays, if only with an empty text; a null text becomes empty.
    """
    return (dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
            .select(*docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, ties to the smallest hash of the text.

    Groups are told apart by their fingerprints, so rows with one id and unrelated texts stay, each for
    its own group. Rows equal in id and text are one. A null id comes last. Texts without a word are one group.
    """
    one = F.min(F.struct(F.isnull("doc_id").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"),
                         F.col("body").alias("_body")))
    keep = near_duplicates(docs).groupBy("root").agg(one.alias("one")).select("one.*")
    keys = keep.columns  # joined and grouped alike, so texts are shuffled once
    kept = docs.withColumns({
        "_none": F.isnull("doc_id"), "_id": F.coalesce("doc_id", F.lit(0)), "_body": F.xxhash64("text")})
    return kept.join(keep, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them; those without a text stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks_by_document(docs, benchmark).filter("NOT contaminated").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences; an empty document is its end mark."""
    return pack(docs, public_tokenizers.path(TOKENIZER), memo_words=MEMO_WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # two models and a tokenizer, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
