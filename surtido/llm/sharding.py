"""Sharding: contiguous shards of near equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtido.operators.ordered import slices_for
from surtido.session import default_parallelism, materialize

SHARDS = 24
ROW_OVERHEAD = 8  # bytes that a row counts beside its text


def row_size(overhead: int = ROW_OVERHEAD) -> Column:
    """UTF-8 bytes of the text (null: none) and the overhead."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long")


def shard_rows(df: DataFrame, shards: int = SHARDS, overhead: int = ROW_OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; law: equal bytes.

    Rows are put in order by ``doc_id`` (nulls first, then by size and checksum). Their
    sizes are summed from the front, and the sum is cut at equal targets: a row belongs
    to the shard in which its middle byte lies. So shards are contiguous in ``doc_id``
    and each is within one row of its target. ``slot`` numbers a shard's rows from 0.

    The prefix sum is global: rows are range partitioned, the partitions' totals (one
    row each) are summed, and each row adds the sum within its own partition. Text is
    read once and never shuffled. Equal ids are spread by a row number, so no id makes a
    large partition.

    Null text: size is the overhead, checksum 0. A row larger than a shard's target
    leaves its neighbours short or empty. Repeated rows are rows of their own. Empty
    table: empty. Extra columns are ignored.

    Runs two jobs when called; what they write is a few bytes a row.
    """
    narrow = materialize(df.select(
        "doc_id", row_size(overhead).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row")), "shard-sizes")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "size", "text_crc32", "row")]
    ranged = materialize(
        narrow.repartitionByRange(slices_for(narrow.count(), default_parallelism(df.sparkSession)), *order)
        .withColumn("part", F.spark_partition_id()), "shard-ranges")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    starts = totals.select(  # one row a partition
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("whole"))

    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rank = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.select("*", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("inner"),
                      F.row_number().over(rank).alias("nth"))
        .join(F.broadcast(starts), "part")
        .select("doc_id", "size", "text_crc32",
                (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
                F.least(F.lit(shards - 1), F.floor(
                    (2 * (F.col("bytes_before") + F.col("inner")) + F.col("size"))
                    * shards / (2 * F.col("whole")).cast("decimal(20,0)")).cast("int")).alias("shard")))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"))
