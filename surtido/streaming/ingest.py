"""Incremental ingest and running daily sales as Structured Streaming queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from surtido.functions.labels import SALE
from surtido.schemas import TRANSACCIONES
from surtido.sources.sinks import audit_row
from surtido.sources.tables import numeric_store
from surtido.sources.versioned import VersionedTable


def transaction_stream(spark: SparkSession, folder: str, schema: StructType = TRANSACCIONES,
                       pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def ingest(stream: DataFrame, target: str, audit: str, checkpoint: str,
           clock: Callable[[], dt.datetime] = dt.datetime.now) -> StreamingQuery:
    """Append everything new to ``target`` and log each batch; ends when caught up.

    The stream's checkpoint takes the place of a high-water mark. A batch owns
    one folder per table and overwrites it, so a batch that is repeated after a
    failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        (batch.observe(seen, F.min("transaction_date").alias("first"),
                       F.max("transaction_date").alias("last"), F.count(F.lit(1)).alias("rows"))
         .write.mode("overwrite").parquet(f"{target}/batch={batch_id}"))
        got = seen.get
        audit_row(spark, clock(), got["first"], got["last"], got["rows"]).write.mode(
            "overwrite").parquet(f"{audit}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_sales(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Revenue and units per store and day. In append mode a day is final, and comes out,
    once the watermark has passed its end; sales later than that are dropped."""
    rows = numeric_store(stream.where(F.col("type") == SALE))
    return (rows.withWatermark("transaction_date", late)
            .groupBy(F.window("transaction_date", "1 day").alias("w"), "tienda_id")
            .agg(F.sum(F.col("quantity") * F.col("sale_price")).cast("double").alias("ventas_cop"),
                 F.sum("quantity").cast("double").alias("ventas_und"))
            .select("tienda_id", F.to_date("w.start").alias("fecha"), "ventas_cop", "ventas_und"))


def write_daily_sales(stream: DataFrame, target: str, checkpoint: str,
                      late: str = "2 days") -> StreamingQuery:
    return (daily_sales(stream, late).writeStream.outputMode("append").format("parquet")
            .option("path", target).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --- days that late sales correct -------------------------------------------------------

DAY_SUMS = "tienda_id long, fecha date, ventas_cop decimal(38,4), ventas_und decimal(38,2)"


def daily_table(spark: SparkSession, root: str) -> VersionedTable:
    """Daily sums by batch, which add up to a day's sales."""
    return VersionedTable(spark, root, spark.createDataFrame([], DAY_SUMS).schema)


def day_sums(rows: DataFrame) -> DataFrame:
    """Exact sums of revenue and units per store and day; sums of such sums are the same."""
    sold = numeric_store(rows.where(F.col("type") == SALE))
    return _sum_days(sold.select(
        F.col("tienda_id").cast("long").alias("tienda_id"), F.to_date("transaction_date").alias("fecha"),
        (F.col("quantity") * F.col("sale_price")).alias("ventas_cop"), F.col("quantity").alias("ventas_und")))


def merge_days(sums: DataFrame) -> DataFrame:
    """One row a store and day from those of several batches."""
    return _sum_days(sums)


def _sum_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tienda_id", "fecha").agg(
        F.sum("ventas_cop").cast("decimal(38,4)").alias("ventas_cop"),
        F.sum("ventas_und").cast("decimal(38,2)").alias("ventas_und"))


def add_daily_sales(stream: DataFrame, days: VersionedTable, checkpoint: str,
                    clock: Callable[[], dt.datetime] = dt.datetime.now) -> StreamingQuery:
    """Add each batch's daily sums to ``days``; ends when caught up.

    No state is kept and nothing is too late: a sale corrects its day whenever it comes, and the last
    days are there as far as they are known. A batch is one commit, so one that is repeated after
    a failure counts once. ``daily_totals`` reads the days; ``days.compact(..., merge_days)`` gathers them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        days.append(day_sums(batch), clock(), batch=batch_id)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_totals(sums: DataFrame) -> DataFrame:
    """Revenue and units per store and day over all batches."""
    return merge_days(sums).select("tienda_id", "fecha", F.col("ventas_cop").cast("double").alias("ventas_cop"),
                                   F.col("ventas_und").cast("double").alias("ventas_und"))
