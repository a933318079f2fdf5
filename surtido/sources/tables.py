"""Scans and lookups over the base tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surtido.functions.exprs import guarded_div, rnd
from surtido.functions.labels import SALE
from surtido.schemas import BASE_TABLES, assert_schema


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A base table stored as Parquet, with its declared schema (no inference job)."""
    return spark.read.schema(BASE_TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, **options: str) -> DataFrame:
    """A base table in a live database, read in ``partitions`` parallel key ranges.

    Filters and column selection are pushed into the database by the connector.
    """
    df = spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                         numPartitions=partitions, properties=options)
    return assert_schema(df, BASE_TABLES[table], table) if table in BASE_TABLES else df


def between_days(ts: Column | str, first: dt.date, last: dt.date) -> Column:
    """Both days included, written on the raw timestamp so that Parquet statistics prune."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    end = last + dt.timedelta(days=1)
    return (ts >= F.lit(first).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def sales(tx: DataFrame) -> DataFrame:
    """Sale rows with the store under its analytic name."""
    return tx.where(F.col("type") == SALE).select(
        "receipt_id", "sku_id", F.col("target_location_id").alias("tienda_id"),
        "quantity", "sale_price", "transaction_date")


def inventory_view(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        F.col("location_id").alias("tienda_id"), "sku_id", "site_qty", "transit_qty",
        "reserved_qty", "min_stock", "max_stock",
        F.col("replenishment_lead_time").alias("lead_time"), "avoid_replenishment")


def catalog_view(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        F.col("id").cast("string").alias("sku_id"), F.col("categories").alias("categoria"),
        F.col("brands").alias("marca"), F.col("seasons").alias("temporada"),
        F.col("size").alias("talla"), F.col("department_name").alias("departamento"),
        F.col("custom_tipolinea").alias("tipo_linea"), "price", "cost")


def store_view(stores: DataFrame) -> DataFrame:
    return stores.select(
        F.col("id").cast("string").alias("tienda_id"), F.col("name").alias("nombre_tienda"),
        F.col("city").alias("ciudad"), "region", F.col("custom_zona").alias("zona"),
        F.col("custom_clima").alias("clima"), F.col("custom_formato").alias("formato"),
        F.col("default_replenishment_lead_time").alias("lead_time"))


def products(catalog: DataFrame, limit: int | None = 200) -> DataFrame:
    """Product records with their margin, in key order; ``limit=None`` gives all."""
    out = catalog.select(
        F.col("id").cast("string").alias("sku_id"),
        F.coalesce("name", F.lit("")).alias("nombre"),
        F.coalesce("categories", F.lit("")).alias("categoria"),
        F.coalesce("brands", F.lit("")).alias("marca"),
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("precio"),
        F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("costo"),
        F.col("department_name").alias("departamento"),
        F.col("custom_tipolinea").alias("tipolinea"), F.col("seasons").alias("season"), "id")
    gain = F.col("precio") - F.col("costo")
    out = out.withColumns({"margen": gain,
                           "margen_porcentual": rnd(guarded_div(gain, "precio") * 100, 2)})
    if limit is not None:
        out = out.orderBy("id").limit(limit)
    return out.drop("id")


def store_records(stores: DataFrame) -> DataFrame:
    return stores.select(
        F.col("id").cast("string").alias("tienda_id"),
        F.coalesce("name", F.lit("")).alias("nombre"),
        F.coalesce("city", F.lit("")).alias("ciudad"),
        F.coalesce("region", F.lit("")).alias("region"),
        F.col("custom_formato").alias("formato"), F.col("custom_clima").alias("clima"),
        F.col("custom_zona").alias("zona"))


def by_key(table: DataFrame, key: str) -> DataFrame:
    """Point lookup on ``id``; text that is no integer finds nothing."""
    return table.where(F.col("id") == F.lit(key).try_cast("bigint"))


def numeric_store(tx: DataFrame) -> DataFrame:
    """Rows whose store key is all digits, with ``tienda_id`` as a 64-bit integer.

    A number too large for that is an error, never a NULL key that would merge stores.
    The cast stands behind its own guard, because an ANSI cast may be evaluated before
    the filter.
    """
    store = F.col("target_location_id")
    digits = store.rlike("^[0-9]+$")
    return tx.where(digits).withColumn("tienda_id", F.when(digits, store.cast("bigint")))


def where_equal(df: DataFrame, **filters) -> DataFrame:
    """Optional equality filters: a ``None`` value means no filter on that column."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def search_stores(report: DataFrame, text: str = "", tier: str | None = None,
                  name: str = "tienda_nombre", city: str = "ciudad") -> DataFrame:
    """Case-insensitive text search on name or city, and an optional tier."""
    if text:
        needle = F.lower(F.lit(text))
        report = report.where(F.lower(name).contains(needle) | F.lower(city).contains(needle))
    return where_equal(report, tier=tier)
