"""The base tables derived from the supplied star-schema Parquet files.

Integer arithmetic on keys only (FIXTURES.md), so that the same values can be
computed in SQL. ``grain="brand"`` uses the part brand as the SKU, which gives
series long enough for the time-series operators.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surtido.functions.exprs import lookup
from surtido.operators.targets import target_calendar

PERIOD = (dt.date(1998, 3, 1), dt.date(1998, 3, 31))
AS_OF = dt.date(1998, 3, 20)

# Daily value target by format, sized to the test data's revenue
TEST_TARGETS = {"GRANDE": 900_000, "MEDIANO": 600_000, "PEQUEÑO": 400_000, "EXPRESS": 300_000,
                "DEFAULT": 500_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _qty(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def _unit(p: Column) -> Column:
    return F.lit(200) + (p * 37) % 3301


def lineitem_to_transactions(lines: DataFrame, sku: Column | str = "l_partkey") -> DataFrame:
    """Line items as transactions; works on batch and streaming frames alike."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kind = (F.when((flag == "N") | ((flag == "A") & (status == "F")), "venta")
            .when((flag == "A") & (status == "O"), "reposicion")
            .when((flag == "R") & (status == "F"), "devolucion")
            .otherwise("traslado"))
    discount = F.round(F.col("l_discount") * 100).cast("int")
    lines = lines.withColumn("type", kind)
    price = F.when(F.col("type") == "venta", _unit(p) * (F.lit(100) - discount)).otherwise(0)
    sku = F.col(sku) if isinstance(sku, str) else sku
    return lines.select(
        F.col("l_orderkey").cast("string").alias("receipt_id"),
        sku.cast("string").alias("sku_id"),
        F.lit("BODEGA_CENTRAL").alias("source_location_id"),
        s.cast("string").alias("target_location_id"),
        _qty(F.col("l_quantity")).alias("quantity"),
        _qty(price).alias("sale_price"),
        "type",
        F.col("l_shipdate").cast("timestamp").alias("transaction_date"))


def transactions(spark: SparkSession, sf_dir: str, grain: str = "part") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if grain == "part":
        return lineitem_to_transactions(lines)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lineitem_to_transactions(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "p_brand")


def catalog(spark: SparkSession, sf_dir: str, grain: str = "part") -> DataFrame:
    p = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("unit", _unit(p))
    if grain == "brand":
        # One catalog row per brand: first names in order, whole averages of the money columns.
        return part.groupBy(F.col("p_brand").alias("id")).agg(
            F.min("p_name").alias("name"), F.min("p_type").alias("categories"),
            F.min("p_brand").alias("brands"), F.min("p_size").cast("string").alias("size"),
            F.lit("verano").alias("seasons"), F.lit(None).cast("string").alias("department_name"),
            F.lit(None).cast("string").alias("custom_tipolinea"),
            _qty(F.floor(F.avg(F.col("unit") * 100))).alias("price"),
            _qty(F.floor(F.avg(F.col("unit") * (F.lit(40) + p % 26)))).alias("cost"),
            F.lit(False).alias("avoid_replenishment"))
    return part.select(
        p.cast("int").alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("categories"), F.col("p_brand").alias("brands"),
        F.col("p_size").cast("string").alias("size"),
        lookup(p % 4, {0: "verano", 1: "invierno", 2: "primavera"}, None).alias("seasons"),
        F.lit(None).cast("string").alias("department_name"),
        F.lit(None).cast("string").alias("custom_tipolinea"),
        _qty(F.col("unit") * 100).alias("price"),
        _qty(F.col("unit") * (F.lit(40) + p % 26)).alias("cost"),
        (p % 50 == 0).alias("avoid_replenishment"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    joined = (table(spark, sf_dir, "supplier")
              .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return joined.select(
        s.cast("int").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        lookup(s % 5, {0: "grande", 1: "mediano", 2: "pequeño", 3: "express"}, None)
        .alias("custom_formato"),
        lookup(s % 4, {0: "calido", 1: "frio", 2: "templado"}, "humedo").alias("custom_clima"),
        lookup(s % 3, {0: "norte", 1: "centro"}, "sur").alias("custom_zona"),
        (F.lit(1) + s % 7).cast("int").alias("default_replenishment_lead_time"))


def inventory(spark: SparkSession, sf_dir: str, grain: str = "part") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    p, s = F.col("p"), F.col("s")
    pairs = (lines.select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
             .where((p * 7 + s * 13) % 3 < 2).distinct())
    low = F.lit(2) + (p + s) % 9
    high = low * (F.lit(3) + p % 6)
    site = (p * 31 + s * 17) % (high * 2)
    quantities = {"site_qty": site, "transit_qty": (p + s * 2) % 6, "reserved_qty": (p * s) % 3,
                  "min_stock": low, "max_stock": high}
    lead = (F.lit(1) + (p + s) % 7).cast("int")
    if grain == "part":
        return pairs.select(
            s.cast("string").alias("location_id"), p.cast("string").alias("sku_id"),
            *[_qty(c).alias(n) for n, c in quantities.items()],
            lead.alias("replenishment_lead_time"), (p % 50 == 0).alias("avoid_replenishment"),
            F.lit(dt.date(2001, 11, 4)).alias("status_date"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (pairs.join(part, p == F.col("p_partkey"))
            .groupBy(s.cast("string").alias("location_id"), F.col("p_brand").alias("sku_id"))
            .agg(*[_qty(F.sum(c)).alias(n) for n, c in quantities.items()],
                 F.avg(lead).cast("int").alias("replenishment_lead_time"),
                 F.lit(False).alias("avoid_replenishment"),
                 F.lit(dt.date(2001, 11, 4)).alias("status_date")))


def targets(spark: SparkSession, sf_dir: str, first: dt.date = PERIOD[0],
            last: dt.date = PERIOD[1]) -> DataFrame:
    bases = {name: (cop, 1) for name, cop in TEST_TARGETS.items()}
    calendar = target_calendar(stores(spark, sf_dir), first, last, bases=bases)
    units = {f"meta_{p}_und": F.greatest(
        F.floor(F.col(f"meta_{p}_cop").cast("double") / 150000), F.lit(1)).cast("int")
        for p in ("diaria", "semanal", "mensual")}
    return calendar.withColumns(units)
