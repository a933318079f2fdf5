"""Shared aggregations. Every one combines on the map side, so a hot key reaches the
shuffle as one row per task. All but ``first_inventory``, whose minimum over a struct
sorts, are hash aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtido.functions.labels import REPLENISHMENT, RETURN, SALE, TRANSFER
from surtido.sources.tables import between_days, inventory_view, numeric_store, sales

PAIR = ("sku_id", "tienda_id")


def mean_of(c: str) -> Column:
    """Average of an exact decimal sum, as a double."""
    return F.sum(c).cast("double") / F.count(c)


def pair_sales(tx: DataFrame, *, priced_only: bool = False, window_days: int | None = None,
               as_of: dt.date | None = None) -> DataFrame:
    """All per-pair sale aggregates in one declaration.

    Column pruning drops the aggregates an operator does not select, including
    the distinct-day count and its second exchange.
    """
    rows = sales(tx)
    if priced_only:
        rows = rows.where(F.col("sale_price") > 0)
    if window_days is not None:
        if as_of is None:
            raise ValueError("window_days needs as_of")
        rows = rows.where(between_days("transaction_date",
                                       as_of - dt.timedelta(days=window_days - 1), as_of))
    return rows.groupBy(*PAIR).agg(
        F.sum("quantity").cast("double").alias("unidades"),
        mean_of("quantity").alias("venta_media"),
        F.stddev_samp("quantity").alias("desviacion"),
        F.count_distinct(F.to_date("transaction_date")).alias("dias_con_venta"),
        F.min("transaction_date").alias("primera_venta"),
        F.max("transaction_date").alias("ultima_venta"),
        F.count("*").alias("num_transacciones"),
        mean_of("sale_price").alias("precio_medio"),
        F.sum(F.col("quantity") * F.col("sale_price")).cast("double").alias("ingreso"))


def pair_demand(tx: DataFrame, *, per_day: bool = False, window_days: int | None = None,
                as_of: dt.date | None = None) -> DataFrame:
    """Demand per pair. The mean is per transaction by default, per selling day with ``per_day``."""
    d = pair_sales(tx, window_days=window_days, as_of=as_of)
    mean = F.col("unidades") / F.col("dias_con_venta") if per_day else F.col("venta_media")
    return d.select(*PAIR, F.col("unidades").alias("demanda_anual"),
                    mean.alias("demanda_diaria_prom"),
                    F.col("desviacion").alias("desviacion_demanda"), "dias_con_venta")


def daily_series(tx: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Units, mean price and revenue per key and selling day; days without sales have no row."""
    return (sales(tx)
            .groupBy(*keys, F.to_date("transaction_date").alias("fecha"))
            .agg(F.sum("quantity").cast("double").alias("cantidad"),
                 mean_of("sale_price").alias("precio_promedio")))


def daily_by_store(tx: DataFrame, first: dt.date | None = None,
                   last: dt.date | None = None) -> DataFrame:
    """Revenue and units per store and day, for stores with a numeric key."""
    rows = numeric_store(tx.where(F.col("type") == SALE))
    if first is not None and last is not None:
        rows = rows.where(between_days("transaction_date", first, last))
    return (rows.groupBy("tienda_id", F.to_date("transaction_date").alias("fecha"))
            .agg(F.sum(F.col("quantity") * F.col("sale_price")).cast("double").alias("ventas_cop"),
                 F.sum("quantity").cast("double").alias("ventas_und")))


def series_stats(daily: DataFrame, min_records: int = 5) -> DataFrame:
    """Mean, deviation and length of each pair's daily series, where it is long enough."""
    return (daily.groupBy(*PAIR)
            .agg(F.avg("cantidad").alias("media"), F.stddev_samp("cantidad").alias("std"),
                 F.count("cantidad").alias("registros"))
            .where(F.col("registros") >= min_records))


def percentiles(daily: DataFrame, shares: dict[str, float], key: str = "sku_id",
                value: str = "cantidad") -> DataFrame:
    """Exact percentiles of a value per key, interpolated; one column per name in ``shares``.

    Values are counted first, so a group holds one entry per distinct value.
    """
    counted = daily.groupBy(key, value).agg(F.count("*").alias("n"))
    found = F.percentile(value, F.array(*[F.lit(x) for x in shares.values()]), F.col("n"))
    return (counted.groupBy(key).agg(found.alias("p"))
            .select(key, *[F.col("p")[i].alias(name) for i, name in enumerate(shares)]))


def sku_rollup(tx: DataFrame) -> DataFrame:
    """Pairs rolled up to SKUs: sums, and means of the pair means."""
    return (pair_sales(tx).groupBy("sku_id")
            .agg(F.sum("unidades").alias("cantidad_total"),
                 F.avg("venta_media").alias("cantidad_promedio"),
                 F.avg("precio_medio").alias("precio_promedio"),
                 F.sum("num_transacciones").alias("num_transacciones"),
                 F.count("tienda_id").alias("num_tiendas")))


def store_rollup(tx: DataFrame) -> DataFrame:
    """Pairs rolled up to stores; both meanings of the mean sale are given."""
    return (pair_sales(tx).groupBy("tienda_id")
            .agg(F.sum("unidades").alias("ventas_totales"),
                 F.avg("venta_media").alias("venta_promedio"),
                 F.avg("unidades").alias("venta_promedio_par"),
                 F.avg("precio_medio").alias("precio_promedio"),
                 F.count("sku_id").alias("num_skus"),
                 F.sum("num_transacciones").alias("transacciones")))


def store_type_summary(tx: DataFrame) -> DataFrame:
    """Per-store totals by transaction type, in one scan.

    By store, SKU and type first: a SKU then counts once per store and type, so
    no distinct aggregate has to expand the raw rows.
    """
    names = {SALE: ("total_ventas", "transac_ventas"),
             REPLENISHMENT: ("total_repuesto", "num_reposiciones"),
             RETURN: ("total_devuelto", "num_devoluciones"),
             TRANSFER: ("total_trasladado", "num_traslados")}
    skus = (tx.groupBy(F.col("target_location_id").alias("tienda_id"), "sku_id", "type")
            .agg(F.sum("quantity").alias("units"), F.count("quantity").alias("rows")))
    aggs = []
    for kind, (total, number) in names.items():
        here = F.col("type") == kind
        aggs += [F.sum(F.when(here, F.col("units"))).cast("double").alias(total),
                 F.coalesce(F.sum(F.when(here, F.col("rows"))), F.lit(0)).alias(number)]
    return skus.groupBy("tienda_id").agg(
        *aggs, F.count_if(F.col("type") == SALE).alias("skus_vendidos"),
        F.count_if(F.col("type") == REPLENISHMENT).alias("skus_repuestos"))


def store_selling_days(tx: DataFrame) -> DataFrame:
    return (sales(tx).groupBy("tienda_id")
            .agg(F.count_distinct(F.to_date("transaction_date")).alias("dias_con_venta")))


def inventory_by_store(inventory: DataFrame) -> DataFrame:
    return (inventory_view(inventory).groupBy("tienda_id")
            .agg(F.sum("site_qty").cast("double").alias("stock_total"),
                 mean_of("site_qty").alias("stock_prom"),
                 F.count("sku_id").alias("skus_activos"),
                 mean_of("lead_time").alias("lead_time_prom"),
                 F.count_if("avoid_replenishment").alias("skus_sin_repos")))


def first_inventory(inventory: DataFrame) -> DataFrame:
    """One inventory row per pair: the lowest by (stock, lead time). A plain
    ``min`` over a struct combines on the map side, which a row number cannot."""
    row = F.struct("site_qty", "lead_time", "min_stock")
    return (inventory_view(inventory).groupBy(*PAIR).agg(F.min(row).alias("r"))
            .select(*PAIR, "r.site_qty", "r.lead_time", "r.min_stock"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("etiqueta")).agg(F.count("*").alias("cantidad"))
