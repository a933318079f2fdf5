"""ABC classes of SKUs and clusters of stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.functions.exprs import as_double
from surtido.functions.labels import (
    ABC_LONG,
    ABC_SHORT,
    STORE_FEATURES,
    STORE_LEVELS,
    STORE_UNCLASSIFIED,
)
from surtido.operators.aggregates import inventory_by_store, sku_rollup, store_rollup
from surtido.operators.clustering import kmeans_labels
from surtido.operators.ordered import running_totals
from surtido.session import materialize
from surtido.sources.tables import sales, store_view


def abc_segmentation(tx: DataFrame, *, scale: float = 100.0, cuts: tuple[float, float] = (0.70, 0.90),
                     labels: Sequence[str] = ABC_SHORT, detail: bool = False) -> DataFrame:
    """ABC classes by running share of units, largest SKU first, ties by key.

    The running share includes the row itself. Sums stay decimal, so a share on
    a cut falls on the same side whatever the partitioning.
    """
    if detail:
        skus = sku_rollup(tx)
    else:
        skus = sales(tx).groupBy("sku_id").agg(F.sum("quantity").cast("double").alias("cantidad_total"))
    units = F.col("cantidad_total").cast("decimal(28,2)")
    df = running_totals(skus, [F.desc("cantidad_total"), F.asc("sku_id")], {"_cum": units})
    total = as_double("_cum_total")
    df = df.withColumns({
        "participacion": F.col("cantidad_total") / total * scale,
        "acumulado": as_double("_cum") / total * scale,
    })
    a, b = (F.lit(c * scale) for c in cuts)
    label = (F.when(F.col("acumulado") <= a, labels[0])
             .when(F.col("acumulado") <= b, labels[1]).otherwise(labels[2]))
    return df.withColumn("segmento_abc", label).drop("_cum", "_cum_total")


def abc_detail(tx: DataFrame) -> DataFrame:
    return abc_segmentation(tx, scale=1.0, labels=ABC_LONG, detail=True)


def abc_summary(abc: DataFrame) -> DataFrame:
    return abc.groupBy("segmento_abc").agg(
        F.count("sku_id").alias("num_skus"), F.sum("cantidad_total").alias("ventas_totales"))


def store_metrics(tx: DataFrame, inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """Sales, stock and attributes per store with sales."""
    stock = inventory_by_store(inventory).select(
        "tienda_id", "stock_total", "stock_prom", F.col("lead_time_prom").alias("lead_time"))
    places = store_view(stores).select("tienda_id", "ciudad", "clima", "zona", "formato")
    return store_rollup(tx).join(stock, "tienda_id", "left").join(places, "tienda_id", "left")


def store_segmentation(tx: DataFrame, inventory: DataFrame, stores: DataFrame, *,
                       k: int | None = None, restarts: int = 10) -> DataFrame:
    """Store clusters on seven features, k chosen by silhouette unless given."""
    metrics = materialize(store_metrics(tx, inventory, stores), "stores")
    labels = [f"Tienda Tipo {{i}} - {level} demanda" for level in STORE_LEVELS]
    return kmeans_labels(metrics, STORE_FEATURES, k, labels, "ventas_totales", "segmento_tienda",
                         restarts)


def store_segmentation_simple(tx: DataFrame, *, k: int = 3, restarts: int = 10) -> DataFrame:
    """Store clusters on three features with a fixed k; the mean sale is that of the pair totals."""
    metrics = materialize(store_rollup(tx).select(
        "tienda_id", "ventas_totales", F.col("venta_promedio_par").alias("venta_promedio"),
        "num_skus"), "stores")
    if metrics.count() < k:
        return metrics.withColumn("segmento_tienda", F.lit(STORE_UNCLASSIFIED))
    return kmeans_labels(metrics, ("ventas_totales", "venta_promedio", "num_skus"), k,
                         ["Tienda Tipo {i}"], "ventas_totales", "segmento_tienda",
                         restarts).drop("cluster")


def segment_summary(segments: DataFrame) -> DataFrame:
    means = {"ventas_totales": "ventas_prom", "num_skus": "skus_prom", "stock_total": "stock_prom"}
    return segments.groupBy("segmento_tienda").agg(
        F.count("tienda_id").alias("num_tiendas"),
        *[F.avg(c).alias(name) for c, name in means.items() if c in segments.columns])
