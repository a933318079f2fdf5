"""Readers of stored results: filters, orders, limits and the small aggregates of the views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.functions.exprs import rnd, strip_symbols
from surtido.functions.labels import TIERS
from surtido.operators.aggregates import label_counts
from surtido.operators.ordered import top
from surtido.sources.tables import where_equal

PAGE = 100


def get_anomalies(stored: DataFrame, tipo: str | None = None, limit: int = PAGE) -> DataFrame:
    return top(where_equal(stored, tipo_anomalia=tipo), limit, F.asc("score_anomalia"),
               F.asc("sku_id"), F.asc("tienda_id"))


def get_eoq(stored: DataFrame, sku: str | None = None, store: str | None = None) -> DataFrame:
    return where_equal(stored, sku_id=sku, tienda_id=store)


def get_risk(stored: DataFrame, sku: str | None = None, store: str | None = None) -> DataFrame:
    return where_equal(stored, sku_id=sku, tienda_id=store).orderBy(
        F.desc("prob_quiebre"), "sku_id", "tienda_id")


def get_forecasts(stored: DataFrame, sku: str | None = None, limit: int = PAGE) -> DataFrame:
    return top(where_equal(stored, sku_id=sku), limit, F.asc("sku_id"), F.asc("fecha"))


def get_predictions(stored: DataFrame, sku: str | None = None, store: str | None = None,
                    limit: int = PAGE) -> DataFrame:
    return top(where_equal(stored, sku_id=sku, tienda_id=store), limit, F.asc("sku_id"),
               F.asc("tienda_id"), F.asc("fecha"))


def get_profitability(stored: DataFrame, sku: str | None = None, limit: int = PAGE) -> DataFrame:
    return top(where_equal(stored, sku_id=sku), limit, F.desc("indice_rentabilidad"),
               F.asc("sku_id"), F.asc("tienda_id"))


def get_rotation(stored: DataFrame, sku: str | None = None, limit: int = PAGE) -> DataFrame:
    return top(where_equal(stored, sku_id=sku), limit, F.desc("indice_velocidad"),
               F.asc("sku_id"), F.asc("tienda_id"))


def get_efficiency(stored: DataFrame, store: str | None = None,
                   limit: int | None = None) -> DataFrame:
    rows = where_equal(stored, tienda_id=store).orderBy(F.desc("indice_eficiencia"), "tienda_id")
    return rows if limit is None else rows.limit(limit)


def get_segmentation(stored: DataFrame, segment: str | None = None) -> DataFrame:
    wanted = segment.upper() if segment else None
    return where_equal(stored, segmento_abc=wanted).orderBy("acumulado", "sku_id")


def get_rules(stored: DataFrame, min_lift: float = 1.0, limit: int | None = None) -> DataFrame:
    rows = stored.where(F.col("lift") >= min_lift).orderBy(
        F.desc("lift"), "sku_origen", "sku_destino")
    return rows if limit is None else rows.limit(limit)


def page_mean(page: DataFrame, value: str, out: str) -> DataFrame:
    """Row count and mean of one column over the rows of a page."""
    return page.agg(F.count("*").alias("total"), rnd(F.avg(value), 2).alias(out))


def abc_totals(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count("*").alias("total"), *[
        F.count_if(F.col("segmento_abc") == s).alias(f"segmento_{s.lower()}") for s in "ABC"])


def critical_count(anomalies: DataFrame) -> DataFrame:
    """Rows, and rows whose type names a stock-out."""
    hit = F.lower("tipo_anomalia").contains("quiebre")
    return anomalies.agg(F.count("*").alias("total"), F.count_if(hit).alias("criticas"))


def high_risk_count(risk: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Rows at or above a probability in percent."""
    return risk.agg(F.count("*").alias("total"),
                    F.count_if(F.col("prob_quiebre") >= threshold).alias("alto_riesgo"))


def kpis(catalog: DataFrame, stores: DataFrame, anomalies: DataFrame, risk: DataFrame,
         threshold: float = 40.0) -> DataFrame:
    """The dashboard's four numbers, as scalar subqueries of one row."""
    critical = critical_count(anomalies).select("criticas").scalar()
    high = high_risk_count(risk, threshold).select("alto_riesgo").scalar()
    n_stores = stores.agg(F.count("*")).scalar()
    return catalog.agg(F.count("*").alias("total_skus")).select(
        "total_skus", n_stores.alias("total_tiendas"), critical.alias("criticas"),
        high.alias("alto_riesgo"))


def anomaly_groups(anomalies: DataFrame) -> DataFrame:
    """Flagged rows by type name without pictogram."""
    flagged = anomalies.where("es_anomalia")
    return label_counts(flagged.withColumn("tipo", strip_symbols("tipo_anomalia")), "tipo")


def class_groups(df: DataFrame, label: str, missing: str = "N/A") -> DataFrame:
    """Rows by class name without pictogram; a missing label is counted under ``missing``."""
    name = F.coalesce(strip_symbols(label), F.lit(missing))
    return label_counts(df.withColumn("clase", name), "clase")


def format_groups(stores: DataFrame) -> DataFrame:
    return label_counts(stores.withColumn("f", F.coalesce("custom_formato", F.lit("N/A"))), "f")


def distinct_cities(stores: DataFrame) -> DataFrame:
    return stores.agg(F.count("*").alias("total_tiendas"),
                      F.count_distinct("city").alias("ciudades"))


def forecast_totals(forecast: DataFrame, n: int = 8) -> DataFrame:
    """The SKUs with most forecast demand, in whole units."""
    totals = forecast.groupBy("sku_id").agg(F.round(F.sum("demanda_estimada")).alias("demanda"))
    return top(totals, n, F.desc("demanda"), F.asc("sku_id"))


def forecast_wide(forecast: DataFrame, skus: Sequence[str] | None = None, n_skus: int = 5,
                  n_days: int = 30) -> DataFrame:
    """Dates as rows, one column per SKU. Without ``skus``, the first ``n_skus`` by key."""
    if skus is None:
        rows = forecast.select("sku_id").distinct().orderBy("sku_id").limit(n_skus).collect()
        skus = [r["sku_id"] for r in rows]  # n_skus rows
    wide = (forecast.where(F.col("sku_id").isin(*skus)).groupBy("fecha")
            .pivot("sku_id", list(skus)).agg(F.first("demanda_estimada")))
    return wide.orderBy("fecha").limit(n_days)


def compliance_chart(report: DataFrame, n: int = 15) -> DataFrame:
    """The best stores with a short display name."""
    name = F.coalesce(F.substring("tienda_nombre", 1, 12),
                      F.concat(F.lit("T"), F.col("tienda_id").cast("string")))
    rows = top(report, n, F.desc("pct_cumplimiento_cop"), F.asc("tienda_id"))
    return rows.select(name.alias("name"), "pct_cumplimiento_cop",
                       "ventas_cop", "meta_cop")


def tier_counts(report: DataFrame) -> DataFrame:
    known = report.where(F.col("tier").isin(*TIERS))
    return label_counts(known, "tier")
