"""Sales-target compliance: daily, by store, by week, month and quarter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtido.functions.exprs import as_double, non_zero, rnd
from surtido.functions.labels import (
    TIER_FEATURES,
    TIERS,
    TREND_DOWN,
    TREND_FLAT,
    TREND_NONE,
    TREND_UP,
)
from surtido.operators.aggregates import daily_by_store
from surtido.operators.clustering import kmeans_labels
from surtido.operators.isolation import flag_outliers
from surtido.operators.ordered import ranked
from surtido.session import materialize


def pct(num, den, digits: int = 2):
    return rnd(as_double(num) / non_zero(den) * 100.0, digits)


def compliance_daily(targets: DataFrame, stores: DataFrame, tx: DataFrame, first: dt.date,
                     last: dt.date) -> DataFrame:
    """Targets of the period with store attributes and that day's sales, zero where none."""
    places = stores.select(F.col("id").alias("tienda_id"), F.col("name").alias("tienda_nombre"),
                           F.col("city").alias("ciudad"), "region",
                           F.col("custom_formato").alias("formato"))
    period = targets.where(F.col("fecha").between(F.lit(first), F.lit(last)))
    df = (period.join(places, "tienda_id")
          .join(daily_by_store(tx, first, last), ["tienda_id", "fecha"], "left")
          .fillna(0.0, subset=["ventas_cop", "ventas_und"]))
    return df.withColumns({"pct_diario_cop": pct("ventas_cop", "meta_diaria_cop"),
                           "pct_diario_und": pct("ventas_und", "meta_diaria_und")})


def first_known(value: str):
    """The earliest non-null value of a group, by date."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col("fecha")))


def _summary_sums() -> list[Column]:
    """Attributes are carried, not grouped by, so a store with a missing attribute stays."""
    return [
        *[F.first(c).alias(c) for c in ("tienda_nombre", "ciudad", "region", "formato")],
        F.count("fecha").alias("dias_totales"),
        F.count_if(F.col("ventas_cop") > 0).alias("dias_con_ventas"),
        F.sum("ventas_cop").alias("ventas_cop_total"),
        F.sum("meta_diaria_cop").cast("double").alias("meta_cop_total"),
        F.sum("ventas_und").alias("ventas_und_total"),
        F.sum("meta_diaria_und").alias("meta_und_total"),
        F.avg("pct_diario_cop").alias("cumplimiento_prom"),
        F.count_if(F.col("pct_diario_cop") >= 100).alias("dias_sobre_meta"),
        F.max("ventas_cop").alias("mejor_dia_cop"),
        first_known("meta_mensual_cop").cast("double").alias("meta_mensual_cop")]


def _summary_rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "pct_cumplimiento_cop": pct("ventas_cop_total", "meta_cop_total"),
        "pct_cumplimiento_und": pct("ventas_und_total", "meta_und_total"),
        "pct_dias_sobre_meta": pct("dias_sobre_meta", "dias_totales", 1),
        "ticket_promedio": rnd(F.col("ventas_cop_total") / non_zero("ventas_und_total")),
    })


def store_summary(daily: DataFrame) -> DataFrame:
    """One row per store: sums over the period and their rates."""
    return _summary_rates(daily.groupBy("tienda_id").agg(*_summary_sums()))


def day_index(daily: DataFrame, key: str = "tienda_id") -> DataFrame:
    """Position 0..n-1 of each day within its store; a store has one row per calendar day."""
    w = Window.partitionBy(key).orderBy("fecha")
    return daily.withColumn("dia", F.row_number().over(w) - 1)


def _trend_sums(y: str) -> list[Column]:
    """Exact sums for a regression of ``y``, a percentage with two decimals, on ``dia``."""
    v = F.coalesce(F.col(y), F.lit(0.0)).cast("decimal(20,2)")
    x = F.col("dia").cast("decimal(10,0)")
    return [F.count("*").cast("decimal(12,0)").alias("_n"), F.sum(x).alias("_sx"), F.sum(v).alias("_sy"),
            F.sum(x * x).alias("_sxx"), F.sum(x * v).alias("_sxy"), F.sum(v * v).alias("_syy")]


def _trend_rates(sums: DataFrame) -> DataFrame:
    """``slope``, ``r2`` and ``tendencia`` in place of the sums."""
    def spread(product: str, a: str, b: str) -> Column:
        return (F.col("_n") * F.col(product) - F.col(a) * F.col(b)).cast("double")

    s = sums.withColumns({"_xy": spread("_sxy", "_sx", "_sy"), "_xx": spread("_sxx", "_sx", "_sx"),
                          "_yy": spread("_syy", "_sy", "_sy")})
    fit = F.when(F.col("_yy") == 0, F.lit(1.0)).otherwise(
        F.col("_xy") * F.col("_xy") / non_zero(F.col("_xx") * F.col("_yy")))
    s = s.withColumns({"_slope": F.when(F.col("_n") >= 3, F.col("_xy") / non_zero("_xx")),
                       "_r2": F.when(F.col("_n") >= 3, fit)})
    slope = F.col("_slope")
    label = (F.when(slope.isNull(), TREND_NONE).when(slope > 0.5, TREND_UP)
             .when(slope > -0.5, TREND_FLAT).otherwise(TREND_DOWN))
    return s.withColumns({"slope": rnd("_slope", 4), "r2": rnd("_r2", 4), "tendencia": label}).drop(
        "_n", "_sx", "_sy", "_sxx", "_sxy", "_syy", "_xy", "_xx", "_yy", "_slope", "_r2")


def trend(daily: DataFrame, key: str = "tienda_id", y: str = "pct_diario_cop") -> DataFrame:
    """Least-squares slope and fit per store; fewer than three days give no trend.

    ``y`` is a percentage with two decimals, so its sums are kept exact, and the
    result does not depend on the order of the rows. A constant series fits fully.
    """
    return _trend_rates(day_index(daily, key).groupBy(key).agg(*_trend_sums(y)))


def projection(summary: DataFrame, as_of: dt.date) -> DataFrame:
    """Month-end revenue at the current pace, against the month's target."""
    d = F.lit(as_of)
    factor = as_double(F.dayofmonth(F.last_day(d))) / F.dayofmonth(d)
    return (summary.withColumn("proyeccion_cop", rnd(F.col("ventas_cop_total") * factor))
            .withColumn("pct_proyeccion", pct("proyeccion_cop", "meta_mensual_cop")))


def _within(same: Column, value: str) -> Column:
    return F.when(same, F.col(value))


def _first_within(same: Column, value: str) -> Column:
    """The earliest known value of the rows in question, by date."""
    return F.min_by(value, F.when(same & F.col(value).isNotNull(), F.col("fecha"))).cast("double")


def _same_week(as_of: dt.date) -> Column:
    d, iso_year = F.lit(as_of), F.lit("YEAROFWEEK")
    return (F.col("semana_iso") == F.weekofyear(d)) & (F.extract(iso_year, F.col("fecha")) == F.extract(iso_year, d))


def _same_month(as_of: dt.date) -> Column:
    return (F.col("mes") == as_of.month) & (F.col("anio") == as_of.year)


def _part_sums(same: Column, part: str, target: str) -> list[Column]:
    return [F.sum(_within(same, "ventas_cop")).alias(f"ventas_{part}"), _first_within(same, target).alias(f"meta_{part}")]


def _part_summary(daily: DataFrame, same: Column, part: str, target: str, rate: str) -> DataFrame:
    sums = daily.where(same).groupBy("tienda_id").agg(*_part_sums(F.lit(True), part, target))
    return sums.withColumn(rate, pct(f"ventas_{part}", f"meta_{part}"))


def week_summary(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """Sales of the ISO week of ``as_of`` against that week's first target."""
    return _part_summary(daily, _same_week(as_of), "semana", "meta_semanal_cop", "pct_semanal")


def month_summary(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """Sales of the month of ``as_of`` against that month's first target."""
    return _part_summary(daily, _same_month(as_of), "mes", "meta_mensual_cop", "pct_mensual")


QUARTERS = ("trim_q1", "trim_q2", "trim_q3", "trim_q4")


def _quarter_rates() -> list[Column]:
    """Compliance of each quarter, as aggregates."""
    out = []
    for q, name in enumerate(QUARTERS, 1):
        here = F.col("trimestre") == q
        out.append(pct(F.sum(_within(here, "ventas_cop")), F.sum(_within(here, "meta_diaria_cop"))).alias(name))
    return out


def quarter_pivot(daily: DataFrame) -> DataFrame:
    """Compliance by store with one column per quarter, in one aggregation."""
    return daily.groupBy("tienda_id").agg(*_quarter_rates())


def store_measures(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """All that the report says of a store but ranking and models, in one pass over its days.

    Days are numbered within their store, and the same partitions then give the sums of the period, the week,
    the month, the quarters and the regression in one aggregate: the days are shuffled once and
    joined with nothing.
    """
    sums = day_index(daily).groupBy("tienda_id").agg(
        *_summary_sums(), *_trend_sums("pct_diario_cop"),
        *_part_sums(_same_week(as_of), "semana", "meta_semanal_cop"),
        *_part_sums(_same_month(as_of), "mes", "meta_mensual_cop"), *_quarter_rates())
    rates = projection(_trend_rates(_summary_rates(sums)), as_of).withColumns({
        "pct_semanal": pct("ventas_semana", "meta_semana"), "pct_mensual": pct("ventas_mes", "meta_mes")})
    return rates.drop("ventas_semana", "meta_semana", "ventas_mes", "meta_mes").fillna(
        0.0, subset=["pct_semanal", "pct_mensual", "ticket_promedio"])


def compliance_stores(targets: DataFrame, stores: DataFrame, tx: DataFrame, first: dt.date,
                      last: dt.date, as_of: dt.date) -> DataFrame:
    """The relational part of the report: one row per store, without ranking, quarters and models."""
    return store_measures(compliance_daily(targets, stores, tx, first, last), as_of).drop(*QUARTERS)


def by_compliance():
    return [F.desc("pct_cumplimiento_cop"), F.asc("tienda_id")]


def compliance_tiers(summary: DataFrame, restarts: int = 10) -> DataFrame:
    """Up to four tiers by k-means, best mean compliance first."""
    return kmeans_labels(summary, TIER_FEATURES, 4, TIERS, "pct_cumplimiento_cop", "tier", restarts)


def anomalous_stores(summary: DataFrame, contamination: float = 0.15) -> DataFrame:
    """Flag stores that behave unlike the others; needs at least five."""
    if summary.count() < 5:
        return summary.withColumn("es_anomalia", F.lit(False)).withColumn(
            "score_anomalia", F.lit(None).cast("double"))
    return flag_outliers(summary, ["tienda_id"], TIER_FEATURES, contamination)


def executive_summary(report: DataFrame, alert_below: float = 80.0) -> DataFrame:
    """One row over all stores; the tier histogram is a map."""
    sold, goal = F.sum("ventas_cop_total"), F.sum("meta_cop_total")
    main = report.agg(
        F.count("*").alias("total_tiendas"),
        rnd(F.avg("pct_cumplimiento_cop"), 2).alias("cumplimiento_global_cop"),
        F.count_if(F.col("pct_cumplimiento_cop") >= 100).alias("tiendas_sobre_meta"),
        F.count_if(F.col("pct_proyeccion") < alert_below).alias("tiendas_en_riesgo"),
        rnd(sold).alias("total_ventas_cop"), rnd(goal).alias("total_meta_cop"),
        pct(sold, goal).alias("pct_ventas_vs_meta"),
        *([F.count_if("es_anomalia").alias("tiendas_anomalas")]
          if "es_anomalia" in report.columns else []))
    if "tier" not in report.columns:
        return main
    tiers = (report.groupBy("tier").agg(F.count("*").alias("n"))
             .agg(F.map_from_entries(F.collect_list(F.struct("tier", "n")))))  # at most four rows
    return main.withColumn("distribucion_tiers", tiers.scalar())


def alerts(report: DataFrame, below: float = 80.0) -> DataFrame:
    return report.where(F.col("pct_proyeccion") < below)


def podium(report: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(first n, last n) of the ranking, both in ranking order."""
    best = report.where(F.col("ranking") <= n)
    last = report.agg(F.max("ranking")).scalar()
    worst = report.where(F.col("ranking") > last - n)
    return best.orderBy("ranking"), worst.orderBy("ranking")


def store_rows(report: DataFrame) -> DataFrame:
    """The per-store records of the report, in whole currency units."""
    return report.select(
        "ranking", "tienda_id", "tienda_nombre", "ciudad", "region", "formato", "tier", "tendencia",
        "slope", "es_anomalia", rnd("ventas_cop_total").alias("ventas_cop"),
        rnd("meta_cop_total").alias("meta_cop"), "pct_cumplimiento_cop", "pct_cumplimiento_und",
        "pct_semanal", "pct_mensual", "proyeccion_cop", "meta_mensual_cop", "pct_proyeccion",
        "ticket_promedio", "dias_sobre_meta", "pct_dias_sobre_meta", "mejor_dia_cop")


@dataclass
class ComplianceReport:
    """The parts of the report, each a DataFrame."""
    tiendas: DataFrame
    resumen_ejecutivo: DataFrame
    top3: DataFrame
    bottom3: DataFrame
    alertas: DataFrame
    trimestres: DataFrame


def compliance(targets: DataFrame, stores: DataFrame, tx: DataFrame, first: dt.date, last: dt.date,
               as_of: dt.date, *, restarts: int = 10) -> ComplianceReport:
    """The full compliance report for a period, as seen on ``as_of``.

    Raises ``ValueError`` when the period has no targets. What is known of each store is written once,
    since many parts read it; the days themselves are read once.
    """
    daily = compliance_daily(targets, stores, tx, first, last)
    measures = materialize(store_measures(daily, as_of), "compliance-stores")
    if measures.isEmpty():
        raise ValueError("Sin metas para el período indicado")
    summary = measures.drop(*QUARTERS)
    with ThreadPool(2) as pool:  # two independent fits on the same table
        fit_tiers = pool.apply_async(compliance_tiers, (summary, restarts))
        fit_flags = pool.apply_async(anomalous_stores, (summary,))
        tiers, flags = fit_tiers.get(), fit_flags.get()
    full = (summary.join(tiers.select("tienda_id", "tier"), "tienda_id")
            .join(flags.select("tienda_id", "es_anomalia"), "tienda_id"))
    report = materialize(ranked(full, by_compliance()), "compliance-report")
    rows = store_rows(report)
    best, worst = podium(rows)
    return ComplianceReport(rows, executive_summary(report), best, worst, alerts(rows),
                            measures.select("tienda_id", *QUARTERS))
