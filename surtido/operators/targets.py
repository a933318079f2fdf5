"""Sales-target calendar: one row per store and day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.functions.exprs import high_season, lookup, rnd
from surtido.functions.labels import (
    LONG_MONTH_DAYS,
    LONG_MONTHS,
    SEASON_PERCENT,
    SHORT_MONTH_DAYS,
    SUNDAY_PERCENT,
    TARGET_RANGES,
    WEEK_DAYS,
)
from surtido.session import default_parallelism

# Midpoint of each range: the calendar is a pure function of store and day.
MIDPOINTS = {name: ((lo + hi) // 2, (ulo + uhi) / 2)
             for name, (lo, hi, ulo, uhi) in TARGET_RANGES.items()}


def target_calendar(stores: DataFrame, first: dt.date, last: dt.date,
                    bases: Mapping[str, tuple[float, float]] = MIDPOINTS) -> DataFrame:
    """Targets by format, season and weekday for every store and day in the period.

    ``bases`` maps an upper-case format to (daily value, daily units) and needs a
    ``DEFAULT`` entry. Days come from a generator on each store row, so there is
    no join; stores are spread over the tasks first because each row grows by the
    length of the period.
    """
    n = default_parallelism(stores.sparkSession)
    fmt = F.upper(F.coalesce("custom_formato", F.lit("DEFAULT")))
    spine = (stores.repartition(n, "id")
             .select(F.col("id").alias("tienda_id"), fmt.alias("fmt"),
                     F.explode(F.sequence(F.lit(first), F.lit(last))).alias("fecha")))
    month = F.month("fecha")
    weekday = F.extract(F.lit("DAYOFWEEK_ISO"), F.col("fecha"))
    cop = lookup("fmt", {k: int(v[0]) for k, v in bases.items()}, int(bases["DEFAULT"][0]))
    und = lookup("fmt", {k: float(v[1]) for k, v in bases.items()}, float(bases["DEFAULT"][1]))
    season = lookup(month, SEASON_PERCENT, 100)
    day_share = F.when(weekday == 7, F.lit(SUNDAY_PERCENT)).otherwise(F.lit(100))
    factor = season * day_share  # in 1/10,000
    days = F.when(month.isin(*LONG_MONTHS), F.lit(LONG_MONTH_DAYS)).otherwise(SHORT_MONTH_DAYS)
    daily = spine.select(
        "tienda_id", "fecha",
        (cop.cast("decimal(15,2)") * factor / 10000).cast("decimal(15,2)")
        .alias("meta_diaria_cop"),
        F.floor(und * factor / 10000).cast("int").alias("meta_diaria_und"),
        days.alias("days"))
    d = F.col("fecha")
    cop_day, und_day = F.col("meta_diaria_cop"), F.col("meta_diaria_und")
    return daily.select(
        "tienda_id", "fecha",
        F.year(d).cast("short").alias("anio"), F.month(d).cast("short").alias("mes"),
        F.weekofyear(d).cast("short").alias("semana_iso"),
        F.extract(F.lit("DAYOFWEEK_ISO"), d).cast("short").alias("dia_semana"),
        F.quarter(d).cast("short").alias("trimestre"),
        high_season(d).alias("es_temporada_alta"),
        "meta_diaria_cop",
        (cop_day * WEEK_DAYS).cast("decimal(15,2)").alias("meta_semanal_cop"),
        (cop_day * F.col("days")).cast("decimal(15,2)").alias("meta_mensual_cop"),
        "meta_diaria_und",
        (und_day * WEEK_DAYS).alias("meta_semanal_und"),
        (und_day * F.col("days")).cast("int").alias("meta_mensual_und"))


def targets_by_year(targets: DataFrame) -> DataFrame:
    """Validation summary of a target table."""
    return targets.groupBy("anio").agg(
        F.count("*").alias("registros"),
        F.count_distinct("tienda_id").alias("tiendas"),
        rnd(F.sum("meta_diaria_cop").cast("double") / F.count("meta_diaria_cop")).alias("meta_dia_prom"),
        rnd(F.sum("meta_mensual_cop").cast("double") / F.count("meta_mensual_cop"))
        .alias("meta_mes_prom"))
