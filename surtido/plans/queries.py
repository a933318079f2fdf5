"""The registered queries: every operator on the supplied tables.

Doubles that the operators leave unrounded are cut to six decimals, and dates
are given as text, so that results compare across engines.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surtido.functions.exprs import classify, clip, guarded_div, high_season, rnd
from surtido.functions.labels import ROTATION_DEFAULT, ROTATION_LADDER, TIER_FEATURES, TIERS
from surtido.operators import (
    aggregates as agg,
    anomalies as anm,
    basket as bsk,
    compliance as cmp,
    forecast as fct,
    ordered,
    performance as prf,
    prediction as prd,
    replenishment as rpl,
    reports,
    risk as rsk,
    segmentation as seg,
    targets as tgt,
)
from surtido.plans.run_all import JOBS, Tables, run_all
from surtido.session import materialize, new_path
from surtido.sources import sinks, tables, testdata as td
from surtido.sources.versioned import VersionedTable
from surtido.streaming import ingest as stm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR_1998 = (dt.date(1998, 1, 1), dt.date(1998, 12, 31))
LOAD_CUT = dt.datetime(2000, 1, 1)
RECEIPT_RULES = {"by": "receipt", "supports": (0.002,), "min_conf": 0.05}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return comparable(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return run


def comparable(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            c = rnd(c, 6)
        elif kind == "decimal":
            c = rnd(c.cast("double"), 6)
        elif kind in ("date", "timestamp"):
            c = c.cast("string")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


# --- scans and filters -----------------------------------------------------------------

@query
def scan_catalog(spark, d):
    return tables.products(td.catalog(spark, d), limit=None)


@query
def products_page(spark, d):
    return tables.products(td.catalog(spark, d), limit=200)


@query
def catalog_margin(spark, d):
    return tables.products(td.catalog(spark, d), limit=None).select(
        "sku_id", "precio", "costo", "margen", "margen_porcentual")


@query
def scan_stores(spark, d):
    return tables.store_records(td.stores(spark, d))


@query
def point_lookup(spark, d):
    product = tables.products(tables.by_key(td.catalog(spark, d), "17"))
    nothing = tables.products(tables.by_key(td.catalog(spark, d), "x17"))
    return product.unionByName(nothing)


@query
def date_range(spark, d):
    return agg.daily_by_store(td.transactions(spark, d), *td.PERIOD)


@query
def regex_store_filter(spark, d):
    return (tables.numeric_store(td.transactions(spark, d)).groupBy("tienda_id", "type")
            .agg(F.count("*").alias("filas"), F.sum("quantity").alias("unidades")))


@query
def optional_filters(spark, d):
    return tables.where_equal(tables.store_records(td.stores(spark, d)),
                              formato="grande", region=None, zona="norte")


@query
def text_search(spark, d):
    places = tables.store_records(td.stores(spark, d)).withColumnRenamed("nombre", "tienda_nombre")
    return tables.search_stores(places, "Nation_1")


@query
def in_list(spark, d):
    rows = tables.sales(td.transactions(spark, d)).where(high_season("transaction_date"))
    return rows.groupBy(F.month("transaction_date").alias("mes")).agg(
        F.count("*").alias("filas"), F.sum("quantity").alias("unidades"))


@query
def history_having(spark, d):
    daily = agg.daily_series(td.transactions(spark, d, "brand"))
    return agg.series_stats(daily, 10).select("sku_id", "tienda_id", "registros")


@query
def basket_having(spark, d):
    b = bsk.baskets(td.transactions(spark, d, "brand"))
    return b.select("tienda_id", "anio", "semana", F.array_join("items", ", ").alias("items"))


@query
def basket_calendar_year(spark, d):
    b = bsk.baskets(td.transactions(spark, d, "brand"), calendar_year=True)
    return b.select("tienda_id", "anio", "semana", F.array_join("items", ", ").alias("items"))


@query
def classify_ladder(spark, d):
    pairs = agg.pair_sales(td.transactions(spark, d)).select("sku_id", "tienda_id", "unidades")
    return pairs.withColumn("clase", classify("unidades", ROTATION_LADDER, ROTATION_DEFAULT))


@query
def rule_cascade(spark, d):
    features = anm.anomaly_features(td.inventory(spark, d), td.transactions(spark, d))
    flagged = features.withColumn("es_anomalia", F.col("ratio_stock_max") >= 0.25)
    return anm.anomaly_type(flagged).select("sku_id", "tienda_id", "es_anomalia", "tipo_anomalia")


@query
def guarded_division(spark, d):
    summary = agg.store_type_summary(td.transactions(spark, d))
    return summary.select("tienda_id",
                          guarded_div("total_devuelto", "total_ventas").alias("devuelto_vendido"),
                          guarded_div("num_traslados", "num_reposiciones", 999.0)
                          .alias("traslado_reposicion"))


@query
def clip_nulls(spark, d):
    demand = agg.pair_demand(td.transactions(spark, d)).select("sku_id", "tienda_id")
    stock = rpl.demand_inventory(demand, td.inventory(spark, d))
    return stock.select("sku_id", "tienda_id", clip("site_qty", 5.0, 60.0).alias("stock"))


@query
def stock_needs(spark, d):
    return anm.stock_needs(td.inventory(spark, d))


# --- joins -----------------------------------------------------------------------------

@query
def join_demand_inventory(spark, d):
    demand = agg.pair_demand(td.transactions(spark, d)).drop("desviacion_demanda")
    products = tables.catalog_view(td.catalog(spark, d)).select("sku_id", "categoria", "marca", "cost")
    return rpl.demand_inventory(demand, td.inventory(spark, d)).join(products, "sku_id", "left")


@query
def join_star_store(spark, d):
    tx = td.transactions(spark, d)
    places = tables.store_view(td.stores(spark, d)).select("tienda_id", "nombre_tienda", "ciudad")
    return (places.join(agg.store_type_summary(tx), "tienda_id", "left")
            .join(agg.store_selling_days(tx), "tienda_id", "left")
            .join(agg.inventory_by_store(td.inventory(spark, d)), "tienda_id", "left"))


def _daily(spark, d, first=td.PERIOD[0], last=td.PERIOD[1]):
    return cmp.compliance_daily(td.targets(spark, d, first, last), td.stores(spark, d),
                                td.transactions(spark, d), first, last)


@query
def join_targets_sales(spark, d):
    return _daily(spark, d).select(
        "tienda_id", "fecha", "tienda_nombre", "region", "formato", "meta_diaria_cop",
        "ventas_cop", "ventas_und", "pct_diario_cop", "pct_diario_und")


@query
def semi_top_skus(spark, d):
    tx = td.transactions(spark, d)
    best = F.broadcast(bsk.top_skus(tx, 25).select("sku_id"))
    return (tables.sales(tx).join(best, "sku_id", "left_semi")
            .groupBy("sku_id").agg(F.count("*").alias("filas"), F.sum("quantity").alias("unidades")))


@query
def anti_insert(spark, d):
    stored = td.targets(spark, d, td.PERIOD[0], td.AS_OF)
    new = td.targets(spark, d, dt.date(1998, 3, 15), td.PERIOD[1])
    return sinks.insert_missing(stored, new, ["tienda_id", "fecha"]).select(
        "tienda_id", "fecha", "meta_diaria_cop")


@query
def first_inventory(spark, d):
    return agg.first_inventory(td.inventory(spark, d))


# --- aggregations ----------------------------------------------------------------------

@query
def pair_demand(spark, d):
    return agg.pair_demand(td.transactions(spark, d))


@query
def pair_demand_window(spark, d):
    return agg.pair_demand(td.transactions(spark, d), per_day=True, window_days=365,
                           as_of=dt.date(2000, 12, 31))


@query
def pair_revenue(spark, d):
    return agg.pair_sales(td.transactions(spark, d), priced_only=True).select(
        "sku_id", "tienda_id", "unidades", "precio_medio", "ingreso", "num_transacciones",
        F.to_date("primera_venta").alias("primera_venta"),
        F.to_date("ultima_venta").alias("ultima_venta"))


@query
def daily_series(spark, d):
    return agg.daily_series(td.transactions(spark, d, "brand"))


@query
def daily_by_sku(spark, d):
    return agg.daily_series(td.transactions(spark, d, "brand"), ("sku_id",))


@query
def daily_by_store(spark, d):
    return agg.daily_by_store(td.transactions(spark, d))


@query
def series_stats(spark, d):
    return agg.series_stats(agg.daily_series(td.transactions(spark, d, "brand")))


@query
def sku_rollup(spark, d):
    return agg.sku_rollup(td.transactions(spark, d))


@query
def store_rollup(spark, d):
    return agg.store_rollup(td.transactions(spark, d))


@query
def store_type_summary(spark, d):
    return agg.store_type_summary(td.transactions(spark, d))


@query
def inventory_by_store(spark, d):
    return agg.inventory_by_store(td.inventory(spark, d))


@query
def percentiles(spark, d):
    daily = agg.daily_series(td.transactions(spark, d, "brand"))
    return agg.percentiles(daily, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query
def label_counts(spark, d):
    return agg.label_counts(_eoq(spark, d), "estado_reposicion")


@query
def quarter_pivot(spark, d):
    return cmp.quarter_pivot(_daily(spark, d, *YEAR_1998))


@query
def week_summary(spark, d):
    return cmp.week_summary(_daily(spark, d), td.AS_OF)


@query
def month_summary(spark, d):
    return cmp.month_summary(_daily(spark, d), td.AS_OF)


@query
def targets_by_year(spark, d):
    return tgt.targets_by_year(td.targets(spark, d, dt.date(1997, 1, 1), dt.date(1998, 12, 31)))


@query
def format_groups(spark, d):
    return reports.format_groups(td.stores(spark, d))


@query
def distinct_cities(spark, d):
    return reports.distinct_cities(td.stores(spark, d))


# --- ordered analytics -----------------------------------------------------------------

@query
def share_of_total(spark, d):
    return seg.abc_segmentation(td.transactions(spark, d)).select("sku_id", "participacion")


@query
def running_share(spark, d):
    return seg.abc_segmentation(td.transactions(spark, d)).select("sku_id", "acumulado")


@query
def store_ranking(spark, d):
    summary = cmp.store_summary(_daily(spark, d)).select("tienda_id", "pct_cumplimiento_cop")
    return ordered.ranked(summary, cmp.by_compliance())


@query
def day_index(spark, d):
    return cmp.day_index(_daily(spark, d)).select("tienda_id", "fecha", "dia")


@query
def first_target(spark, d):
    return (td.targets(spark, d, *YEAR_1998).groupBy("tienda_id", "mes")
            .agg(cmp.first_known("meta_mensual_cop").alias("meta_mensual_cop")))


# --- sorts and limits ------------------------------------------------------------------

@query
def top_profit(spark, d):
    return reports.get_profitability(_profitability(spark, d).select(
        "sku_id", "tienda_id", "margen_porcentual", "rentabilidad_total", "indice_rentabilidad",
        "clasificacion"), limit=10)


@query
def top_profit_margin(spark, d):
    page = reports.get_profitability(_profitability(spark, d), limit=100)
    return reports.page_mean(page, "margen_porcentual", "promedio_margen")


@query
def bottom_stock(spark, d):
    features = anm.anomaly_features(td.inventory(spark, d), td.transactions(spark, d))
    typed = anm.anomaly_type(features.withColumn("es_anomalia", F.lit(True)))
    return anm.critical_stockouts(typed).select("sku_id", "tienda_id", "site_qty", "min_stock")


@query
def coverage_risks(spark, d):
    features = anm.anomaly_features(td.inventory(spark, d), td.transactions(spark, d))
    typed = anm.anomaly_type(features.withColumn("es_anomalia", F.lit(True)))
    return anm.coverage_risks(typed).select("sku_id", "tienda_id", "cobertura_dias", "lead_time")


@query
def urgent_orders(spark, d):
    return rpl.urgent_orders(_eoq(spark, d)).select("sku_id", "tienda_id", "demanda_anual", "eoq")


@query
def top3_bottom3(spark, d):
    summary = cmp.store_summary(_daily(spark, d)).select("tienda_id", "pct_cumplimiento_cop")
    best, worst = cmp.podium(ordered.ranked(summary, cmp.by_compliance()))
    return best.unionByName(worst)


@query
def compliance_chart(spark, d):
    summary = cmp.store_summary(_daily(spark, d))
    return reports.compliance_chart(summary.withColumnsRenamed(
        {"ventas_cop_total": "ventas_cop", "meta_cop_total": "meta_cop"}))


@query
def rotation_page(spark, d):
    df = prf.rotation(td.transactions(spark, d), td.inventory(spark, d), td.catalog(spark, d))
    return reports.get_rotation(df, limit=100).select("sku_id", "tienda_id", "indice_velocidad")


@query
def efficiency_ranking(spark, d):
    df = rpl.replenishment_efficiency(td.transactions(spark, d), td.inventory(spark, d),
                                      td.stores(spark, d))
    return reports.get_efficiency(df, limit=10).select(
        "tienda_id", "indice_eficiencia", "cobertura_reposicion")


@query
def segment_a(spark, d):
    return reports.get_segmentation(
        seg.abc_segmentation(td.transactions(spark, d)), "a").drop("cantidad_total")


# --- analytics -------------------------------------------------------------------------

def _eoq(spark, d):
    return rpl.eoq(td.transactions(spark, d), td.inventory(spark, d), td.catalog(spark, d))


def _profitability(spark, d):
    return prf.profitability(td.transactions(spark, d), td.catalog(spark, d))


@query
def eoq(spark, d):
    return _eoq(spark, d)


@query
def profitability(spark, d):
    return _profitability(spark, d).select(
        "sku_id", "tienda_id", "categoria", "marca", "departamento", "talla", "temporada", "unidades_vendidas",
        "precio_venta_prom", "precio_lista", "costo_total", "ingreso_total", "rentabilidad_total",
        "margen_unitario", "margen_porcentual", "descuento_aplicado", "indice_rentabilidad",
        "clasificacion")


@query
def rotation(spark, d):
    return prf.rotation(td.transactions(spark, d), td.inventory(spark, d), td.catalog(spark, d))


@query
def rotation_classes(spark, d):
    df = prf.rotation(td.transactions(spark, d), td.inventory(spark, d), td.catalog(spark, d))
    return reports.class_groups(df, "clasificacion_rotacion")


@query
def efficiency(spark, d):
    return rpl.replenishment_efficiency(td.transactions(spark, d), td.inventory(spark, d),
                                        td.stores(spark, d)).select(
        "tienda_id", "nombre_tienda", "ciudad", "zona", "clima", "formato", "total_ventas",
        "total_repuesto", "total_devuelto", "num_reposiciones", "skus_vendidos", "skus_repuestos",
        "stock_total", "lead_time_prom", "cobertura_reposicion", "tasa_devolucion",
        "repos_por_mes", "eficiencia_skus", "indice_eficiencia", "clasificacion_eficiencia")


@query
def abc_api(spark, d):
    return seg.abc_segmentation(td.transactions(spark, d)).drop("cantidad_total")


@query
def abc_detail(spark, d):
    return seg.abc_detail(td.transactions(spark, d))


@query
def abc_summary(spark, d):
    return seg.abc_summary(seg.abc_detail(td.transactions(spark, d)))


@query
def abc_totals(spark, d):
    return reports.abc_totals(seg.abc_segmentation(td.transactions(spark, d)))


@query
def store_metrics(spark, d):
    return seg.store_metrics(td.transactions(spark, d), td.inventory(spark, d), td.stores(spark, d))


@query
def store_segments(spark, d):
    return seg.store_segmentation(td.transactions(spark, d), td.inventory(spark, d),
                                  td.stores(spark, d)).drop("cluster")


def _settled_clusters(rows, features, label, rank_by, names):
    """What holds for k-means clusters: names in order of their means, every row nearest to its own mean.

    Recomputed with plain aggregates from the rows' features and names alone.
    """
    value = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    z = [(v - F.avg(v).over(Window.partitionBy())) / F.stddev(v).over(Window.partitionBy()) for v in value]
    z = rows.select(label, F.col(rank_by).alias("rank_by"), *[c.alias(f"z{i}") for i, c in enumerate(z)])  # a row a store
    means = z.groupBy(label).agg(F.avg("rank_by").alias("by"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(len(value))])
    found = {r[label]: r for r in means.collect()}  # one row a cluster

    def away(r):
        return sum((F.col(f"z{i}") - F.lit(r[f"m{i}"])) ** 2 for i in range(len(value)))

    own = F.coalesce(*[F.when(F.col(label) == name, away(r)) for name, r in found.items()])
    least = F.least(*[away(r) for r in found.values()], F.lit(float("inf")))
    by_rank = sorted(found, key=lambda name: -found[name]["by"])
    return z.agg(F.count("*").alias("tiendas"), F.lit(len(found)).cast("bigint").alias("grupos"),
                 F.lit(by_rank == [n for n in names if n in found]).alias("en_orden"),
                 F.bool_and(own <= least + 1e-3).alias("cerca_del_suyo"))


@query
def compliance_tiers_check(spark, d):
    return _settled_clusters(cmp.compliance_tiers(_store_summary(spark, d)), TIER_FEATURES, "tier",
                             "pct_cumplimiento_cop", TIERS)


@query
def store_segments_simple_check(spark, d):
    return _settled_clusters(seg.store_segmentation_simple(td.transactions(spark, d)),
                             ("ventas_totales", "venta_promedio", "num_skus"), "segmento_tienda", "ventas_totales",
                             [f"Tienda Tipo {i}" for i in (1, 2, 3)])


@query
def store_segments_simple(spark, d):
    return seg.store_segmentation_simple(td.transactions(spark, d))


@query
def store_segments_check(spark, d):
    """What must hold for any clusters: every store once, names in order of mean sales."""
    found = seg.store_segmentation(td.transactions(spark, d), td.inventory(spark, d), td.stores(spark, d))
    means = found.groupBy("segmento_tienda").agg(
        F.avg("ventas_totales").alias("media"), F.count("*").alias("n"))
    order = Window.orderBy("segmento_tienda")  # as many rows as clusters
    return means.select("n", (F.col("media") <= F.lag("media", 1, float("inf")).over(order)).alias("ok")).agg(
        F.sum("n").alias("tiendas"), (F.count("*") >= 2).alias("varios"), F.bool_and("ok").alias("en_orden"))


@query
def store_segment_summary(spark, d):
    return seg.segment_summary(seg.store_segmentation(
        td.transactions(spark, d), td.inventory(spark, d), td.stores(spark, d)))


@query
def target_calendar(spark, d):
    return tgt.target_calendar(td.stores(spark, d), *YEAR_1998)


# --- compliance ------------------------------------------------------------------------

def _compliance(spark, d):
    return cmp.compliance_stores(td.targets(spark, d), td.stores(spark, d),
                                 td.transactions(spark, d), *td.PERIOD, td.AS_OF)


def _compliance_full(spark, d):
    return cmp.compliance(td.targets(spark, d), td.stores(spark, d), td.transactions(spark, d),
                          *td.PERIOD, td.AS_OF)


@query
def compliance_stores(spark, d):
    return _compliance(spark, d)


@query
def compliance_trend(spark, d):
    return cmp.trend(_daily(spark, d))


@query
def compliance_projection(spark, d):
    summary = cmp.store_summary(_daily(spark, d))
    return cmp.projection(summary, td.AS_OF).select(
        "tienda_id", "ventas_cop_total", "meta_mensual_cop", "proyeccion_cop", "pct_proyeccion")


@query
def compliance_summary(spark, d):
    return cmp.executive_summary(_compliance(spark, d))


@query
def compliance_alerts(spark, d):
    return cmp.alerts(_compliance(spark, d)).select("tienda_id", "tienda_nombre", "pct_proyeccion")


def _store_summary(spark, d):
    return materialize(cmp.store_summary(_daily(spark, d)), "compliance-stores")


@query
def compliance_tiers(spark, d):
    return cmp.compliance_tiers(_store_summary(spark, d)).select(
        "tienda_id", "tier", "pct_cumplimiento_cop", "pct_dias_sobre_meta", "cumplimiento_prom")


@query
def compliance_report(spark, d):
    return _compliance_full(spark, d).tiendas


@query
def compliance_report_check(spark, d):
    """The full report less what the models name: ranking, figures and one tier and flag a store."""
    rows = _compliance_full(spark, d).tiendas
    return rows.select(
        "ranking", "tienda_id", "tienda_nombre", "ciudad", "region", "formato", "tendencia", "slope", "ventas_cop", "meta_cop",
        "pct_cumplimiento_cop", "pct_cumplimiento_und", "pct_semanal", "pct_mensual", "proyeccion_cop",
        "meta_mensual_cop", "pct_proyeccion", "ticket_promedio", "dias_sobre_meta", "pct_dias_sobre_meta",
        "mejor_dia_cop", F.col("tier").isin(list(TIERS)).alias("con_tier"), F.col("es_anomalia").isNotNull().alias("con_marca"))


@query
def compliance_executive(spark, d):
    return _compliance_full(spark, d).resumen_ejecutivo.drop("distribucion_tiers")


@query
def compliance_anomalies(spark, d):
    return cmp.anomalous_stores(_store_summary(spark, d)).select(
        "tienda_id", "es_anomalia", "score_anomalia")


@query
def compliance_anomalies_check(spark, d):
    """What must hold for any forest: a row a store, the share flagged, scores in range."""
    return cmp.anomalous_stores(_store_summary(spark, d)).agg(
        F.count("*").alias("tiendas"), (F.count_if("es_anomalia") <= 0.15 * F.count("*") + 1).alias("hasta_su_parte"),
        F.bool_and(F.col("score_anomalia").between(-1.0, 0.0)).alias("en_rango"))


# --- baskets ---------------------------------------------------------------------------

@query
def basket_pairs(spark, d):
    found, *_ = bsk.frequent_itemsets(
        bsk.baskets(td.transactions(spark, d, "brand"), by="receipt"), (0.002,))
    return bsk.item_pairs(found)


@query
def basket_rules(spark, d):
    return bsk.basket_rules(td.transactions(spark, d, "brand"), **RECEIPT_RULES)


@query
def basket_week_rules(spark, d):
    return bsk.basket_rules(td.transactions(spark, d, "brand"), supports=(0.001,), min_conf=0.05)


@query
def basket_ladder(spark, d):
    """The supports tried from the highest down, on store weeks: the one used, baskets, itemsets by size, and rules."""
    held = bsk.baskets(td.transactions(spark, d, "brand"))
    found, n, used = bsk.frequent_itemsets(held, (0.05, 0.04, 0.03, 0.02), min_itemsets=5)
    return found.groupBy(F.size("items").cast("long").alias("articulos")).agg(
        F.count("*").alias("conjuntos"), F.sum("freq").alias("canastas")).select(
        "*", F.lit(n).cast("long").alias("total"), F.lit(used).alias("soporte"),
        F.lit(bsk.rules_from_itemsets(found, n).count()).cast("long").alias("reglas"))


@query
def basket_low_support(spark, d):
    """Itemsets of every size on store weeks at a support that sets of three and more reach."""
    found, n, _ = bsk.frequent_itemsets(bsk.baskets(td.transactions(spark, d, "brand")), (0.0003,))
    return found.select(F.array_join("items", ", ").alias("articulos"), F.col("freq").alias("canastas"),
                        F.lit(n).cast("long").alias("total"))


@query
def basket_top_rules(spark, d):
    rules = bsk.basket_rules(td.transactions(spark, d, "brand"), **RECEIPT_RULES)
    return reports.get_rules(rules, 1.0)


# --- models ----------------------------------------------------------------------------

@query
def anomaly_features(spark, d):
    return anm.anomaly_features(td.inventory(spark, d), td.transactions(spark, d))


@query
def anomalies(spark, d):
    return anm.inventory_anomalies(td.inventory(spark, d), td.transactions(spark, d)).select(
        "sku_id", "tienda_id", "site_qty", "cobertura_dias", "es_anomalia", "tipo_anomalia",
        "score_anomalia")


@query
def anomalies_check(spark, d):
    """What must hold for any forest: one row a stock row, the share flagged, names of flags."""
    found = anm.inventory_anomalies(td.inventory(spark, d), td.transactions(spark, d))
    return found.agg(
        F.count("*").alias("filas"), F.count_distinct("sku_id", "tienda_id").alias("pares"),
        (F.count_if("es_anomalia") * 10 <= F.count("*") + 10).alias("hasta_un_decimo"),  # and one row
        (F.count_if("es_anomalia") > 0).alias("alguna"),
        F.bool_and(F.col("es_anomalia") == (F.col("tipo_anomalia") != "Normal")).alias("con_nombre"),
        F.bool_and(F.col("score_anomalia").between(-1.0, 0.0)).alias("en_rango"))


@query
def anomaly_types(spark, d):
    return reports.anomaly_groups(
        anm.inventory_anomalies(td.inventory(spark, d), td.transactions(spark, d)))


@query
def anomaly_types_check(spark, d):
    """The flagged rows by type add up to the flagged rows, and no group is of normal ones."""
    found = materialize(anm.inventory_anomalies(td.inventory(spark, d), td.transactions(spark, d)), "anomalies")
    types = reports.anomaly_groups(found)
    flagged = found.agg(F.count_if("es_anomalia")).first()[0]
    return types.agg(
        (F.sum("cantidad") == flagged).alias("suman"), (F.count("*") == F.count_distinct("etiqueta")).alias("distintas"),
        F.bool_and(F.col("etiqueta") != "Normal").alias("sin_normales"))


@query
def risk_stats(spark, d):
    return rsk.risk_stats(td.transactions(spark, d, "brand"), td.inventory(spark, d, "brand"))


@query
def stockout_risk(spark, d):
    return rsk.stockout_risk(td.transactions(spark, d, "brand"), td.inventory(spark, d, "brand"))


@query
def risk_parts(spark, d):
    """Stock-out risk of every part and store with enough days."""
    return rsk.stockout_risk(td.transactions(spark, d), td.inventory(spark, d))


@query
def risk_levels(spark, d):
    found = rsk.stockout_risk(td.transactions(spark, d, "brand"), td.inventory(spark, d, "brand"))
    return reports.class_groups(found, "nivel_riesgo", "Desconocido")


@query
def risk_page(spark, d):
    found = rsk.stockout_risk(td.transactions(spark, d, "brand"), td.inventory(spark, d, "brand"))
    return reports.get_risk(found).limit(50).select("sku_id", "tienda_id", "prob_quiebre")


@query
def forecast(spark, d):
    return fct.forecast_demand(td.transactions(spark, d, "brand"))


@query
def forecast_top10(spark, d):
    return fct.forecast_summary(
        fct.forecast_demand(td.transactions(spark, d, "brand"), top_n=10))


@query
def forecast_totals(spark, d):
    return reports.forecast_totals(fct.forecast_demand(td.transactions(spark, d, "brand")))


@query
def forecast_wide(spark, d):
    tx = td.transactions(spark, d, "brand")
    known = (agg.daily_series(tx, ("sku_id",)).groupBy("sku_id").count().where("count >= 2")
             .orderBy("sku_id").limit(5))
    return reports.forecast_wide(fct.forecast_demand(tx), [r["sku_id"] for r in known.collect()])


@query
def without_forecast(spark, d):
    return fct.without_forecast(td.transactions(spark, d))


@query
def forecast_check(spark, d):
    """What must hold for any forecast: days, order of the bounds, floor."""
    return fct.forecast_demand(td.transactions(spark, d, "brand")).agg(
        F.count("*").alias("filas"), F.count_distinct("sku_id").alias("skus"),
        F.bool_and(F.col("demanda_minima") <= F.col("demanda_estimada")).alias("minima_debajo"),
        F.bool_and(F.col("demanda_estimada") <= F.col("demanda_maxima")).alias("maxima_encima"),
        (F.min("demanda_minima") >= 0).alias("sin_negativos"))


@query
def forecast_parts_check(spark, d):
    """Forecasts of every part: the normal equations hold for each column, and the days follow from the fit.

    Recomputed in columns from each part's daily series and its coefficients alone.
    """
    tx = td.transactions(spark, d)
    fits = materialize(fct.fit_demand(tx), "fits")
    day = F.unix_date("fecha").cast("double")
    span = F.greatest(F.col("fin") - F.col("inicio"), F.lit(1))
    columns = [F.lit(1.0), (day - F.col("inicio")) / span]
    for period, order in ((365.25, 10), (7, 3)):
        for k in range(1, order + 1):
            columns += [F.sin(day * (2 * math.pi * k / period)), F.cos(day * (2 * math.pi * k / period))]
    rows = agg.daily_series(tx, ("sku_id",)).join(fits, "sku_id").select(
        "sku_id", "coeficientes", "cantidad", F.array(*columns).alias("x"))
    dot = F.aggregate(F.zip_with("x", "coeficientes", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("residuo", F.col("cantidad") - dot)
    told = rows.groupBy("sku_id").agg(
        F.count("*").alias("dias"), F.sum("cantidad").alias("unidades"), F.first("coeficientes").alias("b"),
        F.array(*[F.sum(F.get("x", F.lit(i)) * F.col("residuo")) for i in range(len(columns))]).alias("productos"))
    penalty = F.array(*[F.lit(1e-8 if i < 2 else 1.0) for i in range(len(columns))])
    gap = F.array_max(F.transform(F.arrays_zip("productos", "b", penalty.alias("p")), lambda r: F.abs(
        r["productos"] - r["b"] * r["p"])))
    sound = told.agg(
        F.count("*").alias("skus"), F.sum("dias").alias("dias"), F.sum("unidades").alias("unidades"),
        F.bool_and(gap <= 1e-6 * (1 + F.col("unidades"))).alias("ecuaciones"))
    made = fct.forecast_demand(tx).join(fits, "sku_id")
    value = F.greatest(fct.fitted_value(F.unix_date("fecha").cast("double")), F.lit(0.0))
    follows = made.agg(F.count("*").alias("filas"),
                       F.bool_and(F.abs(F.col("demanda_estimada") - value) <= 0.00501).alias("del_ajuste"),
                       F.bool_and(F.unix_date("fecha").between(F.col("fin") + 1, F.col("fin") + 30)).alias("dias_siguientes"))
    return sound.select("*", *[follows.select(c).scalar().alias(c) for c in follows.columns])


@query
def forecast_totals_check(spark, d):
    """Totals by SKU, the ten largest and the wide table hold the forecast's own sums."""
    found = materialize(fct.forecast_demand(td.transactions(spark, d, "brand")), "forecast")
    totals, summary = reports.forecast_totals(found, n=1000), fct.forecast_summary(found)
    skus = [r["sku_id"] for r in found.select("sku_id").distinct().orderBy("sku_id").limit(5).collect()]
    wide = reports.forecast_wide(found, skus, n_days=10_000)
    whole = found.agg(F.sum("demanda_estimada")).first()[0]
    five = found.where(F.col("sku_id").isin(skus)).agg(F.sum("demanda_estimada")).first()[0]
    cells = sum((F.sum(F.coalesce(F.col(f"`{s}`"), F.lit(0.0))) for s in skus), F.lit(0.0))
    near = lambda c, x: F.abs(c - F.lit(x)) <= 0.01 * (1 + abs(x) * 1e-6)
    return totals.agg(F.count("*").alias("skus")).select(
        "skus", summary.agg(F.count("*")).scalar().alias("resumen"),
        summary.agg(F.abs(F.sum("demanda_total") - whole) <= 0.01 * F.count("*") + 0.01).scalar().alias("suman"),
        wide.agg(near(cells, five)).scalar().alias("tabla"))


def _prediction_inputs(spark, d):
    return (td.transactions(spark, d, "brand"), td.stores(spark, d), td.catalog(spark, d, "brand"))


@query
def predict_features(spark, d):
    return prd.prediction_features(*_prediction_inputs(spark, d))


@query
def predict(spark, d):
    return prd.predict_demand(*_prediction_inputs(spark, d))[0]


@query
def predict_metrics(spark, d):
    return prd.prediction_error(prd.predict_demand(*_prediction_inputs(spark, d))[0])


@query
def predict_check(spark, d):
    """The model on demand that depends on the calendar: keys, sums, floor, and a holdout error
    far below that of the mean."""
    tx, stores, catalog = _prediction_inputs(spark, d)
    day = F.col("transaction_date")
    signal = (5 + 4 * F.month(day) + 3 * F.weekday(day)).cast("decimal(12,2)")
    rows, model = prd.predict_demand(tx.withColumn("quantity", signal), stores, catalog)
    return rows.agg(
        F.count("*").alias("filas"), F.count_distinct("sku_id", "tienda_id", "fecha").alias("claves"),
        F.sum("cantidad_real").alias("cantidad_real"),
        (F.min("cantidad_predicha") >= 0).alias("sin_negativos"),
        (F.lit(model.rmse) < 0.5 * F.stddev("cantidad_real")).alias("mejor_que_la_media"))


@query
def eoq_of_sku(spark, d):
    return reports.get_eoq(_eoq(spark, d), sku="17").select("sku_id", "tienda_id", "eoq")


@query
def feature_importance(spark, d):
    _, model = prd.predict_demand(*_prediction_inputs(spark, d))
    return prd.feature_importance(model, spark)


@query
def kpis(spark, d):
    found = anm.inventory_anomalies(td.inventory(spark, d), td.transactions(spark, d))
    risk = rsk.stockout_risk(td.transactions(spark, d, "brand"), td.inventory(spark, d, "brand"))
    return reports.kpis(td.catalog(spark, d), td.stores(spark, d), found, risk)


# --- loads and streams -----------------------------------------------------------------

@query
def incremental_load(spark, d):
    """Load up to a cut, then the rest through the high-water mark; the result is the table."""
    tx = td.transactions(spark, d)
    stored, log = new_path(spark, "transacciones"), new_path(spark, "log")
    sinks.save_result(tx.where(F.col("transaction_date") < F.lit(LOAD_CUT)), stored)
    sinks.load_increment(stored, tx, log, dt.datetime(2002, 1, 1))
    return (spark.read.parquet(stored).groupBy("type", F.year("transaction_date").alias("anio"))
            .agg(F.count("*").alias("filas"), F.sum("quantity").alias("unidades")))


@query
def load_log(spark, d):
    tx = td.transactions(spark, d)
    stored, log = new_path(spark, "transacciones"), new_path(spark, "log")
    sinks.save_result(tx.where(F.col("transaction_date") < F.lit(LOAD_CUT)), stored)
    sinks.load_increment(stored, tx, log, dt.datetime(2002, 1, 1))
    return spark.read.parquet(log).select(
        F.to_date("fecha_desde").alias("fecha_desde"), F.to_date("fecha_hasta").alias("fecha_hasta"),
        "transacciones", "estado")


@query
def later_rows(spark, d):
    tx = td.transactions(spark, d)
    new = sinks.later_rows(tx.where(F.col("transaction_date") < F.lit(LOAD_CUT)), tx)
    return new.groupBy("target_location_id").agg(F.count("*").alias("filas"),
                                                 F.sum("quantity").alias("unidades"))


def _stock_changes(spark, d, year=2001):
    """Returns (of one year) as stock changes: the returned quantity becomes the new stock."""
    tx = td.transactions(spark, d).where(F.col("type") == "devolucion")
    rows = tx if year is None else tx.where(F.year("transaction_date") == year)
    return rows.select(F.col("target_location_id").alias("location_id"), "sku_id",
                       F.col("quantity").alias("site_qty"),
                       F.to_date("transaction_date").alias("status_date"))


@query
def inventory_update(spark, d):
    return sinks.update_inventory(td.inventory(spark, d), _stock_changes(spark, d)).select(
        "location_id", "sku_id", "site_qty", "status_date")


@query
def inventory_updated_keys(spark, d):
    return sinks.updated_keys(td.inventory(spark, d), _stock_changes(spark, d))


@query
def freshness(spark, d):
    return sinks.freshness(td.transactions(spark, d), dt.date(2001, 11, 10))


@query
def result_store(spark, d):
    """Full refresh, then a read through the stored table."""
    path = new_path(spark, "eficiencia")
    result = rpl.replenishment_efficiency(td.transactions(spark, d), td.inventory(spark, d),
                                          td.stores(spark, d))
    sinks.save_result(result, path)
    sinks.save_result(result, path)
    return reports.page_mean(spark.read.parquet(path), "indice_eficiencia", "promedio_eficiencia")


@query
def run_all_models(spark, d):
    base = Tables(td.transactions(spark, d, "brand"), td.catalog(spark, d, "brand"),
                  td.stores(spark, d), td.inventory(spark, d, "brand"))
    status = run_all(spark, base, new_path(spark, "resultados"))
    return status.select("model", "status", "records_saved")


NOW = dt.datetime(2002, 1, 1)


def _loaded(spark, d) -> VersionedTable:
    """Loaded up to a cut, then by the mark; between them a load that failed before its commit."""
    tx = td.transactions(spark, d)
    stored = VersionedTable(spark, new_path(spark, "transacciones"), tx.schema)
    stored.replace(tx.where(F.col("transaction_date") < F.lit(LOAD_CUT)), NOW)
    stored._write(tx.where(F.col("transaction_date") >= F.lit(LOAD_CUT)), "lost")
    stored.load_later(tx, NOW)
    stored.load_later(tx, NOW)
    return stored


@query
def committed_load(spark, d):
    return _loaded(spark, d).read().groupBy("type", F.year("transaction_date").alias("anio")).agg(
        F.count("*").alias("filas"), F.sum("quantity").alias("unidades"))


@query
def committed_log(spark, d):
    return _loaded(spark, d).log().select(
        F.to_date("fecha_desde").alias("fecha_desde"), F.to_date("fecha_hasta").alias("fecha_hasta"),
        "transacciones", "estado")


@query
def versioned_refresh(spark, d):
    """A refresh of a result by commit records, from the rows that it replaces, then a read."""
    result = rpl.replenishment_efficiency(td.transactions(spark, d), td.inventory(spark, d), td.stores(spark, d))
    stored = VersionedTable(spark, new_path(spark, "eficiencia"), result.schema)
    stored.replace(result, NOW)
    stored.replace(stored.read(), NOW)
    stored.release()
    return reports.page_mean(stored.read(), "indice_eficiencia", "promedio_eficiencia")


@query
def bucket_update(spark, d):
    """Each pair's last return as new stock, in the buckets that hold the keys."""
    stock = td.inventory(spark, d)
    stored = VersionedTable(spark, new_path(spark, "inventarios"), stock.schema, ("location_id", "sku_id"), 32)
    stored.replace(stock, NOW)
    stored.update(_stock_changes(spark, d, None), sinks.update_inventory, NOW)
    return stored.read().select("location_id", "sku_id", "site_qty", "status_date")


@query
def replaced_table(spark, d):
    """A catalog table replaced by one of another schema."""
    name, path = f"ventas_{uuid.uuid4().hex}", new_path(spark, "tabla")
    daily = agg.daily_by_store(td.transactions(spark, d))
    sinks.replace_table(daily.select("tienda_id", "fecha"), name, path)
    sinks.replace_table(daily.groupBy("tienda_id").agg(F.sum("ventas_und").alias("unidades")), name, path)
    return spark.table(name)


@query
def appended_results(spark, d):
    """Two runs of a result, told apart by their time."""
    path, units = new_path(spark, "pronosticos"), agg.store_rollup(td.transactions(spark, d))
    for hour in (1, 2):
        sinks.append_result(units.select("tienda_id", "ventas_totales"), path, dt.datetime(2002, 1, 1, hour))
    return spark.read.parquet(path).groupBy(F.hour("fecha_generacion").alias("hora")).agg(
        F.count("*").alias("tiendas"), F.sum("ventas_totales").alias("ventas"))


@query
def json_records(spark, d):
    """Records as JSON, null fields included, read back by their names."""
    records = sinks.as_json(tables.products(td.catalog(spark, d), limit=None))
    get = lambda name: F.get_json_object("registro", f"$.{name}")
    return records.select(get("sku_id").alias("sku_id"), get("categoria").alias("categoria"),
                          get("precio").cast("double").alias("precio"),
                          F.col("registro").contains('"departamento":null').alias("con_nulos"))


@query
def forecast_page(spark, d):
    found = fct.forecast_demand(td.transactions(spark, d, "brand"))
    return reports.get_forecasts(found, limit=100).select("sku_id", "fecha")


@query
def forecast_of_sku(spark, d):
    """The first ten days of one SKU."""
    found = fct.forecast_demand(td.transactions(spark, d))
    return reports.get_forecasts(found, sku="17", limit=10).select("sku_id", "fecha")


@query
def rotation_of_sku(spark, d):
    rows = prf.rotation(td.transactions(spark, d), td.inventory(spark, d), td.catalog(spark, d))
    return reports.get_rotation(rows, sku="17", limit=1).select("sku_id", "tienda_id", "indice_velocidad")


@query
def prediction_page(spark, d):
    """The page's keys and quantities, from a short fit; its error is over all rows."""
    found, _ = prd.predict_demand(*_prediction_inputs(spark, d), max_iter=2)
    return reports.get_predictions(found, limit=100).select("sku_id", "tienda_id", "fecha", "cantidad_real")


@query
def anomaly_page_check(spark, d):
    """The page has the lowest scores: none beyond it is lower than its highest."""
    found = materialize(anm.inventory_anomalies(td.inventory(spark, d), td.transactions(spark, d)), "anomalies")
    page = materialize(reports.get_anomalies(found, limit=100), "page")
    last = page.agg(F.max("score_anomalia")).first()[0]
    total = reports.critical_count(found)
    return page.agg(F.count("*").alias("filas"), F.bool_and("es_anomalia").alias("marcadas")).select(
        "*", (found.where(F.col("score_anomalia") < last).agg(F.count("*")).scalar() < 100).alias("las_menores"),
        total.select("total").scalar().alias("total"))


@query
def kpis_check(spark, d):
    """The dashboard's numbers; of the forest's only that they are a part of the flags."""
    found = materialize(anm.inventory_anomalies(td.inventory(spark, d), td.transactions(spark, d)), "anomalies")
    risk = rsk.stockout_risk(td.transactions(spark, d, "brand"), td.inventory(spark, d, "brand"))
    numbers = reports.kpis(td.catalog(spark, d), td.stores(spark, d), found, risk)
    flagged = found.agg(F.count_if("es_anomalia")).first()[0]
    return numbers.select("total_skus", "total_tiendas", "alto_riesgo",
                          F.col("criticas").between(0, flagged).alias("criticas_marcadas"))


@query
def run_all_check(spark, d):
    """Statuses and row counts of all jobs whose counts follow from the data."""
    base = Tables(td.transactions(spark, d, "brand"), td.catalog(spark, d, "brand"),
                  td.stores(spark, d), td.inventory(spark, d, "brand"))
    jobs = [job for job in JOBS if job != "market_basket"]
    status = run_all(spark, base, new_path(spark, "resultados"), jobs, {"predicciones_lgbm": {"max_iter": 2}})
    return status.select("model", "status", "records_saved")


def _line_stream(spark, d):
    schema = td.table(spark, d, "lineitem").schema
    lines = stm.transaction_stream(spark, d, schema, "lineitem.parquet")
    return td.lineitem_to_transactions(lines)


@query
def stream_ingest(spark, d):
    target, log = new_path(spark, "stream"), new_path(spark, "stream-log")
    q = stm.ingest(_line_stream(spark, d), target, log, new_path(spark, "stream-checkpoint"))
    q.awaitTermination()
    return (spark.read.parquet(target).groupBy("target_location_id", "type")
            .agg(F.count("*").alias("filas"), F.sum("quantity").alias("unidades")))


@query
def stream_daily_sales(spark, d):
    target = new_path(spark, "stream-daily")
    q = stm.write_daily_sales(_line_stream(spark, d), target, new_path(spark, "stream-checkpoint"))
    q.awaitTermination()
    return spark.read.parquet(target)


@query
def stream_daily_totals(spark, d):
    """Daily sums by batch, gathered once, then a batch that comes again: every day is there, the last ones too."""
    days = stm.daily_table(spark, new_path(spark, "stream-days"))
    stm.add_daily_sales(_line_stream(spark, d), days, new_path(spark, "stream-checkpoint"), lambda: NOW).awaitTermination()
    days.compact(NOW, stm.merge_days)
    days.append(stm.day_sums(td.transactions(spark, d)), NOW, batch=0)
    return stm.daily_totals(days.read())
