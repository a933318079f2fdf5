"""Order quantities and store replenishment efficiency."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.functions.exprs import as_double, classify, clip, guarded_div, non_zero, rnd
from surtido.functions.labels import (
    EFFICIENCY_DEFAULT,
    EFFICIENCY_LADDER,
    ORDER_NOW,
    ORDER_SOON,
    STOCK_OK,
)
from surtido.operators.aggregates import PAIR, inventory_by_store, pair_demand, store_type_summary
from surtido.operators.ordered import top
from surtido.sources.tables import catalog_view, inventory_view, store_view


def demand_inventory(demand: DataFrame, inventory: DataFrame) -> DataFrame:
    """Demand pairs with their stock; pairs without inventory keep NULLs."""
    stock = inventory_view(inventory).select(
        *PAIR, as_double("site_qty").alias("site_qty"), as_double("min_stock").alias("min_stock"),
        as_double("max_stock").alias("max_stock"), "lead_time")
    return demand.join(stock, list(PAIR), "left")


def eoq(tx: DataFrame, inventory: DataFrame, catalog: DataFrame, *, order_cost_rate: float = 0.02,
        min_order_cost: float = 500.0, holding_rate: float = 0.20, z: float = 1.65,
        per_day: bool = False, window_days: int | None = None,
        as_of: dt.date | None = None) -> DataFrame:
    """Economic order quantity, safety stock, reorder point and reorder status per pair.

    An order quantity that rounds to 0 gives NULL cost and frequency.
    """
    demand = pair_demand(tx, per_day=per_day, window_days=window_days, as_of=as_of)
    products = catalog_view(catalog).select(
        "sku_id", "categoria", "marca", as_double("cost").alias("cost"),
        as_double("price").alias("price"))
    df = demand_inventory(demand, inventory).join(products, "sku_id", "left")
    df = df.withColumns({
        "costo_pedido": clip(F.col("cost") * order_cost_rate, lo=min_order_cost),
        "costo_almacenamiento": F.col("cost") * holding_rate,
        "desviacion_demanda": clip(F.coalesce("desviacion_demanda", F.lit(1.0)), lo=0.1),
        "lead_time": clip(F.coalesce("lead_time", F.lit(3)).cast("double"), lo=1.0),
        "demanda_anual": clip(F.coalesce("demanda_anual", F.lit(1.0)), lo=1.0),
        "demanda_diaria_prom": clip(F.coalesce("demanda_diaria_prom", F.lit(0.1)), lo=0.01),
    })
    D, S, H = F.col("demanda_anual"), F.col("costo_pedido"), F.col("costo_almacenamiento")
    df = df.withColumns({
        "eoq": rnd(F.sqrt(F.lit(2.0) * D * S / clip(H, lo=1.0))),
        "stock_seguridad": rnd(F.lit(z) * F.col("desviacion_demanda") * F.sqrt("lead_time")),
    })
    df = df.withColumns({
        "punto_reorden": rnd(F.col("demanda_diaria_prom") * F.col("lead_time")
                             + F.col("stock_seguridad")),
        "costo_total_optimizado": rnd(D / non_zero("eoq") * S + F.col("eoq") / F.lit(2.0) * H, 2),
        "pedidos_por_año": rnd(D / non_zero("eoq"), 1),
    })
    point, stock = F.col("punto_reorden"), F.col("site_qty")
    return df.withColumns({
        "dias_entre_pedidos": rnd(F.lit(365.0) / non_zero("pedidos_por_año")),
        "estado_reposicion": F.when(stock <= point, ORDER_NOW)
        .when(stock <= point * 1.5, ORDER_SOON).otherwise(STOCK_OK),
    }).select(*PAIR, "categoria", "marca", "demanda_anual", "demanda_diaria_prom", "eoq",
              "stock_seguridad", "punto_reorden", "costo_total_optimizado", "pedidos_por_año",
              "dias_entre_pedidos", "estado_reposicion", "site_qty", "lead_time")


def urgent_orders(eoq_result: DataFrame, n: int = 10) -> DataFrame:
    """The pairs to order now with the highest demand."""
    return top(eoq_result.where(F.col("estado_reposicion") == ORDER_NOW), n,
               F.desc("demanda_anual"), F.col("sku_id"), F.col("tienda_id"))


def replenishment_efficiency(tx: DataFrame, inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """Replenishment coverage, returns and SKU coverage per store, with one index.

    Stores without transactions or inventory stay, with zeros.
    """
    df = (store_view(stores).drop("region", "lead_time")
          .join(store_type_summary(tx), "tienda_id", "left")
          .join(inventory_by_store(inventory), "tienda_id", "left"))
    numbers = ["total_ventas", "total_repuesto", "total_devuelto", "total_trasladado",
               "transac_ventas", "num_reposiciones", "num_devoluciones", "num_traslados",
               "skus_vendidos", "skus_repuestos", "stock_total", "skus_activos",
               "lead_time_prom", "skus_sin_repos"]
    df = df.fillna(0, subset=numbers)
    sold, skus = F.col("total_ventas"), F.col("skus_vendidos")
    df = df.withColumns({
        "cobertura_reposicion": rnd(clip(guarded_div("total_repuesto", sold) * 100, hi=150.0), 2),
        "tasa_devolucion": rnd(guarded_div("total_devuelto", sold) * 100, 2),
        "repos_por_mes": rnd(as_double("num_reposiciones") / 12, 2),
        "eficiencia_skus": rnd(clip(guarded_div("skus_repuestos", skus) * 100, hi=100.0), 2),
    })
    coverage = clip(F.lit(100.0) - F.abs(F.col("cobertura_reposicion") - 100.0), lo=0.0) / 100.0
    returns = F.lit(1.0) - clip("tasa_devolucion", hi=30.0) / 30.0
    index = (coverage * 0.5 + returns * 0.3 + F.col("eficiencia_skus") / 100.0 * 0.2) * 100.0
    df = df.withColumn("indice_eficiencia", rnd(index, 2))
    return df.withColumn("clasificacion_eficiencia",
                         classify("indice_eficiencia", EFFICIENCY_LADDER, EFFICIENCY_DEFAULT))
