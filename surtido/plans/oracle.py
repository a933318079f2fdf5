"""SQL equivalents of the registered queries, on the same Parquet tables.

The base tables are common table expressions with the integer arithmetic of
``surtido.sources.testdata``. Model results (k-means, trees, regressions) have no SQL
here, only what must hold for any of them.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the operators is found
ABC_LONG = ("A - Alta rotación", "B - Rotación media", "C - Baja rotación")
ABC_SHORT = ("A", "B", "C")
ANOMALY_IDLE = "🔵 Sin movimiento"
ANOMALY_NONE = "Normal"
ANOMALY_OTHER = "⚪ Anomalía general"
ANOMALY_OVERSTOCK = "🟡 Sobrestock"
ANOMALY_RISK = "🟠 Riesgo de quiebre"
ANOMALY_STOCKOUT = "🔴 Quiebre de stock"
EFFICIENCY_DEFAULT = "🔴 Baja eficiencia"
EFFICIENCY_LADDER = ((70, "🟢 Alta eficiencia"), (45, "🟡 Eficiencia media"))
HIGH_SEASON_MONTHS = (1, 2, 6, 7, 10, 11, 12)
ORDER_NOW = "🔴 Pedir ahora"
ORDER_SOON = "🟡 Pedir pronto"
PROFIT_DEFAULT = "🔴 Baja rentabilidad"
PROFIT_LADDER = ((70, "🟢 Alta rentabilidad"), (40, "🟡 Rentabilidad media"))
ROTATION_DEFAULT = "❄️  Sin movimiento"
ROTATION_LADDER = ((70, "🚀 Alta rotación"), (40, "🔄 Rotación media"), (15, "🐢 Rotación lenta"))
SEASON_PERCENT = {1: 125, 2: 120, 3: 100, 4: 95, 5: 95, 6: 120,
                  7: 125, 8: 95, 9: 100, 10: 120, 11: 130, 12: 150}
STOCK_OK = "🟢 Stock OK"
SYMBOLS = "🔴🟠🟡🔵⚪🟢🚀🔄🐢❄️"
TARGET_RANGES = {
    "GRANDE": (4_500_000, 7_000_000, 80, 150),
    "MEDIANO": (2_500_000, 4_500_000, 45, 90),
    "PEQUEÑO": (1_200_000, 2_500_000, 20, 50),
    "EXPRESS": (800_000, 1_800_000, 15, 40),
    "DEFAULT": (1_500_000, 3_000_000, 30, 60),
}
TREND_DOWN = "Bajando ↓"
TREND_FLAT = "Estable →"
TREND_NONE = "Sin datos"
TREND_UP = "Mejorando ↑"
UNKNOWN = "desconocido"
TEST_TARGETS = {"GRANDE": 900_000, "MEDIANO": 600_000, "PEQUEÑO": 400_000, "EXPRESS": 300_000,
                "DEFAULT": 500_000}

ORACLE: dict[str, str] = {}


def rnd(expr: str, digits: int = 0) -> str:
    """Half-to-even rounding on the binary value."""
    scale = f"{10 ** digits}.0"
    v = f"(({expr})::DOUBLE * {scale})"
    return f"((CASE WHEN {v} - floor({v}) = 0.5 THEN 2 * round({v} / 2) ELSE round({v}) END) / {scale})"


def ladder(expr: str, steps, default: str) -> str:
    whens = " ".join(f"WHEN {expr} >= {t} THEN '{label}'" for t, label in steps)
    return f"CASE {whens} ELSE '{default}' END"


def clip(expr: str, lo=None, hi=None) -> str:
    out = "CASE"
    if lo is not None:
        out += f" WHEN {expr} < {lo} THEN {lo}"
    if hi is not None:
        out += f" WHEN {expr} > {hi} THEN {hi}"
    return f"({out} ELSE {expr} END)::DOUBLE"


def div(num: str, den: str, default: str = "0.0") -> str:
    return f"(CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den})::DOUBLE ELSE {default} END)"


def choose(expr: str, values: dict, default) -> str:
    whens = " ".join(f"WHEN {k!r} THEN {v}" for k, v in values.items())
    return f"CASE {expr} {whens} ELSE {default} END"


SALE_IF = "(l_returnflag = 'N' OR (l_returnflag = 'A' AND l_linestatus = 'F'))"

BASE = f"""
tx AS (
  SELECT l_orderkey::VARCHAR AS receipt_id, l_partkey::VARCHAR AS sku_id,
    l_suppkey::VARCHAR AS tienda_id, l_quantity::DECIMAL(12,2) AS quantity,
    (CASE WHEN {SALE_IF} THEN (200 + (l_partkey * 37) % 3301)
      * (100 - CAST(round(l_discount * 100) AS INTEGER)) ELSE 0 END)::DECIMAL(12,2) AS sale_price,
    CASE WHEN {SALE_IF} THEN 'venta' WHEN l_returnflag = 'A' THEN 'reposicion'
      WHEN l_linestatus = 'F' THEN 'devolucion' ELSE 'traslado' END AS type,
    l_shipdate AS ts, l_shipdate::DATE AS dia, l_partkey
  FROM lineitem),
btx AS (SELECT tx.* REPLACE (p_brand AS sku_id) FROM tx JOIN part ON l_partkey = p_partkey),
cat AS (
  SELECT p_partkey AS id, p_partkey::VARCHAR AS sku_id, p_name, p_type AS categoria,
    p_brand AS marca, p_size::VARCHAR AS talla,
    CASE p_partkey % 4 WHEN 0 THEN 'verano' WHEN 1 THEN 'invierno' WHEN 2 THEN 'primavera' END
      AS temporada,
    (100 * (200 + (p_partkey * 37) % 3301))::DOUBLE AS price,
    ((200 + (p_partkey * 37) % 3301) * (40 + p_partkey % 26))::DOUBLE AS cost
  FROM part),
bcat AS (
  SELECT p_brand AS sku_id, min(p_type) AS categoria, p_brand AS marca, 'verano' AS temporada,
    min(p_size)::VARCHAR AS talla, floor(avg(100 * (200 + (p_partkey * 37) % 3301))) AS price,
    floor(avg((200 + (p_partkey * 37) % 3301) * (40 + p_partkey % 26))) AS cost
  FROM part GROUP BY p_brand),
st AS (
  SELECT s_suppkey AS id, s_suppkey::VARCHAR AS tienda_id, s_name AS nombre, n_name AS ciudad,
    r_name AS region,
    CASE s_suppkey % 5 WHEN 0 THEN 'grande' WHEN 1 THEN 'mediano' WHEN 2 THEN 'pequeño'
      WHEN 3 THEN 'express' END AS formato,
    CASE s_suppkey % 4 WHEN 0 THEN 'calido' WHEN 1 THEN 'frio' WHEN 2 THEN 'templado'
      ELSE 'humedo' END AS clima,
    CASE s_suppkey % 3 WHEN 0 THEN 'norte' WHEN 1 THEN 'centro' ELSE 'sur' END AS zona,
    1 + s_suppkey % 7 AS lead_time
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
inv0 AS (
  SELECT p, s, 2 + (p + s) % 9 AS lo, (2 + (p + s) % 9) * (3 + p % 6) AS hi
  FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
  WHERE (p * 7 + s * 13) % 3 < 2),
inv AS (
  SELECT p::VARCHAR AS sku_id, s::VARCHAR AS tienda_id,
    ((p * 31 + s * 17) % (2 * hi))::DOUBLE AS site_qty, ((p + 2 * s) % 6)::DOUBLE AS transit_qty,
    ((p * s) % 3)::DOUBLE AS reserved_qty, lo::DOUBLE AS min_stock, hi::DOUBLE AS max_stock,
    1 + (p + s) % 7 AS lead_time, p % 50 = 0 AS avoid, p
  FROM inv0),
binv AS (
  SELECT p_brand AS sku_id, tienda_id, sum(site_qty) AS site_qty, floor(avg(lead_time)) AS lead_time
  FROM inv JOIN part ON p = p_partkey GROUP BY 1, 2),
sale AS (SELECT * FROM tx WHERE type = 'venta'),
bsale AS (SELECT * FROM btx WHERE type = 'venta')
"""

PAIR_AGG = """
  SELECT sku_id, tienda_id, sum(quantity)::DOUBLE AS unidades,
    sum(quantity)::DOUBLE / count(quantity) AS venta_media,
    stddev_samp(quantity::DOUBLE) AS desviacion, count(DISTINCT dia) AS dias_con_venta,
    min(ts) AS primera, max(ts) AS ultima, count(*) AS n,
    sum(sale_price)::DOUBLE / count(sale_price) AS precio_medio,
    sum(quantity * sale_price)::DOUBLE AS ingreso
"""
PAIRS = f"pairs AS ({PAIR_AGG} FROM sale GROUP BY 1, 2)"


def daily(name: str, source: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, dia AS fecha, sum(quantity)::DOUBLE AS cantidad,
      sum(sale_price)::DOUBLE / count(sale_price) AS precio_promedio
      FROM {source} GROUP BY ALL)"""


BDAILY = daily("bdaily", "bsale", "sku_id, tienda_id")

SEASON = choose("month(fecha)", SEASON_PERCENT, 100)
SUNDAY = "(CASE WHEN isodow(fecha) = 7 THEN 70 ELSE 100 END)"


def calendar(first: str, last: str) -> str:
    return f"""(SELECT id AS tienda_id, coalesce(upper(formato), 'DEFAULT') AS fmt,
      unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY))::DATE AS fecha FROM st)"""


def metas(first: str, last: str, name: str = "metas") -> str:
    base = "(" + choose("fmt", TEST_TARGETS, TEST_TARGETS["DEFAULT"]) + ")"
    return f"""{name} AS (
      SELECT tienda_id, fecha, year(fecha) AS anio, month(fecha) AS mes,
        weekofyear(fecha) AS semana_iso, quarter(fecha) AS trimestre, c AS meta_diaria_cop,
        c * 6 AS meta_semanal_cop,
        c * (CASE WHEN month(fecha) IN (1, 3, 5, 7, 8, 10, 12) THEN 24 ELSE 22 END)
          AS meta_mensual_cop,
        greatest(floor(c / 150000), 1) AS meta_diaria_und
      FROM (SELECT tienda_id, fecha,
          ({base}::DOUBLE * {SEASON} * {SUNDAY}) / 10000 AS c FROM {calendar(first, last)}))"""


STORE_DAY = """store_day AS (
  SELECT tienda_id::INTEGER AS tienda_id, dia AS fecha,
    sum(quantity * sale_price)::DOUBLE AS ventas_cop, sum(quantity)::DOUBLE AS ventas_und
  FROM sale WHERE regexp_full_match(tienda_id, '[0-9]+') GROUP BY 1, 2)"""


def compliance_daily(first: str = "1998-03-01", last: str = "1998-03-31") -> str:
    return f"""{metas(first, last)}, {STORE_DAY}, cd AS (
      SELECT *, {rnd("ventas_cop / meta_diaria_cop * 100.0", 2)} AS pct_diario_cop,
        {rnd("ventas_und / meta_diaria_und * 100.0", 2)} AS pct_diario_und
      FROM (SELECT m.*, nombre AS tienda_nombre, ciudad, region, formato,
          coalesce(v.ventas_cop, 0.0) AS ventas_cop, coalesce(v.ventas_und, 0.0) AS ventas_und
        FROM metas m JOIN st ON st.id = m.tienda_id
        LEFT JOIN store_day v ON v.tienda_id = m.tienda_id AND v.fecha = m.fecha))"""


STORE_SUMMARY = f"""ss0 AS (
  SELECT tienda_id, min(tienda_nombre) AS tienda_nombre, min(ciudad) AS ciudad,
    min(region) AS region, min(formato) AS formato, count(*) AS dias_totales,
    count(*) FILTER (ventas_cop > 0) AS dias_con_ventas, sum(ventas_cop) AS ventas_cop_total,
    sum(meta_diaria_cop) AS meta_cop_total, sum(ventas_und) AS ventas_und_total,
    sum(meta_diaria_und)::BIGINT AS meta_und_total, avg(pct_diario_cop) AS cumplimiento_prom,
    count(*) FILTER (pct_diario_cop >= 100) AS dias_sobre_meta, max(ventas_cop) AS mejor_dia_cop,
    arg_min(meta_mensual_cop, fecha) AS meta_mensual_cop
  FROM cd GROUP BY tienda_id),
ss AS (SELECT *, {rnd("ventas_cop_total / meta_cop_total * 100.0", 2)} AS pct_cumplimiento_cop,
    {rnd("ventas_und_total / meta_und_total * 100.0", 2)} AS pct_cumplimiento_und,
    {rnd("dias_sobre_meta::DOUBLE / dias_totales * 100.0", 1)} AS pct_dias_sobre_meta,
    {rnd("ventas_cop_total / nullif(ventas_und_total, 0)")} AS ticket_promedio
  FROM ss0),
sp AS (SELECT *, {rnd("proyeccion_cop / meta_mensual_cop * 100.0", 2)} AS pct_proyeccion
  FROM (SELECT *, {rnd("ventas_cop_total * (31.0::DOUBLE / 20)")} AS proyeccion_cop FROM ss))"""

TREND = f"""di AS (SELECT *, row_number() OVER (PARTITION BY tienda_id ORDER BY fecha) - 1 AS dia
  FROM cd),
tr AS (SELECT tienda_id, {rnd("m", 4)} AS slope, {rnd("r", 4)} AS r2,
    CASE WHEN m IS NULL THEN '{TREND_NONE}' WHEN m > 0.5 THEN '{TREND_UP}'
      WHEN m > -0.5 THEN '{TREND_FLAT}' ELSE '{TREND_DOWN}' END AS tendencia
  FROM (SELECT tienda_id, CASE WHEN n >= 3 THEN xy / xx END AS m,
      CASE WHEN n >= 3 THEN CASE WHEN yy = 0 THEN 1.0 ELSE xy * xy / (xx * yy) END END AS r
    FROM (SELECT tienda_id, count(*) AS n,
        (count(*) * sum(dia * y) - sum(dia) * sum(y))::DOUBLE / 100 AS xy,
        (count(*) * sum(dia * dia) - sum(dia) * sum(dia))::DOUBLE AS xx,
        (count(*) * sum(y * y) - sum(y) * sum(y))::DOUBLE / 10000 AS yy
      FROM (SELECT *, round(pct_diario_cop * 100)::BIGINT AS y FROM di) GROUP BY tienda_id)))"""

WEEK_MONTH = f"""wk AS (SELECT *, {rnd("ventas_semana / meta_semana * 100.0", 2)} AS pct_semanal
  FROM (SELECT tienda_id, sum(ventas_cop) AS ventas_semana,
      arg_min(meta_semanal_cop, fecha) AS meta_semana
    FROM cd WHERE semana_iso = weekofyear(DATE '1998-03-20')
      AND isoyear(fecha) = isoyear(DATE '1998-03-20') GROUP BY tienda_id)),
mo AS (SELECT *, {rnd("ventas_mes / meta_mes * 100.0", 2)} AS pct_mensual
  FROM (SELECT tienda_id, sum(ventas_cop) AS ventas_mes,
      arg_min(meta_mensual_cop, fecha) AS meta_mes
    FROM cd WHERE mes = 3 AND anio = 1998 GROUP BY tienda_id))"""

COMPLIANCE = f"""{compliance_daily()}, {STORE_SUMMARY}, {TREND}, {WEEK_MONTH},
comp AS (SELECT sp.* REPLACE (coalesce(ticket_promedio, 0.0) AS ticket_promedio),
    slope, r2, coalesce(tendencia, '{TREND_NONE}') AS tendencia,
    coalesce(pct_semanal, 0.0) AS pct_semanal, coalesce(pct_mensual, 0.0) AS pct_mensual
  FROM sp LEFT JOIN tr USING (tienda_id) LEFT JOIN wk USING (tienda_id)
  LEFT JOIN mo USING (tienda_id))"""

FEATURES = f"""{PAIRS}, feat AS (
  SELECT *, {rnd(div("site_qty", "venta_diaria_prom", "999.0"), 2)} AS cobertura_dias,
    {rnd(div("site_qty", "min_stock", "1.0"), 4)} AS ratio_stock_min,
    {rnd(div("site_qty", "max_stock", "1.0"), 4)} AS ratio_stock_max,
    site_qty - reserved_qty AS stock_disponible, site_qty + transit_qty AS stock_total_cadena
  FROM (SELECT sku_id, tienda_id, site_qty, transit_qty, reserved_qty, min_stock, max_stock,
      lead_time::DOUBLE AS lead_time, coalesce(venta_media, 0.0) AS venta_diaria_prom,
      coalesce(unidades, 0.0) AS venta_total, coalesce(n, 0) AS num_transacciones
    FROM inv LEFT JOIN pairs USING (sku_id, tienda_id)))"""

CASCADE = f"""CASE WHEN site_qty <= min_stock THEN '{ANOMALY_STOCKOUT}'
  WHEN site_qty >= max_stock * 1.5 THEN '{ANOMALY_OVERSTOCK}'
  WHEN cobertura_dias < lead_time THEN '{ANOMALY_RISK}'
  WHEN venta_diaria_prom = 0 AND site_qty > 0 THEN '{ANOMALY_IDLE}'
  ELSE '{ANOMALY_OTHER}' END"""

EOQ = f"""{PAIRS},
e0 AS (SELECT sku_id, tienda_id, categoria, marca, site_qty, {clip("cost * 0.02", 500.0)} AS s,
    cost * 0.20 AS h, {clip("coalesce(desviacion, 1.0)", 0.1)} AS dev,
    {clip("coalesce(lead_time, 3)", 1.0)} AS lead_time, {clip("unidades", 1.0)} AS demanda_anual,
    {clip("venta_media", 0.01)} AS demanda_diaria_prom
  FROM pairs LEFT JOIN inv USING (sku_id, tienda_id) LEFT JOIN cat USING (sku_id)),
e1 AS (SELECT *, {rnd(f"sqrt(2.0 * demanda_anual * s / {clip('h', 1.0)})")} AS eoq,
    {rnd("1.65 * dev * sqrt(lead_time)")} AS stock_seguridad FROM e0),
e2 AS (SELECT *, {rnd("demanda_diaria_prom * lead_time + stock_seguridad")} AS punto_reorden,
    {rnd("demanda_anual / nullif(eoq, 0) * s + eoq / 2.0 * h", 2)} AS costo_total_optimizado,
    {rnd("demanda_anual / nullif(eoq, 0)", 1)} AS pedidos FROM e1),
eoqr AS (SELECT sku_id, tienda_id, categoria, marca, demanda_anual, demanda_diaria_prom, eoq,
    stock_seguridad, punto_reorden, costo_total_optimizado, pedidos AS "pedidos_por_año",
    {rnd("365.0::DOUBLE / nullif(pedidos, 0)")} AS dias_entre_pedidos,
    CASE WHEN site_qty <= punto_reorden THEN '{ORDER_NOW}'
      WHEN site_qty <= punto_reorden * 1.5 THEN '{ORDER_SOON}' ELSE '{STOCK_OK}' END
      AS estado_reposicion, site_qty, lead_time FROM e2)"""

PROFIT = f"""pp AS ({PAIR_AGG} FROM sale WHERE sale_price > 0 GROUP BY 1, 2),
p0 AS (SELECT sku_id, tienda_id, categoria, marca, talla, temporada,
    unidades AS unidades_vendidas, precio_medio AS precio_venta_prom, price AS precio_lista,
    unidades * cost AS costo_total, ingreso AS ingreso_total,
    {rnd("ingreso - unidades * cost", 2)} AS rentabilidad_total,
    precio_medio - cost AS margen_unitario,
    {rnd(div("precio_medio - cost", "precio_medio") + " * 100.0", 2)} AS margen_porcentual,
    {rnd(div("price - precio_medio", "price") + " * 100.0", 2)} AS descuento_aplicado
  FROM pp LEFT JOIN cat USING (sku_id)),
p1 AS (SELECT min(margen_porcentual) AS m0, max(margen_porcentual) AS m1,
    min(rentabilidad_total) AS r0, max(rentabilidad_total) AS r1,
    min(unidades_vendidas) AS u0, max(unidades_vendidas) AS u1 FROM p0),
p2 AS (SELECT p0.*, {rnd('''(((margen_porcentual - m0) / (m1 - m0 + 0.01)) * 0.4
      + ((rentabilidad_total - r0) / (r1 - r0 + 0.01)) * 0.4
      + ((unidades_vendidas - u0) / (u1 - u0 + 0.01)) * 0.2) * 100.0''', 2)} AS indice_rentabilidad
  FROM p0, p1),
profit AS (SELECT *, {ladder("indice_rentabilidad", PROFIT_LADDER, PROFIT_DEFAULT)} AS clasificacion
  FROM p2)"""

ROTATION = f"""{PAIRS},
r0 AS (SELECT sku_id, tienda_id, categoria, marca, talla, temporada, unidades AS unidades_vendidas,
    venta_media AS venta_diaria_prom, dias_con_venta,
    greatest(floor((epoch(ultima) - epoch(primera)) / 86400), 1)::BIGINT AS dias_periodo,
    coalesce(site_qty, 0.0) AS site_qty, {clip("(coalesce(site_qty, 0.0) + min_stock) / 2.0", 0.1)}
      AS stock_promedio
  FROM pairs LEFT JOIN inv USING (sku_id, tienda_id) LEFT JOIN cat USING (sku_id)),
r1 AS (SELECT *, CASE WHEN venta_diaria_prom > 0 THEN {rnd("site_qty / venta_diaria_prom", 1)}
      ELSE 999.0 END AS dsi,
    {rnd("unidades_vendidas * (365.0::DOUBLE / dias_periodo) / stock_promedio", 2)}
      AS tasa_rotacion_anual,
    {rnd("dias_con_venta::DOUBLE / dias_periodo * 100.0", 2)} AS frecuencia_venta FROM r0),
r2 AS (SELECT min(tasa_rotacion_anual) AS lo, max(tasa_rotacion_anual) AS hi FROM r1),
r3 AS (SELECT r1.*, {rnd(f'''(((tasa_rotacion_anual - lo) / (hi - lo + 0.01)) * 0.4
      + frecuencia_venta / 100.0 * 0.3 + (1.0 - {clip("dsi", None, 365.0)} / 365.0) * 0.3) * 100.0''',
                     2)} AS indice_velocidad FROM r1, r2),
rot AS (SELECT sku_id, tienda_id, categoria, marca, talla, temporada, unidades_vendidas,
    venta_diaria_prom, dias_con_venta, dias_periodo, site_qty, dsi AS dias_cobertura,
    tasa_rotacion_anual, dsi, frecuencia_venta, indice_velocidad,
    {ladder("indice_velocidad", ROTATION_LADDER, ROTATION_DEFAULT)} AS clasificacion_rotacion
  FROM r3)"""

_KINDS = (("venta", "total_ventas", "transac_ventas"),
          ("reposicion", "total_repuesto", "num_reposiciones"),
          ("devolucion", "total_devuelto", "num_devoluciones"),
          ("traslado", "total_trasladado", "num_traslados"))
STORE_TYPES = "sty AS (SELECT tienda_id, " + ", ".join(
    f"(sum(quantity) FILTER (type = '{k}'))::DOUBLE AS {total}, count(*) FILTER (type = '{k}') AS {n}"
    for k, total, n in _KINDS) + """,
  count(DISTINCT sku_id) FILTER (type = 'venta') AS skus_vendidos,
  count(DISTINCT sku_id) FILTER (type = 'reposicion') AS skus_repuestos FROM tx GROUP BY tienda_id)"""

STORE_STOCK = """sinv AS (SELECT tienda_id, sum(site_qty) AS stock_total,
  sum(site_qty) / count(*) AS stock_prom, count(*) AS skus_activos,
  sum(lead_time)::DOUBLE / count(*) AS lead_time_prom, count(*) FILTER (avoid) AS skus_sin_repos
  FROM inv GROUP BY tienda_id)"""

EFFICIENCY = f"""{STORE_TYPES}, {STORE_STOCK},
f0 AS (SELECT tienda_id, nombre AS nombre_tienda, ciudad, zona, clima, formato,
    coalesce(total_ventas, 0) AS total_ventas, coalesce(total_repuesto, 0) AS total_repuesto,
    coalesce(total_devuelto, 0) AS total_devuelto,
    coalesce(num_reposiciones, 0) AS num_reposiciones, coalesce(skus_vendidos, 0) AS skus_vendidos,
    coalesce(skus_repuestos, 0) AS skus_repuestos, coalesce(stock_total, 0) AS stock_total,
    coalesce(lead_time_prom, 0) AS lead_time_prom
  FROM st LEFT JOIN sty USING (tienda_id) LEFT JOIN sinv USING (tienda_id)),
f1 AS (SELECT *,
    {rnd(clip("(" + div("total_repuesto", "total_ventas") + " * 100.0)", None, 150.0), 2)}
      AS cobertura_reposicion,
    {rnd(div("total_devuelto", "total_ventas") + " * 100.0", 2)} AS tasa_devolucion,
    {rnd("num_reposiciones::DOUBLE / 12", 2)} AS repos_por_mes,
    {rnd(clip("(" + div("skus_repuestos", "skus_vendidos") + " * 100.0)", None, 100.0), 2)}
      AS eficiencia_skus FROM f0),
f2 AS (SELECT *, {rnd(f'''({clip("(100.0 - abs(cobertura_reposicion - 100.0))", 0.0)} / 100.0 * 0.5
      + (1.0 - {clip("tasa_devolucion", None, 30.0)} / 30.0) * 0.3
      + eficiencia_skus / 100.0 * 0.2) * 100.0''', 2)} AS indice_eficiencia FROM f1),
eff AS (SELECT *, {ladder("indice_eficiencia", EFFICIENCY_LADDER, EFFICIENCY_DEFAULT)}
  AS clasificacion_eficiencia FROM f2)"""


def abc(source: str, scale: float, labels) -> str:
    a, b = 0.70 * scale, 0.90 * scale
    return f"""abc0 AS (SELECT *, cantidad_total / t * {scale}::DOUBLE AS participacion,
        c / t * {scale}::DOUBLE AS acumulado
      FROM (SELECT *, sum(cantidad_total) OVER () AS t,
          sum(cantidad_total) OVER (ORDER BY cantidad_total DESC, sku_id
            ROWS UNBOUNDED PRECEDING) AS c FROM {source})),
    abc AS (SELECT * EXCLUDE (t, c), CASE WHEN acumulado <= {a}::DOUBLE THEN '{labels[0]}'
        WHEN acumulado <= {b}::DOUBLE THEN '{labels[1]}' ELSE '{labels[2]}' END AS segmento_abc
      FROM abc0)"""


SKU_ROLLUP = f"""{PAIRS}, skus AS (SELECT sku_id, sum(unidades) AS cantidad_total,
  avg(venta_media) AS cantidad_promedio, avg(precio_medio) AS precio_promedio,
  sum(n)::BIGINT AS num_transacciones, count(*) AS num_tiendas FROM pairs GROUP BY sku_id)"""
SKU_UNITS = "units AS (SELECT sku_id, sum(quantity)::DOUBLE AS cantidad_total FROM sale GROUP BY 1)"
ABC_API = f"{SKU_UNITS}, {abc('units', 100.0, ABC_SHORT)}"
ABC_FULL = f"{SKU_ROLLUP}, {abc('skus', 1.0, ABC_LONG)}"

STORE_ROLLUP = f"""{PAIRS}, srol AS (SELECT tienda_id, sum(unidades) AS ventas_totales,
  avg(venta_media) AS venta_promedio, avg(unidades) AS venta_promedio_par,
  avg(precio_medio) AS precio_promedio, count(*) AS num_skus, sum(n)::BIGINT AS transacciones
  FROM pairs GROUP BY tienda_id)"""

PRODUCT = f"""sku_id, p_name AS nombre, categoria, marca, price AS precio, cost AS costo,
  NULL::VARCHAR AS departamento, NULL::VARCHAR AS tipolinea, temporada AS season,
  price - cost AS margen,
  {rnd(div("price - cost", "price") + " * 100.0", 2)} AS margen_porcentual"""

STORE = "tienda_id, nombre, ciudad, region, formato, clima, zona"


def store_week(calendar_year: bool) -> str:
    year = "year(dia)" if calendar_year else "isoyear(dia)"
    return f"""best AS (SELECT sku_id FROM bsale GROUP BY 1 ORDER BY count(*) DESC, sku_id LIMIT 25),
    bk AS (SELECT tienda_id, {year} AS anio, weekofyear(dia) AS semana,
        list_sort(list(DISTINCT sku_id)) AS items
      FROM bsale WHERE sku_id IN (SELECT sku_id FROM best) GROUP BY 1, 2, 3)"""


def item_baskets(key: str, support: str) -> str:
    return f"""best AS (SELECT sku_id FROM bsale GROUP BY 1 ORDER BY count(*) DESC, sku_id LIMIT 25),
br0 AS (SELECT DISTINCT {key} AS basket, sku_id FROM bsale WHERE sku_id IN (SELECT sku_id FROM best)),
br AS (SELECT * FROM br0 WHERE basket IN
  (SELECT basket FROM br0 GROUP BY 1 HAVING count(*) > 1)),
nb AS (SELECT count(DISTINCT basket)::DOUBLE AS n FROM br),
one AS (SELECT sku_id AS a, count(*) AS f FROM br GROUP BY 1 HAVING count(*) >= {support} * (SELECT n FROM nb)),
two AS (SELECT x.sku_id AS a, y.sku_id AS b, count(*) AS f FROM br x JOIN br y
  ON x.basket = y.basket AND x.sku_id < y.sku_id GROUP BY 1, 2
  HAVING count(*) >= {support} * (SELECT n FROM nb))"""

RECEIPTS = item_baskets("receipt_id", "0.002")

# Sets of up to three items; no set of four reaches this support at the checked scale.

def rules(key: str, support: str) -> str:
    return f"""{item_baskets(key, support)},
three AS (SELECT x.sku_id AS a, y.sku_id AS b, z.sku_id AS c, count(*) AS f
  FROM br x JOIN br y ON x.basket = y.basket AND x.sku_id < y.sku_id
  JOIN br z ON x.basket = z.basket AND y.sku_id < z.sku_id GROUP BY 1, 2, 3
  HAVING count(*) >= {support} * (SELECT n FROM nb)),
sets AS (SELECT a AS s, f FROM one UNION ALL SELECT a || ', ' || b, f FROM two),
dirs AS (SELECT a AS l, b AS r, f FROM two UNION ALL SELECT b, a, f FROM two
  UNION ALL SELECT a, b || ', ' || c, f FROM three UNION ALL SELECT b || ', ' || c, a, f FROM three
  UNION ALL SELECT b, a || ', ' || c, f FROM three UNION ALL SELECT a || ', ' || c, b, f FROM three
  UNION ALL SELECT c, a || ', ' || b, f FROM three UNION ALL SELECT a || ', ' || b, c, f FROM three),
rules AS (SELECT d.l AS sku_origen, d.r AS sku_destino, d.f / n AS soporte,
    d.f::DOUBLE / x.f AS confianza, d.f::DOUBLE / x.f / (y.f / n) AS lift,
    CASE WHEN d.f::DOUBLE / x.f >= 1 THEN 9999.0
      ELSE {rnd("(1.0 - y.f / n) / (1.0 - d.f::DOUBLE / x.f)", 4)} END AS conviction
  FROM dirs d JOIN sets x ON x.s = d.l JOIN sets y ON y.s = d.r, nb
  WHERE d.f::DOUBLE / x.f >= 0.05)"""


RULES = rules("receipt_id", "0.002")

LOADED = "year(ts)"


def add(name: str, ctes: str, select: str, six: str = "") -> None:
    """Register a query; the columns named in ``six`` are cut to six decimals."""
    body = f"WITH {BASE}" + (f", {ctes}" if ctes else "") + "\n" + select
    if six:
        cuts = ", ".join(f"{rnd(c, 6)} AS {c}" for c in six.split())
        body = f"SELECT * REPLACE ({cuts}) FROM ({body})"
    ORACLE[name] = body


# --- scans and filters -----------------------------------------------------------------
add("scan_catalog", "", f"SELECT {PRODUCT} FROM cat")
add("products_page", "", f"SELECT {PRODUCT} FROM (SELECT * FROM cat ORDER BY id LIMIT 200)")
add("catalog_margin", "", f"""SELECT sku_id, precio, costo, margen,
  margen_porcentual FROM (SELECT {PRODUCT} FROM cat)""")
add("scan_stores", "", f"SELECT {STORE} FROM st")
add("point_lookup", "", f"SELECT {PRODUCT} FROM cat WHERE id = 17")
add("date_range", STORE_DAY, """SELECT tienda_id::BIGINT AS tienda_id, fecha::VARCHAR AS fecha,
  ventas_cop, ventas_und FROM store_day WHERE fecha BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'""")
add("regex_store_filter", "", """SELECT tienda_id::BIGINT AS tienda_id, type, count(*) AS filas,
  sum(quantity)::DOUBLE AS unidades FROM tx WHERE regexp_full_match(tienda_id, '[0-9]+') GROUP BY 1, 2""")
add("optional_filters", "", f"SELECT {STORE} FROM st WHERE formato = 'grande' AND zona = 'norte'")
add("text_search", "", """SELECT tienda_id, nombre AS tienda_nombre, ciudad, region, formato, clima, zona
  FROM st WHERE contains(lower(nombre), 'nation_1') OR contains(lower(ciudad), 'nation_1')""")
add("in_list", "", f"""SELECT month(dia)::BIGINT AS mes, count(*) AS filas,
  sum(quantity)::DOUBLE AS unidades FROM sale WHERE month(dia) IN {HIGH_SEASON_MONTHS} GROUP BY 1""")
add("history_having", BDAILY, """SELECT sku_id, tienda_id, count(*) AS registros FROM bdaily
  GROUP BY 1, 2 HAVING count(*) >= 10""")
for _name, _flag in (("basket_having", False), ("basket_calendar_year", True)):
    add(_name, store_week(_flag), """SELECT tienda_id, anio::BIGINT AS anio, semana::BIGINT AS semana,
      array_to_string(items, ', ') AS items FROM bk WHERE len(items) > 1""")
add("classify_ladder", PAIRS, f"""SELECT sku_id, tienda_id, unidades,
  {ladder("unidades", ROTATION_LADDER, ROTATION_DEFAULT)} AS clase FROM pairs""")
add("rule_cascade", FEATURES, f"""SELECT sku_id, tienda_id, ratio_stock_max >= 0.25 AS es_anomalia,
  CASE WHEN ratio_stock_max >= 0.25 THEN {CASCADE} ELSE '{ANOMALY_NONE}' END AS tipo_anomalia FROM feat""")
add("guarded_division", STORE_TYPES, f"""SELECT tienda_id,
  {div("total_devuelto", "total_ventas")} AS devuelto_vendido,
  {div("num_traslados", "num_reposiciones", "999.0")} AS traslado_reposicion FROM sty""",
    "devuelto_vendido traslado_reposicion")
add("clip_nulls", PAIRS, f"""SELECT sku_id, tienda_id, {clip("site_qty", 5.0, 60.0)} AS stock
  FROM pairs LEFT JOIN inv USING (sku_id, tienda_id)""")
add("stock_needs", "", """SELECT sku_id, tienda_id, site_qty - reserved_qty AS stock_disponible,
  site_qty + transit_qty AS stock_total_cadena,
  site_qty - reserved_qty <= min_stock AS necesita_reposicion FROM inv""")

# --- joins -----------------------------------------------------------------------------
add("join_demand_inventory", PAIRS, """SELECT sku_id, tienda_id, unidades AS demanda_anual,
  venta_media AS demanda_diaria_prom, dias_con_venta, site_qty, min_stock, max_stock,
  lead_time, categoria, marca, cost
  FROM pairs LEFT JOIN inv USING (sku_id, tienda_id) LEFT JOIN cat USING (sku_id)""",
    "demanda_diaria_prom")
add("join_star_store", f"{STORE_TYPES}, {STORE_STOCK}", """SELECT st.tienda_id, nombre AS nombre_tienda,
  ciudad, sty.* EXCLUDE (tienda_id), dias_con_venta, sinv.* EXCLUDE (tienda_id)
  FROM st LEFT JOIN sty USING (tienda_id)
  LEFT JOIN (SELECT tienda_id, count(DISTINCT dia) AS dias_con_venta FROM sale GROUP BY 1) d
    USING (tienda_id) LEFT JOIN sinv USING (tienda_id)""", "stock_prom lead_time_prom")
add("join_targets_sales", compliance_daily(), """SELECT tienda_id::BIGINT AS tienda_id,
  fecha::VARCHAR AS fecha, tienda_nombre, region, formato, meta_diaria_cop, ventas_cop, ventas_und,
  pct_diario_cop, pct_diario_und FROM cd""")
add("semi_top_skus", "", """SELECT sku_id, count(*) AS filas, sum(quantity)::DOUBLE AS unidades
  FROM sale WHERE sku_id IN (SELECT sku_id FROM sale GROUP BY 1 ORDER BY count(*) DESC, sku_id LIMIT 25)
  GROUP BY 1""")
add("anti_insert", f"{metas('1998-03-01', '1998-03-20', 'm1')}, {metas('1998-03-15', '1998-03-31', 'm2')}",
    """SELECT tienda_id::BIGINT AS tienda_id, fecha::VARCHAR AS fecha, meta_diaria_cop FROM m2
  WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.tienda_id = m2.tienda_id AND m1.fecha = m2.fecha)""")
add("first_inventory", "", "SELECT sku_id, tienda_id, site_qty, lead_time, min_stock FROM inv")

# --- aggregations ----------------------------------------------------------------------
add("pair_demand", PAIRS, """SELECT sku_id, tienda_id, unidades AS demanda_anual,
  venta_media AS demanda_diaria_prom, desviacion AS desviacion_demanda, dias_con_venta FROM pairs""",
    "demanda_diaria_prom desviacion_demanda")
add("pair_demand_window", f"""pairs AS ({PAIR_AGG} FROM sale
  WHERE dia BETWEEN DATE '2000-01-02' AND DATE '2000-12-31' GROUP BY 1, 2)""",
    """SELECT sku_id, tienda_id, unidades AS demanda_anual,
  unidades / dias_con_venta AS demanda_diaria_prom, desviacion AS desviacion_demanda,
  dias_con_venta FROM pairs""", "demanda_diaria_prom desviacion_demanda")
add("pair_revenue", f"pp AS ({PAIR_AGG} FROM sale WHERE sale_price > 0 GROUP BY 1, 2)",
    """SELECT sku_id, tienda_id, unidades, precio_medio, ingreso, n AS num_transacciones,
  primera::DATE::VARCHAR AS primera_venta, ultima::DATE::VARCHAR AS ultima_venta FROM pp""",
    "precio_medio")
add("daily_series", BDAILY, """SELECT sku_id, tienda_id, fecha::VARCHAR AS fecha, cantidad,
  precio_promedio FROM bdaily""", "precio_promedio")
add("daily_by_sku", daily("d1", "bsale", "sku_id"), """SELECT sku_id, fecha::VARCHAR AS fecha,
  cantidad, precio_promedio FROM d1""", "precio_promedio")
add("daily_by_store", STORE_DAY, """SELECT tienda_id::BIGINT AS tienda_id, fecha::VARCHAR AS fecha,
  ventas_cop, ventas_und FROM store_day""")
STATS = """stats AS (SELECT sku_id, tienda_id, avg(cantidad) AS media, stddev_samp(cantidad) AS std,
  count(*) AS registros FROM bdaily GROUP BY 1, 2 HAVING count(*) >= 5)"""
add("series_stats", f"{BDAILY}, {STATS}", "SELECT * FROM stats", "media std")
add("sku_rollup", SKU_ROLLUP, "SELECT * FROM skus", "cantidad_promedio precio_promedio")
add("store_rollup", STORE_ROLLUP, "SELECT * FROM srol",
    "venta_promedio venta_promedio_par precio_promedio")
add("store_type_summary", STORE_TYPES, "SELECT * FROM sty")
add("inventory_by_store", STORE_STOCK, "SELECT * FROM sinv", "stock_prom lead_time_prom")
add("percentiles", BDAILY, """SELECT sku_id, quantile_cont(cantidad, 0.5) AS p50,
  quantile_cont(cantidad, 0.9) AS p90, quantile_cont(cantidad, 0.95) AS p95,
  quantile_cont(cantidad, 0.99) AS p99 FROM bdaily GROUP BY 1""", "p50 p90 p95 p99")
add("label_counts", EOQ, "SELECT estado_reposicion AS etiqueta, count(*) AS cantidad FROM eoqr GROUP BY 1")
_QUARTERS = ", ".join(
    rnd(f"(sum(ventas_cop) FILTER (trimestre = {q})) / (sum(meta_diaria_cop) FILTER (trimestre = {q})) * 100.0", 2)
    + f" AS trim_q{q}" for q in (1, 2, 3, 4))
add("quarter_pivot", compliance_daily("1998-01-01", "1998-12-31"),
    f"SELECT tienda_id::BIGINT AS tienda_id, {_QUARTERS} FROM cd GROUP BY 1")
add("week_summary", f"{compliance_daily()}, {WEEK_MONTH}",
    "SELECT * REPLACE (tienda_id::BIGINT AS tienda_id) FROM wk")
add("month_summary", f"{compliance_daily()}, {WEEK_MONTH}",
    "SELECT * REPLACE (tienda_id::BIGINT AS tienda_id) FROM mo")
add("targets_by_year", metas("1997-01-01", "1998-12-31"), f"""SELECT anio::BIGINT AS anio,
  count(*) AS registros, count(DISTINCT tienda_id) AS tiendas,
  {rnd("sum(meta_diaria_cop) / count(*)")} AS meta_dia_prom,
  {rnd("sum(meta_mensual_cop) / count(*)")} AS meta_mes_prom FROM metas GROUP BY 1""")
add("format_groups", "", "SELECT coalesce(formato, 'N/A') AS etiqueta, count(*) AS cantidad FROM st GROUP BY 1")
add("distinct_cities", "", "SELECT count(*) AS total_tiendas, count(DISTINCT ciudad) AS ciudades FROM st")

# --- ordered analytics -----------------------------------------------------------------
add("share_of_total", ABC_API, "SELECT sku_id, participacion FROM abc", "participacion")
add("running_share", ABC_API, "SELECT sku_id, acumulado FROM abc", "acumulado")
RANKED = f"""{compliance_daily()}, {STORE_SUMMARY}, rk AS (SELECT tienda_id::BIGINT AS tienda_id,
  pct_cumplimiento_cop, row_number() OVER (ORDER BY pct_cumplimiento_cop DESC, tienda_id) AS ranking
  FROM ss)"""
add("store_ranking", RANKED, "SELECT * FROM rk")
add("day_index", f"{compliance_daily()}, {TREND}",
    "SELECT tienda_id::BIGINT AS tienda_id, fecha::VARCHAR AS fecha, dia FROM di")
add("first_target", metas("1998-01-01", "1998-12-31"), """SELECT tienda_id::BIGINT AS tienda_id,
  mes::BIGINT AS mes, arg_min(meta_mensual_cop, fecha) AS meta_mensual_cop FROM metas GROUP BY 1, 2""")

# --- sorts and limits ------------------------------------------------------------------
_TOP = "ORDER BY indice_rentabilidad DESC, sku_id, tienda_id LIMIT"
add("top_profit", PROFIT, f"""SELECT sku_id, tienda_id, margen_porcentual, rentabilidad_total,
  indice_rentabilidad, clasificacion FROM profit {_TOP} 10""")
add("top_profit_margin", PROFIT, f"""SELECT count(*) AS total, {rnd("avg(margen_porcentual)", 2)}
  AS promedio_margen FROM (SELECT * FROM profit {_TOP} 100)""")
add("bottom_stock", FEATURES, f"""SELECT sku_id, tienda_id, site_qty, min_stock FROM feat
  WHERE {CASCADE} = '{ANOMALY_STOCKOUT}' ORDER BY site_qty, sku_id, tienda_id LIMIT 10""")
add("coverage_risks", FEATURES, f"""SELECT sku_id, tienda_id, cobertura_dias, lead_time FROM feat
  WHERE {CASCADE} = '{ANOMALY_RISK}' ORDER BY cobertura_dias, sku_id, tienda_id LIMIT 10""")
add("urgent_orders", EOQ, f"""SELECT sku_id, tienda_id, demanda_anual, eoq FROM eoqr
  WHERE estado_reposicion = '{ORDER_NOW}' ORDER BY demanda_anual DESC, sku_id, tienda_id LIMIT 10""")
add("top3_bottom3", RANKED, """SELECT * FROM rk WHERE ranking <= 3
  OR ranking > (SELECT max(ranking) FROM rk) - 3""")
add("compliance_chart", f"{compliance_daily()}, {STORE_SUMMARY}", """SELECT
  left(tienda_nombre, 12) AS name, pct_cumplimiento_cop, ventas_cop_total AS ventas_cop,
  meta_cop_total AS meta_cop FROM ss ORDER BY pct_cumplimiento_cop DESC, tienda_id LIMIT 15""")
add("rotation_page", ROTATION, """SELECT sku_id, tienda_id, indice_velocidad FROM rot
  ORDER BY indice_velocidad DESC NULLS LAST, sku_id, tienda_id LIMIT 100""")
add("efficiency_ranking", EFFICIENCY, """SELECT tienda_id, indice_eficiencia, cobertura_reposicion
  FROM eff ORDER BY indice_eficiencia DESC, tienda_id LIMIT 10""")
add("segment_a", ABC_API, "SELECT * EXCLUDE (cantidad_total) FROM abc WHERE segmento_abc = 'A'",
    "participacion acumulado")

# --- analytics -------------------------------------------------------------------------
add("eoq", EOQ, "SELECT * FROM eoqr", "demanda_diaria_prom")
add("profitability", PROFIT, "SELECT *, NULL::VARCHAR AS departamento FROM profit", "precio_venta_prom margen_unitario")
add("rotation", ROTATION, "SELECT * FROM rot", "venta_diaria_prom")
add("rotation_classes", ROTATION, f"""SELECT
  trim(regexp_replace(clasificacion_rotacion, '[{SYMBOLS}]', '', 'g')) AS etiqueta,
  count(*) AS cantidad FROM rot GROUP BY 1""")
add("efficiency", EFFICIENCY, "SELECT * FROM eff", "lead_time_prom")
add("abc_api", ABC_API, "SELECT * EXCLUDE (cantidad_total) FROM abc", "participacion acumulado")
add("abc_detail", ABC_FULL, "SELECT * FROM abc",
    "cantidad_promedio precio_promedio participacion acumulado")
add("abc_summary", ABC_FULL, """SELECT segmento_abc, count(*) AS num_skus,
  sum(cantidad_total) AS ventas_totales FROM abc GROUP BY 1""")
add("abc_totals", ABC_API, "SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER (segmento_abc = '{s}') AS segmento_{s.lower()}" for s in "ABC") + " FROM abc")
add("store_metrics", f"{STORE_ROLLUP}, {STORE_STOCK}", """SELECT srol.*, stock_total, stock_prom,
  lead_time_prom AS lead_time, ciudad, clima, zona, formato
  FROM srol LEFT JOIN sinv USING (tienda_id) LEFT JOIN st USING (tienda_id)""",
    "venta_promedio venta_promedio_par precio_promedio stock_prom lead_time")
_COP = choose("fmt", {k: (v[0] + v[1]) // 2 for k, v in TARGET_RANGES.items()},
              sum(TARGET_RANGES["DEFAULT"][:2]) // 2)
_UND = choose("fmt", {k: (v[2] + v[3]) / 2 for k, v in TARGET_RANGES.items()},
              sum(TARGET_RANGES["DEFAULT"][2:]) / 2)
add("target_calendar", "", f"""SELECT tienda_id::BIGINT AS tienda_id, fecha::VARCHAR AS fecha,
  year(fecha)::BIGINT AS anio, month(fecha)::BIGINT AS mes, weekofyear(fecha)::BIGINT AS semana_iso,
  isodow(fecha)::BIGINT AS dia_semana, quarter(fecha)::BIGINT AS trimestre,
  month(fecha) IN {HIGH_SEASON_MONTHS} AS es_temporada_alta, c AS meta_diaria_cop,
  c * 6 AS meta_semanal_cop, c * k AS meta_mensual_cop, u AS meta_diaria_und,
  u * 6 AS meta_semanal_und, u * k AS meta_mensual_und
  FROM (SELECT tienda_id, fecha, (({_COP})::DOUBLE * {SEASON} * {SUNDAY}) / 10000 AS c,
      floor(({_UND})::DOUBLE * ({SEASON} * {SUNDAY}) / 10000)::BIGINT AS u,
      CASE WHEN month(fecha) IN (1, 3, 5, 7, 8, 10, 12) THEN 24 ELSE 22 END AS k
    FROM {calendar("1998-01-01", "1998-12-31")})""")

# --- compliance ------------------------------------------------------------------------
add("compliance_stores", COMPLIANCE, "SELECT * REPLACE (tienda_id::BIGINT AS tienda_id) FROM comp",
    "cumplimiento_prom")
add("compliance_trend", f"{compliance_daily()}, {TREND}",
    "SELECT * REPLACE (tienda_id::BIGINT AS tienda_id) FROM tr")
add("compliance_projection", f"{compliance_daily()}, {STORE_SUMMARY}", """SELECT
  tienda_id::BIGINT AS tienda_id, ventas_cop_total, meta_mensual_cop, proyeccion_cop,
  pct_proyeccion FROM sp""")
add("compliance_summary", COMPLIANCE, f"""SELECT count(*) AS total_tiendas,
  {rnd("avg(pct_cumplimiento_cop)", 2)} AS cumplimiento_global_cop,
  count(*) FILTER (pct_cumplimiento_cop >= 100) AS tiendas_sobre_meta,
  count(*) FILTER (pct_proyeccion < 80) AS tiendas_en_riesgo,
  {rnd("sum(ventas_cop_total)")} AS total_ventas_cop, {rnd("sum(meta_cop_total)")} AS total_meta_cop,
  {rnd("sum(ventas_cop_total) / sum(meta_cop_total) * 100.0", 2)} AS pct_ventas_vs_meta FROM comp""")
add("compliance_alerts", COMPLIANCE, """SELECT tienda_id::BIGINT AS tienda_id, tienda_nombre,
  pct_proyeccion FROM comp WHERE pct_proyeccion < 80""")

add("compliance_tiers_check", f"{compliance_daily()}, {STORE_SUMMARY}", """SELECT count(*) AS tiendas,
  least(4, count(*)) AS grupos, true AS en_orden, true AS cerca_del_suyo FROM ss""")
add("compliance_report_check", COMPLIANCE, f"""SELECT
  row_number() OVER (ORDER BY pct_cumplimiento_cop DESC, tienda_id) AS ranking, tienda_id::BIGINT AS tienda_id,
  tienda_nombre, ciudad, region, formato, tendencia, slope, {rnd("ventas_cop_total")} AS ventas_cop,
  {rnd("meta_cop_total")} AS meta_cop, pct_cumplimiento_cop, pct_cumplimiento_und, pct_semanal, pct_mensual,
  proyeccion_cop, meta_mensual_cop, pct_proyeccion, ticket_promedio, dias_sobre_meta, pct_dias_sobre_meta,
  mejor_dia_cop, true AS con_tier, true AS con_marca FROM comp""")

# --- baskets ---------------------------------------------------------------------------
add("basket_pairs", RECEIPTS, "SELECT a, b, f AS canastas FROM two")
_WEEK = "(tienda_id || '/' || isoyear(dia) || '/' || weekofyear(dia))"
add("basket_ladder", f"""{item_baskets(_WEEK, "0.02")},
three AS (SELECT count(*) AS f FROM br x JOIN br y ON x.basket = y.basket AND x.sku_id < y.sku_id
  JOIN br z ON x.basket = z.basket AND y.sku_id < z.sku_id GROUP BY x.sku_id, y.sku_id, z.sku_id),
sets AS (SELECT 1 AS k, f FROM one UNION ALL SELECT 2, f FROM two UNION ALL SELECT 3, f FROM three),
steps AS (SELECT s::DOUBLE AS s, (SELECT count(*) FROM sets, nb WHERE f >= ceil(s * n)) AS c
  FROM (VALUES (0.05), (0.04), (0.03), (0.02)) t(s)),
used AS (SELECT max(s) AS s FROM steps WHERE c > 5)""", """SELECT k::BIGINT AS articulos, count(*) AS conjuntos,
  sum(f)::BIGINT AS canastas, any_value(n)::BIGINT AS total, any_value(s) AS soporte, 0::BIGINT AS reglas
  FROM sets, nb, used WHERE f >= ceil(s * n) GROUP BY k""")
# All sizes: each basket's subsets, grown one later article at a time.
add("basket_low_support", f"""{item_baskets(_WEEK, "0.0003")},
held AS (SELECT basket, list_sort(list(sku_id)) AS items FROM br GROUP BY 1),
hist AS (SELECT items, count(*) AS w FROM held GROUP BY 1),
parts AS (SELECT row_number() OVER () AS id, items, w, unnest(range(1, (1 << len(items)))) AS m FROM hist)""",
    """SELECT array_to_string(list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1), ', ') AS articulos,
  sum(w)::BIGINT AS canastas, any_value(n)::BIGINT AS total FROM parts, nb
  GROUP BY 1 HAVING sum(w) >= ceil(0.0003 * any_value(n))""")
add("basket_rules", RULES, "SELECT * FROM rules", "soporte confianza lift")
add("basket_week_rules", rules("(tienda_id, isoyear(dia), weekofyear(dia))", "0.001"),
    "SELECT * FROM rules", "soporte confianza lift")
add("basket_top_rules", RULES, "SELECT * FROM rules WHERE lift >= 1.0", "soporte confianza lift")

# --- models: their inputs --------------------------------------------------------------
add("anomaly_features", FEATURES, "SELECT * FROM feat", "venta_diaria_prom")
add("risk_stats", f"{BDAILY}, {STATS}", f"""SELECT sku_id, tienda_id, media,
  {clip("coalesce(std, 1.0)", 0.1)} AS std, registros,
  coalesce(site_qty, media * 5) AS stock_actual, coalesce(lead_time, 3)::BIGINT AS lead_time
  FROM stats LEFT JOIN binv USING (sku_id, tienda_id)""", "media std stock_actual")
_TAIL = "0.319381530 -0.356563782 1.781477937 -1.821255978 1.330274429".split()


def below(x: str) -> str:
    """The standard normal distribution function (Abramowitz and Stegun 26.2.17)."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * abs({x})))"
    series = "0.0::DOUBLE"
    for factor in reversed(_TAIL):
        series = f"(({series} + ({factor})::DOUBLE) * {t})"
    tail = f"(exp(-({x}) * ({x}) / 2.0::DOUBLE) / sqrt(2.0::DOUBLE * pi()) * {series})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"


RISK = f"""{BDAILY}, {STATS},
r0 AS (SELECT sku_id, tienda_id, media, {clip("coalesce(std, 1.0)", 0.1)} AS std,
  coalesce(site_qty, media * 5)::DOUBLE AS stock, coalesce(lead_time, 3)::BIGINT AS lead_time
  FROM stats LEFT JOIN binv USING (sku_id, tienda_id)),
r1 AS (SELECT *, media / std AS z FROM r0),
r2 AS (SELECT *, {below("z")} AS b, exp(-z * z / 2.0::DOUBLE) / sqrt(2.0::DOUBLE * pi()) AS d FROM r1),
r3 AS (SELECT *, media * b + std * d AS day, (media * media + std * std) * b + media * std * d AS sq FROM r2),
r4 AS (SELECT *, day * 30 AS mean, sqrt(greatest(sq - day * day, 0.0::DOUBLE) * 30) AS spread FROM r3),
r5 AS (SELECT *, (stock - mean) / nullif(spread, 0) AS gap FROM r4),
r6 AS (SELECT *, coalesce(1.0::DOUBLE - {below("gap")},
  CASE WHEN stock < mean THEN 1.0 ELSE 0.0 END)::DOUBLE * 100 AS prob FROM r5),
risk AS (SELECT sku_id, tienda_id, {rnd("stock", 2)} AS stock_actual, lead_time,
  {rnd("media", 2)} AS demanda_media_diaria,
  {rnd("greatest(mean, 0.0)", 2)} AS demanda_p50,
  {rnd("greatest(mean + 1.2815515655::DOUBLE * spread, 0.0)", 2)} AS demanda_p90,
  {rnd("greatest(mean + 1.6448536270::DOUBLE * spread, 0.0)", 2)} AS demanda_p95,
  {rnd("greatest(mean + 2.3263478740::DOUBLE * spread, 0.0)", 2)} AS demanda_p99,
  {rnd("prob", 2)} AS prob_quiebre,
  {rnd("greatest(mean + 1.6448536270::DOUBLE * spread, 0.0)", 2)} AS stock_recomendado,
  {rnd(div("stock", "media", "999.0"), 1)} AS dias_cobertura,
  CASE WHEN prob >= 70 THEN '🔴 Riesgo alto' WHEN prob >= 40 THEN '🟡 Riesgo medio'
    WHEN prob >= 15 THEN '🟠 Riesgo bajo-medio' ELSE '🟢 Riesgo bajo' END AS nivel_riesgo,
  30::BIGINT AS dias_simulacion FROM r6)"""
add("stockout_risk", RISK, "SELECT * FROM risk")
add("risk_parts", "pinv AS (SELECT sku_id, tienda_id, site_qty, lead_time FROM inv), "
    + RISK.replace("bsale", "sale").replace("binv", "pinv"), "SELECT * FROM risk")
add("risk_levels", RISK, f"""SELECT trim(regexp_replace(nivel_riesgo, '[{SYMBOLS}]', '', 'g')) AS etiqueta,
  count(*) AS cantidad FROM risk GROUP BY 1""")
add("risk_page", RISK, """SELECT sku_id, tienda_id, prob_quiebre FROM risk
  ORDER BY prob_quiebre DESC, sku_id, tienda_id LIMIT 50""")
add("predict_features", BDAILY, f"""SELECT sku_id, tienda_id, fecha::VARCHAR AS fecha, cantidad,
  precio_promedio, clima, zona, coalesce(formato, '{UNKNOWN}') AS formato, ciudad,
  lead_time::BIGINT AS lead_time, categoria, marca, temporada, talla, '{UNKNOWN}' AS tipo_linea,
  price, cost, (isodow(fecha) - 1)::BIGINT AS dia_semana, month(fecha)::BIGINT AS mes,
  weekofyear(fecha)::BIGINT AS semana, (isodow(fecha) >= 6)::BIGINT AS es_fin_semana,
  (month(fecha) IN {HIGH_SEASON_MONTHS})::BIGINT AS temporada_alta,
  {rnd("(price - cost) / nullif(price, 0)", 4)} AS margen
  FROM bdaily LEFT JOIN st USING (tienda_id) LEFT JOIN bcat USING (sku_id)""", "precio_promedio")

# --- models: what must hold for any fit ---------------------------------------------------
add("forecast_check", daily("d1", "bsale", "sku_id"), """SELECT (30 * count(*))::BIGINT AS filas,
  count(*) AS skus, true AS minima_debajo, true AS maxima_encima, true AS sin_negativos
  FROM (SELECT sku_id FROM d1 GROUP BY 1 HAVING count(*) >= 2)""")
add("forecast_parts_check", daily("d1", "sale", "sku_id"), """SELECT count(*) AS skus, sum(n)::BIGINT AS dias,
  sum(u)::DOUBLE AS unidades, true AS ecuaciones, (30 * count(*))::BIGINT AS filas, true AS del_ajuste,
  true AS dias_siguientes
  FROM (SELECT sku_id, count(*) AS n, sum(cantidad) AS u FROM d1 GROUP BY 1 HAVING count(*) >= 2)""")
add("forecast_totals_check", daily("d1", "bsale", "sku_id"), """SELECT count(*) AS skus, count(*) AS resumen,
  true AS suman, true AS tabla FROM (SELECT sku_id FROM d1 GROUP BY 1 HAVING count(*) >= 2)""")
add("without_forecast", daily("d1", "sale", "sku_id"), """SELECT sku_id, count(*) AS dias,
  'menos de dos días con venta' AS motivo FROM d1 GROUP BY 1 HAVING count(*) < 2""")
add("anomalies_check", "", """SELECT count(*) AS filas, count(DISTINCT (sku_id, tienda_id)) AS pares,
  true AS hasta_un_decimo, true AS alguna, true AS con_nombre, true AS en_rango FROM inv""")
add("anomaly_types_check", "", "SELECT true AS suman, true AS distintas, true AS sin_normales")
add("compliance_anomalies_check", f"{compliance_daily()}, {STORE_SUMMARY}",
    "SELECT count(*) AS tiendas, true AS hasta_su_parte, true AS en_rango FROM ss")
add("predict_check", "", """SELECT count(DISTINCT (sku_id, tienda_id, dia)) AS filas,
  count(DISTINCT (sku_id, tienda_id, dia)) AS claves,
  sum(5 + 4 * month(dia) + 3 * (isodow(dia) - 1))::DOUBLE AS cantidad_real,
  true AS sin_negativos, true AS mejor_que_la_media FROM bsale""")
add("store_segments_check", STORE_ROLLUP, """SELECT count(*)::BIGINT AS tiendas, true AS varios,
  true AS en_orden FROM srol""")
add("store_segments_simple_check", STORE_ROLLUP, """SELECT count(*) AS tiendas, least(3, count(*)) AS grupos,
  true AS en_orden, true AS cerca_del_suyo FROM srol""")
add("eoq_of_sku", EOQ, "SELECT sku_id, tienda_id, eoq FROM eoqr WHERE sku_id = '17'")

# --- loads and streams -----------------------------------------------------------------
add("incremental_load", "", f"""SELECT type, {LOADED}::BIGINT AS anio, count(*) AS filas,
  sum(quantity)::DOUBLE AS unidades FROM tx GROUP BY 1, 2""")
add("load_log", "", """SELECT (SELECT max(dia)::VARCHAR FROM tx WHERE dia < DATE '2000-01-01') AS fecha_desde,
  (SELECT max(dia)::VARCHAR FROM tx) AS fecha_hasta, count(*) AS transacciones, 'exitoso' AS estado
  FROM tx WHERE dia >= DATE '2000-01-01'""")
add("later_rows", "", """SELECT tienda_id AS target_location_id, count(*) AS filas,
  sum(quantity)::DOUBLE AS unidades FROM tx WHERE dia >= DATE '2000-01-01' GROUP BY 1""")
CHANGES = """chg AS (SELECT tienda_id, sku_id, max({'d': dia, 'q': quantity}) AS c FROM tx
  WHERE type = 'devolucion' AND year(ts) = 2001 GROUP BY 1, 2)"""
add("inventory_update", CHANGES, """SELECT inv.tienda_id AS location_id, inv.sku_id,
  coalesce(c.q::DOUBLE, site_qty) AS site_qty,
  coalesce(c.d, DATE '2001-11-04')::VARCHAR AS status_date
  FROM inv LEFT JOIN chg ON inv.tienda_id = chg.tienda_id AND inv.sku_id = chg.sku_id""")
add("inventory_updated_keys", CHANGES, """SELECT count(*) AS actualizados FROM inv
  JOIN chg ON inv.tienda_id = chg.tienda_id AND inv.sku_id = chg.sku_id""")
add("freshness", "", """SELECT max(dia)::VARCHAR AS ultima_fecha,
  (DATE '2001-11-10' - max(dia))::BIGINT AS dias_pendientes,
  (DATE '2001-11-10' - max(dia)) <= 0 AS al_dia FROM tx""")
add("result_store", EFFICIENCY, f"""SELECT count(*) AS total,
  {rnd("avg(indice_eficiencia)", 2)} AS promedio_eficiencia FROM eff""")
add("stream_ingest", "", """SELECT tienda_id AS target_location_id, type, count(*) AS filas,
  sum(quantity)::DOUBLE AS unidades FROM tx GROUP BY 1, 2""")
add("stream_daily_sales", STORE_DAY, """SELECT tienda_id::BIGINT AS tienda_id, fecha::VARCHAR AS fecha,
  ventas_cop, ventas_und FROM store_day
  WHERE fecha + INTERVAL 1 DAY <= (SELECT max(ts) FROM sale) - INTERVAL 2 DAY""")
add("stream_daily_totals", STORE_DAY, """SELECT tienda_id::BIGINT AS tienda_id, fecha::VARCHAR AS fecha,
  ventas_cop, ventas_und FROM store_day""")
add("committed_load", "", f"""SELECT type, {LOADED}::BIGINT AS anio, count(*) AS filas,
  sum(quantity)::DOUBLE AS unidades FROM tx GROUP BY 1, 2""")
add("committed_log", "", """SELECT (SELECT max(dia)::VARCHAR FROM tx WHERE dia < DATE '2000-01-01') AS fecha_desde,
  (SELECT max(dia)::VARCHAR FROM tx) AS fecha_hasta, count(*) AS transacciones, 'exitoso' AS estado
  FROM tx WHERE dia >= DATE '2000-01-01'""")
add("versioned_refresh", EFFICIENCY, f"""SELECT count(*) AS total,
  {rnd("avg(indice_eficiencia)", 2)} AS promedio_eficiencia FROM eff""")
add("bucket_update", CHANGES.replace(" AND year(ts) = 2001", ""), """SELECT inv.tienda_id AS location_id, inv.sku_id,
  coalesce(c.q::DOUBLE, site_qty) AS site_qty,
  coalesce(c.d, DATE '2001-11-04')::VARCHAR AS status_date
  FROM inv LEFT JOIN chg ON inv.tienda_id = chg.tienda_id AND inv.sku_id = chg.sku_id""")
add("replaced_table", STORE_DAY, """SELECT tienda_id::BIGINT AS tienda_id, sum(ventas_und) AS unidades
  FROM store_day GROUP BY 1""")
add("appended_results", STORE_ROLLUP, """SELECT hora::BIGINT AS hora, count(*) AS tiendas,
  sum(ventas_totales) AS ventas FROM srol, range(1, 3) r(hora) GROUP BY 1""")
add("json_records", "", "SELECT sku_id, categoria, price AS precio, true AS con_nulos FROM cat")
_SPAN = "unnest(range(1, 31)) AS k FROM (SELECT sku_id, max(fecha) AS last FROM d1 GROUP BY 1 HAVING count(*) >= 2)"
add("forecast_page", daily("d1", "bsale", "sku_id"), f"""SELECT sku_id, (last + k::INTEGER)::VARCHAR AS fecha
  FROM (SELECT sku_id, last, {_SPAN}) ORDER BY sku_id, last + k::INTEGER LIMIT 100""")
add("forecast_of_sku", daily("d1", "sale", "sku_id"), f"""SELECT sku_id, (last + k::INTEGER)::VARCHAR AS fecha
  FROM (SELECT sku_id, last, {_SPAN}) WHERE sku_id = '17' ORDER BY k LIMIT 10""")
add("rotation_of_sku", ROTATION, """SELECT sku_id, tienda_id, indice_velocidad FROM rot WHERE sku_id = '17'
  ORDER BY indice_velocidad DESC NULLS LAST, tienda_id LIMIT 1""")
add("prediction_page", BDAILY, """SELECT sku_id, tienda_id, fecha::VARCHAR AS fecha, cantidad AS cantidad_real
  FROM bdaily ORDER BY sku_id, tienda_id, fecha LIMIT 100""")
add("anomaly_page_check", "", """SELECT least(count(*), 100) AS filas, count(*) >= 1010 AS marcadas,
  true AS las_menores, count(*) AS total FROM inv""")
add("kpis_check", RISK, """SELECT (SELECT count(*) FROM cat) AS total_skus, (SELECT count(*) FROM st) AS total_tiendas,
  count(*) FILTER (prob_quiebre >= 40) AS alto_riesgo, true AS criticas_marcadas FROM risk""")
add("run_all_check", f"""{BDAILY}, {STATS}, bpairs AS (SELECT sku_id, tienda_id, count(*) FILTER (sale_price > 0) AS priced
  FROM bsale GROUP BY 1, 2), {daily("d1", "bsale", "sku_id")}""", """SELECT model, 'success' AS status,
  n::BIGINT AS records_saved FROM (VALUES
  ('pronosticos', (SELECT 30 * count(*) FROM (SELECT sku_id FROM d1 GROUP BY 1 HAVING count(*) >= 2))),
  ('predicciones_lgbm', (SELECT count(*) FROM bdaily)),
  ('anomalias_inventario', (SELECT count(*) FROM binv)),
  ('eoq_resultados', (SELECT count(*) FROM bpairs)),
  ('monte_carlo', (SELECT count(*) FROM stats)),
  ('rentabilidad_sku', (SELECT count(*) FROM bpairs WHERE priced > 0)),
  ('rotacion_sku', (SELECT count(*) FROM bpairs)),
  ('eficiencia_reposicion', (SELECT count(*) FROM st)),
  ('segmentacion_skus', (SELECT count(DISTINCT sku_id) FROM bsale)),
  ('segmentacion_tiendas', (SELECT count(DISTINCT tienda_id) FROM bsale))) t(model, n)""")
