"""Result labels, thresholds and calendar tables that stored results
and their readers depend on."""

# Transaction types
SALE = "venta"
REPLENISHMENT = "reposicion"
RETURN = "devolucion"
TRANSFER = "traslado"

# Months counted as high season
HIGH_SEASON_MONTHS = (1, 2, 6, 7, 10, 11, 12)

# Text used for a missing category
UNKNOWN = "desconocido"

# Pictograms that labels may carry
SYMBOLS = "🔴🟠🟡🔵⚪🟢🚀🔄🐢❄️"

# Reorder status
ORDER_NOW = "🔴 Pedir ahora"
ORDER_SOON = "🟡 Pedir pronto"
STOCK_OK = "🟢 Stock OK"

# Stock-out risk, by probability in percent
RISK_LADDER = ((70, "🔴 Riesgo alto"), (40, "🟡 Riesgo medio"), (15, "🟠 Riesgo bajo-medio"))
RISK_DEFAULT = "🟢 Riesgo bajo"

# Profitability index
PROFIT_LADDER = ((70, "🟢 Alta rentabilidad"), (40, "🟡 Rentabilidad media"))
PROFIT_DEFAULT = "🔴 Baja rentabilidad"

# Rotation index (the last label has two spaces after its pictogram)
ROTATION_LADDER = ((70, "🚀 Alta rotación"), (40, "🔄 Rotación media"), (15, "🐢 Rotación lenta"))
ROTATION_DEFAULT = "❄️  Sin movimiento"

# Replenishment efficiency index
EFFICIENCY_LADDER = ((70, "🟢 Alta eficiencia"), (45, "🟡 Eficiencia media"))
EFFICIENCY_DEFAULT = "🔴 Baja eficiencia"

# Inventory anomaly types
ANOMALY_NONE = "Normal"
ANOMALY_STOCKOUT = "🔴 Quiebre de stock"
ANOMALY_OVERSTOCK = "🟡 Sobrestock"
ANOMALY_RISK = "🟠 Riesgo de quiebre"
ANOMALY_IDLE = "🔵 Sin movimiento"
ANOMALY_OTHER = "⚪ Anomalía general"

# ABC classes: short and long form
ABC_SHORT = ("A", "B", "C")
ABC_LONG = ("A - Alta rotación", "B - Rotación media", "C - Baja rotación")

# Store clusters
STORE_LEVELS = ("Alta", "Media", "Baja")
STORE_UNCLASSIFIED = "Sin clasificar"

# Compliance tiers, best first
TIERS = ("Excelente 🏆", "Bueno ✅", "Regular ⚠️", "Crítico 🚨")

# Compliance trend by slope, in points per day
TREND_UP = "Mejorando ↑"
TREND_FLAT = "Estable →"
TREND_DOWN = "Bajando ↓"
TREND_NONE = "Sin datos"

# Daily target range by store format: value min, value max, units min, units max
TARGET_RANGES = {
    "GRANDE": (4_500_000, 7_000_000, 80, 150),
    "MEDIANO": (2_500_000, 4_500_000, 45, 90),
    "PEQUEÑO": (1_200_000, 2_500_000, 20, 50),
    "EXPRESS": (800_000, 1_800_000, 15, 40),
    "DEFAULT": (1_500_000, 3_000_000, 30, 60),
}

# Seasonal factor of the daily target by month, in percent
SEASON_PERCENT = {1: 125, 2: 120, 3: 100, 4: 95, 5: 95, 6: 120,
                  7: 125, 8: 95, 9: 100, 10: 120, 11: 130, 12: 150}

# Sunday share of the daily target, in percent
SUNDAY_PERCENT = 70

# Working days per month used for the monthly target
LONG_MONTHS = (1, 3, 5, 7, 8, 10, 12)
LONG_MONTH_DAYS = 24
SHORT_MONTH_DAYS = 22

# Working days per week used for the weekly target
WEEK_DAYS = 6

# Model inputs: inventory anomalies
ANOMALY_FEATURES = ("site_qty", "transit_qty", "reserved_qty", "min_stock", "max_stock", "lead_time",
                    "venta_diaria_prom", "venta_total", "cobertura_dias", "ratio_stock_min",
                    "ratio_stock_max", "stock_disponible")

# Model inputs: store clusters
STORE_FEATURES = ("ventas_totales", "venta_promedio", "precio_promedio", "num_skus",
                  "transacciones", "stock_total", "lead_time")

# Model inputs: compliance tiers and anomalous stores
TIER_FEATURES = ("pct_cumplimiento_cop", "pct_dias_sobre_meta", "cumplimiento_prom")

# Model inputs: daily demand, the text ones and all
DEMAND_CATEGORIES = ("clima", "zona", "formato", "ciudad", "categoria", "marca", "temporada",
                     "talla", "tipo_linea")
DEMAND_FEATURES = ("dia_semana", "mes", "semana", "es_fin_semana", "temporada_alta",
                   "clima", "zona", "formato", "ciudad", "lead_time",
                   "categoria", "marca", "temporada", "talla", "tipo_linea",
                   "price", "cost", "margen", "precio_promedio")
