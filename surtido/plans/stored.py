"""Read side: pages and totals over result tables written by ``run_all``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtido.operators import reports
from surtido.operators.prediction import prediction_error
from surtido.sources.tables import where_equal


@dataclass
class Page:
    """The rows of a request, and one row of totals over all that it matches.

    Only the two means of a page (margin, efficiency) are those of the rows shown.
    """
    rows: DataFrame
    totals: DataFrame


def _count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


class StoredResults:
    """Lazy readers, one per kind of request; nothing runs until a frame is used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def forecasts(self, sku: str | None = None, limit: int = reports.PAGE) -> Page:
        rows = reports.get_forecasts(self.table("pronosticos"), sku, limit)
        return Page(rows, _count(rows))

    def predictions(self, sku: str | None = None, store: str | None = None,
                    limit: int = reports.PAGE) -> Page:
        stored = self.table("predicciones_lgbm")
        rows = reports.get_predictions(stored, sku, store, limit)
        return Page(rows, prediction_error(where_equal(stored, sku_id=sku, tienda_id=store)))

    def anomalies(self, tipo: str | None = None, limit: int = reports.PAGE) -> Page:
        stored = self.table("anomalias_inventario")
        rows = reports.get_anomalies(stored, tipo, limit)
        return Page(rows, reports.critical_count(where_equal(stored, tipo_anomalia=tipo)))

    def eoq(self, sku: str | None = None, store: str | None = None) -> Page:
        rows = reports.get_eoq(self.table("eoq_resultados"), sku, store)
        return Page(rows, _count(rows))

    def risk(self, sku: str | None = None, store: str | None = None) -> Page:
        rows = reports.get_risk(self.table("monte_carlo"), sku, store)
        return Page(rows, reports.high_risk_count(rows))

    def profitability(self, sku: str | None = None, limit: int = reports.PAGE) -> Page:
        rows = reports.get_profitability(self.table("rentabilidad_sku"), sku, limit)
        return Page(rows, reports.page_mean(rows, "margen_porcentual", "promedio_margen"))

    def rotation(self, sku: str | None = None, limit: int = reports.PAGE) -> Page:
        rows = reports.get_rotation(self.table("rotacion_sku"), sku, limit)
        return Page(rows, _count(rows))

    def efficiency(self, store: str | None = None) -> Page:
        rows = reports.get_efficiency(self.table("eficiencia_reposicion"), store)
        return Page(rows, reports.page_mean(rows, "indice_eficiencia", "promedio_eficiencia"))

    def segmentation(self, segment: str | None = None) -> Page:
        rows = reports.get_segmentation(self.table("segmentacion_skus"), segment)
        return Page(rows, reports.abc_totals(rows))

    def store_segments(self) -> Page:
        rows = self.table("segmentacion_tiendas").orderBy("tienda_id")
        return Page(rows, _count(rows))

    def rules(self, min_lift: float = 1.0) -> Page:
        rows = reports.get_rules(self.table("market_basket"), min_lift)
        return Page(rows, _count(rows))
