import datetime as dt

import numpy as np
import pytest
from conftest import by
from pyspark.sql import functions as F

from surtido import schemas
from surtido.functions.labels import TIERS
from surtido.operators import compliance as cmp
from surtido.operators.reports import compliance_chart, tier_counts
from surtido.operators.targets import MIDPOINTS, target_calendar, targets_by_year
from surtido.sources.sinks import insert_missing
from surtido.sources.tables import search_stores

FIRST, LAST, AS_OF = dt.date(2024, 3, 1), dt.date(2024, 3, 20), dt.date(2024, 3, 20)


def _targets(frames, rows):
    """(store, day, daily target)"""
    out = []
    for store, day, goal in rows:
        iso = day.isocalendar()
        goal = None if goal is None else int(goal)
        week = None if goal is None else goal * 6
        out.append((store, day, day.year, day.month, iso[1], iso[2], (day.month - 1) // 3 + 1, False,
                    goal, week, None if goal is None else goal * 20, 10, 60, 200))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in schemas.METAS_VENTAS]
    wide = frames.spark.createDataFrame(out, ", ".join(
        t.replace("decimal(15,2)", "long").replace("smallint", "int") for t in types))
    return wide.select(*[F.col(f.name).cast(f.dataType) for f in schemas.METAS_VENTAS])


@pytest.fixture(scope="module")
def month(frames):
    days = [FIRST + dt.timedelta(days=i) for i in range(20)]
    goals, sold = [], []
    for store in range(1, 7):
        for i, day in enumerate(days if store != 6 else days[:2]):
            goals.append((store, day, 100 + (i if store == 5 else 0)))
            amount = {1: 50 + 5 * i, 2: 100, 3: 150 - 5 * i, 4: 300 if i == 0 else 0, 5: 80, 6: 90}[store]
            if amount:
                sold.append(("s", str(store), 1, amount, "venta", day.isoformat()))
    goals += [(1, d.replace(year=2023), 999) for d in days]  # another year, same ISO weeks
    sold += [("s", "CENTRAL", 1, 5, "venta", "2024-03-05"), ("s", "1", 9, 0, "devolucion", "2024-03-05")]
    stores = frames.stores([(i, None if i == 4 else "Norte", "GRANDE") for i in range(1, 7)])
    return _targets(frames, goals), stores, frames.tx(sold)


@pytest.fixture(scope="module")
def daily(month):
    return cmp.compliance_daily(*month, FIRST, LAST).cache()


def test_store_summary(daily):
    rows = by(cmp.store_summary(daily), "tienda_id")
    assert len(rows) == 6  # the store without region stays
    r = rows[4]
    assert (r.dias_totales, r.dias_con_ventas, r.dias_sobre_meta) == (20, 1, 1)
    assert (r.ventas_cop_total, r.meta_cop_total, r.pct_cumplimiento_cop) == (300.0, 2000.0, 15.0)
    assert (r.pct_dias_sobre_meta, r.mejor_dia_cop, r.ticket_promedio) == (5.0, 300.0, 300.0)
    assert rows[5].meta_mensual_cop == 2000.0  # first day's value, though it varies
    assert rows[1].pct_cumplimiento_cop == round(sum(50 + 5 * i for i in range(20)) / 20, 2)


def test_first_known_skips_null(frames):
    goals = _targets(frames, [(1, dt.date(2024, 3, 1), None), (1, dt.date(2024, 3, 2), 7),
                              (1, dt.date(2024, 3, 3), 9)])
    assert goals.agg(cmp.first_known("meta_diaria_cop").alias("x")).first().x == 7


def test_trend(daily):
    rows = by(cmp.trend(daily), "tienda_id")
    assert (rows[1].slope, rows[1].r2, rows[1].tendencia) == (5.0, 1.0, "Mejorando ↑")
    assert (rows[2].slope, rows[2].tendencia) == (0.0, "Estable →")
    assert (rows[3].slope, rows[3].tendencia) == (-5.0, "Bajando ↓")
    assert (rows[6].slope, rows[6].tendencia) == (None, "Sin datos")
    y = np.array([300.0] + [0.0] * 19)
    assert rows[4].slope == pytest.approx(np.polyfit(np.arange(20), y, 1)[0], abs=1e-4)


def test_projection(daily):
    r = by(cmp.projection(cmp.store_summary(daily), AS_OF), "tienda_id")[2]
    assert r.proyeccion_cop == round(2000 * 31 / 20)
    assert r.pct_proyeccion == round(3100 / 2000 * 100, 2)


def test_week_month_and_quarter(month):
    wide = cmp.compliance_daily(*month, dt.date(2023, 1, 1), LAST)
    week = by(cmp.week_summary(wide, AS_OF), "tienda_id")[2]
    assert (week.ventas_semana, week.meta_semana) == (300.0, 600.0)  # Monday 18th to the 20th
    assert by(cmp.week_summary(wide, AS_OF), "tienda_id")[1].meta_semana == 600.0  # not 2023's
    assert by(cmp.month_summary(wide, AS_OF), "tienda_id")[2].pct_mensual == 100.0
    q = by(cmp.quarter_pivot(wide), "tienda_id")[2]
    assert (q.trim_q1, q.trim_q2) == (100.0, None)


def test_report(month):
    report = cmp.compliance(*month, FIRST, LAST, AS_OF, restarts=3)
    rows = by(report.tiendas, "tienda_id")
    order = sorted(rows.values(), key=lambda r: r.ranking)
    pcts = [r.pct_cumplimiento_cop for r in order]
    assert pcts == sorted(pcts, reverse=True) and [r.ranking for r in order] == [1, 2, 3, 4, 5, 6]
    assert {r.tier for r in order} <= set(TIERS) and rows[4].tier == "Crítico 🚨"
    assert rows[6].tendencia == "Sin datos"
    assert [r.ranking for r in report.top3.collect()] == [1, 2, 3]
    assert [r.ranking for r in report.bottom3.collect()] == [4, 5, 6]
    assert {r.tienda_id for r in report.alertas.collect()} == {4, 6}
    total = report.resumen_ejecutivo.first()
    assert total.total_tiendas == 6 and total.tiendas_en_riesgo == 2
    assert sum(total.distribucion_tiers.values()) == 6
    assert total.tiendas_anomalas == sum(r.es_anomalia for r in order)
    assert total.pct_ventas_vs_meta == round(total.total_ventas_cop / total.total_meta_cop * 100, 2)
    assert report.trimestres.count() == 6
    assert compliance_chart(report.tiendas, 2).count() == 2
    assert sum(r.cantidad for r in tier_counts(report.tiendas).collect()) == 6
    assert search_stores(report.tiendas, "CIUDAD 4", "Crítico 🚨").count() == 1
    assert search_stores(report.tiendas, "tienda", None).count() == 6


def test_no_targets_in_the_period(month):
    with pytest.raises(ValueError):
        cmp.compliance(*month, dt.date(2020, 1, 1), dt.date(2020, 1, 31), AS_OF)


def test_few_stores_are_never_anomalous(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(4)],
                               "tienda_id int, pct_cumplimiento_cop double, "
                               "pct_dias_sobre_meta double, cumplimiento_prom double")
    assert {r.es_anomalia for r in cmp.anomalous_stores(df).collect()} == {False}


def test_one_store_has_one_tier(spark):
    df = spark.createDataFrame([(1, 50.0, 1.0, 2.0)], "tienda_id int, pct_cumplimiento_cop double, "
                               "pct_dias_sobre_meta double, cumplimiento_prom double")
    assert [r.tier for r in cmp.compliance_tiers(df).collect()] == [TIERS[0]]


def test_target_calendar(frames):
    stores = frames.stores([(1, "Norte", "grande"), (2, "Norte", None), (3, "Norte", "kiosko")])
    cal = target_calendar(stores, dt.date(2024, 12, 28), dt.date(2025, 1, 2))
    rows = by(cal, "tienda_id", "fecha")
    assert len(rows) == 18
    sat, sun = rows[1, dt.date(2024, 12, 28)], rows[1, dt.date(2024, 12, 29)]
    base, units = MIDPOINTS["GRANDE"]
    assert sat.meta_diaria_cop == base * 1.5 and sun.meta_diaria_cop == sat.meta_diaria_cop * 7 / 10
    assert sat.meta_semanal_cop == sat.meta_diaria_cop * 6
    assert sat.meta_mensual_cop == sat.meta_diaria_cop * 24
    assert (sat.meta_diaria_und, sat.dia_semana, sun.dia_semana) == (int(units * 1.5), 6, 7)
    new_year = rows[2, dt.date(2024, 12, 30)]
    assert (new_year.anio, new_year.semana_iso, new_year.trimestre) == (2024, 1, 4)
    assert rows[3, dt.date(2025, 1, 1)].meta_diaria_cop == MIDPOINTS["DEFAULT"][0] * 1.25
    assert all(r.es_temporada_alta for r in rows.values())
    schemas.assert_schema(cal, schemas.METAS_VENTAS)
    years = by(targets_by_year(cal), "anio")
    assert (years[2024].registros, years[2024].tiendas, years[2025].registros) == (12, 3, 6)


def test_insert_missing_targets(frames):
    stores = frames.stores([(1, "Norte", "grande")])
    stored = target_calendar(stores, dt.date(2024, 1, 1), dt.date(2024, 1, 5))
    new = target_calendar(stores, dt.date(2024, 1, 4), dt.date(2024, 1, 8))
    added = insert_missing(stored, new.unionByName(new), ["tienda_id", "fecha"])
    assert sorted(r.fecha.day for r in added.collect()) == [6, 7, 8]
