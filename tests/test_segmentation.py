import random

from conftest import by
from pyspark.sql import functions as F

from surtido.operators.ordered import ranked, running_totals, top
from surtido.operators.segmentation import (
    abc_detail,
    abc_segmentation,
    abc_summary,
    segment_summary,
    store_segmentation,
    store_segmentation_simple,
)


def test_running_totals_match_a_plain_sum_with_heavy_ties(spark):
    rng = random.Random(1)
    # A third of the rows share one value.
    rows = [(f"k{i:05d}", 7 if i % 3 == 0 else rng.randint(0, 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = running_totals(df, [F.desc("v"), F.asc("k")], {"c": F.col("v"), "n": F.lit(1)})
    want, total = {}, 0
    for i, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        total += v
        want[k] = (total, i + 1)
    found = {r.k: (r.c, r.n) for r in got.collect()}
    assert found == want
    assert {(r.c_total, r.n_total) for r in got.collect()} == {(total, 3000)}


def test_ranked_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 10).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    a = {r.id: r.ranking for r in ranked(df, order).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = {r.id: r.ranking for r in ranked(df.repartition(5), order).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b and sorted(a.values()) == list(range(1, 501))


def test_top_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "k string, v int")
    assert [r.k for r in top(df, 2, F.desc("v"), F.asc("k")).collect()] == ["a", "b"]


def test_abc_with_equal_totals_goes_by_key(frames):
    tx = frames.sales([(s, "A", 10, "2024-01-01") for s in "edcba"])
    rows = by(abc_segmentation(tx), "sku_id")
    assert [round(rows[s].acumulado, 6) for s in "abcde"] == [20, 40, 60, 80, 100]
    assert [rows[s].segmento_abc for s in "abcde"] == ["A", "A", "A", "B", "C"]
    assert sum(r.participacion for r in rows.values()) == 100


def test_abc_leader_above_the_cut_is_not_a(frames):
    tx = frames.sales([("x", "A", 80, "2024-01-01"), ("y", "A", 15, "2024-01-01"),
                       ("z", "A", 5, "2024-01-01")])
    rows = by(abc_segmentation(tx), "sku_id")
    assert [rows[s].segmento_abc for s in "xyz"] == ["B", "C", "C"]


def test_abc_detail_and_summary(frames):
    tx = frames.sales([("x", "A", 10, "2024-01-01"), ("x", "A", 20, "2024-01-02"),
                       ("x", "B", 40, "2024-01-01"), ("y", "A", 30, "2024-01-01")])
    detail = abc_detail(tx)
    r = by(detail, "sku_id")["x"]
    assert (r.cantidad_total, r.num_tiendas, r.num_transacciones) == (70.0, 2, 3)
    assert r.cantidad_promedio == (15 + 40) / 2 and r.segmento_abc == "A - Alta rotación"
    s = by(abc_summary(detail), "segmento_abc")
    assert (s["C - Baja rotación"].num_skus, s["C - Baja rotación"].ventas_totales) == (1, 30.0)


def _three_groups(frames):
    rows = []
    for store, (skus, qty) in {"1": (2, 5), "2": (2, 6), "3": (2, 5), "4": (10, 50), "5": (10, 52),
                               "6": (10, 51), "7": (30, 200), "8": (30, 205), "9": (30, 202)}.items():
        rows += [(f"s{i}", store, qty, "2024-01-01") for i in range(skus)]
    return frames.sales(rows)


def test_planted_store_groups_are_found(frames):
    tx = _three_groups(frames)
    rows = by(store_segmentation_simple(tx, restarts=4), "tienda_id")
    names = {t: rows[t].segmento_tienda for t in rows}
    assert {names[t] for t in "789"} == {"Tienda Tipo 1"}
    assert {names[t] for t in "456"} == {"Tienda Tipo 2"}
    assert {names[t] for t in "123"} == {"Tienda Tipo 3"}


def test_number_of_store_groups_is_chosen(frames):
    tx = _three_groups(frames)
    inv = frames.inventory([("s1", str(t), 10, 1, 5, 2) for t in range(1, 9)])
    stores = frames.stores([(t, "Norte", "GRANDE") for t in range(1, 10)])
    out = store_segmentation(tx, inv, stores, restarts=2)
    rows = by(out, "tienda_id")
    assert rows["9"].stock_total is None  # the cluster feature counts it as 0
    assert rows["7"].segmento_tienda == "Tienda Tipo 1 - Alta demanda"
    assert sum(r.num_tiendas for r in segment_summary(out).collect()) == 9


def test_two_stores_are_not_classified(frames):
    tx = frames.sales([("a", "1", 1, "2024-01-01"), ("a", "2", 9, "2024-01-01")])
    assert {r.segmento_tienda for r in store_segmentation_simple(tx).collect()} == {"Sin clasificar"}


def test_slices_grow_with_the_rows(spark, monkeypatch):
    from surtido.operators import ordered

    assert [ordered.slices_for(n, 200) for n in (0, 1, 30_000, 10**7, 10**9, 10**12)] == [1, 1, 2, 200, 1000, 10**6]
    monkeypatch.setattr(ordered, "SLICE_ROWS", 7)
    df = spark.range(100).select("id", (F.col("id") * 37 % 11).alias("v"))
    got = running_totals(df, [F.desc("v"), F.asc("id")], {"c": F.col("v")}).orderBy(F.desc("v"), "id").collect()
    total = 0
    for r in got:
        total += r.v
        assert (r.c, r.c_total) == (total, sum(x.v for x in got))
