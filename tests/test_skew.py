"""One SKU, store, pair, day and receipt each hold a third of all rows; results must
equal a brute-force computation on the same rows."""

import random
from collections import defaultdict

import pytest
from conftest import by

from surtido.operators.aggregates import pair_demand, store_type_summary
from surtido.operators.basket import baskets
from surtido.operators.performance import profitability
from surtido.operators.risk import risk_stats
from surtido.operators.segmentation import abc_segmentation
from surtido.sources.sinks import insert_missing, update_inventory

N = 6000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    kinds = ["venta", "venta", "venta", "reposicion", "devolucion"]
    out = []
    for i in range(N):
        if i % 3 == 0:
            sku, store, receipt = "hot", "1", "r0"
        else:
            sku, store, receipt = f"s{rng.randint(0, 59)}", str(rng.randint(1, 12)), f"r{rng.randint(1, 900)}"
        kind = rng.choice(kinds)
        day = "2024-01-01" if i % 3 == 1 else f"2024-0{rng.randint(1, 6)}-{rng.randint(1, 28):02d}"
        out.append((sku, store, rng.randint(1, 9), rng.randint(5, 20) if kind == "venta" else 0, kind,
                    day, receipt))
    return out


@pytest.fixture(scope="module")
def tx(frames, rows):
    return frames.tx(rows).repartition(6).cache()


def test_pair_demand(tx, rows):
    want = defaultdict(list)
    for sku, store, qty, _, kind, day, _ in rows:
        if kind == "venta":
            want[sku, store].append((qty, day))
    got = by(pair_demand(tx), "sku_id", "tienda_id")
    assert got.keys() == want.keys()
    for key, items in want.items():
        assert got[key].demanda_anual == sum(q for q, _ in items)
        assert got[key].dias_con_venta == len({d for _, d in items})


def test_store_types(tx, rows):
    got = by(store_type_summary(tx), "tienda_id")
    for store in got:
        mine = [r for r in rows if r[1] == store]
        assert got[store].total_ventas == sum(r[2] for r in mine if r[4] == "venta")
        assert got[store].skus_vendidos == len({r[0] for r in mine if r[4] == "venta"})
        assert got[store].num_devoluciones == sum(r[4] == "devolucion" for r in mine)


def test_abc(tx, rows):
    totals = defaultdict(int)
    for r in rows:
        if r[4] == "venta":
            totals[r[0]] += r[2]
    got, total, run = by(abc_segmentation(tx), "sku_id"), sum(totals.values()), 0
    for sku, units in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        run += units
        assert got[sku].acumulado == pytest.approx(run / total * 100)


def test_baskets(tx, rows):
    top = defaultdict(int)
    for r in rows:
        if r[4] == "venta":
            top[r[0]] += 1
    best = {s for s, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:25]}
    want = defaultdict(set)
    for r in rows:
        if r[4] == "venta" and r[0] in best:
            want[r[6]].add(r[0])
    got = {r.receipt_id: r["items"] for r in baskets(tx, by="receipt").collect()}
    assert got == {k: sorted(v) for k, v in want.items() if len(v) > 1}


def test_profit_keeps_every_pair(tx, rows, frames):
    got = profitability(tx, frames.catalog([(1, 10, 5)]))
    assert got.count() == len({(r[0], r[1]) for r in rows if r[4] == "venta"})


def test_risk_stats_of_the_hot_pair(tx, rows, frames):
    inv = frames.inventory([("hot", "1", 7, 1, 9, 2)] * 500 + [("hot", "1", 5, 1, 9, 4)])
    r = by(risk_stats(tx, inv), "sku_id", "tienda_id")["hot", "1"]
    days = {x[5] for x in rows if x[0] == "hot" and x[4] == "venta"}
    assert r.registros == len(days) and (r.stock_actual, r.lead_time) == (5.0, 4)


def test_repeated_keys_in_loads(frames, spark):
    new = frames.inventory([("hot", "1", 7, 1, 9, 2)] * 2000 + [("a", "1", 7, 1, 9, 2)])
    stored = frames.inventory([("b", "1", 7, 1, 9, 2)])
    assert insert_missing(stored, new, ["location_id", "sku_id"]).count() == 2
    changes = new.select("location_id", "sku_id", "site_qty", "status_date")
    assert update_inventory(stored.unionByName(new.limit(1)), changes).count() == 2
