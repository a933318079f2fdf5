import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from surtido import schemas  # noqa: E402
from surtido.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def dec(x):
    return None if x is None else Decimal(str(x))


class Frames:
    """Small base tables from the fields a test cares about."""

    def __init__(self, spark):
        self.spark = spark

    def tx(self, rows):
        """(sku, store, quantity, price, type, 'YYYY-MM-DD'[, receipt])"""
        out = []
        for i, (sku, store, qty, price, kind, day, *receipt) in enumerate(rows):
            out.append((receipt[0] if receipt else f"r{i}", sku, "BODEGA_CENTRAL", store, dec(qty),
                        dec(price), kind, dt.datetime.fromisoformat(day)))
        return self.spark.createDataFrame(out, schemas.TRANSACCIONES)

    def sales(self, rows):
        """(sku, store, quantity, 'YYYY-MM-DD') at price 10"""
        return self.tx([(sku, store, qty, 10, "venta", day) for sku, store, qty, day in rows])

    def inventory(self, rows):
        """(sku, store, site, min, max, lead[, avoid])"""
        out = []
        for sku, store, site, low, high, lead, *avoid in rows:
            out.append((store, sku, dec(site), dec(0), dec(0), dec(low), dec(high), lead,
                        bool(avoid and avoid[0]), dt.date(2024, 1, 1)))
        return self.spark.createDataFrame(out, schemas.INVENTARIOS)

    def catalog(self, rows):
        """(id, price, cost)"""
        out = [(i, f"p{i}", "cat", "brand", "M", None, None, None, dec(price), dec(cost), False)
               for i, price, cost in rows]
        return self.spark.createDataFrame(out, schemas.CATALOGOS)

    def stores(self, rows):
        """(id, region, format)"""
        out = [(i, f"Tienda {i}", f"Ciudad {i}", region, fmt, "frio", "norte", 3)
               for i, region, fmt in rows]
        return self.spark.createDataFrame(out, schemas.TIENDAS)


@pytest.fixture(scope="session")
def frames(spark):
    return Frames(spark)


def by(df, *keys):
    """Rows of a small result by key."""
    out = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        out[key[0] if len(keys) == 1 else key] = r
    return out
