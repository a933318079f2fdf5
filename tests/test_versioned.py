"""Committed folders: refresh, exactly-once loads, updates by bucket, mergeable days."""

import datetime as dt

import pytest
from conftest import by
from pyspark.sql import functions as F

from surtido import schemas
from surtido.sources import sinks
from surtido.sources.versioned import CommitConflict, VersionedTable
from surtido.streaming import ingest as stm

NOW = dt.datetime(2024, 5, 1)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), spark.range(0).schema)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_replace_append_and_history(spark, table):
    assert table.read().count() == 0 and table.history() == []
    assert table.replace(spark.range(5), NOW) == 5
    assert table.append(spark.range(5, 7), NOW) == 2
    assert ids(table.read()) == list(range(7))
    assert table.replace(table.read().where("id > 3"), NOW) == 3  # reads what it replaces
    assert ids(table.read()) == [4, 5, 6]
    assert table.replace(spark.range(0), NOW) == 0 and table.read().count() == 0
    assert [(r.version, r.kind, r.rows) for r in table.history()] == [
        (1, "replace", 5), (2, "append", 2), (3, "replace", 3), (4, "replace", 0)]


def test_a_failed_write_is_not_seen(spark, table):
    table.replace(spark.range(3), NOW)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for write in (table.replace, table.append):
        with pytest.raises(Exception, match="no"):
            write(broken, NOW)
    assert ids(table.read()) == [0, 1, 2] and len(table.history()) == 1


def test_a_reader_keeps_its_version(spark, table):
    table.replace(spark.range(3), NOW)
    before = table.read()
    table.replace(spark.range(10, 12), NOW)
    assert ids(before) == [0, 1, 2] and ids(table.read()) == [10, 11]
    assert table.release() == 1 and ids(table.read()) == [10, 11]


def test_two_writers_of_one_version_conflict(spark, table, monkeypatch):
    table.replace(spark.range(3), NOW)
    stale = table.history()
    table.append(spark.range(3, 4), NOW)
    with pytest.raises(CommitConflict):
        table._commit(stale, "append", "other", NOW)


def test_load_is_exactly_once(spark, frames, tmp_path, monkeypatch):
    stored = VersionedTable(spark, str(tmp_path / "tx"), schemas.TRANSACCIONES)
    feed = frames.sales([("1", "A", 1, "2024-01-01"), ("1", "A", 2, "2024-01-02")])
    assert stored.load_later(feed, NOW, since=dt.datetime(2023, 1, 1)) == 2
    more = feed.unionByName(frames.sales([("1", "A", 3, "2024-01-03"), ("1", "A", 4, "2024-01-04")]))

    def crash(*args, **kwargs):
        raise OSError("lost between rows and record")

    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(OSError):
            stored.load_later(more, NOW)
    assert stored.read().count() == 2 and stored.log().count() == 1  # neither rows nor log
    assert stored.load_later(more, NOW) == 2 and stored.load_later(more, NOW) == 0
    assert stored.read().count() == 4
    log = stored.log().orderBy("fecha_hasta").collect()
    assert [(r.fecha_desde.day, r.fecha_hasta.day, r.transacciones, r.estado) for r in log] == [
        (1, 2, 2, "exitoso"), (2, 4, 2, "exitoso")]
    stored.compact(NOW)
    assert stored.load_later(more, NOW) == 0 and stored.read().count() == 4  # the mark stays


def test_the_mark_of_replaced_rows(spark, frames, tmp_path):
    stored = VersionedTable(spark, str(tmp_path / "tx"), schemas.TRANSACCIONES)
    stored.replace(frames.sales([("1", "A", 1, "2024-01-01"), ("1", "A", 2, "2024-01-02")]), NOW)
    feed = frames.sales([("1", "A", 9, "2024-01-02"), ("1", "A", 3, "2024-01-03")])
    assert stored.load_later(feed, NOW) == 1 and stored.read().count() == 3


def test_update_writes_touched_buckets_only(spark, frames, tmp_path):
    rows = [(str(i), "A", i, 1, 9, 2) for i in range(200)]
    stock = VersionedTable(spark, str(tmp_path / "inv"), schemas.INVENTARIOS, ("location_id", "sku_id"), 16)
    assert stock.replace(frames.inventory(rows), NOW) == 200
    changes = spark.createDataFrame(
        [("A", "17", 500, dt.date(2024, 2, 1)), ("A", "17", 600, dt.date(2024, 2, 2)), ("A", "none", 1, dt.date(2024, 2, 2))],
        "location_id string, sku_id string, site_qty int, status_date date").withColumn(
        "site_qty", F.col("site_qty").cast("decimal(12,2)"))
    assert 1 <= stock.update(changes, sinks.update_inventory, NOW) <= 2
    got = by(stock.read(), "sku_id")
    assert len(got) == 200 and got["17"].site_qty == 600 and got["18"].site_qty == 18
    assert set(stock.read().columns) == set(schemas.INVENTARIOS.names)
    assert stock.history()[-1].rows < 60  # of 200
    whole = sinks.update_inventory(frames.inventory(rows), changes)
    assert stock.read().select(whole.columns).exceptAll(whole).count() == 0
    assert stock.update(changes.limit(0), sinks.update_inventory, NOW) == 0


def test_late_sales_correct_their_day(spark, frames, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    days = stm.daily_table(spark, str(tmp_path / "days"))

    def feed(*rows):
        frames.sales([("a", *r) for r in rows]).coalesce(1).write.mode("append").parquet(src)
        stm.add_daily_sales(stm.transaction_stream(spark, src, files_per_batch=1), days, ck).awaitTermination()
        return {(r.tienda_id, r.fecha.day): (r.ventas_und, r.ventas_cop) for r in stm.daily_totals(days.read()).collect()}

    assert feed(("1", 2, "2024-01-01T08:00:00"), ("1", 3, "2024-01-01T20:00:00"), ("W", 4, "2024-01-02")) == {(1, 1): (5, 50)}
    assert feed(("1", 1, "2024-01-20"), ("2", 7, "2024-01-03")) == {(1, 1): (5, 50), (1, 20): (1, 10), (2, 3): (7, 70)}
    want = {(1, 1): (6, 60), (1, 20): (1, 10), (2, 3): (7, 70)}
    assert feed(("1", 1, "2024-01-01T23:00:00")) == want  # three weeks late
    days.compact(NOW, stm.merge_days)
    read = lambda: {(r.tienda_id, r.fecha.day): (r.ventas_und, r.ventas_cop) for r in stm.daily_totals(days.read()).collect()}
    assert read() == want and days.read().count() == 3
    repeated = days.read().where("false")
    days.append(repeated, NOW, batch=1)  # a batch that comes again behind the compaction
    assert read() == want


def test_a_repeated_batch_counts_once(spark, frames, tmp_path):
    days = stm.daily_table(spark, str(tmp_path / "days"))
    batch = stm.day_sums(frames.sales([("a", "1", 2, "2024-01-01")]))
    assert days.append(batch, NOW, batch=0) == 1 and days.append(batch, NOW, batch=0) == 0
    assert days.read().count() == 1
