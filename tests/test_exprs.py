import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surtido.functions import (
    classify,
    clip,
    guarded_div,
    iso_week_key,
    lookup,
    min_max,
    non_zero,
    rnd,
    strip_symbols,
)
from surtido.functions.labels import ROTATION_DEFAULT, ROTATION_LADDER


def test_rnd_is_half_to_even_like_numpy(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 0.125, 2.675, 1.005, 1234.565, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        got = [r[0] for r in df.select(rnd("x", digits)).collect()]
        want = [None if v is None else float(np.round(v, digits)) for v in values]
        assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=50))
def test_rnd_matches_numpy_on_any_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(rnd("x", 2)).collect()] == [float(np.round(v, 2)) for v in values]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clip("x", 2.0, 8.0)).collect()] == [2.0, 5.0, 8.0, None]
    assert [r[0] for r in df.select(clip("x", lo=2.0)).collect()] == [2.0, 5.0, 9.0, None]


def test_guarded_div(spark):
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (6.0, None), (6.0, -1.0)], "a double, b double")
    assert [r[0] for r in df.select(guarded_div("a", "b", 9.0)).collect()] == [2.0, 9.0, 9.0, 9.0]
    assert [r[0] for r in df.select(F.col("a") / non_zero("b")).collect()][:3] == [2.0, None, None]


def test_classify_sends_null_to_the_default(spark):
    df = spark.createDataFrame([(70.0,), (69.9,), (15.0,), (0.0,), (None,)], "x double")
    got = [r[0] for r in df.select(classify("x", ROTATION_LADDER, ROTATION_DEFAULT)).collect()]
    labels = [label for _, label in ROTATION_LADDER]
    assert got == [labels[0], labels[1], labels[2], ROTATION_DEFAULT, ROTATION_DEFAULT]


def test_min_max_and_lookup(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0)], "k int, x double")
    got = df.select(min_max("x", F.lit(0.0), F.lit(10.0)), lookup("k", {1: "a"}, "z")).collect()
    assert [tuple(r) for r in got] == [(0.0, "a"), (10.0 / 10.01, "z")]


def test_iso_week_around_new_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 29),), (dt.date(2024, 12, 30),),
                                (dt.date(2025, 1, 1),)], "d date")
    iso = [tuple(r) for r in df.select(*iso_week_key("d")).collect()]
    mixed = [tuple(r) for r in df.select(*iso_week_key("d", calendar_year=True)).collect()]
    assert iso == [(2024, 52), (2025, 1), (2025, 1)]
    assert mixed == [(2024, 52), (2024, 1), (2025, 1)]


def test_strip_symbols(spark):
    df = spark.createDataFrame([(ROTATION_DEFAULT,), ("🔴 Quiebre de stock",), (None,)], "x string")
    assert [r[0] for r in df.select(strip_symbols("x")).collect()] == [
        "Sin movimiento", "Quiebre de stock", None]
