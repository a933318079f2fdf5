"""Registered queries against their SQL, and the shape of their plans."""

import re

import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.check import compare, duck

SQLS = entry.oracle_sql()
QUERIES = entry.queries()
# At this scale sets of four items reach the support of the rules' SQL.
OTHER_SCALE = {"basket_rules", "basket_top_rules", "basket_week_rules"}
# Variants of model runs that other tests cover.
SLOW = {"run_all_models", "kpis", "store_segments", "store_segment_summary", "compliance_executive",
        "compliance_anomalies", "compliance_tiers", "anomaly_types", "risk_levels",
        "forecast_totals", "forecast_top10", "predict", "feature_importance"}
# Model runs whose SQL the check tool and the driver compare.
SLOW_SQL = {"predict_check", "store_segments_check"}
# Queries of optional subpackages have tests of their own.
OWN = {"pipeline"} | {name for name in QUERIES if re.match(r"op\d+_", name)}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_its_query():
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(SQLS) - OTHER_SCALE - SLOW_SQL - OWN))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, con, SQLS[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", sorted(OTHER_SCALE))
def test_rules_equal_sql(spark, name):
    big = SF.replace("0.001", "0.01")
    assert compare(QUERIES[name](spark, big), duck(big), SQLS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS) - SLOW - OWN))
def test_model_query_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.collect()) > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
