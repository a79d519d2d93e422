"""Every registered query against its oracle; queries without one must run."""

import pytest
from compare import duck_rows, spark_rows
from conftest import SF

from meridial import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_oracle(spark, duck, name):
    assert spark_rows(plans.QUERIES[name](spark, SF)) == duck_rows(duck.sql(plans.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_reports_take_every_event(spark, duck):
    got = {r["user_id"]: r["click"] for r in plans.QUERIES["report_features_all"](spark, SF).collect()}
    want = duck.sql("SELECT user_id, avg(value) FROM events WHERE event_type = 'click' GROUP BY 1").fetchall()
    assert got and all(abs(got[u] - v) < 1e-4 for u, v in want if u in got)


def test_texts_of_every_language_are_taken(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert plans.QUERIES["loose_normalize_all_texts"](spark, SF).count() == n
    assert plans.QUERIES["pattern_classify_all_texts"](spark, SF).groupBy().sum("n").first()[0] == n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["norm_stats", "asof_zscore_profile", "set_compare", "history_pool", "resolve_layered"])
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["upsert_norms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderkey" not in plan
