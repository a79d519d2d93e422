"""Pools at scale: what travels by target is packed, and packing loses nothing."""

import re

import pytest
from conftest import SF

from meridial import plans
from meridial.operators import neighbors, recommender
from meridial.plans import complete, recommend
from meridial.plans.registry import Tables


def test_packed_items_are_added_up_exactly(spark):
    """Null items, many times, averages that are whole, are not, and are null; each count needs another width."""
    given = [(1, "a", 2.0, 0.5)] * 300 + [(1, None, None, None)] * 2 + [(2, "a", 40_000.0, None), (2, None, 3.0, 0.25), (3, "b", None, 1e300), (None, "a", 1.0, 1.0)]
    rows = spark.createDataFrame(given, "e int, item string, whole double, part double")
    near = spark.createDataFrame([(9, 1), (9, 2), (9, 2), (9, 3), (8, 3), (7, None)], "target int, neighbour int")
    for least in (1, 2):
        got = neighbors.history_pool(near, rows, "e", ["item"], min_entities=least, averages=["whole", "part"]).collect()
        want = [
            (9, "a", 301, 2, (600.0 + 40_000) / 301, 0.5), (9, None, 3, 2, 3.0, 0.25),
            *([(9, "b", 1, 1, None, 1e300), (8, "b", 1, 1, None, 1e300)] if least == 1 else []),
        ]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert neighbors.history_pool(near, rows.where("false"), "e", ["item"]).count() == 0


@pytest.mark.parametrize("name", ["history_pool"])
def test_items_are_unpacked_where_they_are_added_up(spark, name):
    """No shuffle above the unpacking: the rows of targets times neighbours times items stay in their task."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < re.search(r"(?<!Broadcast)Exchange", plan).start()


def test_the_floor_costs_no_shuffle_of_the_pool(spark):
    """A pool that neighbours filled is read as it was written: no window over it, and its large side is joined in place."""
    t = Tables(spark, SF)
    pool = recommender.pools(recommend._knn(t), complete._prescriptions(t), complete._entities(t), staples=complete._STAPLES)
    plan = pool._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "avg_n_sets" in pool.columns


def test_a_batch_reads_its_counts_and_staples_as_tables(spark):
    """Neither is joined from the order lines again, and no shuffle of the pool is below its windows."""
    plan = plans.QUERIES["batch_recommend"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and plan.index("Window") < plan.index("Generate")
