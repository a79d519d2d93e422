"""Exact nearest profiles against brute force: odd values, several groups and buffers, no row a pair."""

import math
import random

import pytest
from conftest import SF

from meridial import plans
from meridial.operators import nearest as near
from meridial.operators import neighbors


def _brute(rows, k, by_length):
    """``rows``: (id, block, values); what the SQL of dense profiles says, nulls and not-a-number last."""
    out = []
    for a, g, va in rows:
        found = []
        for b, h, vb in rows:
            if a == b or g is None or g != h:
                continue
            gaps = [x - y for x, y in zip(va or [], vb or []) if x is not None and y is not None]
            d = math.sqrt(sum(x * x for x in gaps) / (len(va) if by_length else len(gaps))) if gaps else None
            found.append(((2, 0) if d is None else (1, 0) if math.isnan(d) else (0, d if math.isinf(d) else round(d + 1e-9, 3)), b))
        out += [(a, b, d, i) for i, (d, b) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def _said(df):
    d = lambda x: (2, 0) if x is None else (1, 0) if math.isnan(x) else (0, x)
    return sorted((r["target"], r["neighbour"], d(r["distance"]), r["place"]) for r in df.collect())


def _vectors():
    rng = random.Random(11)
    rows = []
    for i in range(260):
        v = [round(rng.gauss((i % 5) * 4, 1), 3) for _ in range(5)]
        v = {1: [None, *v[1:]], 2: v[:3], 3: [math.nan, *v[1:]], 4: [math.inf, *v[1:]], 5: [], 6: None, 7: [None] * 5, 8: [1.0] * 5, 9: [1.0] * 5, 10: [3e30] * 5}.get(i % 26, v)
        rows.append((f"e{i}", None if i % 31 == 0 else i % 2, v))
    return rows


def test_dense_profiles_with_odd_values(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "id string, grp int, v array<double>")
    assert _said(neighbors.knn_dense(df, "id", "v", ["grp"], k=6)) == _brute(rows, 6, True)


def test_groups_and_buffers_lose_no_neighbour(spark, monkeypatch):
    """As many groups of targets as there can be, and tiles of entities smaller than a buffer."""
    rows = [(i, 0, v) for i, (_, _, v) in enumerate(_vectors()) if v]
    df = spark.createDataFrame(rows, "id int, grp int, v array<double>")
    monkeypatch.setattr(near, "TARGETS", (40, 8))
    assert _said(neighbors.knn_dense(df, "id", "v", ["grp"], k=4)) == _brute(rows, 4, True)
    # in this process, so that the sizes hold
    packed = [(e, v) for e, _, v in sorted(rows)]
    monkeypatch.setattr(near, "_ROWS", 16)
    monkeypatch.setattr(near, "_MET", 32)
    group = near._Group(4, 1, False, 5, 8)
    group.buffer = 64
    import pyarrow as pa

    ids, arrays = pa.array([e for e, _ in packed]), pa.array([v for _, v in packed], pa.list_(pa.float64()))
    group.ask(ids, arrays)
    for lo in range(0, len(ids), 20):
        group.meet(ids.slice(lo, 20), arrays.slice(lo, 20))
    got = {}
    for r in (r for b in group.found() for r in b.to_pylist()):
        got.setdefault(r["target"], set()).add(r["neighbour"])
    want = {}
    for a, b, d, _ in _brute([(e, 0, v) for e, v in packed], 4, False):
        if d[0] < 2:
            want.setdefault(a, set()).add(b)
    assert got == want


@pytest.mark.parametrize("name", ["knn_dense", "knn_dense_tiled", "knn_sparse_tiled", "knn_sparse"])
def test_no_row_a_pair(spark, name):
    """What is left to Spark's windows is k rows of a target: no join within blocks."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan
