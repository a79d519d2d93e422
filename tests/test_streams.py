"""Streams over several batches: restarts, late rows, forgotten keys."""

import datetime as dt

import random

import pytest

from meridial.operators import norms
from meridial.streaming import twins


def events(spark, folder, n, rows):
    """A file of events: (id, user, hour of the first day, value)."""
    day = dt.datetime(2024, 1, 1)
    data = [(i, u, None if h is None else day + dt.timedelta(hours=h), float(v)) for i, u, h, v in rows]
    spark.createDataFrame(data, "event_id int, user string, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_latest_state_goes_on_after_a_restart(spark, tmp_path):
    with twins.stateful(spark):
        seen = []

        def run():
            changes = twins.latest_changes(stream(spark, path), ["user"], ["ts", "event_id"])
            twins.run_once(changes, f"{tmp_path}/checkpoint", mode="update", each=twins.append_changes(f"{tmp_path}/changes"))
            rows = spark.read.parquet(f"{tmp_path}/changes")
            seen.append(rows.count())
            return {r["user"]: (r["event_id"], r["value"]) for r in twins.latest_of_changes(rows, ["user"]).collect()}

        path = events(spark, tmp_path, 0, [(1, "a", 1, 5), (2, "b", 2, 6), (3, "a", 3, 7), (4, "c", None, 1)])
        assert run() == {"a": (3, 7.0), "b": (2, 6.0)}
        # an older row of a known key and an equal one change nothing; only what changes is written
        events(spark, tmp_path, 1, [(5, "a", 2, 9), (6, "b", 4, 8), (3, "a", 3, 7)])
        assert run() == {"a": (3, 7.0), "b": (6, 8.0)}
        assert seen == [2, 3]


def test_idle_keys_are_forgotten(spark, tmp_path):
    with twins.stateful(spark):
        path = events(spark, tmp_path, 0, [(1, "a", 1, 5)])
        for more in ([(2, "b", 40, 6)], [(3, "b", 41, 6)], [(4, "a", 42, 1)]):
            changes = twins.latest_changes(stream(spark, path), ["user"], ["value"], idle=3_600_000)
            twins.run_once(changes, f"{tmp_path}/checkpoint", mode="update", each=twins.append_changes(f"{tmp_path}/changes"))
            events(spark, tmp_path, 1, more)
        changes = twins.latest_changes(stream(spark, path), ["user"], ["value"], idle=3_600_000)
        twins.run_once(changes, f"{tmp_path}/checkpoint", mode="update", each=twins.append_changes(f"{tmp_path}/changes"))
        # the last row of a has a lower value than the one forgotten, and is handed on all the same
        assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/changes").where("user = 'a'").orderBy("event_id").collect()] == [1, 4]


def test_late_rows_are_dropped_and_windows_written_once(spark, tmp_path):
    path = events(spark, tmp_path, 0, [(1, "a", 1, 5), (2, "a", 30, 1)])

    def run():
        spend = twins.rolling_spend(stream(spark, path), "user", "value", length="24 hours", slide="24 hours", cap=20.0)
        twins.run_once(spend, f"{tmp_path}/checkpoint", path=f"{tmp_path}/out", mode="append")
        return sorted((r["window_start"].day, r["spent"], r["n_calls"], r["capped"]) for r in spark.read.schema(spend.schema).parquet(f"{tmp_path}/out").collect())

    assert run() == [(1, 5.0, 1, False)]
    # the first day is closed: its row comes too late; the second day's is in time
    events(spark, tmp_path, 1, [(3, "a", 2, 100), (4, "a", 29, 30)])
    assert run() == [(1, 5.0, 1, False)]
    events(spark, tmp_path, 2, [(5, "a", 60, 1)])
    assert run() == [(1, 5.0, 1, False), (2, 31.0, 2, True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_sessions_equal_all_pairs(spark, seed):


    rng = random.Random(seed)
    day = lambda: rng.choice([None, *(dt.date(2024, 1, 1 + i) for i in range(12))])
    sessions = [(rng.choice([None, 1, 2, 3]), rng.choice(["x", "y"]), day(), rng.random()) for _ in range(60)]
    targets = [(rng.choice([None, 1, 2, 3, 4]), day()) for _ in range(20)]
    want = sorted({(e, d, m, max(s[2] for s in sessions if s[0] == e and s[1] == m and s[2] and s[2] <= d)) for e, d in targets if e and d for m in "xy" if any(s[0] == e and s[1] == m and s[2] and s[2] <= d for s in sessions)})
    df = norms.asof_sessions(spark.createDataFrame(sessions, "entity int, modality string, session_date date, value double"), spark.createDataFrame(targets, "entity int, as_of_date date"))
    assert sorted((r["entity"], r["as_of_date"], r["modality"], r["session_date"]) for r in df.collect()) == want


def test_spread_quantiles_equal_percentiles(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, rng.randint(0, 5) * 1.0, rng.uniform(-3, 3)])) for _ in range(500)] + [("one", 2.5), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    norm = lambda **kw: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in norms.norm_stats(df, ["g"], min_obs=1, **kw).collect()), key=repr)
    assert norm(spread=True) == norm() and len(norm()) == 5
    assert norms.spread_quantiles(df.where("false"), ["g"]).count() == 0
