"""Gram indexes and one-to-one matches against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from conftest import SF

from pyspark.sql import functions as F

from meridial import plans
from meridial.functions.text import loose
from meridial.operators import catalogue, resolve
from meridial.operators.grams import alike, candidates, containing


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def score(kind, a, b):
    if kind == "difflib":
        return SequenceMatcher(None, a, b).ratio()
    return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def names(seed, n):
    """Names of common and rare words, with slips."""
    rng = random.Random(seed)
    words = ["band", "row", "press", "goblet", "squat", "éclair", "of", "single", "leg", *("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(40))]
    out = []
    for _ in range(n):
        x = list(" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 5))))
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.choice([0, 1])] = rng.choice(["", "z", "o"])
        out.append("".join(x))
    return [*out, "", "", "a", "b", "aaaaaaaa", "aaaaaaa", "11", "1"]


@pytest.mark.parametrize("kind", ["levenshtein", "difflib"])
@pytest.mark.parametrize("least", [0.3, 0.7, 0.8, 0.88, 0.95])
def test_no_pair_is_lost(spark, kind, least):
    xs, ys = names(1, 120), names(2, 120)
    left = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(None, None)], "i int, x string")
    right = spark.createDataFrame([(i, y) for i, y in enumerate(ys)] + [(None, None)], "j int, y string")
    want = sorted((i, j, round(score(kind, x, y), 9)) for i, x in enumerate(xs) for j, y in enumerate(ys) if score(kind, x, y) >= least)
    got = sorted((r["i"], r["j"], round(r["score"], 9)) for r in alike(left, right, "x", "y", least, kind).collect())
    assert got == want and want


def test_candidates_are_few(spark):
    xs, ys = names(3, 1500), names(4, 1500)
    left, right = spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string")
    for least, most in ((0.7, 12), (0.8, 5), (0.88, 2)):
        met, found = candidates(left, right, "x", "y", least, "levenshtein").count(), alike(left.distinct(), right.distinct(), "x", "y", least, "levenshtein").count()
        assert 0 < found <= met <= most * found


def test_pairs_meet_within_keys(spark):
    left = spark.createDataFrame([(1, "p", "band row"), (1, "q", "band row"), (None, "p", "band row")], "k int, g string, x string")
    right = spark.createDataFrame([(1, "p", "band rows"), (2, "p", "band rows"), (None, "p", "band rows")], "k int, g string, y string")
    assert [(r["k"], r["g"]) for r in alike(left, right, "x", "y", 0.8, "levenshtein", on=["k", "g"]).collect()] == [(1, "p")]


def test_containing_equals_all_pairs(spark):
    ns = names(5, 300) + ["customer#00012", "Customer", "éclair of row"]
    qs = ["", "a", "ro", "row", "and r", "éclair", "customer#000", "aaa", "aaaaaaaaa", "zzz", "xyz", " ", "of", "1", "band row"]
    queries = spark.createDataFrame([(q, i) for i, q in enumerate(qs)] + [("row", 99), (None, 100)], "q string, i int")
    got = sorted((r["i"], r["n"], r["j"]) for r in containing(queries, "q", spark.createDataFrame([(n, j) for j, n in enumerate(ns)] + [(None, -1)], "n string, j int"), "n").collect())
    assert got == sorted((i, n, j) for i, q in [*enumerate(qs), (99, "row")] for j, n in enumerate(ns) if q in n)


@pytest.mark.parametrize("seed", range(3))
def test_mutual_best_is_the_sorted_walk(spark, seed):
    rng = random.Random(seed)
    pairs = [(k, f"l{a}", f"r{b}", rng.choice([0.9, 0.95, 1.0])) for k in range(3) for a in range(9) for b in range(9) if rng.random() < 0.5]
    want = []
    for p in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if not any(w[0] == p[0] and (w[1] == p[1] or w[2] == p[2]) for w in want):
            want.append(p)
    df = spark.createDataFrame(pairs, "k int, a string, b string, score double")
    assert sorted(tuple(r) for r in resolve.mutual_best(df, ["k"], "a", "b").collect()) == sorted(want)
    assert resolve.mutual_best(df.where("false"), ["k"], "a", "b").count() == 0


@pytest.mark.parametrize("kind", ["levenshtein", "difflib"])
def test_nearest_equal_all_pairs(spark, kind):
    asked, items = ["goblet", "band rows", "zzzz", "qq", "éclair"], sorted(set(names(6, 60)))
    asked_df = spark.createDataFrame([(a,) for a in asked], "name string")
    got = sorted((r["name"], r["place"], r["id"], r["similarity"]) for r in resolve.nearest_names(asked_df, spark.createDataFrame(list(enumerate(items)), "id int, name string"), kind=kind).collect())
    plain = {r["name"]: r["l"] for r in spark.createDataFrame([(x,) for x in {*asked, *items}], "name string").select("name", loose(F.col("name")).alias("l")).collect()}
    want = []
    for a in asked:
        best = sorted((-round(score(kind, plain[a], plain[x]), 3), i) for i, x in enumerate(items))[:3]
        want += [(a, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["entity_lookup", "name_search", "anchor_neighbors", "resolve_layered", "greedy_match_edit"])
def test_no_nested_loops_and_no_groups_in_python(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("NestedLoop", "CartesianProduct", "FlatMapGroups", "Python"))


def test_catalogue_holds_the_published_metrics():
    """Counts and single definitions by literals, not by the library's tables."""
    by = {d.key: d for d in catalogue.CATALOGUE}
    assert len(by) == len(catalogue.CATALOGUE) == 228
    count = lambda test: sum(map(test, catalogue.CATALOGUE))
    assert [count(lambda d, m=m: d.modality.startswith(m)) for m in ("pitching", "hitting", "mobility", "proteus", "athletic_screen")] == [71, 48, 43, 24, 42]
    assert count(lambda d: bool(d.grades)) == 32 and count(lambda d: d.kind == "json_diff") == 7
    assert by["mob_shoulder_stability_flexion"].grades == (11, 17.5, 25) and by["mob_elbow_extension"].grades == (7, 3, 0) and by["mob_isa"].grades == ()
    d = by["pitch_time_to_max_abduction_ms"]
    assert (d.field, d.less, d.scale) == ("TIMING.MaxShoulderHorAngleTime.X", "TIMING.FootstrikeTime.X", 1000)
    assert by["pitch_lead_leg_grf_min_y_abs"].absolute and by["hit_max_bat_ang_vel_mean"].field == "PROCESSED.Max_Bat_Ang_Vel_MEAN"
    d = by["proteus_hitter_trunk_rotation_power_high"]
    assert (d.movement, d.movement_whole, d.position, d.position_not) == ("Straight Arm Trunk Rotation", True, None, "pitcher")
    assert by["screen_slv_right_auc_j"].side == "right" and by["screen_dj_rsi"].source == "screen_dj"


def test_catalogue_reads_a_source_once_and_only_its_keys(spark):
    text = '{"PLANE.Vertical_attack_angle": [5.5], "PLANE.Horizontal_attack_angle": "7", "PROCESSED.Pelvis_Angle@Contact": {"a": 1}, "other": 3}'
    trials = spark.createDataFrame([(1, "2020-01-01", text), (1, "2020-01-01", "no json"), (1, "2020-01-02", None)], "entity int, session_date string, metrics string")
    got = {(r["metric_key"], r["session_date"]): r["value"] for r in catalogue.values_by_catalogue({"hitting_trials": trials}).collect()}
    assert got == {("hit_vertical_attack_angle_at_contact", "2020-01-01"): 5.5, ("hit_horizontal_attack_angle_at_contact", "2020-01-01"): 7.0}
    plan = plans.QUERIES["catalogue_pitching_json"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1


def test_catalogue_norms_shuffle_rows_of_sessions(spark):
    """A session's values travel in one row: nothing is unpacked below the shuffle by entity; large values keep a small deviation."""
    trials = spark.createDataFrame([(e, "2020-01-01", f'{{"PLANE.Vertical_attack_angle": {1e9 + e % 3}}}') for e in range(9)] + [(0, "2020-01-01", "{}")], "entity int, session_date string, metrics string")
    people = spark.createDataFrame([(e, None if e == 8 else "PRO") for e in range(9)], "entity int, age_group string")
    out = catalogue.norms_by_catalogue({"hitting_trials": trials}, people)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.rindex("Exchange hashpartitioning(entity")
    got = out.collect()
    assert [(r["metric_key"], r["age_group"], r["n_observations"], r["p50"]) for r in got] == [("hit_vertical_attack_angle_at_contact", "PRO", 8, 1e9 + 1)]
    assert got[0]["std_value"] == pytest.approx(0.834523, abs=1e-5)
