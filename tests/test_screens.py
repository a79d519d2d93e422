"""Screens: published breakpoints, findings a test and patterns over tests, by literal values."""

import json

import pytest
from pyspark.sql import functions as F

from meridial.operators import screens as S

FIELDS = "e int, test string, auc_j double, kurtosis double, rpd_max_w_per_s double, work_early_pct double, ct double, rsi double, auc_pct double, pp_pct double, jh_pct double, force_pct double, velocity_pct double, ramp_time_pct double, force_at_pp double, throws string"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def screens(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], FIELDS)


def test_breakpoints_are_read_from_nested_files(spark, tmp_path):
    doc = {"note": "from a table", "dj": {"ct": {"5": 0.31, "50": 0.45, "95": 0.597, "n": 127}, "jh_in": {"5": 14.66, "95": 27.69}, "odd": 3}, "none": {}}
    (tmp_path / "points.json").write_text(json.dumps(doc))
    points = S.read_breakpoints(spark, str(tmp_path))
    got = sorted(map(tuple, points.collect()), key=str)
    assert got == sorted([("dj", "ct", 5.0, 0.31, 127), ("dj", "ct", 50.0, 0.45, 127), ("dj", "ct", 95.0, 0.597, 127), ("dj", "jh_in", 5.0, 14.66, None), ("dj", "jh_in", 95.0, 27.69, None)], key=str)
    values = spark.createDataFrame([(1, "dj", "ct", 0.38), (2, "dj", "ct", 0.2), (3, "dj", "jh_in", 30.0), (4, "cmj", "ct", 0.4), (5, "dj", "ct", None)], "e int, test string, metric string, value double")
    rows = {r["e"]: (r["percentile"], r["standing"]) for r in S.screen_percentiles(values, points).collect()}
    assert rows[1] == (pytest.approx(27.5), pytest.approx(72.5))  # shorter contact is better
    assert rows == {1: rows[1], 2: (5.0, 95.0), 3: (95.0, 95.0), 4: (None, None), 5: (None, None)}
    assert S.screen_percentiles(values, points.where("false")).where("percentile IS NOT NULL").count() == 0


@pytest.mark.parametrize(
    "row, column, want",
    [
        ({"test": "dj", "auc_j": 570.5}, "auc_label", "elite"),
        ({"test": "dj", "auc_j": 570.0}, "auc_label", "high"),
        ({"test": "dj", "auc_j": 326.0}, "auc_label", "gap"),
        ({"test": "cmj", "auc_j": 560.0}, "auc_label", "gap"),
        ({"test": "cmj", "auc_j": 1260.1}, "auc_label", "elite"),
        ({"test": "ppu", "auc_j": 701.0}, "auc_label", "elite"),
        ({"test": "slv_left", "auc_j": 1031.0}, "auc_label", "elite"),
        ({"test": "slv_right", "auc_j": 1030.0}, "auc_label", "below"),
        ({"test": "other", "auc_j": 1030.0}, "auc_label", None),
        ({"test": "dj"}, "auc_label", None),
        ({"test": "ppu", "kurtosis": -1.56}, "shape", "flat"),
        ({"test": "ppu", "kurtosis": -1.25}, "shape", "ideal"),
        ({"test": "slv_left", "kurtosis": -0.1}, "shape", "sharp"),
        ({"test": "slv_right", "rpd_max_w_per_s": 18201.0}, "ramp_elite", True),
        ({"test": "cmj", "rpd_max_w_per_s": 25200.0}, "ramp_elite", False),
        ({"test": "cmj", "force_pct": 80.0, "velocity_pct": 65.0}, "dominance", "balanced"),
        ({"test": "cmj", "force_pct": 81.0, "velocity_pct": 65.0}, "dominance", "force"),
        ({"test": "cmj", "pp_pct": 80.0, "auc_pct": 49.0}, "spike", True),
        ({"test": "cmj", "work_early_pct": 85.0, "auc_pct": 10.0}, "front_loaded", False),
        ({"test": "cmj", "rpd_max_w_per_s": 26000.0, "ramp_time_pct": 60.0}, "late_ramp", True),
        ({"test": "ppu", "pp_pct": 90.0, "jh_pct": 70.0}, "no_range", True),
        ({"test": "dj", "pp_pct": 90.0, "jh_pct": 70.0}, "no_range", None),
        ({"test": "dj", "ct": 0.33, "jh_pct": 50.0}, "jump_kind", "reactive"),
        ({"test": "dj", "ct": 0.34, "jh_pct": 90.0}, "jump_kind", "powerful"),
        ({"test": "dj", "ct": 0.3, "jh_pct": 40.0}, "jump_kind", "quick"),
        ({"test": "dj", "ct": 0.5, "jh_pct": 40.0}, "jump_kind", "neither"),
        ({"test": "dj", "ct": None, "jh_pct": 40.0}, "jump_kind", None),
        ({"test": "dj", "ct": 0.3, "rsi": 3.0}, "on_target", True),
    ],
)
def test_findings_of_one_test(spark, row, column, want):
    assert S.test_findings(screens(spark, row)).first()[column] == want


def test_patterns_over_tests(spark):
    base = {"pp_pct": 50.0, "auc_pct": 60.0, "jh_pct": 50.0, "force_pct": 50.0, "velocity_pct": 50.0, "kurtosis": -1.28}
    rows = [
        *({**base, "e": 1, "test": t} for t in ("dj", "cmj")),
        {**base, "e": 2, "test": "dj", "jh_pct": 61.0, "auc_pct": 40.0, "pp_pct": 85.0},
        {**base, "e": 2, "test": "cmj", "auc_pct": 49.0, "pp_pct": 80.0},
        *({**base, "e": 3, "test": t, "rpd_max_w_per_s": 40000.0} for t in ("dj", "cmj")),
        {**base, "e": 3, "test": "ppu", "auc_pct": 20.0, "force_pct": 90.0},
        *({**base, "e": 3, "test": t, "rpd_max_w_per_s": 100.0, "kurtosis": 0.3} for t in ("slv_left", "slv_right")),
        {**base, "e": 4, "test": "dj", "auc_pct": 10.0},
        *({**base, "e": 4, "test": t, "auc_j": 2000.0, "kurtosis": -0.5} for t in ("slv_left", "slv_right")),
        {"e": 5, "test": "dj"},
        *({**base, "e": 6, "test": t, "jh_pct": 20.0 if t == "dj" else 50.0, "velocity_pct": 90.0} for t in ("dj", "cmj")),
    ]
    got = {r["e"]: r["patterns"] for r in S.screen_patterns(S.test_findings(screens(spark, *rows)), "e").collect()}
    assert got == {
        1: ["arms_add_little"],
        2: ["arms_add", "bilateral_auc_gap", "brief_everywhere"],
        3: ["arms_add_little", "peaker", "ramp_lost_on_one_leg", "upper_bottleneck", "upper_speed_strength"],
        4: ["single_leg_only"],
        5: [],
        6: ["reactive_limit", "velocity_dominant"],
    }
    assert S.screen_patterns(S.test_findings(screens(spark, {"e": 1}).where("false")), "e").count() == 0


def test_plant_leg_may_lead(spark):
    legs = lambda e, hand, left, right, fl=1000.0, fr=1000.0: [{"e": e, "test": "slv_left", "throws": hand, "auc_j": left, "force_at_pp": fl}, {"e": e, "test": "slv_right", "throws": hand, "auc_j": right, "force_at_pp": fr}]
    rows = [*legs(1, "Right", 1000.0, 800.0), *legs(2, "L", 1000.0, 800.0), *legs(3, "right ", 1000.0, 700.0), *legs(4, None, 1.0, 2.0), *legs(5, "R", 900.0, 900.0, 1000.0, 740.0), *legs(6, "R", None, 900.0)]
    got = {r["e"]: (r["plant"], r["drive"], r["verdict"]) for r in S.leg_roles(screens(spark, *rows), "e", "throws").collect()}
    assert got == {1: (1000.0, 800.0, "expected"), 2: (800.0, 1000.0, "drive_leads"), 3: (1000.0, 700.0, "monitor"), 5: (900.0, 900.0, "monitor")}


def test_best_trial_of_a_test(spark):
    rows = spark.createDataFrame([(1, "dj", 1, 20.0), (1, "dj", 2, 25.0), (1, "dj", 3, 25.0), (1, "cmj", 1, None), (2, "dj", 1, None), (2, "dj", 2, 1.0)], "e int, test string, trial int, pp_w_per_kg double")
    best = {(r["e"], r["test"]): r["trial"] for r in S.best_trials(rows, "e", order="trial").collect()}
    assert best == {(1, "dj"): 2, (1, "cmj"): 1, (2, "dj"): 2}
    assert S.best_trials(rows.where(F.lit(False)), "e", order="trial").count() == 0
