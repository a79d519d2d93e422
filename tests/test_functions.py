"""Hand-computed rows for the traps of row-level expressions."""

import datetime

from pyspark.sql import functions as F

from meridial.functions import rows as X
from meridial.functions import text as T



def values(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_json_numbers(spark):
    texts = ['{"a.b@c d": [41.69]}', '{"a.b@c d": 5.2}', '{"a.b@c d": "3.5"}', '{"a.b@c d": null}', '{"a.b@c d": "AMRAP"}', '{"x": 1}', '{"a.b@c d": "30d"}', "not json", None]
    m = X.json_map("v")
    assert values(spark, texts, X.json_number(m, "a.b@c d")) == [41.69, 5.2, 3.5, None, None, None, None, None, None]
    assert values(spark, texts[:6], X.has_key(m, "a.b@c d")) == [True, True, True, True, True, False]


def test_numbers_in_text(spark):
    assert values(spark, ["30d", "30f", " 8 ", "-1.5e2", "1_0", "nan", "", None, "."], X.number("v")) == [None, None, 8.0, -150.0, None, None, None, None, None]
    tokens = spark.createDataFrame([(["8", "AMRAP", "30s", "30d", "8.9", ""],), ([],), (["x"],), (None,)], "v array<string>")
    assert [r[0] for r in tokens.select(T.numbers("v", "int")).collect()] == [[8, 8], None, None, None]


def test_age_groups(spark):
    df = spark.createDataFrame([("HIGH SCHOOL ", 40), (None, 13), ("", 14), ("", 18), (None, 19), (None, 22), (None, 23), (None, None)], "g string, a int")
    assert [r[0] for r in df.select(X.age_group("g", "a")).collect()] == ["HIGH SCHOOL", "YOUTH", "HIGH SCHOOL", "HIGH SCHOOL", "COLLEGE", "COLLEGE", "PRO", "unknown"]
    assert [r[0] for r in df.select(X.age_group("g", "a", None)).collect()][-1] is None


def test_recode_bands_and_zscore(spark):
    assert values(spark, [1.0, 2.5, 3.0, 35.0, None], X.recode("v", {1: 10, 2: 20, 3: 30}), "double") == [10.0, 2.5, 30.0, 35.0, None]
    bands = [(50, 60, "Elite"), (40, 60, "Strength"), (30, 40, "Watch"), (None, 30, "Flag"), (65, None, "Watch")]
    assert values(spark, [55.0, 45.0, 62.0, 70.0, 1.0, None], X.banded("v", bands), "double") == ["Elite", "Strength", "Neutral", "Watch", "Flag", None]
    df = spark.createDataFrame([(3.0, 3.0, 1.0), (4.0, 3.0, 0.0), (None, 3.0, 1.0), (5.0, 3.0, 0.5)], "v double, m double, s double")
    assert [r[0] for r in df.select(X.zscore("v", "m", "s")).collect()] == [0.0, None, None, 4.0]


def test_cost_and_errors(spark):
    df = spark.createDataFrame([("a", 1_000_000, 2_000_000), ("unknown", 5, 5), (None, 1, 1)], "m string, i long, o long")
    assert [r[0] for r in df.select(X.cost("m", "i", "o", {"a": (0.5, 2.0)})).collect()] == [4.5, 0.0, 0.0]
    assert values(spark, ["503 x", "RESOURCE_EXHAUSTED", "bad", None], X.transient("v")) == [True, True, False, False]


def test_loose_names(spark):
    names = ["Row w/ Band", "ROW with band", "Push & Pull", "5/10/5  Shuttle!", "“Curly” – dash", None, "café"]
    assert values(spark, names, T.loose("v")) == ["row w band", "row w band", "push and pull", "5/10/5 shuttle", "curly dash", "", "caf"]
    assert values(spark, ["café", "ﬁt"], T.loose("v", fold=True)) == ["cafe", "fit"]


def test_patterns(spark):
    names = ["Trapbar  Deadlift", "Hex Bar Deadlift", "DB Row", "Reverse Throw", "zzz", None, "Drop Step", "single"]
    assert values(spark, names, T.classify("v")) == ["hip-hinge / posterior chain"] * 2 + ["horizontal pull / row", "reverse throw", "unclassified", "unclassified", "drop step", "shoulder cuff / care"]
    # a word inside another does not count when strict
    assert values(spark, ["single", "throw"], T.classify("v", strict=True)) == ["unclassified", "unclassified"]
    assert len(T.PATTERNS) == 39


def test_doses(spark):
    texts = ["3 x 5", "3x10", "1 x 60s", "2 x 1min", "5 each", None, " 4 × 6 "]
    sets = lambda d: [r if r is None else (r["sets"], r["reps"], r["reps_array"]) for r in values(spark, texts, T.dose("v", d))]
    assert [s[:2] for s in sets("catalogue")] == [(3, 5), (3, 10), (1, 60), (2, 1), (None, None), (None, None), (4, 6)]
    assert sets("payload")[2] == (1, None, []) and sets("payload")[3] == (None, None, []) and sets("payload")[0] == (3, 5, [5, 5, 5])
    assert [s[:2] for s in sets("eval")] == [(3, 5), (3, 10), (1, 60), (2, 1), (None, None), (None, None), (4, 6)]
    df = spark.createDataFrame([(3, [5, 5, 5], None), (2, [5, 6], None), (2, [], 7.9), (None, [1], 1.0)], "n int, r array<int>, a double")
    assert [r[0] for r in df.select(T.dose_text(F.col("n"), F.col("r"), F.col("a"))).collect()] == ["3 x 5", "2 x 5/6", "2 x 7", None]


def test_ids_slugs_and_units(spark):
    df = spark.createDataFrame([("4421", "12"), ("99", "1"), ("x1", "2a"), (None, None)], "f string, s string")
    got = [r[0].asDict() for r in df.select(T.taxonomy("f", "s")).collect()]
    assert got[0] == {"athlete_level": "High School", "focus": "In-Season", "sprint_days_per_week": 2, "variant_identifier": "1", "mesocycle_number": 1, "movement_bucket": "Upper", "lift_position_in_day": None}
    assert set(got[2].values()) == {None} == set(got[3].values())
    assert values(spark, ["Lower--Body / 2", "  ", None, "É a"], T.slug("v")) == ["lower_body_2", "unknown", "unknown", "é_a"]
    assert values(spark, ["OZ_32", "lb_1", "5_OZ", "None_Given", None], T.weight_text("v")) == ["32 oz", "1 lb", "5 oz", "none given", ""]
    assert values(spark, ["32 oz", "1LB", "x", None], T.weight_code("v")) == ["OZ_32", "LB_1", None, None]
    assert values(spark, ["P2 then P1", "none", None], T.level_token("v")) == ["P1", None, None]
    assert values(spark, ["Rest day", "offset", None], T.off_day("v")) == [True, False, False]


def test_dates_are_floored(spark):
    from meridial.operators.programs import duration_days

    a, b = datetime.datetime(2024, 1, 1, 12), datetime.datetime(2024, 1, 3, 11)
    df = spark.createDataFrame([(a, b), (b, a), (a, None)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(duration_days(F.col("a"), F.col("b"))).collect()] == [1, -2, None]
