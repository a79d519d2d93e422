"""Small fixtures, published arithmetic and properties of the operators."""

import datetime
import json
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridial.operators import biomech, cadence, compare, corpus, facts, neighbors, norms, payload, programs, resolve, tiles
from meridial.sources import tables

D = datetime.date


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_norms_need_five_and_z_of_the_mean_is_zero(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 9, 4)] + [("b", 1.0)] * 4, "g string, value double")
    n = norms.norm_stats(v, ["g"]).collect()
    assert [(r["g"], r["n_observations"], r["mean_value"], r["p25"], r["p50"]) for r in n] == [("a", 5, 4.0, 2.0, 4.0)]


def test_as_of_takes_only_the_latest_session(spark):
    v = spark.createDataFrame([(1, D(2024, 1, 1), "m", "x", 1.0), (1, D(2024, 2, 1), "m", "y", 2.0), (1, D(2024, 3, 1), "m", "x", 3.0)], "entity int, session_date date, modality string, metric_key string, value double")
    e = spark.createDataFrame([(1, "g")], "entity int, age_group string")
    n = spark.createDataFrame([("m", "y", "g", 1.0, 0.5)], "modality string, metric_key string, age_group string, mean_value double, std_value double")
    t = spark.createDataFrame([(1, D(2024, 2, 15))], "entity int, as_of_date date")
    got = norms.asof_profiles(v, n, e, t).select("metric_key", "value", "z").collect()
    assert [tuple(r) for r in got] == [("y", 2.0, 2.0)]
    maps = norms.profile_maps(norms.asof_profiles(v, n, e, t)).first()
    assert maps["raw_values"] == {"y": 2.0} and maps["source_dates"] == {"m": D(2024, 2, 1)}


def test_session_values_average_or_keep_records(spark):
    src = spark.createDataFrame([(1, D(2024, 1, 1), 1.0, "Left"), (1, D(2024, 1, 1), 3.0, "R"), (1, D(2024, 1, 1), None, None)], "entity int, session_date date, x double, side string")
    from meridial.functions.rows import side_is

    spec = [facts.Metric("s", "m", "mean", F.col("x")), facts.Metric("s", "m", "left", F.col("x"), where=side_is("side", "l")), facts.Metric("s", "m", "each", F.col("x"), per_record=True)]
    got = facts.session_values({"s": src}, spec).select("metric_key", "value")
    assert rows(got, "metric_key", "value") == [("each", 1.0), ("each", 3.0), ("left", 1.0), ("mean", 2.0)]
    assert [m.key for m in facts.metrics_for_role([facts.Metric("s", "m", "a", F.col("x"), applies_to="pitcher"), spec[0]], "hitter")] == ["mean"]


def test_published_recalls(spark):
    counts = {"lift": (19, 70, 2), "plyo": (48, 18, 10), "prep": (31, 13, 6), "bp": (11, 6, 3)}
    items = []
    for c, (a, r, both) in counts.items():
        items += [(c, f"b{i}", True, True) for i in range(both)] + [(c, f"a{i}", True, False) for i in range(a - both)] + [(c, f"r{i}", False, True) for i in range(r - both)]
    flags = spark.createDataFrame(items, "component string, item string, in_actual boolean, in_recommended boolean").withColumn("run", F.lit(1))
    m = compare.overlap(flags, ["run", "component"])
    got = {r["component"]: (r["recall"], r["precision"], r["f1"]) for r in m.collect()}
    assert got == {"lift": (0.105, 0.029, 0.045), "plyo": (0.208, 0.556, 0.303), "prep": (0.194, 0.462, 0.273), "bp": (0.273, 0.5, 0.353)}
    assert compare.weighted_recall(m, ["run"]).first()["overall_recall"] == 0.179
    total = compare.grouped_overlap(flags, ["run"], "component").where("component IS NULL").first()
    assert (total["n_actual"], total["n_recommended"], total["n_both"]) == tuple(sum(c[i] for c in counts.values()) for i in range(3))


def test_empty_sides_have_null_measures(spark):
    flags = spark.createDataFrame([(1, "x", False, True)], "run int, item string, in_actual boolean, in_recommended boolean")
    m = compare.overlap(flags, ["run"]).first()
    assert m["recall"] is None and m["precision"] == 0.0


def test_repeated_items_take_the_last_dose(spark):
    a = spark.createDataFrame([(1, "x", "3 x 5", 0), (1, "x", "4 x 4", 1)], "run int, item string, dose string, n int")
    b = spark.createDataFrame([(1, "x", "4 x 4", 0)], "run int, item string, dose string, n int")
    assert compare.item_flags(a, b, ["run"], "item", dose="dose", order="n").first()["dose_match"]


def test_knn_is_symmetric_and_leaves_the_entity_out(spark):
    p = spark.createDataFrame([("g", e, m, float(e * (m + 1))) for e in range(6) for m in range(5)], "grp string, entity int, metric_key int, z double")
    k = neighbors.knn_profiles(p, "entity", ["grp"], k=10).collect()
    d = {(r["target"], r["neighbour"]): r["distance"] for r in k}
    assert all(a != b and d[b, a] == x for (a, b), x in d.items()) and len(d) == 30
    sparse = p.where("NOT (entity = 0 AND metric_key = 0)")
    assert all(0 not in (r["target"], r["neighbour"]) for r in neighbors.knn_profiles(sparse, "entity", ["grp"]).collect())


def test_reverse_throw_leads(spark):
    df = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "rev", 5), (1, 2, "rev", 9), (1, 3, "b", 1)], "k int, o int, n string, w int")
    got = neighbors.lead_one(df, ["k"], "o", F.col("n") == "rev", F.col("w"))
    assert rows(got.select("place", "o"), "place") == [(0, 2), (1, 0), (2, 3)]


def test_names_resolve_by_layers(spark):
    cat = spark.createDataFrame([(1, "Pull Through"), (2, "pull through"), (3, "Band Row w/ Twist"), (4, "Goblet Squat")], "id long, name string")
    names = spark.createDataFrame([("PULL THROUGH ",), ("band row with twist",), ("pull throughs",), ("zzz",), ("",)], "name string")
    got = {r["name"]: (r["id"], r["method"]) for r in resolve.resolve_names(names, cat).collect()}
    assert got == {"PULL THROUGH ": (1, "exact"), "band row with twist": (3, "loose"), "pull throughs": (1, "fuzzy"), "zzz": (None, "unmatched"), "": (None, "unmatched")}
    near = resolve.nearest_names(names.where("name = 'zzz'"), cat, top_n=2).collect()
    assert len(near) == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["band row", "band rows", "bands row", "goblet", "goblets", "x"]), min_size=1, max_size=6), st.lists(st.sampled_from(["band row", "band rowz", "goblet", "goblett"]), min_size=1, max_size=6))
def test_greedy_matches_are_one_to_one_and_maximal(spark, left, right):
    a = spark.createDataFrame([(1, n) for n in left], "k int, name string")
    b = spark.createDataFrame([(1, n) for n in right], "k int, name string")
    got = resolve.greedy_match(a, b, ["k"], threshold=0.8).collect()
    lefts, rights = [r["left_name"] for r in got], [r["right_name"] for r in got]
    assert len(set(lefts)) == len(lefts) and len(set(rights)) == len(rights)
    for x in set(left) - set(lefts):
        for y in set(right) - set(rights):
            assert SequenceMatcher(None, x, y).ratio() < 0.8


def test_upsert_is_idempotent_and_groups_vanish(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = tables.upserted(old, new, ["k"])
    assert rows(once, "k") == [(1, "a"), (2, "c"), (3, "d")] == rows(tables.upserted(once, new, ["k"]), "k")
    groups = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(tables.replaced(old, new.where("k = 2"), ["k"], groups), "k") == [(2, "c")]
    ids = rows(tables.numbered_after(spark.createDataFrame([(7,)], "id long"), new.select("v"), ["v"]), "v")
    assert ids == [("c", 8), ("d", 9)] and rows(tables.with_ids(new, ["k"])) == rows(tables.with_ids(new, ["k"]))


def test_snapshot_isolates_failures(spark, tmp_path):
    good = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")

    def reader(name):
        if name == "bad":
            raise ValueError("no such table")
        return good

    log = tables.snapshot(reader, ["good", "bad", "good"], f"file://{tmp_path}", spark)
    assert [(r["table_name"], r["status"], r["n_rows"]) for r in log.collect()] == [("good", "success", 2), ("bad", "error", None), ("good", "success", 2)]
    assert rows(tables.current(spark, f"file://{tmp_path}", "good"), "k") == [(1, None), (2, "x")]
    part = tables.write_version(good, f"file://{tmp_path}/p", partition_by=["k"])
    tables.write_version(spark.createDataFrame([(2, "y")], "k int, v string"), f"file://{tmp_path}/p", partition_by=["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"file://{tmp_path}/p").collect()) == [(1, None), (2, "y")] and part is not None


def test_catalogue_keeps_the_first_block(spark, tmp_path):
    head = {"raw": " Named ", "id_numeric": "4421", "mesocycle_id": "11", "description": "d"}
    block = lambda name: {"levels": {"L1": {"header": head, "exercises": [{"exercise": name, "sets_x_reps": "3 x 5"}, {"exercise": "b", "sets_x_reps": "5 each"}]}}}
    named = {"levels": {"L1": {"header": {"raw": " Named "}, "exercises": []}}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"index": {"4421": {"description": "x", "made_for_athletes": ["p"], "notes": None}}, "blocks": [block("first"), block("second"), named]}, indent=1))
    templates, items = tables.load_catalogue(spark, f"file://{path}")
    assert rows(templates.select("template_id", "focus", "description", "made_for_athletes"), "template_id") == [("4421-11", "In-Season", "x", ["p"]), ("Named", None, None, None)]
    assert rows(items.select("exercise_order", "exercise_name", "parsed_sets", "parsed_reps"), "exercise_order") == [(0, "first", 3, 5), (1, "b", None, None)]


def test_reports(spark, tmp_path):
    doc = {"results": [{"id": "A", "type": "scalar", "data": [{"measurement": "Fastball 1", "values": [2.0, 9.0]}, {"measurement": "Fastball 2", "values": []}]}, {"id": "S", "type": "series", "data": [{"measurement": "Fastball 1", "values": [1.0]}]}], "measurements": [{"id": "Fastball 1", "fields": [{"id": "Comments", "value": "90.5"}]}], "metadata": {"customFields": []}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    r = tables.read_reports(spark, f"file://{tmp_path}/r.json")
    assert rows(biomech.report_scalars(r, "report").select("metric", "measurement", "value")) == [("A", "Fastball 1", 2.0)]
    m = r.select("report", F.explode("measurements").alias("m")).select("report", F.col("m.id").alias("measurement"), F.get("m.fields", F.lit(0))["value"].alias("comment"))
    v = biomech.velocity_summary(biomech.fastballs(m), "report").first()
    assert (v["mean"], v["sd"], v["count"]) == (90.5, 0.0, 1)


def test_sheet_blocks_end_at_two_empty_rows(spark):
    kinds = ["x", "H", "a", "", "b", "", "", "c", "H", "d"]
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "s string, n int, k string")
    got = programs.segment_blocks(df, "s", "n", F.col("k") == "H", F.col("k") == "")
    assert rows(got.select("n", "block"), "n") == [(1, 1), (2, 1), (4, 1), (8, 2), (9, 2)]


def test_payload_writes_nulls(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", 3.0)], "k int, o int, n string, w double")
    got = json.loads(programs.payloads(df, ["k"], ["o"], ["n", "w"]).first()["payload"])
    assert got == {"k": 1, "items": [{"n": "a", "w": 3.0}, {"n": "b", "w": None}]}


def test_breakdown_counts_links_without_targets(spark):
    p = spark.createDataFrame([(1,), (2,)], "p int")
    link = spark.createDataFrame([(1, 10), (1, 10), (1, 99)], "p int, t int")
    target = spark.createDataFrame([(10, "Legs")], "t int, g string")
    got = programs.category_breakdown(p, "p", link, target, "t", F.col("g"))
    assert rows(got.select("p", "category", "n", "unique_count"), "p", "category") == [(1, "Legs", 2, 1), (1, "unknown", 1, 1), (2, "unknown", 1, 0)]


def test_cadence(spark):
    e = spark.createDataFrame([(1, "SATURDAY", False), (2, "x", True)], "e int, g string, o boolean")
    w = cadence.week(e, F.col("g"), F.col("o"))
    assert [r["level"] for r in w.where("e = 1").orderBy("dow").collect()] == ["P0", "P0", "P1", "P1", "P0", "P1", "P1"]
    assert [r["level"] for r in w.where("e = 2").orderBy("dow").collect()] == list(cadence.OFF_SEASON)
    days = spark.createDataFrame([(1, D(2024, 1, d)) for d in (1, 2, 3, 6, 7)], "e int, day date")
    seen = spark.createDataFrame([(1, D(2024, 1, 1)), (1, D(2024, 1, 2))], "e int, day date")
    assert rows(cadence.appearance_levels(days, seen, "e").select("day", "level"), "day") == [(D(2024, 1, 1), "P2"), (D(2024, 1, 2), "P0"), (D(2024, 1, 3), "P0"), (D(2024, 1, 6), "P2"), (D(2024, 1, 7), "P2")]


def test_clusters_are_deterministic(spark):
    v = spark.createDataFrame([(i, [float(i % 3) * 10 + i / 100, float(i % 3)]) for i in range(30)], "id int, v array<double>")
    a, b = (rows(corpus.cluster(corpus.standardised_vectors(v, "v"), "v", k=3, n_init=2).select("id", "cluster"), "id") for _ in range(2))
    assert a == b and len({c for _, c in a}) == 3
    pc = corpus.components(corpus.standardised_vectors(v, "v"), "v").first()["components"]
    assert len(pc) == 2


def test_labels_of_clusters(spark):
    m = spark.createDataFrame([(0, "z_max_rotation", -0.5), (0, "z_velocity", 0.9), (0, "z_b", 0.1), (1, "z_b", 0.0)], "c int, metric_key string, mean double")
    got = dict(rows(corpus.label_clusters(m, "c")))
    assert got == {0: "↓ max rot (-0.5) · ↑ vel (+0.9)", 1: "near-population-average"}


@pytest.mark.parametrize("value, pct", [(-1.0, 10.0), (0.0, 10.0), (5.0, 30.0), (10.0, 50.0), (99.0, 50.0), (None, None)])
def test_percentiles_interpolate(spark, value, pct):
    b = spark.createDataFrame([("m", 10, 0.0), ("m", 50, 10.0)], "metric string, pct int, value double")
    v = spark.createDataFrame([("m", value)], "metric string, value double")
    assert norms.interpolated_percentile(v, b).first()["percentile"] == pct


def test_empty_tables(spark):
    none = spark.createDataFrame([], "entity int, session_date date, modality string, metric_key string, value double")
    assert norms.norm_stats(none, ["modality", "metric_key"]).count() == 0
    flags = spark.createDataFrame([], "run int, item string, in_actual boolean, in_recommended boolean")
    assert compare.overlap(flags, ["run"]).count() == 0 and compare.grouped_overlap(flags, ["run"], "item").count() == 0


@pytest.mark.parametrize("kind", ["difflib", "levenshtein"])
def test_no_pair_that_reaches_the_threshold_is_lost(spark, kind):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcd ", k=rng.randrange(1, 9))) for _ in range(60)]
    left = spark.createDataFrame([(w,) for w in words[:30]], "x string")
    right = spark.createDataFrame([(w,) for w in words[30:]], "y string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    score = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if kind == "difflib" else (lambda a, b: 1 - distance(a, b) / max(len(a), len(b)))
    want = sorted((a, b) for a in words[:30] for b in words[30:] if score(a, b) >= 0.6)
    got = sorted((r["x"], r["y"]) for r in resolve.alike(left, right, "x", "y", 0.6, kind).collect())
    assert got == want and want


def test_packed_profiles_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = [(e, e % 3, f"m{m}", rng.choice([None, round(rng.uniform(-2, 2), 2)])) for e in range(24) for m in range(7) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "entity int, grp int, metric_key string, z double")
    by = {}
    for e, _, m, z in rows:
        if z is not None:
            by.setdefault(e, {})[m] = z
    want = {}
    for a in by:
        near = []
        for b in by:
            both = by[a].keys() & by[b].keys()
            if a != b and a % 3 == b % 3 and len(both) >= 3:
                near.append((round((sum((by[a][m] - by[b][m]) ** 2 for m in both) / len(both)) ** 0.5 + 1e-9, 3), b, len(both)))
        want[a] = sorted(near)[:4]
    got = {}
    for r in neighbors.knn_profiles(df, "entity", ["grp"], k=4, min_common=3).orderBy("target", "place").collect():
        got.setdefault(r["target"], []).append((r["distance"], r["neighbour"], r["n_common"]))
    assert {a: [(pytest.approx(d), b, n) for d, b, n in x] for a, x in want.items() if x} == got
    # more metrics than are written out
    wide = df.unionByName(spark.createDataFrame([(e, e % 3, f"w{i}", float(i % 3)) for e in range(24) for i in range(130)], df.schema))
    assert neighbors.knn_profiles(wide, "entity", ["grp"], k=4).count() == 24 * 4


def test_documents_survive_the_way_there_and_back(spark):
    items = spark.createDataFrame([(1, "lift", "s1", 2, "b", "3x5"), (1, "lift", "s1", 1, "a", None), (1, "plyo", "P1", 1, "zz", None), (2, "lift", "s1", 1, "a", "1x1")], "entity int, component string, session string, place int, name string, dose string")
    resolved = spark.createDataFrame([("a", 7, "exact"), ("b", 8, "fuzzy")], "name string, id long, method string")
    days = spark.createDataFrame([(1, 3, "lift", "s1")], "entity int, day int, component string, session string")
    docs = payload.compiled(items, resolved, days, "entity")
    got = sorted(map(tuple, payload.flattened(docs, "entity").collect()), key=str)
    assert got == sorted([(1, "lift", "s1", 1, "a", 7, "exact", None), (1, "lift", "s1", 2, "b", 8, "fuzzy", "3x5"), (1, "plyo", "P1", 1, "zz", None, "unmatched", None), (2, "lift", "s1", 1, "a", 7, "exact", "1x1")], key=str)
    one = json.loads({r["entity"]: r["payload"] for r in docs.collect()}[1])
    assert one["unmatched"] == ["zz"] and one["days"] == [{"day": 3, "component": "lift", "session": "s1"}]
    broken = spark.createDataFrame([(1, "{"), (2, None), (3, "{}")], "entity int, payload string")
    assert payload.flattened(broken, "entity").count() == 0


def _all_pairs(rows, k, least):
    """``rows``: {entity: (block, {metric: value})}."""
    out = []
    for a, (g, va) in rows.items():
        near = []
        for b, (h, vb) in rows.items():
            both = va.keys() & vb.keys()
            if a != b and g is not None and g == h and len(both) >= least:
                near.append((round((sum((va[m] - vb[m]) ** 2 for m in both) / len(both)) ** 0.5 + 1e-9, 3), b, len(both)))
        out += [(a, b, d, n, i) for i, (d, b, n) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def test_tiles_lose_no_neighbour(spark):
    rng = random.Random(7)
    rows = {}
    for e in range(700):
        at = rng.choice([-9.0, 0.0, 4.0, 11.0])
        # gaps, equal profiles, a block of one, entities without a block
        held = {f"m{i}": round(at + rng.random() * (0 if e % 9 == 0 else 2), 3) for i in range(8) if rng.random() < 0.85}
        rows[e] = ("one" if e == 1 else None if e % 50 == 3 else "small" if e % 20 == 4 else "big", held)
    long = spark.createDataFrame([(e, g, m, v) for e, (g, held) in rows.items() for m, v in held.items()], "entity int, grp string, metric_key string, z double")
    for least in (1, 5, 8):
        got = sorted((r["target"], r["neighbour"], r["distance"], r["n_common"], r["place"]) for r in tiles.knn_tiled(long, "entity", ["grp"], k=6, min_common=least).collect())
        want = _all_pairs(rows, 6, least)
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert tiles.knn_tiled(long.where("false"), "entity", ["grp"]).count() == 0


def test_tiles_score_a_share_of_pairs_that_falls(spark):
    rng = random.Random(3)
    shares = []
    for n in (1200, 4800):
        centres = [[rng.gauss(0, 20) for _ in range(6)] for _ in range(24)]
        rows = [(i, [c + rng.gauss(0, 1) for c in centres[i % 24]]) for i in range(n)]
        packed = spark.createDataFrame(rows, "_e int, _v array<double>")
        first, more = tiles.tiled_pairs(packed, 6, [], 5, 1, 32)
        placed = tiles.placed_in_tiles(packed, [], 32)
        own = placed.groupBy("_cell").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
        shares.append((own + more.count()) / (n * (n - 1)))
    assert shares[1] < shares[0] < 0.9 and shares[1] < 0.35, shares
