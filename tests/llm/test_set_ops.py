"""Fingerprints, the Jaccard join, decontamination and mixing against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from conftest import SF

from meridial.llm import queries, set_join
from meridial.llm.decontaminate import drop_contaminated, find_contamination
from meridial.llm.fingerprint import OnePermutation, edited_fingerprints, fingerprints
from meridial.llm.mixture import draw, mix, targets
from meridial.llm.set_join import PartEnum, apart, cells_of, jaccard_components, keep_one, wide_sketch

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", "   \t\n", "one", "one two three four", "One TWO three four", "é ñ\x0bß 漢字 x", "a " * 3000, "same text here now and then again", "same text here now and then again"]


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k, lower=True):
    w = re.findall(WORD, low(text) if lower else text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def frame(spark, texts, **extra):
    """Documents with columns whose names clash with those the operators use inside."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), "x", 1.5, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, size double, place string")


def near_copies(n, seed=1):
    """Texts of which many are edits of a few, so that links form chains."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    base = [rng.choices(words, k=rng.choice([3, 8, 30, 60, 120])) for _ in range(max(1, n // 12))]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def components(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    of = list(range(len(texts)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * den >= len(a | b) * num:
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("texts, k, num", [(near_copies(240), 4, 85), (near_copies(150, 2), 5, 80), (ODD, 4, 85), (["x y z"], 4, 85)])
def test_components_equal_brute_force(spark, texts, k, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, texts), shingle=k, num=num).collect()}
    assert got == components(texts, k, num, 100)


def test_components_of_an_empty_table_and_of_null_ids(spark):
    assert jaccard_components(frame(spark, ODD).where("false")).count() == 0
    t = "a b c d e f"
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (3, t + " "), (None, "alone in here"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 3), (7, 3), (7, 3), (3, 3), (None, None), (None, None)], key=str)


@pytest.mark.parametrize("n2, k2", [(2, 1), (3, 1), (4, 2), (0, 0)])
def test_partenum_never_misses_a_pair(n2, k2):
    rng = np.random.default_rng(n2)
    scheme = PartEnum(85, 100, lambda high: (n2, k2) if n2 else cells_of(high))
    for _ in range(300):
        n = int(rng.integers(1, rng.choice([20, 90, 900])))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, 1 + n * 15 // 100))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)]))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both >= 85 * union and both < union:
            assert set(scheme.signatures(a).tolist()) & set(scheme.signatures(b).tolist())


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(3)
    texts = ODD + near_copies(40) + [" ".join(rng.choices("abcdefghijklmnop", k=600)) for _ in range(5)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = frame(spark, texts).repartition(3, "doc_id")
    got = {r["doc_id"]: r for r in edited_fingerprints(df).collect()}
    one = OnePermutation()
    errors = []
    for i, t in enumerate(texts):
        t, following, r = t or "", texts[(i + 1) % len(texts)] or "", got[i]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t, 5), shingles(edited, 5)
        errors.append(abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)))
        assert (r["fingerprint"] == "") == (not a) and 0 <= r["near_next"] <= 1
    assert np.mean(errors) < 0.05
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[8]["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints(df).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}
    assert len(one.pack(np.zeros(512, np.uint8))) == 344


def test_fingerprints_of_few_rows_and_null_ids(spark):
    assert edited_fingerprints(frame(spark, ODD).where("false")).count() == 0
    r = edited_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    df = spark.createDataFrame([(None, "aaaaaaaa"), (1, "bbbbbbbb"), (None, None), (1, "bbbbbbbb")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["edited_sha256"]) for r in edited_fingerprints(df).collect())
    want = sorted([("None", hashlib.sha256(b"").hexdigest()), ("None", hashlib.sha256(b"aaaaaabb").hexdigest()), ("1", hashlib.sha256(b"bbbbbbbb").hexdigest()), ("1", hashlib.sha256(b"bbbbbb").hexdigest())])
    assert got == want


def test_bias_correction_is_unbiased():
    rng = np.random.default_rng(5)
    one = OnePermutation()
    for share in (0.0, 0.3, 0.8):
        est = []
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
            k = round(len(x) * 2 * share / (1 + share))
            y = np.sort(np.concatenate([x[rng.permutation(len(x))[:k]], rng.integers(0, 2**63, len(x) - k).astype(np.uint64) * np.uint64(2)]))
            est.append(one.likeness(one.values(x), one.values(y)))
        assert abs(np.mean(est) - share) < 0.02


def test_wide_sketches_never_say_more_than_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((300, 300), (300, 900), (5000, 700), (2000, 2100)):
        pool = np.unique(rng.integers(0, 2**63, n + m).astype(np.uint64))
        both = pool[: min(n, m) // 2]
        x, y = np.sort(np.concatenate([both, pool[len(both) : n]])), np.sort(np.concatenate([both, pool[n : n + m - len(both)]]))
        found, true = apart(wide_sketch(x), wide_sketch(y)), len(np.setxor1d(x, y))
        assert 0.2 * true < found <= true and apart(wide_sketch(x), wide_sketch(x)) == 0


def families(rng, n: int) -> list[tuple]:
    """Rows of families of near copies; null, repeated and unique ids."""
    rows = []
    for f in range(n):
        words = [f"f{f}w{i}" for i in range(rng.choice([3, 30, 120, 700]))]
        for _ in range(rng.choice([1, 2, 5])):
            t = list(words)
            for _ in range(rng.choice([0, 0, 1, 3])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.choice([None, rng.randrange(40), rng.randrange(10**6)]), " ".join(t)))
    rows += [rng.choice(rows) for _ in range(n)] + [(None, None), (7, ""), (7, ""), (None, " ")]
    rng.shuffle(rows)
    return rows


def brute_components(texts: list, k: int, num: int, den: int) -> list[int]:
    """A representative's position for every text; texts without words stand alone."""
    sets, up = [shingles(t, k) for t in texts], list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_components_with_null_and_repeated_keys_equal_brute_force(spark):
    rng = random.Random(3)
    rows = families(rng, 40)
    of = brute_components([t for _, t in rows], 4, 85, 100)
    least = {}
    for (k, _), c in zip(rows, of, strict=True):
        least[c] = min((x for x in (least.get(c), k) if x is not None), default=None)
    want = sorted((str(k), len(shingles(t, 4)), str(least[c])) for (k, t), c in zip(rows, of, strict=True))
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, n string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(df).collect())
    assert got == want
    bridge = [(1, " ".join(f"w{i}" for i in range(60))), (None, " ".join(f"w{i}" for i in range(3, 63))), (3, " ".join(f"w{i}" for i in range(6, 66)))]
    found = jaccard_components(spark.createDataFrame(bridge, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {1}


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(4)
    rows = families(rng, 40)
    of = brute_components([t for _, t in rows], 5, 80, 100)
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id int, text string, node string")
    got = [(r["doc_id"], r["text"]) for r in keep_one(df).collect()]
    assert keep_one(df).columns == df.columns and keep_one(df.where("false")).count() == 0
    where = {}
    for (k, t), c in zip(rows, of, strict=True):
        where.setdefault((k, t), c)
    assert sum(not shingles(t, 5) for _, t in got) == 4
    worded = [(k, t) for k, t in got if shingles(t, 5)]
    found = [where[x] for x in worded]
    every = {c for (k, t), c in zip(rows, of, strict=True) if shingles(t, 5)}
    assert len(found) == len(set(found)) and set(found) == every
    least = {}
    for (k, t), c in zip(rows, of, strict=True):
        least[c] = min(least.get(c, (True, 0)), (k is None, k or 0))
    assert all((k is None, k or 0) == least[where[(k, t)]] for k, t in worded)


def test_contamination_equals_sql_and_both_paths_agree(spark, duck):
    want = duck_rows(duck.sql(queries.ORACLES["op9_decontaminate"]))
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert spark_rows(find_contamination(docs, items)) == want and want[1]
    assert spark_rows(find_contamination(docs, items, max_broadcast=0)) == want


@pytest.mark.parametrize("most", [0, 10**6])
def test_contamination_edges(spark, most):
    item = " ".join(f"w{i}" for i in range(14))  # ten shingles
    cut = " ".join(f"w{i}" for i in range(12))  # eight of them
    less = " ".join(f"w{i}" for i in range(11))
    docs = spark.createDataFrame([(1, "x " * 5000 + item.upper()), (2, cut), (3, less), (4, None), (5, ""), (None, item), (6, "short one"), (7, "Short  one"), (2, cut)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, "short one"), (12, None), (13, " "), (14, item)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["containment"]) for r in find_contamination(docs, items, max_broadcast=most).collect())
    assert got == sorted([(d, i, c) for d, c in (("1", 1.0), ("2", 0.8), ("2", 0.8), ("None", 1.0)) for i in (10, 14)] + [("6", 11, 1.0), ("7", 11, 1.0)])
    assert find_contamination(docs.where("false"), items, max_broadcast=most).count() == 0
    assert find_contamination(docs, items.where("false"), max_broadcast=most).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_short_items_are_found_inside_long_texts(spark, most):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcde", k=rng.choice([0, 1, 2, 3, 4, 5, 6, 40]))) for _ in range(60)] + [None, "x " * 3000 + "Short  ONE" + " y" * 3000, "shortone one short"]
    asked = ["short one", "a", "b c", "a b c", "d d e a", "c a b d e", "", None, "b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    low = [(t or "").lower().split() for t in texts]
    want = sorted((d, i, 1, 1) for d, t in enumerate(low) for i, q in enumerate(asked) if q and any(t[j : j + len(q.split())] == q.split() for j in range(len(t))))
    got = sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in find_contamination(docs, items, max_broadcast=most).collect())
    assert got == want and (61, 0, 1, 1) in want and (62, 0, 1, 1) not in want


@pytest.mark.parametrize("most", [0, 10**6])
def test_clean_rows_stay_whatever_their_ids_and_columns(spark, most):
    item = " ".join(f"w{i}" for i in range(14))
    rows = [(1, "y " * 99 + item, 5, "r"), (1, "other words", 6, None), (None, item, 7, "r"), (None, None, 8, "r"), (2, "", 9, "r"), (1, "other words", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, hash string")
    items = spark.createDataFrame([(3, item, 1), (None, None, 2), (3, item, 3)], "item_id long, text string, hashes int")
    kept = drop_contaminated(docs, items, max_broadcast=most)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:2] + rows[3:], key=str)
    found = sorted((str(r["doc_id"]), r["item_id"]) for r in find_contamination(docs, items, max_broadcast=most).collect())
    assert found == [("1", 3), ("1", 3), ("None", 3), ("None", 3)]


def test_mixture_equals_sql(spark, duck):
    assert spark_rows(queries.QUERIES["op3_mixture"](spark, SF)) == duck_rows(duck.sql(queries.ORACLES["op3_mixture"]))


def test_targets_stop_at_twice_the_size(spark):
    got = [(r["source"], r["target"]) for r in targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500)], "source string, source_size long")).orderBy("rank").collect()]
    # 2265 in all: a stops at 20, c at 0; b and the null source share the rest 2 to 5 until the latter stops at 1000
    assert got == [("a", 20.0), ("b", pytest.approx(1245.0)), ("c", 0.0), (None, pytest.approx(1000.0))]


def test_mixture_shards_and_edges(spark):
    rng = random.Random(0)
    texts = [" ".join(["w"] * rng.randrange(1, 40)) for _ in range(900)] + [None, "", "v " * 3000]
    docs = frame(spark, texts)
    rows = draw(docs).collect()
    again = draw(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in rows) == sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in again)
    assert len(rows) == len(texts) and all(r["taken"] == r["size"] * len(r["shards"]) <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0, r["source_size"]])[1] += r["taken"]
    # no further from the target than the source's largest document
    largest = {s: max(r["size"] for r in rows if r["source"] == s) for s in by}
    assert all(abs(taken - goal) < largest[s] for s, (goal, taken, _) in by.items())
    m = mix(docs).collect()
    assert sum(r["size"] for r in m) == sum(r["taken"] for r in rows) and {r["shard"] for r in m} == set(range(8))
    # a shard gets a pass of a document once
    assert len({(r["doc_id"], r["pass"]) for r in m}) == len(m)
    assert draw(docs.where("false")).count() == 0
    none = spark.createDataFrame([(None, None, None), (None, "a b", None), (1, "", "s")], "doc_id long, text string, source string")
    assert sorted((r["size"], r["taken"]) for r in draw(none).collect()) == [(0, 0), (0, 0), (2, 2)]


def test_null_and_repeated_keys_keep_to_the_target(spark):
    rows = [(k, " ".join([f"w{i if k is None else 0}"] * 10), src) for src, k in (("a", None), ("b", 7)) for i in range(200)] + [(i, "v " * 10, "c") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = ([(r["source"], r["doc_id"], r["taken"], tuple(r["shards"])) for r in draw(x).collect()] for x in (df, df.repartition(7, "text")))
    assert sorted(once, key=str) == sorted(again, key=str)
    goal = {r["source"]: r["target"] for r in draw(df).collect()}
    for s, want in goal.items():
        taken = sum(t for x, _, t, _ in once if x == s)
        assert abs(taken - want) < 10, (s, taken, want)


def test_leaves_have_equal_quotas(spark):
    rng = random.Random(2)
    df = frame(spark, [" ".join(["w"] * rng.randrange(1, 9)) for _ in range(700)])
    blocks = {}
    for r in mix(df).collect():
        blocks.setdefault(r["shard"], set()).add((r["source"], r["pass"], r["place"][:2]))
    # 3 sources and the null one, 256 blocks a pass; a leaf has an eighth of all drawn blocks but for rounding
    sizes = [len(b) for b in blocks.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.5 * max(sizes)
    every = [b for x in blocks.values() for b in x]
    assert len(every) <= len(set(every)) + 4  # a block goes to one shard, but for the document that fills the gap


def test_near_copies_meet_once_and_not_in_every_signature_they_share(spark, monkeypatch):
    monkeypatch.setattr(set_join, "PIECE", 100)
    # 40 signatures of one family of 30 under centre 0, and 5 signatures of centre 100 that share no member; none is linked
    family = [(s, i, i, 0, 0, 30) for s in range(40) for i in range(1, 31)]
    apart_ones = [(1000 + s, 200 + 10 * s + i, 200 + 10 * s + i, 100, 100, 6) for s in range(5) for i in range(6)]
    placed = spark.createDataFrame(family + apart_ones, "sig long, id long, component long, centre long, central long, out long")
    ids = sorted({r[1] for r in family + apart_ones})
    info = spark.createDataFrame([(i, 50, *([7] * 8)) for i in ids], "id long, n long, " + ", ".join(f"s{i} long" for i in range(8)))
    got = sorted(map(tuple, set_join.unmet(placed, info, 85, 100).collect()))
    want = [(i, j) for i in range(1, 31) for j in range(i + 1, 31)]
    want += [(200 + 10 * s + i, 200 + 10 * s + j) for s in range(5) for i in range(6) for j in range(i + 1, 6)]
    assert got == want


def test_a_family_of_near_copies_equals_brute_force(spark):
    # copies of one text, about as far from each other as the threshold allows
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(t))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, texts)).collect()}
    assert got == components(texts, 4, 85, 100)
