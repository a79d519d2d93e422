"""Neighbours, pools, name resolution and comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridial.functions import text as T
from meridial.operators import compare as C
from meridial.operators import neighbors as N
from meridial.operators import resolve as S
from meridial.operators import tiles
from meridial.operators.norms import top
from meridial.plans.programs import classify_sql
from meridial.plans.registry import R4, Tables, query, r4
from meridial.sources.scratch import written

# ---- neighbours -----------------------------------------------------------


def _long(t: Tables) -> DataFrame:
    """Per customer, mean prices in ten thousands by priority and status; blocks are segment and nation."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    key = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    return o.groupBy("c_mktsegment", "c_nationkey", "c_custkey", key.alias("metric_key")).agg((F.avg("o_totalprice") / 10000).alias("z"))


_LONG = "SELECT c_mktsegment, c_nationkey, c_custkey, o_orderpriority || '/' || o_orderstatus AS metric_key, avg(o_totalprice) / 10000 AS z FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
_KNN = f"""l AS ({_LONG}), d AS (SELECT a.c_custkey AS target, b.c_custkey AS neighbour, round(sqrt(sum((a.z - b.z) ** 2) / count(*)) + 1e-9, 3) AS distance, count(*)::BIGINT AS n_common
    FROM l a JOIN l b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND a.metric_key = b.metric_key AND a.c_custkey <> b.c_custkey GROUP BY ALL HAVING count(*) >= 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, neighbour)::INT AS place FROM d QUALIFY place <= 10)"""


def _knn(t: Tables) -> DataFrame:
    return N.knn_profiles(_long(t), "c_custkey", ["c_mktsegment", "c_nationkey"], k=10, min_common=3)


@query(f"WITH {_KNN} SELECT * FROM k")
def knn_sparse(t: Tables) -> DataFrame:
    return _knn(t)


@query(
    """WITH d AS (SELECT a.vec_id AS target, b.vec_id AS neighbour, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) / len(a.embedding)) + 1e-9, 3) AS distance
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, neighbour)::INT AS place FROM d QUALIFY place <= 5"""
)
def knn_dense(t: Tables) -> DataFrame:
    return N.knn_dense(t.embeddings, "vec_id", "embedding", ["label"], k=5)


@query(f"WITH {_KNN.replace('a.c_nationkey = b.c_nationkey AND ', '')} SELECT * FROM k")
def knn_sparse_tiled(t: Tables) -> DataFrame:
    return tiles.knn_tiled(_long(t), "c_custkey", ["c_mktsegment"], k=10, min_common=3)


@query(
    """WITH d AS (SELECT a.vec_id AS target, b.vec_id AS neighbour, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) / len(a.embedding)) + 1e-9, 3) AS distance
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, neighbour)::INT AS place FROM d QUALIFY place <= 5"""
)
def knn_dense_tiled(t: Tables) -> DataFrame:
    return tiles.knn_dense_tiled(t.embeddings, "vec_id", "embedding", ["label"], width=64, k=5)


@query(
    f"""WITH a AS (SELECT n_nationkey AS family, '00' || n_nationkey AS anchor FROM nation), s AS (SELECT family, anchor, c_custkey, c_acctbal FROM a JOIN customer ON contains(lower(c_name), lower(anchor)) QUALIFY row_number() OVER (PARTITION BY family, anchor ORDER BY c_custkey) = 1),
    d AS (SELECT c.c_custkey, family, round(abs(c.c_acctbal - s.c_acctbal) + 1e-9, 3) AS distance, s.c_custkey AS anchor FROM customer c JOIN s ON c.c_custkey <> s.c_custkey),
    m AS (SELECT c_custkey, family, min((distance, anchor)) AS x FROM d GROUP BY ALL)
    SELECT c_custkey, family, x[1] AS distance, x[2] AS anchor, row_number() OVER (PARTITION BY c_custkey ORDER BY x[1], family)::INT AS place FROM m QUALIFY place <= 5"""
)
def anchor_neighbors(t: Tables) -> DataFrame:
    anchors = t.nation.select(F.col("n_nationkey").alias("family"), F.concat(F.lit("00"), F.col("n_nationkey").cast("string")).alias("anchor"))
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return N.anchor_neighbors(c.select("c_custkey", "c_acctbal"), "c_custkey", anchors, "family", c, "c_custkey", "c_name", lambda a: F.abs(F.col("c_acctbal") - a["c_acctbal"]), k=5)


# ---- pools ----------------------------------------------------------------


def _given(t: Tables) -> DataFrame:
    """Prescriptions: a customer's order lines with their parts."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    return t.lineitem.join(o, "l_orderkey").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("c_custkey", "p_name", "p_type", "p_brand", "l_quantity", "l_extendedprice")


_GIVEN = "g AS (SELECT o_custkey AS c_custkey, p_name, p_type, p_brand, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {_KNN}, {_GIVEN} SELECT target, p_type, p_name, count(*)::BIGINT AS times_prescribed, count(DISTINCT c_custkey)::BIGINT AS n_entities, {R4('avg(l_quantity)')} AS avg_l_quantity FROM k JOIN g ON neighbour = c_custkey GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 2")
def history_pool(t: Tables) -> DataFrame:
    p = N.history_pool(_knn(t), _given(t), "c_custkey", ["p_type", "p_name"], averages=["l_quantity"])
    return p.withColumn("avg_l_quantity", r4("avg_l_quantity"))


@query(f"WITH {_KNN}, {_GIVEN} SELECT target, p_name, p_brand, count(*)::BIGINT AS times_prescribed, count(DISTINCT c_custkey)::BIGINT AS n_entities FROM k JOIN g ON neighbour = c_custkey WHERE p_name NOT LIKE 'old %' GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 2")
def weighted_pool(t: Tables) -> DataFrame:
    return N.history_pool(_knn(t), _given(t).where(~F.col("p_name").like("old %")), "c_custkey", ["p_name", "p_brand"])


_STAPLES = f"WITH {_GIVEN}, c AS (SELECT c_mktsegment, p_name, count(DISTINCT c_custkey)::BIGINT AS n_entities, count(*)::BIGINT AS times_prescribed FROM g JOIN customer USING (c_custkey) GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 10) SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_entities DESC, p_name)::INT AS place FROM c QUALIFY place <= 6"


@query(_STAPLES)
def staples(t: Tables) -> DataFrame:
    g = _given(t).join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return N.staple_pool(g, "c_custkey", ["c_mktsegment"], "p_name")


@query(
    """WITH a AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS place FROM part WHERE p_type = 'PROMO'), b AS (SELECT p_brand, upper(p_name) AS p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::INT AS place FROM part WHERE p_type <> 'PROMO'),
    u AS (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 FROM b) SELECT p_brand, p_name, place, source FROM u QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY source, place) = 1"""
)
def priority_merge(t: Tables) -> DataFrame:
    price = F.col("p_retailprice")
    a = t.part.where("p_type = 'PROMO'").select("p_brand", "p_name", F.row_number().over(Window.partitionBy("p_brand").orderBy(price.desc(), "p_partkey")).alias("place"))
    b = t.part.where("p_type != 'PROMO'").select("p_brand", F.upper("p_name").alias("p_name"), F.row_number().over(Window.partitionBy("p_brand").orderBy(price, "p_partkey")).alias("place"))
    return N.merge_pools(["p_brand"], "p_name", a, b)


@query(
    """WITH r AS (SELECT *, p_name LIKE 'large%' AS s, row_number() OVER (PARTITION BY p_brand, p_name LIKE 'large%' ORDER BY p_size DESC, p_partkey) AS b FROM part)
    SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) - 1)::INT AS place FROM r WHERE NOT s OR b = 1"""
)
def reorder_renumber(t: Tables) -> DataFrame:
    return N.lead_one(t.part, ["p_brand"], "p_partkey", F.col("p_name").like("large%"), F.col("p_size")).select("p_brand", "p_partkey", "place")


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 25")
def pool_cap(t: Tables) -> DataFrame:
    return N.capped(t.part, ["p_brand"], 25, F.col("p_retailprice").desc(), "p_partkey").select("p_brand", "p_partkey")


@query(
    """WITH pool AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), picks AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
    hot AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50)
    SELECT o_custkey, l_partkey, EXISTS (FROM pool p WHERE p.o_custkey = k.o_custkey AND p.l_partkey = k.l_partkey) AS valid, l_partkey IN (FROM hot) AS tagged FROM picks k"""
)
def pick_validation(t: Tables) -> DataFrame:
    o = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pool = o.where("l_returnflag = 'R'").select("o_custkey", "l_partkey")
    picks = o.where("l_returnflag = 'A'").select("o_custkey", "l_partkey").distinct()
    good, bad = N.valid_picks(picks, pool, ["o_custkey", "l_partkey"])
    hot = t.lineitem.where("l_quantity = 50").select("l_partkey").distinct().withColumn("tagged", F.lit(True))
    every = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return every.join(hot, "l_partkey", "left").fillna(False, ["tagged"]).select("o_custkey", "l_partkey", "valid", "tagged")


SLOTS = {"ECONOMY": 3, "PROMO": 2, "SMALL": 1}


@query(
    f"""WITH {_KNN}, {_GIVEN}, h AS (SELECT target, p_type AS slot, p_name AS item, count(*)::BIGINT AS times_prescribed, count(DISTINCT c_custkey)::BIGINT AS n_entities FROM k JOIN g ON neighbour = c_custkey GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 2),
    s AS ({_STAPLES}), t AS (SELECT h.*, EXISTS (FROM s JOIN customer c USING (c_mktsegment) WHERE c.c_custkey = h.target AND s.p_name = h.item) AS is_staple FROM h)
    SELECT target, slot, item, is_staple, n_entities, row_number() OVER (PARTITION BY target, slot ORDER BY is_staple DESC, n_entities DESC, times_prescribed DESC, item)::INT AS place FROM t
    QUALIFY place <= CASE slot {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SLOTS.items())} END""".replace(f"s AS ({_STAPLES})", "c AS (SELECT c_mktsegment, p_name, count(DISTINCT c_custkey)::BIGINT AS n_entities FROM g JOIN customer USING (c_custkey) GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 10), s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_entities DESC, p_name) <= 6)")
)
def batch_recommend(t: Tables) -> DataFrame:
    slots = _given(t).select("c_custkey", F.col("p_type").alias("slot"), F.col("p_name").alias("item"))
    # both pools read the same counts
    per = written(N.counted(slots, "c_custkey", ["slot", "item"]))
    segment = t.customer.select("c_custkey", "c_mktsegment")
    # some rows a segment, written so that their size is known
    mine = written(N.staple_pool(per.join(segment, "c_custkey"), "c_custkey", ["c_mktsegment"], "item").select("c_mktsegment", "item", F.lit(True).alias("is_staple")))
    pool = N.history_pool(_knn(t), per, "c_custkey", ["slot", "item"])
    pool = pool.join(segment.withColumnRenamed("c_custkey", "target"), "target").join(mine, ["c_mktsegment", "item"], "left").fillna(False, ["is_staple"])
    return N.recommend(pool, "target", SLOTS).select("target", "slot", "item", "is_staple", "n_entities", "place")


# ---- names ----------------------------------------------------------------


def _noisy() -> Column:
    m, n = F.col("p_partkey") % 5, F.col("p_name")
    return F.when(m == 0, F.upper(n)).when(m == 1, F.concat(F.lit(" "), n, F.lit("!"))).when(m == 2, F.concat(n, F.lit("s"))).when(m == 3, F.concat(F.lit("zz "), n)).otherwise("unknown thing")


_NOISY = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name || '!' WHEN 2 THEN p_name || 's' WHEN 3 THEN 'zz ' || p_name ELSE 'unknown thing' END"


def _catalogue(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("name"))


_RATIO = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"
_RESOLVED = f"""c AS (SELECT min(p_partkey) AS id, p_name AS matched FROM part GROUP BY ALL), n AS (SELECT DISTINCT {_NOISY} AS name FROM part), a AS (SELECT name, lower(trim(name)) AS e, trim(regexp_replace(lower(name), '[^a-z0-9/ ]+', ' ', 'g')) AS l FROM n),
    x AS (SELECT a.*, c1.id AS i1, c1.matched AS m1, c2.id AS i2, c2.matched AS m2 FROM a LEFT JOIN c c1 ON c1.matched = e LEFT JOIN c c2 ON c2.matched = l),
    f AS (SELECT x.name, c.id, c.matched, {_RATIO.format('x.l', 'c.matched')} AS score FROM x JOIN c ON split_part(x.l, ' ', 1) = split_part(c.matched, ' ', 1) OR split_part(x.l, ' ', 1) NOT IN (SELECT split_part(matched, ' ', 1) FROM c) WHERE i1 IS NULL AND i2 IS NULL),
    b AS (SELECT * FROM f WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, id) = 1),
    r AS (SELECT x.name, coalesce(i1, i2, b.id) AS id, CASE WHEN i1 IS NOT NULL THEN 'exact' WHEN i2 IS NOT NULL THEN 'loose' WHEN b.id IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS method, coalesce(m1, m2, b.matched) AS matched_name FROM x LEFT JOIN b USING (name))"""


def _resolved(t: Tables, kind: str = "levenshtein") -> DataFrame:
    return S.resolve_names(t.part.select(_noisy().alias("name")), _catalogue(t), threshold=0.75, kind=kind)


@query(f"WITH {_RESOLVED} SELECT * FROM r")
def resolve_layered(t: Tables) -> DataFrame:
    return _resolved(t)


@query(f"WITH {_RESOLVED} SELECT method, count(*)::BIGINT AS n FROM part JOIN r ON r.name = {_NOISY} GROUP BY ALL")
def match_tally(t: Tables) -> DataFrame:
    return t.part.select(_noisy().alias("name")).join(_resolved(t), "name").groupBy("method").agg(F.count("*").alias("n"))


@query()
def resolve_difflib(t: Tables) -> DataFrame:
    return _resolved(t, "difflib")


@query()
def nearest_names(t: Tables) -> DataFrame:
    lost = _resolved(t, "difflib").where("method = 'unmatched'")
    return S.nearest_names(lost, _catalogue(t))


@query(
    f"""WITH q AS (SELECT DISTINCT lower(trim(CASE s_suppkey % 3 WHEN 0 THEN 'Customer#00000000' || s_suppkey % 10 WHEN 1 THEN '#0000000' || (s_suppkey % 40 + 10) ELSE 'Custmer#0000000' || (s_suppkey % 40 + 10) END)) AS query FROM supplier),
    e AS (SELECT c_custkey AS id, c_name AS entity_name, lower(trim(c_name)) AS n FROM customer),
    h AS (SELECT query, id, entity_name, CASE WHEN n = query THEN 1 ELSE 2 END AS tier, 1.0::DOUBLE AS ratio FROM q JOIN e ON contains(n, query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, length(entity_name), entity_name, id) = 1),
    z AS (SELECT query, id, entity_name, 3 AS tier, {_RATIO.format('query', 'n')} AS ratio FROM q CROSS JOIN e WHERE query NOT IN (SELECT query FROM h) AND {_RATIO.format('query', 'n')} >= 0.7 QUALIFY row_number() OVER (PARTITION BY query ORDER BY ratio DESC, entity_name, id) = 1)
    SELECT query, id, entity_name, tier, {R4('ratio')} AS ratio FROM h UNION ALL SELECT query, id, entity_name, tier, {R4('ratio')} FROM z"""
)
def entity_lookup(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    q = F.when(k % 3 == 0, F.concat(F.lit("Customer#00000000"), (k % 10).cast("string"))).when(k % 3 == 1, F.concat(F.lit("#0000000"), (k % 40 + 10).cast("string"))).otherwise(F.concat(F.lit("Custmer#0000000"), (k % 40 + 10).cast("string")))
    found = S.lookup_entities(t.supplier.select(q.alias("name")), t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), kind="levenshtein")
    return found.withColumn("ratio", r4("ratio"))


@query(
    f"""WITH q AS (SELECT lower(n_name) AS query FROM nation), u AS (SELECT s_suppkey, n_name, s_name, lower(coalesce(n_name, '') || ' ' || coalesce(s_name, '')) AS al FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    h AS (SELECT query, s_suppkey, {_RATIO.format('query', 'al')} AS ratio FROM q JOIN u ON contains(al, query)), b AS (SELECT *, max(ratio) OVER (PARTITION BY query) AS best FROM h)
    SELECT query, s_suppkey, {R4('ratio')} AS ratio, sum((ratio >= best - 0.05)::INT) OVER (PARTITION BY query) >= 2 AS ambiguous FROM b"""
)
def name_search(t: Tables) -> DataFrame:
    users = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "s_name")
    found = S.search_names(t.nation.select(F.lower("n_name").alias("query")), users, ["n_name", "s_name"])
    return found.select("query", "s_suppkey", r4("ratio").alias("ratio"), "ambiguous")


@query()
def greedy_match(t: Tables) -> DataFrame:
    a = t.part.select("p_brand", F.col("p_name").alias("name"))
    b = t.part.select("p_brand", _noisy().alias("name"))
    return S.greedy_match(a, b, ["p_brand"], threshold=0.9)


_CLEAN_AND_NOISY = f"""a AS (SELECT DISTINCT p_brand, p_name AS left_name FROM part), b AS (SELECT DISTINCT p_brand, {_NOISY} AS right_name FROM part),
    s AS (SELECT p_brand, left_name, right_name, {_RATIO.format("left_name", "right_name")} AS score FROM a JOIN b USING (p_brand)),
    p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, left_name, right_name) AS n FROM s WHERE score >= 0.6)"""


@query(
    f"""WITH RECURSIVE {_CLEAN_AND_NOISY},
    walk AS (SELECT p_brand, 0::BIGINT AS n, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights FROM (SELECT DISTINCT p_brand FROM p)
      UNION ALL SELECT p_brand, p.n, CASE WHEN list_contains(lefts, left_name) OR list_contains(rights, right_name) THEN lefts ELSE list_append(lefts, left_name) END,
                       CASE WHEN list_contains(lefts, left_name) OR list_contains(rights, right_name) THEN rights ELSE list_append(rights, right_name) END
                FROM walk JOIN p USING (p_brand) WHERE p.n = walk.n + 1),
    kept AS (SELECT p_brand, unnest(lefts) AS left_name, unnest(rights) AS right_name FROM walk QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC) = 1)
    SELECT p_brand, left_name, right_name, {R4("score")} AS score FROM kept JOIN p USING (p_brand, left_name, right_name)"""
)
def greedy_match_edit(t: Tables) -> DataFrame:
    """One-to-one by edit distance: what a walk down the sorted pairs keeps."""
    a = t.part.select("p_brand", F.col("p_name").alias("name"))
    b = t.part.select("p_brand", _noisy().alias("name"))
    return S.greedy_match(a, b, ["p_brand"], threshold=0.6, kind="levenshtein").withColumn("score", r4("score"))


@query(
    f"""WITH {_RESOLVED}, lost AS (SELECT name, l FROM x JOIN r USING (name) WHERE method = 'unmatched'),
    d AS (SELECT DISTINCT name, id, matched AS matched_name, round({_RATIO.format("l", "matched")}, 3) AS similarity FROM lost CROSS JOIN c)
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, id)::INT AS place FROM d QUALIFY place <= 3"""
)
def nearest_names_edit(t: Tables) -> DataFrame:
    """The three nearest of what nothing matches, by edit distance."""
    lost = _resolved(t).where("method = 'unmatched'")
    return S.nearest_names(lost, _catalogue(t), kind="levenshtein")


# ---- comparisons ----------------------------------------------------------


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_type", "p_name", "l_quantity", "l_returnflag")
    return o.where("l_returnflag = 'A'"), o.where("l_returnflag = 'R'")


_SIDES = "o AS (SELECT o_custkey, p_type, p_name, l_quantity, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def _flags_sql(keys: str) -> str:
    return f"fl AS (SELECT {keys}, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, max(l_quantity) FILTER (l_returnflag = 'A') = max(l_quantity) FILTER (l_returnflag = 'R') AS d FROM o WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)"


def _part_sql(x: str, y: str) -> str:
    return f"round(({x}) / nullif({y}, 0)::DOUBLE + 1e-9, 3)"


_MEASURES = f"{_part_sql('n_both', 'n_recommended')} AS \"precision\", {_part_sql('n_both', 'n_actual')} AS recall, {_part_sql('2 * n_both', 'n_actual + n_recommended')} AS f1, {_part_sql('n_both', 'n_actual + n_recommended - n_both')} AS jaccard"
_COUNTS = "count(*) FILTER (a)::BIGINT AS n_actual, count(*) FILTER (r)::BIGINT AS n_recommended, count(*) FILTER (a AND r)::BIGINT AS n_both"


@query(f"WITH {_SIDES}, {_flags_sql('o_custkey, p_name')}, c AS (SELECT o_custkey, {_COUNTS}, count(*) FILTER (a AND r AND d)::BIGINT AS n_dose FROM fl GROUP BY ALL) SELECT *, {_MEASURES}, {_part_sql('n_dose', 'n_both')} AS dose_agreement FROM c")
def set_compare(t: Tables) -> DataFrame:
    flags = C.item_flags(*_sides(t), ["o_custkey"], "p_name", dose="l_quantity")
    return C.overlap(flags, ["o_custkey"])


def _grouped(t: Tables) -> DataFrame:
    return C.item_flags(*_sides(t), ["o_custkey", "p_type"], "p_name")


_GROUPED = f"{_SIDES}, {_flags_sql('o_custkey, p_type, p_name')}"


@query(f"WITH {_GROUPED}, c AS (SELECT o_custkey, p_type, {_COUNTS} FROM fl GROUP BY GROUPING SETS ((o_custkey, p_type), (o_custkey))) SELECT *, {_MEASURES} FROM c")
def set_compare_grouped(t: Tables) -> DataFrame:
    return C.grouped_overlap(_grouped(t), ["o_custkey"], "p_type")


COMPONENTS = {"ECONOMY": "lift", "LARGE": "plyo", "MEDIUM": "prep", "SMALL": "bp", "STANDARD": "hit", "PROMO": "me"}


@query(
    f"""WITH {_GROUPED}, c AS (SELECT o_custkey, p_type, {_COUNTS} FROM fl GROUP BY ALL), m AS (SELECT o_custkey, {_part_sql('n_both', 'n_actual')} AS recall, CASE p_type WHEN 'ECONOMY' THEN 0.3 WHEN 'LARGE' THEN 0.3 WHEN 'MEDIUM' THEN 0.3 WHEN 'SMALL' THEN 0.1 ELSE 0 END::DOUBLE AS w FROM c)
    SELECT o_custkey, coalesce(round(sum(w * recall) / nullif(sum(w) FILTER (recall IS NOT NULL), 0) + 1e-9, 3), 0)::DOUBLE AS overall_recall FROM m GROUP BY ALL"""
)
def weighted_recall(t: Tables) -> DataFrame:
    m = C.overlap(_grouped(t), ["o_custkey", "p_type"]).withColumn("component", T.lookup("p_type", COMPONENTS))
    return C.weighted_recall(m, ["o_custkey"])


@query(
    f"""WITH {_GROUPED}, c AS (SELECT o_custkey, p_type, {_COUNTS} FROM fl GROUP BY ALL), m AS (SELECT *, {_MEASURES} FROM c)
    SELECT p_type, count(*)::BIGINT AS n_runs, round(avg(f1) + 1e-9, 3) AS f1, round(avg(recall) + 1e-9, 3) AS recall, round(avg("precision") + 1e-9, 3) AS "precision", round(100.0 * sum(n_both) / sum(sum(n_both)) OVER () + 1e-9, 3)::DOUBLE AS share_pct FROM m GROUP BY ALL"""
)
def eval_rollup(t: Tables) -> DataFrame:
    m = C.overlap(_grouped(t), ["o_custkey", "p_type"])
    out = m.groupBy("p_type").agg(F.count("*").alias("n_runs"), *(F.round(F.avg(c) + 1e-9, 3).alias(c) for c in ("f1", "recall", "precision")), F.sum("n_both").alias("n"))
    # one row a component
    return out.select("p_type", "n_runs", "f1", "recall", "precision", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 1e-9, 3).alias("share_pct"))


@query(f"WITH {_GROUPED}, m AS (SELECT p_type, p_name, count(*)::BIGINT AS n FROM fl WHERE a AND NOT r GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_name)::INT AS place FROM m QUALIFY place <= 20")
def top_missed(t: Tables) -> DataFrame:
    missed = _grouped(t).where("in_actual AND NOT in_recommended").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    return top(missed, ["p_type"], 20, F.col("n").desc(), "p_name", rank="place")


_ITEMS = "CASE length(p_name) % 4 WHEN 0 THEN '[Legs] ' || p_name || ' squat' WHEN 1 THEN '[Upper] ' || p_name || ' row' WHEN 2 THEN p_name || ' press up' ELSE p_name END"


def _item() -> Column:
    m, n = F.length("p_name") % 4, F.col("p_name")
    return F.when(m == 0, F.concat(F.lit("[Legs] "), n, F.lit(" squat"))).when(m == 1, F.concat(F.lit("[Upper] "), n, F.lit(" row"))).when(m == 2, F.concat(n, F.lit(" press up"))).otherwise(n)


_BARE = f"regexp_replace({_ITEMS}, '^\\[[^\\]]+\\]\\s*', '')"


@query(f"WITH {_SIDES}, {_flags_sql('o_custkey, p_name')} SELECT o_custkey, 'actual' AS side, {_BARE} AS item FROM fl WHERE a UNION ALL SELECT o_custkey, 'recommended', {_BARE} FROM fl WHERE r")
def comparison_items(t: Tables) -> DataFrame:
    flags = C.item_flags(*_sides(t), ["o_custkey"], "p_name").withColumn("item", _item())
    return C.comparison_items(flags, ["o_custkey"], "item")


def _patterned(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct().withColumn("item", T.without_group(_item()))
    names = names.join(S.classify_names(names, "item"), "item").select("p_name", "pattern")
    return C.item_flags(*_sides(t), ["o_custkey"], "p_name").join(names, "p_name")


_PATTERNED = f"{_SIDES}, {_flags_sql('o_custkey, p_name')}, n AS (SELECT DISTINCT p_name, {classify_sql(_BARE)} AS pattern FROM part), fp AS (SELECT fl.*, n.pattern FROM fl JOIN n USING (p_name))"


@query(f"WITH {_PATTERNED}, p AS (SELECT o_custkey, pattern, bool_or(a) AS a, bool_or(r) AS r FROM fp WHERE pattern <> 'unclassified' GROUP BY ALL) SELECT o_custkey, count(*) FILTER (a)::BIGINT AS n_patterns, count(*) FILTER (a AND r)::BIGINT AS n_found, {_part_sql('count(*) FILTER (a AND r)', 'count(*) FILTER (a)')} AS pattern_recall FROM p GROUP BY ALL")
def pattern_recall(t: Tables) -> DataFrame:
    return C.pattern_recall(_patterned(t), ["o_custkey"])


@query(f"WITH {_PATTERNED} SELECT pattern, count(*)::BIGINT AS n_items FROM fp x WHERE a AND NOT EXISTS (FROM fp y WHERE y.r AND y.o_custkey = x.o_custkey AND y.pattern = x.pattern) GROUP BY ALL")
def pattern_miss(t: Tables) -> DataFrame:
    return C.pattern_misses(_patterned(t), ["o_custkey"])


@query("SELECT dayofweek(o_orderdate)::INT AS dow, o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH')::BIGINT AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM')::BIGINT AS medium FROM orders GROUP BY ALL")
def weekday_dist(t: Tables) -> DataFrame:
    by = t.orders.groupBy((F.dayofweek("o_orderdate") - 1).alias("dow"), "o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).count().fillna(0)
    return by.select("dow", "o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("3-MEDIUM").alias("medium"))


def _weekday_sql(status: str) -> str:
    return f"SELECT o_custkey, dayofweek(o_orderdate)::INT AS dow, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS level FROM orders WHERE o_orderstatus = '{status}' GROUP BY ALL"


@query(f"WITH a AS ({_weekday_sql('F')}), r AS ({_weekday_sql('O')}) SELECT o_custkey, count(*)::BIGINT AS n_days, count(*) FILTER (a.level = r.level)::BIGINT AS n_match, {_part_sql('count(*) FILTER (a.level = r.level)', 'count(*)')} AS agreement FROM a LEFT JOIN r USING (o_custkey, dow) GROUP BY ALL")
def schedule_match(t: Tables) -> DataFrame:
    first = lambda s: t.orders.where(f"o_orderstatus = '{s}'").groupBy("o_custkey", (F.dayofweek("o_orderdate") - 1).alias("dow")).agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("level"))
    return C.schedule_match(first("F"), first("O"), ["o_custkey"])


@query("SELECT p_name FROM part WHERE p_type = 'PROMO' INTERSECT SELECT p_name FROM part WHERE p_type = 'SMALL' AND p_size < 20 EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#1'")
def name_sets(t: Tables) -> DataFrame:
    names = lambda where: t.part.where(where).select("p_name")
    return names("p_type = 'PROMO'").intersect(names("p_type = 'SMALL' AND p_size < 20")).subtract(names("p_brand = 'Brand#1'"))
