"""The complete recommendation over the tables: customers' order lines stand in for prescriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.operators import recommender as R
from meridial.plans.recommend import _KNN, _knn
from meridial.plans.registry import Tables, query

_CATEGORIES = {"STANDARD": "prep", "ECONOMY": "me", "MEDIUM": "bp", "PROMO": "hit", "LARGE": "plyo", "SMALL": "lift"}
_STAPLES = ("blue rod", "new gear", "hot rod", "no such thing")
_REVERSE = "^(red|hot)"
_WEIGHTS = ("OZ_32", "LB_1", None)
_TAKES = {"prep": 6, "bulletproofing": 5, "hitting": 4, "plyo": 3}


def _prescriptions(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"))
    rows = t.lineitem.join(o, "l_orderkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    category = F.try_element_at(F.create_map(*(F.lit(x) for kv in _CATEGORIES.items() for x in kv)), F.col("p_type"))
    weight = F.get(F.array(*(F.lit(w).cast("string") for w in _WEIGHTS)), (F.col("l_quantity") % 3).cast("int"))
    return rows.select("entity", category.alias("category"), F.col("p_name").alias("item"), weight.alias("weight"), (F.col("l_linenumber") % 4).alias("intensity"), F.col("l_quantity").alias("n_sets"), F.col("l_tax").alias("avg_reps"))


def _entities(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("entity"), (F.col("c_custkey") % 2 == 0).alias("is_pitcher"), (F.col("c_custkey") % 3 == 0).alias("is_hitter"))


_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{R.COMPONENTS[v]}'" for k, v in _CATEGORIES.items() if v in R.COMPONENTS) + " END"
_LISTED = ", ".join(f"'{s}'" for s in _STAPLES)
_POOLS = f"""{_KNN},
    given AS (SELECT o_custkey AS entity, {_CASE} AS component, p_name AS item, p_type = 'ECONOMY' AS me, CASE WHEN p_type <> 'LARGE' THEN '' WHEN l_linenumber % 4 < 3 THEN 'P' || l_linenumber % 4 END AS level,
                     CASE WHEN p_type = 'LARGE' THEN coalesce(['OZ_32', 'LB_1', NULL][(l_quantity % 3 + 1)::INT], '') ELSE '' END AS weight
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    g AS (SELECT * FROM given WHERE component IS NOT NULL AND level IS NOT NULL),
    h AS (SELECT target, component, level, item, weight, count(*)::BIGINT AS times_prescribed, count(DISTINCT entity)::BIGINT AS n_entities FROM k JOIN g ON neighbour = entity
          WHERE (component <> 'plyo' OR target % 2 = 0) AND (component <> 'hitting' OR target % 3 = 0) GROUP BY ALL HAVING count(DISTINCT entity) >= 2),
    f AS (SELECT c_custkey AS target, component, level, item, weight, times_prescribed, n_entities
          FROM customer CROSS JOIN (SELECT component, level, item, weight, count(*)::BIGINT AS times_prescribed, count(DISTINCT entity)::BIGINT AS n_entities FROM g WHERE component = 'bulletproofing' AND item IN ({_LISTED}) GROUP BY ALL) WHERE c_custkey % 2 = 0),
    p AS (SELECT *, target % 2 = 0 AND component = 'bulletproofing' AND lower(trim(item)) IN ({_LISTED}) AS is_staple, component = 'prep' AND lower(trim(item)) IN (SELECT lower(trim(item)) FROM g WHERE me) AS is_me
          FROM (SELECT * FROM h UNION ALL SELECT * FROM f WHERE NOT EXISTS (FROM h WHERE h.target = f.target AND h.component = f.component AND lower(trim(h.item)) = lower(trim(f.item)))))"""
_TAKEN = "CASE component " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TAKES.items()) + " END"
_CAP = ", ".join(f"({i}, '{n}', '{d}')" for i, (n, d) in enumerate(R.MOBILITY_CAP))


@query(
    f"""WITH {_POOLS},
    n AS (SELECT *, row_number() OVER (PARTITION BY target, component, level ORDER BY is_staple DESC, n_entities DESC, times_prescribed DESC, item, weight) AS turn FROM p QUALIFY turn <= {_TAKEN}),
    s AS (SELECT *, turn + CASE WHEN is_me THEN 1000000 ELSE 0 END AS o, component = 'plyo' AND regexp_matches(item, '{_REVERSE}') AS rev, CASE weight WHEN 'OZ_32' THEN 32 WHEN 'LB_1' THEN 16 END AS w FROM n),
    b AS (SELECT * FROM s QUALIFY NOT rev OR row_number() OVER (PARTITION BY target, component, level, rev ORDER BY w DESC NULLS LAST, o) = 1)
    SELECT target, component, level, item, weight, (row_number() OVER (PARTITION BY target, component, level ORDER BY rev DESC, o) - 1)::INT AS place, is_staple, is_me, n_entities, times_prescribed, NULL::VARCHAR AS sets_x_reps, true AS kept FROM b
    UNION ALL SELECT c_custkey, 'lift_mobility_cap', '', item, '', place, NULL, NULL, NULL, NULL, dose, true FROM customer CROSS JOIN (VALUES {_CAP}) v(place, item, dose) WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'prep', '', 'no such item', '', 1, NULL, NULL, NULL, NULL, NULL, false FROM customer"""
)
def recommend_complete(t: Tables) -> DataFrame:
    """Pools by component and level, gates, staples, cap and validation; each customer also picks what no pool has."""
    people = _entities(t)
    pool = R.pools(_knn(t), _prescriptions(t), people, staples=_STAPLES, averages=())
    wrong = people.select(F.col("entity").alias("target"), F.lit("prep").alias("component"), F.lit("").alias("level"), F.lit("no such item").alias("item"), F.lit("").alias("weight"), F.lit(1).alias("place"))
    columns = wrong.columns
    good, dropped = R.recommended(pool, people, R.picked(pool, _TAKES).select(columns).unionByName(wrong), reverse=_REVERSE)
    return good.withColumn("kept", F.lit(True)).unionByName(dropped.select(*columns, F.lit(False).alias("kept")), allowMissingColumns=True)
