"""Choices among templates, buckets, sources and runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.operators import selection as S
from meridial.plans.registry import R4, Tables, query, r4

_GROUPS = "CASE c_nationkey % 5 WHEN 0 THEN 'college ' WHEN 1 THEN 'High School' WHEN 2 THEN 'PRO' WHEN 3 THEN 'youth' END"


@query(
    f"""WITH g AS (SELECT c_custkey, upper(trim(coalesce({_GROUPS}, ''))) AS g FROM customer)
    SELECT c_custkey, unnest(CASE g WHEN 'COLLEGE' THEN ['College'] WHEN 'HIGH SCHOOL' THEN ['High School', 'High School (Beginner)'] WHEN 'PRO' THEN ['Pro'] WHEN 'YOUTH' THEN ['Before Baseball Club (Beginner)', 'Baseball Club (Advanced)'] ELSE [] END) AS athlete_level FROM g"""
)
def template_levels(t: Tables) -> DataFrame:
    m = F.col("c_nationkey") % 5
    g = F.when(m == 0, "college ").when(m == 1, "High School").when(m == 2, "PRO").when(m == 3, "youth")
    return S.template_levels(t.customer.select("c_custkey", g.alias("g")), "g").select("c_custkey", "athlete_level")


@query(
    """WITH r AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'Lower ' || p_type WHEN l_partkey % 3 = 1 THEN NULL ELSE p_type END AS parent, CASE WHEN p_size > 25 THEN 'upper body' ELSE 'misc' END AS kind FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_partkey, CASE WHEN lower(parent) LIKE '%lower%' THEN 'Legs' WHEN kind LIKE '%upper%' THEN 'Upper' ELSE 'Other' END AS bucket FROM r"""
)
def item_buckets(t: Tables) -> DataFrame:
    m = F.col("l_partkey") % 3
    parent = F.when(m == 0, F.concat(F.lit("Lower "), "p_type")).when(m == 2, F.col("p_type"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "l_linenumber", parent.alias("parent"), F.when(F.col("p_size") > 25, "upper body").otherwise("misc").alias("kind"))
    return S.item_buckets(rows, ["l_orderkey", "l_partkey"], "parent", "kind", "l_linenumber")


@query("WITH a AS (SELECT o_custkey, o_orderkey, 'a' AS path FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000), b AS (SELECT o_custkey, o_orderkey, 'b' AS path FROM orders WHERE o_orderstatus = 'F') SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (o_custkey)")
def source_fallback(t: Tables) -> DataFrame:
    path = lambda where, name: t.orders.where(where).select("o_custkey", "o_orderkey", F.lit(name).alias("path"))
    return S.first_available(["o_custkey"], path("o_orderstatus = 'P' AND o_totalprice > 300000", "a"), path("o_orderstatus = 'F'", "b"))


@query("SELECT o_orderkey, coalesce(string_agg(l_partkey || 'x' || l_quantity::INT, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def template_items(t: Tables) -> DataFrame:
    items = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    out = S.template_items(t.orders.select("o_orderkey"), items, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_partkey", "l_quantity"])
    shown = F.transform("items", lambda x: F.concat_ws("x", x["l_partkey"].cast("string"), x["l_quantity"].cast("int").cast("string")))
    return out.select("o_orderkey", F.array_join(shown, ",").alias("items"))


@query(
    """WITH c AS (SELECT p_type, p_brand, count(DISTINCT p_size)::BIGINT AS n FROM part GROUP BY ALL), a AS (SELECT p_type, p_brand, round(min(abs(p_retailprice - 1000)) + 1e-9, 3) AS distance FROM part WHERE p_size > 48 GROUP BY ALL)
    SELECT p_type, p_brand, distance, row_number() OVER (PARTITION BY p_type ORDER BY distance NULLS LAST, n DESC, p_brand)::INT AS place FROM c LEFT JOIN a USING (p_type, p_brand) QUALIFY place <= 3"""
)
def template_choice(t: Tables) -> DataFrame:
    c = t.part.groupBy("p_type", "p_brand").agg(F.countDistinct("p_size").alias("n"))
    a = t.part.where("p_size > 48").groupBy("p_type", "p_brand").agg(F.round(F.min(F.abs(F.col("p_retailprice") - 1000)) + 1e-9, 3).alias("distance"))
    return S.choose_families(c, a, ["p_type"], "p_brand", "n", k=3).select("p_type", "p_brand", "distance", "place")


@query("SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) = 1")
def one_per_bucket(t: Tables) -> DataFrame:
    return S.one_per_bucket(t.part, ["p_brand"], "p_type", F.col("p_size").desc(), "p_partkey").select("p_brand", "p_type", "p_partkey")


@query(f"SELECT user_id, {R4('sum(coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, 0))')} AS total_cost, count(*)::BIGINT AS total_calls FROM events GROUP BY ALL")
def run_totals(t: Tables) -> DataFrame:
    calls = t.events.select("user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("cost"), F.lit(1).alias("calls"))
    return S.run_totals(calls, ["user_id"], ["cost", "calls"]).select("user_id", r4("total_cost").alias("total_cost"), "total_calls")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 13")
def last_runs(t: Tables) -> DataFrame:
    return S.last_runs(t.events, "event_id", 13).select("event_id", "user_id")


@query("SELECT CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'PROMO' ELSE p_type END AS p_type, count(*)::BIGINT AS n FROM part GROUP BY 1")
def merged_categories(t: Tables) -> DataFrame:
    return S.as_one_category(t.part, "p_type", merge=("PROMO", "SMALL"), into="PROMO").groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT event_id, ['dj', 'cmj', 'ppu', 'slv', 'other'][(event_id % 5 + 1)::INT] AS test, value * 400 AS ramp, -value / 50 AS k, percent_rank() OVER (PARTITION BY event_type ORDER BY value) * 100 AS f, percent_rank() OVER (PARTITION BY event_type ORDER BY event_id) * 100 AS v FROM events)
    SELECT event_id, ramp > CASE test WHEN 'dj' THEN 32700 WHEN 'cmj' THEN 25200 WHEN 'ppu' THEN 8000 WHEN 'slv' THEN 18200 END AS ramp_elite,
      CASE test WHEN 'dj' THEN CASE WHEN k < -1.45 THEN 'Very Flat' WHEN k < -1.1 THEN 'Ideal' ELSE 'Sharp / Peaked' END WHEN 'cmj' THEN CASE WHEN k < -1.3 THEN 'Very Flat' WHEN k < -0.4 THEN 'Ideal' ELSE 'Sharp / Peaked' END
        WHEN 'ppu' THEN CASE WHEN k < -1.55 THEN 'Very Flat' WHEN k < -1.25 THEN 'Ideal' ELSE 'Sharp / Peaked' END WHEN 'slv' THEN CASE WHEN k < -1 THEN 'Very Flat' WHEN k < -0.2 THEN 'Ideal' ELSE 'Sharp / Peaked' END END AS kurtosis_label,
      CASE WHEN f - v > 15 THEN 'force' WHEN f - v < -15 THEN 'velocity' ELSE 'balanced' END AS dominance FROM s"""
)
def screen_flags(t: Tables) -> DataFrame:
    test = F.element_at(F.array(*map(F.lit, ("dj", "cmj", "ppu", "slv", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = S.with_percentile(S.with_percentile(t.events, ["event_type"], "value"), ["event_type"], "event_id")
    e = e.select("event_id", test.alias("test"), (F.col("value") * 400).alias("rpd_max_w_per_s"), (-F.col("value") / 50).alias("kurtosis"), F.col("value_pct").alias("force_pct"), F.col("event_id_pct").alias("velocity_pct"))
    return S.screen_flags(e, "test").select("event_id", "ramp_elite", "kurtosis_label", "dominance")
