"""Joins by address, bridge and id, domains, and documents, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridial.functions import rows as X
from meridial.operators import compare, corpus, links, payload, programs
from meridial.operators import resolve as S
from meridial.plans.recommend import _LONG, _long
from meridial.plans.registry import R4, Tables, query, r4

# ---- addresses and bridges ------------------------------------------------

_USERS = "u AS (SELECT s_suppkey AS user_id, 'CUSTOMER#' || substr(s_name, 10) AS user_email FROM supplier)"


def _users(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("user_id"), F.concat(F.lit("CUSTOMER#"), F.expr("substr(s_name, 10)")).alias("user_email"))


@query(f"WITH {_USERS} SELECT c_custkey, user_id FROM customer LEFT JOIN u ON lower(c_name) = lower(user_email)")
def email_join(t: Tables) -> DataFrame:
    return links.on_lower(t.customer, _users(t), "c_name", "user_email").select("c_custkey", "user_id")


@query(
    f"""WITH {_USERS}, p AS (SELECT o_custkey AS user_id, o_orderpriority AS org_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) = 1),
    m AS (SELECT lower(user_email) AS e, min(user_id) AS user_id FROM u GROUP BY 1)
    SELECT c_custkey, user_id, org_id FROM customer LEFT JOIN m ON lower(c_name) = e LEFT JOIN p USING (user_id)"""
)
def user_backref(t: Tables) -> DataFrame:
    closed = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    programs = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("org_id"), closed.alias("closed"), "o_orderkey")
    return links.back_reference(t.customer, _users(t), programs, "c_custkey", "c_name", order=[F.col("closed").desc_nulls_last(), F.col("o_orderkey").desc()])


@query(
    """WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber < 4 AND l_returnflag = 'R' THEN l_suppkey END AS s_suppkey FROM lineitem), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3)
    SELECT o_orderkey, 'bridge' AS component, coalesce(n_name, 'unknown') AS category, count(*)::BIGINT AS n, count(DISTINCT n_nationkey)::BIGINT AS unique_count
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN supplier USING (s_suppkey) LEFT JOIN n ON n_nationkey = s_nationkey GROUP BY ALL"""
)
def bridge_breakdown(t: Tables) -> DataFrame:
    held = (F.col("l_linenumber") < 4) & (F.col("l_returnflag") == "R")
    link = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(held, F.col("l_suppkey")).alias("s_suppkey"))
    bridge = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    target = t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name")
    return links.bridged_breakdown(t.orders, "o_orderkey", link, bridge, target, link_key="s_suppkey", bridge_key="n_nationkey", group=F.col("n_name"), component="bridge")


_LINK = "l AS (SELECT l_orderkey, CASE WHEN l_linenumber < 4 AND l_returnflag = 'R' THEN l_suppkey END AS s_suppkey FROM lineitem), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3)"


@query(
    f"""WITH {_LINK}, b AS (SELECT o_orderkey, coalesce(n_name, 'unknown') AS category, count(*)::BIGINT AS n, count(DISTINCT n_nationkey)::BIGINT AS u FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN supplier USING (s_suppkey) LEFT JOIN n ON n_nationkey = s_nationkey GROUP BY ALL),
    a AS (SELECT o_orderkey, coalesce(p_type, 'unknown') AS category, count(*)::BIGINT AS n, count(DISTINCT p_partkey)::BIGINT AS u FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    x AS (SELECT o_orderkey, sum(n)::BIGINT AS n_lift, sum(u)::BIGINT AS n_unique_lift FROM a GROUP BY 1), y AS (SELECT o_orderkey, sum(n)::BIGINT AS n_bridge, sum(u)::BIGINT AS n_unique_bridge FROM b GROUP BY 1),
    g AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS goals FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
    SELECT x.*, n_bridge, n_unique_bridge, coalesce(goals, '') AS goals FROM x JOIN y USING (o_orderkey) LEFT JOIN g ON l_orderkey = o_orderkey"""
)
def component_summary(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    lift = programs.category_breakdown(t.orders, "o_orderkey", lines, t.part.select("p_partkey", "p_type"), "p_partkey", F.col("p_type"))
    every = programs.program_summaries(lift.unionByName(bridge_breakdown(t)), "o_orderkey", ["lift", "bridge"])
    goals = t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    out = programs.with_goals(every, goals, "o_orderkey", "l_linestatus")
    return out.select("o_orderkey", "n_lift", "n_unique_lift", "n_bridge", "n_unique_bridge", F.array_join("goals", ",").alias("goals"))


@query(
    "SELECT l_orderkey, level, item, dose FROM ("
    + " UNION ALL ".join(f"SELECT l_orderkey, '{level}' AS level, {item}::VARCHAR AS item, {dose}::INT::VARCHAR AS dose FROM lineitem" for level, item, dose in (("beginner", "nullif(l_returnflag, 'N')", "l_quantity"), ("advanced", "l_linestatus", "l_linenumber"), ("college", "nullif(l_suppkey, 1)", "l_quantity"), ("pro", "CASE WHEN l_discount > 0 THEN '' END", "l_linenumber")))
    + ") WHERE item IS NOT NULL AND item <> ''"
)
def sheet_levels(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("a"), "l_linestatus", F.nullif(F.col("l_suppkey"), F.lit(1).cast("long")).alias("c"), F.when(F.col("l_discount") > 0, "").alias("d"), F.col("l_quantity").cast("int").alias("q"), "l_linenumber")
    return programs.stacked_levels(rows, ["l_orderkey"], {"beginner": ("a", "q"), "advanced": ("l_linestatus", "l_linenumber"), "college": ("c", "q"), "pro": ("d", "l_linenumber")})


@query("SELECT l_returnflag, count(*)::BIGINT AS n_runs, round(avg(l_discount) + 1e-9, 3) AS mean_l_discount, round(avg(l_tax) + 1e-9, 3) AS mean_l_tax, round(avg(l_quantity) + 1e-9, 3) AS mean_l_quantity, count(DISTINCT p_brand)::BIGINT AS n_families FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def component_means(t: Tables) -> DataFrame:
    runs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return compare.component_means(runs, "l_returnflag", ["l_discount", "l_tax", "l_quantity"], family="p_brand")


# ---- keys, flags and domains ----------------------------------------------


@query("SELECT l_returnflag || '.' || l_linestatus AS metric_key, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def key_axis_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(X.key_axis("l_returnflag", "l_linestatus").alias("metric_key")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE NOT coalesce(CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) GROUP BY ALL")
def archived_filter(t: Tables) -> DataFrame:
    archived = F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False)
    return t.part.withColumn("archived", archived).where(X.not_archived("archived")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT 'P' || CASE WHEN l_discount > 0 THEN l_linenumber % 4 END AS level, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def intensity_levels(t: Tables) -> DataFrame:
    intensity = F.when(F.col("l_discount") > 0, F.col("l_linenumber") % 4)
    return t.lineitem.groupBy(X.intensity_level(intensity).alias("level")).agg(F.count("*").alias("n"))


_METRICS = "m AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pitch_' WHEN 'view' THEN 'hit_' WHEN 'purchase' THEN 'mob_' WHEN 'error' THEN 'screen_' ELSE 'proteus_' END || (user_id % 7) AS metric_key, value FROM events)"


@query(
    f"WITH {_METRICS} "
    + " UNION ALL ".join(f"SELECT '{d}' AS domain, metric_key, count(value)::BIGINT AS n FROM m WHERE {' OR '.join(f'starts_with(metric_key, {p!r})' for p in prefixes)} GROUP BY ALL" for d, prefixes in X.DOMAINS.items())
    + " UNION ALL SELECT 'all', metric_key, count(value)::BIGINT FROM m GROUP BY ALL"
)
def domain_metrics(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    prefix = F.when(kind == "click", "pitch_").when(kind == "view", "hit_").when(kind == "purchase", "mob_").when(kind == "error", "screen_").otherwise("proteus_")
    # metrics are counted once; domains pick of the counts
    n = t.events.groupBy(F.concat(prefix, (F.col("user_id") % 7).cast("string")).alias("metric_key")).agg(F.count("value").alias("n"))
    domains = F.array_compact(F.array(*(F.when(X.in_domain("metric_key", d), F.lit(d)) for d in [*X.DOMAINS, "all"])))
    return n.select(F.explode(domains).alias("domain"), "metric_key", "n")


@query("SELECT p_type, array_to_string(list_sort(list(DISTINCT split_part(p_brand || '.' || p_size, '.', 1))), ',') AS families FROM part GROUP BY ALL")
def family_set(t: Tables) -> DataFrame:
    rows = t.part.select("p_type", F.concat_ws(".", "p_brand", "p_size").alias("id"))
    return links.family_sets(rows, ["p_type"], "id").withColumn("families", F.array_join("families", ","))


_CURATED = ["Brand#1", "Brand#3", "Brand#5"]


@query(
    f"""SELECT p_brand, count(DISTINCT o_custkey)::BIGINT AS n_entities, round(avg(l_quantity) + 1e-9, 1) AS avg_l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE p_type = 'PROMO' AND p_brand IN ({', '.join(repr(n) for n in _CURATED)}) GROUP BY ALL"""
)
def curated_staples(t: Tables) -> DataFrame:
    given = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return links.curated_prevalence(given, _CURATED, "o_custkey", "p_brand", F.col("p_type") == "PROMO", averages=["l_quantity"])


_WIDE = ["1-URGENT/F", "2-HIGH/O", "5-LOW/P"]


@query(f"WITH l AS ({_LONG}) SELECT c_custkey, " + ", ".join(f"""{R4(f"max(z) FILTER (metric_key = '{m}')")} AS "z_{m}" """ for m in _WIDE) + " FROM l GROUP BY ALL")
def wide_profile(t: Tables) -> DataFrame:
    wide = links.wide_profiles(_long(t), "c_custkey", _WIDE)
    return wide.select("c_custkey", *(r4(F.col(f"`z_{m}`")).alias(f"z_{m}") for m in _WIDE))


@query("SELECT dayofweek(o_orderdate)::INT AS dow, count(*) FILTER (o_orderpriority = '2-HIGH')::BIGINT AS n FROM orders GROUP BY ALL ORDER BY n DESC, dow LIMIT 3")
def workday_preference(t: Tables) -> DataFrame:
    return links.preferred_days(t.orders.withColumn("dow", F.dayofweek("o_orderdate") - 1), "dow", F.col("o_orderpriority") == "2-HIGH")


@query(
    f"""WITH l AS ({_LONG}), s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
    SELECT c_custkey, metric_key, {R4('z')} AS z FROM l WHERE c_custkey IN (FROM s) AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
)
def corpus_inner(t: Tables) -> DataFrame:
    summaries = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    who = t.customer.withColumn("role", F.when(F.col("c_acctbal") > 0, "both").otherwise("none"))
    found = corpus.corpus_long(_long(t), summaries, who, "c_custkey", "pitcher")
    return found.select("c_custkey", "metric_key", r4("z").alias("z"))


# ---- documents ------------------------------------------------------------


def _names(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id")).where("id % 3 != 0").select("id", F.col("p_name").alias("name"))


def _documents(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    items = lines.select("l_orderkey", F.col("l_returnflag").alias("component"), F.col("l_linestatus").alias("session"), F.col("l_linenumber").alias("place"), F.col("p_name").alias("name"), F.when(F.col("l_discount") > 0, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("x10"))).alias("dose"))
    days = t.lineitem.where("l_quantity > 25").select("l_orderkey", (F.dayofweek("l_shipdate") - 1).alias("day"), F.col("l_returnflag").alias("component"), F.col("l_linestatus").alias("session"))
    resolved = S.resolve_names(items, _names(t), threshold=2.0, kind="levenshtein")
    return payload.compiled(items, resolved, days.distinct(), "l_orderkey")


_IDS = "c AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY ALL HAVING min(p_partkey) % 3 != 0)"


@query(
    f"""WITH {_IDS} SELECT l_orderkey, l_returnflag AS component, l_linestatus AS session, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, p_name, CASE WHEN l_discount > 0 THEN l_quantity::INT || 'x10' END NULLS FIRST)::INT AS place, p_name AS name, c.id,
    CASE WHEN c.id IS NULL THEN 'unmatched' ELSE 'exact' END AS method, CASE WHEN l_discount > 0 THEN l_quantity::INT || 'x10' END AS dose FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN c ON c.name = p_name"""
)
def payload_items(t: Tables) -> DataFrame:
    return payload.flattened(_documents(t), "l_orderkey")


@query(
    f"""WITH {_IDS}, u AS (SELECT l_orderkey, count(DISTINCT p_name)::BIGINT AS n_unmatched FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name NOT IN (SELECT name FROM c) GROUP BY ALL),
    d AS (SELECT l_orderkey, count(DISTINCT (dayofweek(l_shipdate), l_returnflag, l_linestatus))::BIGINT AS n_days FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
    SELECT l_orderkey, coalesce(n_days, 0) AS n_days, coalesce(n_unmatched, 0) AS n_unmatched, count(DISTINCT l_returnflag)::BIGINT AS n_components FROM lineitem LEFT JOIN u USING (l_orderkey) LEFT JOIN d USING (l_orderkey) GROUP BY ALL"""
)
def payload_tree(t: Tables) -> DataFrame:
    p = F.from_json("payload", payload.SCHEMA)
    tree = _documents(t).select("l_orderkey", p.alias("p"))
    return tree.select("l_orderkey", F.size("p.days").cast("long").alias("n_days"), F.size("p.unmatched").cast("long").alias("n_unmatched"), F.size("p.components").cast("long").alias("n_components"))
