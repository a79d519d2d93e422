"""Facts, norms, profiles and latest rows over the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridial.functions import rows as X
from meridial.operators import facts, norms
from meridial.plans.registry import R4, Tables, query, r4


def order_sessions(t: Tables) -> DataFrame:
    """Orders as sessions: the customer is the entity, the priority the modality, the price the value."""
    return t.orders.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("session_date"), F.col("o_orderpriority").alias("modality"), F.lit("price").alias("metric_key"), F.col("o_totalprice").alias("value"))


def session_means(t: Tables) -> DataFrame:
    return order_sessions(t).groupBy("entity", "session_date", "modality", "metric_key").agg(F.avg("value").alias("value"))


def groups(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("entity"), X.age_group(F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")), F.col("c_nationkey")).alias("age_group"))


_GROUP = "coalesce(nullif(trim(nullif(c_mktsegment, 'FURNITURE')), ''), CASE WHEN c_nationkey < 14 THEN 'YOUTH' WHEN c_nationkey < 19 THEN 'HIGH SCHOOL' WHEN c_nationkey < 23 THEN 'COLLEGE' WHEN c_nationkey >= 23 THEN 'PRO' ELSE 'unknown' END)"
_SESSIONS = "SELECT o_custkey AS entity, o_orderdate::DATE AS session_date, o_orderpriority AS modality, 'price' AS metric_key, avg(o_totalprice) AS value FROM orders GROUP BY ALL"
_STATS = f"count(value)::BIGINT AS n_observations, {R4('avg(value)')} AS mean_value, {R4('stddev_samp(value)')} AS std_value, " + ", ".join(f"{R4(f'quantile_cont(value, {p})')} AS p{round(100 * p):02d}" for p in norms.QUANTILES)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r4(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


@query(f"WITH s AS ({_SESSIONS}), g AS (SELECT c_custkey AS entity, {_GROUP} AS age_group FROM customer) SELECT modality, metric_key, age_group, {_STATS} FROM s JOIN g USING (entity) GROUP BY ALL HAVING count(value) >= 5")
def norm_stats(t: Tables) -> DataFrame:
    return rounded(norms.norm_stats(session_means(t).join(groups(t), "entity"), ["modality", "metric_key", "age_group"]))


WIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    f"""WITH l AS (SELECT o_custkey AS entity, o_orderdate::DATE AS session_date, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    u AS (UNPIVOT l ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric_key VALUE v),
    s AS (SELECT entity, session_date, metric_key, avg(v) AS value FROM u GROUP BY ALL), g AS (SELECT c_custkey AS entity, {_GROUP} AS age_group FROM customer)
    SELECT metric_key, age_group, {_STATS} FROM s JOIN g USING (entity) GROUP BY ALL HAVING count(value) >= 5"""
)
def norm_stats_wide(t: Tables) -> DataFrame:
    wide = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("session_date"), *WIDE)
    spec = [facts.Metric("lineitem", "lines", c, F.col(c)) for c in WIDE]
    values = facts.session_values({"lineitem": wide}, spec)
    return rounded(norms.norm_stats(values.join(groups(t), "entity"), ["metric_key", "age_group"]))


@query(f"WITH l AS (SELECT l_returnflag, l_extendedprice AS value FROM lineitem) SELECT l_returnflag, {_STATS} FROM l GROUP BY ALL HAVING count(value) >= 5")
def norm_stats_spread(t: Tables) -> DataFrame:
    """Three groups of all order lines: quantiles by ranges, no group in one task."""
    return rounded(norms.norm_stats(t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("value")), ["l_returnflag"], spread=True))


@query(f"SELECT user_id, event_type, count(*)::BIGINT AS n, {R4('avg(try_cast(json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ') AS DOUBLE))')} AS mean_k FROM events WHERE json_exists(props, '$.k') GROUP BY ALL")
def json_metric_mean(t: Tables) -> DataFrame:
    e = t.events.withColumn("m", X.json_map("props")).where(X.has_key("m", "k"))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), r4(F.avg(X.json_number("m", "k"))).alias("mean_k"))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a.b@c d": [' || json_extract_string(props, '$.k') || ', 7]}' WHEN 1 THEN '{"a.b@c d": ' || json_extract_string(props, '$.k') || '}'
    WHEN 2 THEN '{"a.b@c d": "' || json_extract_string(props, '$.k') || '"}' ELSE '{"a.b@c d": "AMRAP"}' END AS j FROM events)
    SELECT event_id, CASE WHEN json_type(j, '$."a.b@c d"') = 'ARRAY' THEN try_cast(json_extract_string(j, '$."a.b@c d"[0]') AS DOUBLE) ELSE try_cast(json_extract_string(j, '$."a.b@c d"') AS DOUBLE) END AS number FROM e"""
)
def json_poly_number(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), k, F.lit(", 7]"))).when(F.col("event_id") % 4 == 1, k).when(F.col("event_id") % 4 == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise('"AMRAP"')
    e = t.events.select("event_id", X.json_map(F.concat(F.lit('{"a.b@c d": '), body, F.lit("}"))).alias("m"))
    return e.select("event_id", X.json_number("m", "a.b@c d").alias("number"))


@query(f"SELECT user_id, {R4('avg(abs(value - try_cast(json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ') AS DOUBLE)) * 1000)')} AS mean_gap, count(*)::BIGINT AS n FROM events WHERE json_exists(props, '$.k') GROUP BY ALL")
def json_diff_scaled(t: Tables) -> DataFrame:
    e = t.events.withColumn("m", X.json_map("props")).where(X.has_key("m", "k"))
    gap = X.scaled(F.col("value") - X.json_number("m", "k"), absolute=True, scale=1000.0)
    return e.groupBy("user_id").agg(r4(F.avg(gap)).alias("mean_gap"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 12.5 WHEN 2 THEN 37.5 WHEN 3 THEN 75.0 ELSE p_size END::DOUBLE AS grade FROM part")
def grade_recode(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.recode("p_size", {1: 12.5, 2: 37.5, 3: 75.0}).alias("grade"))


@query(f"SELECT c_mktsegment, {R4('avg((c_acctbal > 0)::INT)')} AS share_positive, count(*) FILTER (c_acctbal > 0)::BIGINT AS n_positive, count(*) FILTER (c_nationkey < 10)::BIGINT AS n_low, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def flag_proportion(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(r4(F.avg((F.col("c_acctbal") > 0).cast("int"))).alias("share_positive"), F.count_if(F.col("c_acctbal") > 0).alias("n_positive"), F.count_if(F.col("c_nationkey") < 10).alias("n_low"), F.count("*").alias("n"))


@query(
    f"""SELECT p_brand, {R4('avg(l_quantity)')} AS mean_quantity, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_name ILIKE '%IN%' AND p_name NOT LIKE 'old %' AND p_type NOT IN ('PROMO') AND (nullif(p_type, 'SMALL') IS NULL OR p_type NOT ILIKE 'st%') GROUP BY ALL"""
)
def ilike_variant_mean(t: Tables) -> DataFrame:
    kind = F.nullif(F.col("p_type"), F.lit("SMALL"))
    part = t.part.where(F.ilike(F.col("p_name"), F.lit("%IN%")) & ~F.col("p_name").like("old %") & ~F.col("p_type").isin("PROMO") & X.not_prefixed(kind, "st"))
    return t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(r4(F.avg("l_quantity")).alias("mean_quantity"), F.count("*").alias("n"))


@query(
    f"""WITH a AS (SELECT l_suppkey, avg(l_quantity) FILTER (lower(substr(l_linestatus, 1, 1)) = 'f') AS l, avg(l_quantity) FILTER (lower(substr(l_linestatus, 1, 1)) = 'o') AS r FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, {R4('l')} AS left_mean, {R4('r')} AS right_mean, {R4('100 * (l - r) / nullif(greatest(l, r), 0)')} AS asymmetry_pct FROM a"""
)
def side_asymmetry(t: Tables) -> DataFrame:
    sided = t.lineitem.withColumn("side", F.when(X.side_is("l_linestatus", "f"), "f").when(X.side_is("l_linestatus", "o"), "o"))
    return rounded(facts.asymmetry(sided, ["l_suppkey"], "side", "l_quantity", "f", "o"))


@query(
    """WITH a AS (SELECT c_custkey, c_acctbal > 5000 OR EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS p, c_nationkey < 5 OR EXISTS (FROM events WHERE user_id = c_custkey AND event_type = 'error') AS h FROM customer)
    SELECT c_custkey, CASE WHEN p AND h THEN 'both' WHEN p THEN 'pitcher' WHEN h THEN 'hitter' ELSE 'unknown' END AS role FROM a"""
)
def entity_role(t: Tables) -> DataFrame:
    pitching = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    hitting = t.events.where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    flags = {"pitcher": F.col("c_acctbal") > 5000, "hitter": F.col("c_nationkey") < 5}
    return facts.roles(t.customer, "c_custkey", flags, {"pitcher": pitching, "hitter": hitting}).select("c_custkey", "role")


AS_OF = datetime.date(1998, 12, 31)


def as_of(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("entity"), F.lit(AS_OF).alias("as_of_date"))


@query("SELECT o_custkey AS entity, DATE '1998-12-31' AS as_of_date, o_orderpriority AS modality, max(o_orderdate::DATE) AS session_date FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate::DATE <= DATE '1998-12-31' GROUP BY ALL")
def asof_session(t: Tables) -> DataFrame:
    return norms.asof_sessions(order_sessions(t), as_of(t))


_PROFILE = f"""s AS ({_SESSIONS}), g AS (SELECT c_custkey AS entity, {_GROUP} AS age_group FROM customer),
    n AS (SELECT modality, metric_key, age_group, avg(value) AS mean_value, stddev_samp(value) AS std_value FROM s JOIN g USING (entity) GROUP BY ALL HAVING count(value) >= 5),
    a AS (SELECT entity, modality, max(session_date) AS session_date FROM s WHERE session_date <= DATE '1998-12-31' GROUP BY ALL),
    p AS (SELECT s.entity, DATE '1998-12-31' AS as_of_date, s.modality, s.metric_key, s.session_date, s.value, g.age_group, (s.value - mean_value) / nullif(std_value, 0) AS z
          FROM s JOIN a USING (entity, modality, session_date) JOIN g USING (entity) LEFT JOIN n ON n.modality = s.modality AND n.metric_key = s.metric_key AND n.age_group = g.age_group)"""


def profiles_of(t: Tables) -> DataFrame:
    values, entities = session_means(t), groups(t)
    return norms.asof_profiles(values, norms.norm_stats(values.join(entities, "entity"), ["modality", "metric_key", "age_group"]), entities, as_of(t))


@query(f"WITH {_PROFILE} SELECT entity, as_of_date, modality, metric_key, session_date, {R4('value')} AS value, age_group, {R4('z')} AS z FROM p")
def asof_zscore_profile(t: Tables) -> DataFrame:
    return rounded(profiles_of(t))


@query(f"WITH {_PROFILE} SELECT entity, modality AS metric_key, {R4('value')} AS raw_value, {R4('z')} AS z FROM p")
def profile_maps_long(t: Tables) -> DataFrame:
    p = profiles_of(t).withColumn("metric_key", F.col("modality"))
    m = norms.profile_maps(p).select("entity", "z_scores", F.explode("raw_values").alias("metric_key", "raw_value"))
    return m.select("entity", "metric_key", r4("raw_value").alias("raw_value"), r4(F.element_at("z_scores", F.col("metric_key"))).alias("z"))


def _sources(t: Tables) -> list[DataFrame]:
    return [t.orders.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("session_date")), t.events.select(F.col("user_id").alias("entity"), F.to_date("ts").alias("session_date"))]


@query("SELECT o_custkey AS entity, o_orderdate::DATE AS session_date FROM orders UNION SELECT user_id, ts::DATE FROM events")
def session_pairs(t: Tables) -> DataFrame:
    return facts.session_pairs(_sources(t))


@query("SELECT entity, max(session_date) AS session_date FROM (SELECT o_custkey AS entity, o_orderdate::DATE AS session_date FROM orders UNION ALL SELECT user_id, ts::DATE FROM events) GROUP BY ALL")
def latest_session(t: Tables) -> DataFrame:
    return facts.latest_sessions(_sources(t))


@query("SELECT event_type, count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_entities, min(event_id) AS min_order, max(event_id) AS max_order FROM events GROUP BY ALL")
def metric_discovery(t: Tables) -> DataFrame:
    return facts.discover(t.events, "event_type", "user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS session_date, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) = 1")
def latest_row(t: Tables) -> DataFrame:
    return norms.latest(t.orders, ["o_custkey"], F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("session_date"), "o_orderpriority")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS d, o_totalprice FROM orders WHERE o_totalprice > 1000 OR o_orderpriority = '1-URGENT')
    SELECT o_custkey, o_orderkey, d FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS LAST, o_orderkey) = 1"""
)
def latest_nulls_last(t: Tables) -> DataFrame:
    o = t.orders.where("o_totalprice > 1000 OR o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("d"))
    return norms.latest(o, ["o_custkey"], F.col("d").desc_nulls_last(), F.col("o_orderkey"))


@query(
    """SELECT c_mktsegment, c_custkey, 'strength' AS kind, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 3
    UNION ALL SELECT c_mktsegment, c_custkey, 'deficit', row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS place FROM customer QUALIFY place <= 3"""
)
def top_bottom_n(t: Tables) -> DataFrame:
    c = t.customer
    best = norms.top(c, ["c_mktsegment"], 3, F.col("c_acctbal").desc(), "c_custkey", rank="place").withColumn("kind", F.lit("strength"))
    worst = norms.top(c, ["c_mktsegment"], 3, F.col("c_acctbal"), "c_custkey", rank="place").withColumn("kind", F.lit("deficit"))
    return best.unionByName(worst).select("c_mktsegment", "c_custkey", "kind", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1")
def best_trial(t: Tables) -> DataFrame:
    return facts.best_trial(t.orders, ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


_POINTS = [(5, -900.0), (25, 1500.0), (50, 4400.0), (75, 7300.0), (95, 9400.0)]


@query(
    f"""WITH b AS (SELECT * FROM (VALUES {', '.join(str(p) for p in _POINTS)}) v(pct, v)), n AS (SELECT *, lead(pct) OVER (ORDER BY v) AS p2, lead(v) OVER (ORDER BY v) AS v2 FROM b)
    SELECT c_custkey, {R4("CASE WHEN c_acctbal < -900 THEN 5 WHEN c_acctbal >= 9400 THEN 95 ELSE (SELECT any_value(pct + (p2 - pct) * (c_acctbal - v) / (v2 - v)) FROM n WHERE v <= c_acctbal AND c_acctbal < v2) END")} AS percentile FROM customer"""
)
def percentile_lookup(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.lit("acctbal").alias("metric"), F.col("c_acctbal").alias("value"))
    rows = c.sparkSession.range(1).select(F.lit("acctbal").alias("metric"), F.explode(F.array(*(F.struct(F.lit(p).alias("pct"), F.lit(v).alias("value")) for p, v in _POINTS))).alias("x"))
    points = rows.select("metric", "x.*")
    return norms.interpolated_percentile(c, points).select("c_custkey", r4("percentile").alias("percentile"))


@query(
    """SELECT p_partkey, CASE WHEN p_retailprice >= 2000 THEN 'Elite' WHEN p_retailprice >= 1500 AND p_retailprice < 1900 THEN 'Strength' WHEN p_retailprice >= 1000 AND p_retailprice < 1600 THEN 'Watch' WHEN p_retailprice < 950 THEN 'Flag' ELSE 'Neutral' END AS status FROM part"""
)
def band_status(t: Tables) -> DataFrame:
    bands = [(2000, None, "Elite"), (1500, 1900, "Strength"), (1000, 1600, "Watch"), (None, 950, "Flag")]
    return t.part.select("p_partkey", X.banded("p_retailprice", bands).alias("status"))


@query("SELECT s_nationkey, s_suppkey, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)::BIGINT AS place, s_acctbal = max(s_acctbal) OVER (PARTITION BY s_nationkey) AS leads FROM supplier")
def cohort_rank(t: Tables) -> DataFrame:
    w = Window.partitionBy("s_nationkey")
    return t.supplier.select("s_nationkey", "s_suppkey", F.dense_rank().over(w.orderBy(F.col("s_acctbal").desc())).cast("long").alias("place"), (F.col("s_acctbal") == F.max("s_acctbal").over(w)).alias("leads"))


@query("SELECT o_custkey, dayofweek(o_orderdate)::INT AS dow, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS level FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def first_per_weekday(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderstatus <> 'P'")
    return o.groupBy("o_custkey", (F.dayofweek("o_orderdate") - 1).alias("dow")).agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("level"))
