"""Correlations, clusters, reports, cadence and call logs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridial.functions import rows as X
from meridial.operators import biomech as B
from meridial.operators import cadence as K
from meridial.operators import corpus as P
from meridial.plans.profiles import rounded
from meridial.plans.registry import ORACLES, R4, Tables, query, r4


def _metrics(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("metric_key")).agg(F.avg("o_totalprice").alias("value"))


_METRICS = "m AS (SELECT o_custkey AS entity, o_orderpriority AS metric_key, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


def _features(t: Tables) -> DataFrame:
    g = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("entity")).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returns"), F.count_if(F.col("l_quantity") == 50).cast("double").alias("full"))
    return g.unpivot("entity", ["quantity", "discount", "returns", "full"], "feature", "value")


_FEATURES = """w AS (SELECT o_custkey AS entity, sum(l_quantity) AS quantity, avg(l_discount) AS discount, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS returns, count(*) FILTER (l_quantity = 50)::DOUBLE AS "full" FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    f AS (UNPIVOT w ON quantity, discount, returns, "full" INTO NAME feature VALUE value)"""
_PAIRS = f"{_METRICS}, {_FEATURES}, r AS (SELECT metric_key, feature, count(*)::BIGINT AS n_pairs, {R4('corr(m.value, f.value)')} AS r FROM m JOIN f USING (entity) GROUP BY ALL HAVING count(*) >= 15)"


@query(f"WITH {_PAIRS} SELECT * FROM r")
def pearson_pairs(t: Tables) -> DataFrame:
    return rounded(P.pearson_pairs(_metrics(t), _features(t), "entity"))


@query(f"WITH {_PAIRS} SELECT * FROM r ORDER BY abs(r) DESC NULLS LAST, metric_key, feature LIMIT 12")
def top_corr(t: Tables) -> DataFrame:
    return P.strongest(rounded(P.pearson_pairs(_metrics(t), _features(t), "entity")), 12)


@query(f"WITH {_METRICS}, s AS (SELECT metric_key FROM m GROUP BY ALL HAVING count(*) >= 0.86 * (SELECT count(DISTINCT entity) FROM m)), k AS (SELECT m.* FROM m SEMI JOIN s USING (metric_key)) SELECT entity, metric_key, {R4('value')} AS value FROM k WHERE entity IN (SELECT entity FROM k GROUP BY ALL HAVING count(*) >= 0.5 * (SELECT count(*) FROM s))")
def coverage_filter(t: Tables) -> DataFrame:
    return rounded(P.covered(_metrics(t), "entity", min_coverage=0.86).select("entity", "metric_key", "value"))


@query(f"WITH {_FEATURES} SELECT feature, count(*)::BIGINT AS n_nonzero FROM f WHERE value <> 0 GROUP BY ALL HAVING count(*) >= 0.6 * (SELECT count(DISTINCT entity) FROM f)")
def sparse_feature_drop(t: Tables) -> DataFrame:
    return P.dense_features(_features(t), "entity", min_nonzero=0.6)


@query(f"WITH {_METRICS}, n AS (SELECT count(DISTINCT entity) AS n FROM m), s AS (SELECT metric_key, avg(value) AS mu, sqrt((sum(value * value) - count(*) * avg(value) ** 2) / any_value(n)) AS sd FROM m, n GROUP BY ALL) SELECT entity, metric_key, {R4('(value - mu) / nullif(sd, 0)')} AS z FROM m JOIN s USING (metric_key)")
def standardise(t: Tables) -> DataFrame:
    return rounded(P.standardise(_metrics(t), "entity"))


def _places(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("label").alias("cluster"), F.posexplode("embedding").alias("i", "x")).select("vec_id", "cluster", F.concat(F.lit("z_dim_velocity_"), F.col("i").cast("string")).alias("metric_key"), (F.col("x").cast("double") * 8).alias("value"))


_MEANS = "p AS (SELECT vec_id, label AS cluster, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * 8 AS value FROM embeddings), a AS (SELECT cluster, 'z_dim_velocity_' || i AS metric_key, count(DISTINCT vec_id)::BIGINT AS size, round(avg(value) + 1e-9, 2) + 0.0 AS mean FROM p GROUP BY ALL)"


@query(f"WITH {_MEANS} SELECT * FROM a")
def archetype_means(t: Tables) -> DataFrame:
    return P.cluster_means(_places(t), "cluster", "vec_id")


@query(
    f"""WITH {_MEANS}, l AS (SELECT cluster, 0 AS o, metric_key, mean, row_number() OVER (PARTITION BY cluster ORDER BY mean, metric_key) AS n FROM a WHERE mean <= -0.4 QUALIFY n <= 4),
    h AS (SELECT cluster, 1 AS o, metric_key, mean, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, metric_key) AS n FROM a WHERE mean >= 0.4 QUALIFY n <= 4), u AS (FROM l UNION ALL FROM h),
    s AS (SELECT cluster, string_agg(CASE o WHEN 0 THEN '↓ ' ELSE '↑ ' END || replace(replace(regexp_replace(metric_key, '^z_', ''), '_', ' '), 'velocity', 'vel'), ' · ' ORDER BY o, n) AS bare FROM u GROUP BY ALL)
    SELECT DISTINCT a.cluster, coalesce(bare, 'near-population-average') AS bare FROM a LEFT JOIN s USING (cluster)"""
)
def archetype_label(t: Tables) -> DataFrame:
    labelled = P.label_clusters(P.cluster_means(_places(t), "cluster", "vec_id"), "cluster")
    return labelled.select("cluster", F.regexp_replace("label", r" \([+-][0-9.]+\)", "").alias("bare"))


@query()
def kmeans_archetypes(t: Tables) -> DataFrame:
    return P.cluster(P.standardised_vectors(t.embeddings, "embedding"), "embedding", n_init=3).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def pca_2d(t: Tables) -> DataFrame:
    return P.components(P.standardised_vectors(t.embeddings, "embedding"), "embedding").select("vec_id", "components")


# ---- reports --------------------------------------------------------------


@query(
    f"""WITH r AS (SELECT user_id, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL), w AS (PIVOT r ON metric IN ('click', 'error', 'purchase', 'signup', 'view') USING first(value)),
    v AS (SELECT user_id, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, min(value) AS min, max(value) AS max, count(*)::BIGINT AS count FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT user_id, {R4('click')} AS click, {R4('error')} AS error, {R4('purchase')} AS purchase, {R4('click * error')} AS product, {R4('view - signup')} AS extension, {R4('purchase / nullif(view, 0)')} AS per_view, {R4('mean')} AS velocity_mean, {R4('sd')} AS velocity_sd, count AS n_pitches FROM w JOIN v USING (user_id)"""
)
def report_features(t: Tables) -> DataFrame:
    return _report_features(t, t.events)


@query(ORACLES["report_features"])
def report_features_all(t: Tables) -> DataFrame:
    """The former name of ``report_features`` over all events."""
    return _report_features(t, t.events)


def _report_features(t: Tables, events: DataFrame) -> DataFrame:
    scalars = events.select("user_id", F.col("event_type").alias("metric"), "value")
    names = ["click", "error", "purchase", "signup", "view"]
    derived = {"product": F.col("click") * F.col("error"), "extension": F.col("view") - F.col("signup"), "per_view": B.ratio("purchase", "view")}
    f = B.report_features(B.report_means(scalars, "user_id"), "user_id", names, derived)
    v = B.velocity_summary(t.events.where("event_type = 'purchase'"), "user_id", "value")
    out = f.join(v, "user_id").select("user_id", "click", "error", "purchase", "product", "extension", "per_view", F.col("mean").alias("velocity_mean"), F.col("sd").alias("velocity_sd"), F.col("count").alias("n_pitches"))
    return rounded(out)


@query(
    f"""WITH r AS (SELECT user_id, (event_id % 13) * 10 AS ms, avg(value) AS v FROM events GROUP BY ALL) SELECT user_id, coalesce(max(ms) FILTER (ms BETWEEN 10 AND 120 AND v <= 45), 0)::INT AS dwell_ms FROM r GROUP BY ALL"""
)
def dwell_time(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Shoulder_Angle@Footstrike_"), ((F.col("event_id") % 13) * 10).cast("string"), F.lit("ms_X"))
    means = B.report_means(t.events.select("user_id", name.alias("metric"), "value"), "user_id")
    return B.dwell_ms(means, "user_id", r"@Footstrike_(\d+)ms_X$", threshold=45.0)


@query(
    """WITH c AS (SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal > 8000 THEN 'model' END, CASE WHEN c_acctbal > 6000 AND c_nationkey < 10 THEN 'sequenced' END, CASE WHEN c_acctbal < 0 THEN 'compensating' END], lambda x: x IS NOT NULL), ',') AS archetypes FROM customer) SELECT * FROM c"""
)
def archetype_rules(t: Tables) -> DataFrame:
    rules = {"model": F.col("c_acctbal") > 8000, "sequenced": (F.col("c_acctbal") > 6000) & (F.col("c_nationkey") < 10), "compensating": F.col("c_acctbal") < 0}
    return t.customer.select("c_custkey", F.array_join(B.labels(rules), ",").alias("archetypes"))


def _profile_sql() -> str:
    n = len(B.MEASURES)
    op = {"*": "{0} * {1}", "-": "{0} - {1}", "/": "{0} / nullif({1}, 0)", "ms": "({0} - {1}) * 1000"}
    means = ", ".join(f"avg(value) FILTER (event_id % {n} = {i}) AS {name}" for i, name in enumerate(B.MEASURES))
    named = [*(f"{R4(name)} AS {name}" for name in B.MEASURES), *(f"{R4(op[o].format(a, b))} AS {name}" for name, (a, o, b) in B.DERIVED.items())]
    return f"WITH m AS (SELECT user_id, {means} FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT user_id, {', '.join(named)} FROM m"


@query(_profile_sql())
def report_profile(t: Tables) -> DataFrame:
    metrics = F.array(*map(F.lit, B.MEASURES.values()))
    named = t.events.where("value IS NOT NULL").select("user_id", F.get(metrics, F.col("event_id") % len(B.MEASURES)).alias("metric"), "value")
    means = named.groupBy("user_id", "metric").agg(F.avg("value").alias("value"))
    wide = B.report_profile(means, "user_id")
    return wide.select("user_id", *(r4(c).alias(c) for c in wide.columns if c != "user_id"))


#: Ranges in which customers' balances are spread as values of the metrics.
_RANGES = {
    "stride_pct": (65, 90), "separation_fs": (20, 75), "trunk_product": (0, 480), "knee_extension": (0, 40), "lead_grf": (1, 2.4), "forward_flex": (10, 60), "lateral_tilt": (5, 50), "dwell_ms": (0, 80), "back_grf": (1, 2),
    "lead_braking": (-1.3, -0.3), "elbow_torque": (70, 140), "stress_per_mph": (1.0, 1.5), "shoulder_distraction": (0.3, 1.2), "pelvis_stop_ms": (100, 220), "rotation_fs": (10, 80), "max_rotation": (150, 205),
    "pelvis_fs": (0, 500), "amplification": (1.0, 1.9), "hand_amplification": (0.8, 1.2), "velocity_sd": (0, 1), "pelvis_peak": (600, 1000),
}


def _spread(metric: str) -> tuple[str, tuple[float, float]]:
    """SQL of both engines for a customer's share of the range, and the range."""
    i = list(_RANGES).index(metric) + 2
    return f"((c_custkey * {i * 37}) % 101 + c_acctbal / 10000 / {i}) / 102", _RANGES[metric]


def _metric_sql(metric: str) -> str:
    share, (low, high) = _spread(metric)
    return f"({float(low)!r}::DOUBLE + {share} * {float(high - low)!r}::DOUBLE)"


def _metric(metric: str) -> Column:
    share, (low, high) = _spread(metric)
    return F.lit(float(low)) + F.expr(share) * F.lit(float(high - low))


def _status_sql(metric: str) -> str:
    v = _metric_sql(metric)
    bounds = lambda a, z: " AND ".join([f"{v} >= {a}"] * (a is not None) + [f"{v} < {z}"] * (z is not None))
    return "CASE " + " ".join(f"WHEN {bounds(a, z)} THEN '{s}'" for a, z, s in B.BANDS[metric]) + " ELSE 'Neutral' END"


@query(f"SELECT metric, status, count(*)::BIGINT AS n FROM ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {_status_sql(m)} AS status FROM customer" for m in B.BANDS)}) GROUP BY ALL")
def cylinder_bands(t: Tables) -> DataFrame:
    each = t.customer.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _metric(m).alias("value")) for m in B.BANDS))).alias("x")).select("x.*")
    return each.select("metric", B.status_of("metric", "value").alias("status")).groupBy("metric", "status").agg(F.count("*").alias("n"))


def _count_sql(names: str) -> str:
    return "(" + " + ".join(f"(({_status_sql(m)}) IN ({names}))::INT" for m in B.CYLINDERS) + ")"


def _archetypes_sql() -> str:
    value = lambda m: {"n_strong": _count_sql("'Elite', 'Strength', 'Healthy'"), "n_flags": _count_sql("'Flag', 'Elevated'")}.get(m) or _metric_sql(m)
    cases = [f"CASE WHEN {' AND '.join(f'{value(m)} {op} {x}' for m, op, x in rules)} THEN '{name}' END" for name, rules in B.ARCHETYPES.items()]
    return f"SELECT c_custkey, array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',') AS archetypes FROM customer"


@query(_archetypes_sql())
def archetype_profiles(t: Tables) -> DataFrame:
    values = {m: F.col(m) for m in _RANGES}
    wide = t.customer.select("c_custkey", *(_metric(m).alias(m) for m in _RANGES))
    return wide.select("c_custkey", F.array_join(B.archetypes_of(values | B.cylinder_counts(values)), ",").alias("archetypes"))


@query(
    f"SELECT l_suppkey, {R4('avg(l_quantity) FILTER ((lower(l_linestatus) = ' + chr(39) + 'f' + chr(39) + ') = (l_suppkey % 2 = 0))')} AS plant_mean, {R4('avg(l_quantity) FILTER ((lower(l_linestatus) = ' + chr(39) + 'f' + chr(39) + ') <> (l_suppkey % 2 = 0))')} AS drive_mean FROM lineitem GROUP BY ALL"
)
def plant_drive(t: Tables) -> DataFrame:
    side = t.lineitem.withColumn("side", F.when(F.lower("l_linestatus") == "f", "left").otherwise("right"))
    return rounded(B.plant_and_drive(side, ["l_suppkey"], "side", "l_quantity", F.col("l_suppkey") % 2 == 0))


# ---- cadence --------------------------------------------------------------


@query(
    """WITH g AS (SELECT c_custkey, c_nationkey % 7 AS g, c_acctbal < 0 AS off FROM customer), d AS (SELECT *, unnest(range(7))::INT AS dow FROM g)
    SELECT c_custkey, dow, CASE WHEN off THEN ['P0', 'P0', 'P1', 'P2', 'P0', 'P1', 'P1'][dow + 1] ELSE ['P1', 'P0', 'P0', 'P1', 'P1', 'P0', 'P1'][((dow - g + 7) % 7 + 1)::INT] END AS level FROM d"""
)
def cadence_offsets(t: Tables) -> DataFrame:
    day = F.element_at(F.array(*(F.lit(d.title()) for d in K.DAYS)), F.col("c_nationkey") % 7 + 1)
    return K.week(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), day, F.col("c_acctbal") < 0).select("c_custkey", "dow", "level")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN greatest(least((o_orderkey % 5)::INT, 2), 1) WHEN 2 THEN least((o_orderkey % 5)::INT, 1) ELSE least((o_orderkey % 5)::INT, 3) END AS level FROM orders"""
)
def phase_gate(t: Tables) -> DataFrame:
    m = F.col("o_orderkey") % 4
    phase = F.when(m == 0, "Recovery").when(m == 1, "Preseason Build").when(m == 2, "Rebuild Capacity").otherwise("other")
    return t.orders.select("o_orderkey", K.phase_gate((F.col("o_orderkey") % 5).cast("int"), phase).alias("level"))


@query(
    """WITH a AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
    g AS (SELECT d.user_id, d.day, (d.day - max(a.day))::INT AS gap FROM d LEFT JOIN a ON a.user_id = d.user_id AND a.day < d.day GROUP BY d.user_id, d.day) SELECT *, CASE WHEN gap = 1 THEN 'P0' WHEN gap <= 3 THEN 'P1' ELSE 'P2' END AS level FROM g"""
)
def appearance_cadence(t: Tables) -> DataFrame:
    days = t.events.select("user_id", F.to_date("ts").alias("day")).distinct()
    return K.appearance_levels(days, t.events.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")), "user_id")


@query(
    """WITH h AS (SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN (user_id % 4 + 1)::INT END AS last, avg((event_type <> 'error')::INT) AS done, count(DISTINCT ts::DATE) AS weeks, bool_or(event_type = 'signup' AND value > 90) AS pain, user_id % 2 = 0 AS ready FROM events GROUP BY ALL)
    SELECT user_id, CASE WHEN last IS NULL THEN 1 WHEN done < 0.5 THEN greatest(1, last - 1) WHEN done >= 0.8 AND weeks >= 4 AND NOT pain AND ready THEN least(4, last + 1) ELSE last END::INT AS level FROM h"""
)
def progression_rule(t: Tables) -> DataFrame:
    u = F.col("user_id")
    h = t.events.groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("int")).alias("done"), F.countDistinct(F.to_date("ts")).alias("weeks"), F.max((F.col("event_type") == "signup") & (F.col("value") > 90)).alias("pain"))
    last = F.when(u % 7 != 0, (u % 4 + 1).cast("int"))
    return h.select("user_id", K.next_level(last, F.col("done"), F.col("weeks"), F.col("pain"), u % 2 == 0).cast("int").alias("level"))


@query(
    """WITH i AS (SELECT p_brand, ['Legs', 'Upper', 'Total Body'][(p_partkey % 3 + 1)::INT] AS bucket, min(p_partkey) AS template_id FROM part GROUP BY ALL), d AS (SELECT DISTINCT p_brand, unnest(['SUNDAY', 'MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY', 'SATURDAY']) AS day FROM part),
    b AS (SELECT *, CASE day WHEN 'MONDAY' THEN 'Legs' WHEN 'WEDNESDAY' THEN 'Upper' WHEN 'FRIDAY' THEN 'Total Body' END AS bucket FROM d) SELECT p_brand, day, b.bucket, template_id FROM b LEFT JOIN i USING (p_brand, bucket)"""
)
def weekly_layout(t: Tables) -> DataFrame:
    bucket = F.element_at(F.array(F.lit("Legs"), F.lit("Upper"), F.lit("Total Body")), (F.col("p_partkey") % 3 + 1).cast("int"))
    index = t.part.groupBy("p_brand", bucket.alias("bucket")).agg(F.min("p_partkey").alias("template_id"))
    return K.weekly_layout(t.part.select("p_brand").distinct(), ["p_brand"], index, {"MONDAY": "Legs", "WEDNESDAY": "Upper", "FRIDAY": "Total Body"}).select("p_brand", "day", "bucket", "template_id")


# ---- logs and versions ----------------------------------------------------

PRICES = {"click": (0.075, 0.30), "view": (0.30, 2.50), "purchase": (1.25, 10.0)}


@query(
    f"""WITH l AS (SELECT ts, event_type, event_id % 1000 AS a, event_id % 300 AS b, CASE WHEN event_id % 11 = 0 THEN '503 UNAVAILABLE' WHEN event_id % 13 = 0 THEN 'bad' END AS e FROM events), c AS (SELECT *, (a * CASE event_type WHEN 'click' THEN 0.075 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 1.25 ELSE 0 END::DOUBLE + b * CASE event_type WHEN 'click' THEN 0.3 WHEN 'view' THEN 2.5 WHEN 'purchase' THEN 10 ELSE 0 END::DOUBLE) / 1e6 AS cost FROM l)
    SELECT event_type, count(*)::BIGINT AS n_calls, sum(a)::BIGINT AS tokens_in, sum(b)::BIGINT AS tokens_out, round(sum(cost) + 1e-9, 6) AS spent, count(*) FILTER (e LIKE '%503%')::BIGINT AS n_transient FROM c WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL"""
)
def spend_24h(t: Tables) -> DataFrame:
    k = F.col("event_id")
    error = F.when(k % 11 == 0, "503 UNAVAILABLE").when(k % 13 == 0, "bad")
    now = t.events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    log = t.events.join(F.broadcast(now), F.col("ts") > F.col("since")).select("event_type", (k % 1000).alias("a"), (k % 300).alias("b"), error.alias("e")).withColumn("cost", X.cost("event_type", "a", "b", PRICES))
    return log.groupBy("event_type").agg(F.count("*").alias("n_calls"), F.sum("a").alias("tokens_in"), F.sum("b").alias("tokens_out"), F.round(F.sum("cost") + 1e-9, 6).alias("spent"), F.count_if(X.transient("e")).alias("n_transient"))


@query(
    """WITH h AS (SELECT conv_id, turn, sha256(coalesce(role, '')) AS hash FROM conversations), l AS (SELECT *, lag(hash) OVER w IS DISTINCT FROM hash AS changed FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn, hash))
    SELECT conv_id, turn, hash, sum(changed::INT) OVER (PARTITION BY conv_id ORDER BY turn, hash ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM l"""
)
def version_registry(t: Tables) -> DataFrame:
    """Roles stand for prompt texts: a new version wherever the hash changes."""
    w = Window.partitionBy("conv_id").orderBy("turn", "hash")
    h = t.conversations.select("conv_id", "turn", F.sha2(F.coalesce("role", F.lit("")), 256).alias("hash"))
    changed = (~F.lag("hash").over(w).eqNullSafe(F.col("hash"))).cast("int")
    return h.withColumn("c", changed).select("conv_id", "turn", "hash", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("version"))


@query(f"SELECT c_mktsegment, count(*)::BIGINT AS n, {R4('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM customer GROUP BY ALL")
def population_by_group(t: Tables) -> DataFrame:
    return P.share(t.customer, "c_mktsegment").withColumn("pct", r4("pct"))
