"""Sources, sinks and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridial.operators import norms
from meridial.plans.registry import R4, Tables, query, r4
from meridial.sources import tables as S
from meridial.sources.scratch import scratch
from meridial.streaming import twins as W


def _norms(t: Tables, low: str, high: str) -> DataFrame:
    o = t.orders.where(F.col("o_orderdate").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    return norms.norm_stats(o.select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("value")), ["o_orderpriority", "o_orderstatus"]).select("o_orderpriority", "o_orderstatus", "n_observations", r4("mean_value").alias("mean_value"))


def _norms_sql(low: str, high: str) -> str:
    return f"SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n_observations, {R4('avg(o_totalprice)')} AS mean_value FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '{low}' AND TIMESTAMP '{high}' GROUP BY ALL HAVING count(*) >= 5"


_OLD, _NEW = ("1995-01-01", "1996-12-31"), ("2001-07-25", "2001-12-31")


@query(f"WITH old AS ({_norms_sql(*_OLD)}), new AS ({_norms_sql(*_NEW)}) SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (o_orderpriority, o_orderstatus)")
def upsert_norms(t: Tables) -> DataFrame:
    return S.upserted(_norms(t, *_OLD), _norms(t, *_NEW), ["o_orderpriority", "o_orderstatus"])


@query(f"WITH old AS ({_norms_sql(*_OLD)}), new AS ({_norms_sql(*_NEW)} AND o_orderpriority < '3') SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3')".replace("HAVING count(*) >= 5 AND o_orderpriority < '3'", "HAVING count(*) >= 5 AND any_value(o_orderpriority) < '3'"))
def replace_partition(t: Tables) -> DataFrame:
    new = _norms(t, *_NEW).where("o_orderpriority < '3'")
    return S.replaced(_norms(t, *_OLD), new, ["o_orderpriority"], t.orders.where("o_orderpriority < '3'").select("o_orderpriority"))


@query("SELECT 'region' AS table_name, 'success' AS status, (SELECT count(*) FROM region)::BIGINT AS n_rows UNION ALL SELECT 'orders', 'success', (SELECT count(*) FROM orders) UNION ALL SELECT 'missing', 'error', NULL")
def sync_snapshot(t: Tables) -> DataFrame:
    spark = t.region.sparkSession
    target = scratch(spark)
    log = S.snapshot(lambda name: getattr(t, name), ["region", "orders", "missing"], target, spark)
    return log.select("table_name", "status", "n_rows")


@query("SELECT p_partkey::BIGINT AS p_partkey, p_name, NULL::INT AS p_brand, try_cast(p_size AS SMALLINT) AS p_size, p_retailprice FROM part")
def type_map_cast(t: Tables) -> DataFrame:
    types = {"p_partkey": "bigint", "p_name": "varchar", "p_brand": "int", "p_size": "smallint", "p_retailprice": "double"}
    return S.as_types(t.part, types).select(*types)


_ODD_SQL = """CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '\\N' WHEN 3 THEN 'a "' || p_name || '", b' WHEN 4 THEN p_name || chr(10) || 'second line' WHEN 5 THEN 'NULL' ELSE p_name END"""


@query(f"SELECT p_partkey::BIGINT AS p_partkey, {_ODD_SQL} AS p_name, try_cast(p_size AS SMALLINT) AS p_size, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS p_retailprice, count(*) OVER ()::BIGINT AS n_written FROM part")
def snapshot_copy_form(t: Tables) -> DataFrame:
    """The parts in copy form and back: nulls, empty texts, quotes, line ends and texts that look like a null."""
    k, name = F.col("p_partkey"), F.col("p_name")
    odd = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "").when(k % 7 == 2, r"\N").when(k % 7 == 3, F.concat(F.lit('a "'), name, F.lit('", b'))).when(k % 7 == 4, F.concat(name, F.lit("\nsecond line"))).when(k % 7 == 5, "NULL").otherwise(name)
    path = scratch(t.part.sparkSession)
    n = S.write_copy_form(t.part.select("p_partkey", odd.alias("p_name"), "p_size", F.when(k % 3 > 0, F.col("p_retailprice")).alias("p_retailprice")), path)
    types = {"p_partkey": "bigint", "p_name": "varchar", "p_size": "smallint", "p_retailprice": "double"}
    return S.read_copy_form(t.part.sparkSession, path, types).withColumn("n_written", F.lit(n).cast("long"))


@query("SELECT p_brand, count(*)::BIGINT AS n, sum(p_partkey)::BIGINT AS keys, (SELECT count(*) FROM part)::BIGINT AS n_written FROM part GROUP BY ALL")
def reload_swap(t: Tables) -> DataFrame:
    """A table written, then loaded again: readers see the new version."""
    target = scratch(t.part.sparkSession)
    S.reloaded(t.part.select("p_partkey", F.lit("old").alias("p_brand")), target, "part")
    n = S.reloaded(t.part.select("p_partkey", "p_brand"), target, "part")
    now = S.current(t.part.sparkSession, target, "part")
    return now.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"), F.lit(n).cast("long").alias("n_written"))


@query("SELECT c_custkey, c_name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_acctbal, c_custkey) AS id FROM customer")
def append_numbered(t: Tables) -> DataFrame:
    """Customers appended behind the suppliers, numbered by balance."""
    return S.numbered_after(t.supplier.select(F.col("s_suppkey").alias("id")), t.customer.select("c_custkey", "c_name", "c_acctbal"), ["c_acctbal", "c_custkey"]).drop("c_acctbal")


@query("WITH n AS (SELECT trim(CASE p_partkey % 3 WHEN 0 THEN '# ' || p_name WHEN 1 THEN ' ' || p_name || ' ' ELSE ' ' END) AS name FROM part) SELECT name, count(*)::BIGINT AS n FROM n WHERE name <> '' AND NOT starts_with(name, '#') GROUP BY ALL")
def name_list(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 3
    lines = t.part.select(F.when(m == 0, F.concat(F.lit("# "), "p_name")).when(m == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(" ").alias("value"))
    return S.name_list(lines).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n_templates, sum(n)::BIGINT AS n_items, sum(s)::BIGINT AS sets FROM (SELECT p_brand, count(*) AS n, sum(p_size % 5 + 1) AS s FROM part GROUP BY ALL)")
def catalog_load(t: Tables) -> DataFrame:
    """The parts written as nested catalogues of templates, one document a brand and line, and loaded again."""
    spark = t.part.sparkSession
    item = F.struct(F.col("p_name").alias("exercise"), F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit(" x 8")).alias("sets_x_reps"))
    header = F.struct(F.col("p_brand").alias("raw"), F.lit(None).cast("string").alias("id_numeric"), F.lit(None).cast("string").alias("mesocycle_id"), F.lit(None).cast("string").alias("description"))
    levels = F.create_map(F.lit("L1"), F.struct(header.alias("header"), F.col("items").alias("exercises")))
    docs = t.part.groupBy("p_brand").agg(F.collect_list(item).alias("items")).select(F.array(F.struct(levels.alias("levels"))).alias("blocks"))
    path = scratch(spark)
    docs.write.json(path)
    templates, items = S.load_catalogue(spark, path, multi_line=False)
    return templates.agg(F.count("*").alias("n_templates")).crossJoin(items.agg(F.count("*").alias("n_items"), F.sum("parsed_sets").alias("sets")))


# ---- streams: each equals its batch form ----------------------------------


def _stream(t: Tables) -> DataFrame:
    return W.event_stream(t.events.sparkSession, f"{t._folder}/events.parquet")


def _finished(stream: DataFrame, mode: str = "complete", *, each=None) -> tuple[DataFrame | None, str, int]:
    spark = stream.sparkSession
    at = scratch(spark)
    if each is not None:
        return None, at, W.run_once(stream, f"{at}/checkpoint", each=each(at), mode="update" if mode == "update" else "append")
    if mode == "append":
        W.run_once(stream, f"{at}/checkpoint", path=f"{at}/out", mode=mode)
        return spark.read.schema(stream.schema).parquet(f"{at}/out"), at, 0
    # a complete result replaces the one before it
    n = W.run_once(stream, f"{at}/checkpoint", mode="complete", each=lambda b, i: b.write.mode("overwrite").parquet(f"{at}/v{i}"))
    return spark.read.schema(stream.schema).parquet(f"{at}/v{n - 1}"), at, n


@query(
    f"""WITH w AS (SELECT event_type, value, unnest(range(24)) AS k, date_trunc('hour', ts) AS h FROM events) SELECT (h - k * INTERVAL 1 HOUR) AS window_start, event_type, {R4('sum(value)')} AS spent, count(*)::BIGINT AS n_calls, sum(value) >= 9000 AS capped FROM w GROUP BY ALL"""
)
def stream_spend(t: Tables) -> DataFrame:
    out, _, _ = _finished(W.rolling_spend(_stream(t), "event_type", "value", cap=9000.0))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", r4("spent").alias("spent"), "n_calls", "capped")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(t: Tables) -> DataFrame:
    stream = _stream(t).select("user_id", "event_type", "ts", "event_id", "value")
    _, at, n = _finished(stream, each=lambda at: W.latest_upserts(["user_id", "event_type"], ["ts", "event_id"], f"{at}/state"))
    return t.events.sparkSession.read.parquet(f"{at}/state/v{n - 1}").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_state(t: Tables) -> DataFrame:
    """The same by a state of one row a key: a batch writes only what changes."""
    spark = t.events.sparkSession
    stream = _stream(t).select("user_id", "event_type", "ts", "event_id", "value")
    with W.stateful(spark):
        _, at, _ = _finished(W.latest_changes(stream, ["user_id", "event_type"], ["ts", "event_id"]), "update", each=lambda at: W.append_changes(f"{at}/changes"))
    return W.latest_of_changes(spark.read.parquet(f"{at}/changes"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query(
    f"""WITH w AS (SELECT event_type, value, unnest(range(24)) AS k, date_trunc('hour', ts) AS h FROM events)
    SELECT (h - k * INTERVAL 1 HOUR) AS window_start, event_type, {R4('sum(value)')} AS spent, count(*)::BIGINT AS n_calls FROM w WHERE h - k * INTERVAL 1 HOUR + INTERVAL 24 HOUR <= {_CLOSED} GROUP BY ALL"""
)
def stream_spend_append(t: Tables) -> DataFrame:
    """Windows that the watermark has closed, each written once."""
    out, _, _ = _finished(W.rolling_spend(_stream(t), "event_type", "value"), "append")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", r4("spent").alias("spent"), "n_calls")


@query(f"SELECT ts::DATE AS day, event_type, {R4('avg(value)')} AS mean, count(*)::BIGINT AS n FROM events WHERE ts::DATE + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL")
def stream_daily_mean_append(t: Tables) -> DataFrame:
    out, _, _ = _finished(W.daily_means(_stream(t), ["event_type"], "value"), "append")
    return out.select("day", "event_type", r4("mean").alias("mean"), "n")


@query(f"SELECT ts::DATE AS day, event_type, {R4('avg(value)')} AS mean, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_daily_mean(t: Tables) -> DataFrame:
    out, _, _ = _finished(W.daily_means(_stream(t), ["event_type"], "value"))
    return out.select("day", "event_type", r4("mean").alias("mean"), "n")


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS n_ids, sum(event_id)::BIGINT AS ids FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """Every event delivered twice."""
    s = _stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out, _, _ = _finished(W.deduplicated(s, ["event_id"]), "append")
    return out.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum("event_id").alias("ids"))


@query(
    f"""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM g)
    SELECT user_id, min(ts) AS visit_start, {R4('avg(value)')} AS mean, count(*)::BIGINT AS n FROM s GROUP BY user_id, visit"""
)
def stream_visits(t: Tables) -> DataFrame:
    out, _, _ = _finished(W.visits(_stream(t), "user_id", "value"), "complete")
    return out.select("user_id", F.col("visit_start").cast("timestamp_ntz").alias("visit_start"), r4("mean").alias("mean"), "n")
