"""Population norms, and profiles of entities against them as of a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridial.functions.rows import zscore
from meridial.sources.scratch import written

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def norm_stats(values: DataFrame, keys: Sequence[str], *, min_obs: int = 5, probs: Sequence[float] = QUANTILES, approximate: bool = False, spread: bool = False, metrics: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation and quantiles of ``value`` per group of ``keys``.

    All quantiles come from one pass, which holds a group's distinct values in
    a task; ``approximate`` bounds that, ``spread`` does without and stays exact.
    Groups under ``min_obs`` are left out.
    """
    if metrics is not None:
        values = values.where(F.col("metric_key").isin(list(metrics)))
    if spread:
        sums = values.groupBy(*keys).agg(F.count("value").alias("n_observations"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value")).where(F.col("n_observations") >= min_obs)
        q = spread_quantiles(values, keys, probs).select(*(F.col(k).alias(f"_{k}") for k in keys), "_q")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return _quantile_columns(sums.join(q, same), keys, probs)
    array = F.array(*(F.lit(p) for p in probs))
    q = F.percentile_approx("value", list(probs), 10_000) if approximate else F.percentile("value", array)
    out = values.groupBy(*keys).agg(F.count("value").alias("n_observations"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), q.alias("_q")).where(F.col("n_observations") >= min_obs)
    return _quantile_columns(out, keys, probs)


def counted_stats(counts: DataFrame, keys: Sequence[str], *, min_obs: int = 5, probs: Sequence[float] = QUANTILES) -> DataFrame:
    """As ``norm_stats`` of rows ``*keys, value, _n``: each value once a group with its number."""
    group = Window.partitionBy(*keys)
    known = counts.withColumn("_of", F.sum("_n").over(group)).withColumn("_mean", F.sum(F.col("value") * F.col("_n")).over(group) / F.col("_of")).where(F.col("_of") >= min_obs)
    # squares of gaps from the mean, so that a small deviation of large values is kept
    squares = F.sum((F.col("value") - F.col("_mean")) * (F.col("value") - F.col("_mean")) * F.col("_n"))
    q = F.percentile("value", F.array(*(F.lit(p) for p in probs)), F.col("_n")).alias("_q")
    out = known.groupBy(*keys).agg(F.first("_of").alias("n_observations"), F.first("_mean").alias("mean_value"), squares.alias("_s"), q)
    return _quantile_columns(out.withColumn("std_value", F.sqrt(F.try_divide("_s", F.col("n_observations") - 1))), keys, probs)


def _quantile_columns(rows: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    names = [f"p{round(100 * p):02d}" for p in probs]
    return rows.select(*keys, "n_observations", "mean_value", "std_value", *(F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)))


def spread_quantiles(values: DataFrame, keys: Sequence[str], probs: Sequence[float] = QUANTILES, value: str = "value") -> DataFrame:
    """``keys`` and ``_q``: exact interpolated quantiles, however many values a group has.

    Values are dealt by ranges of (keys, value), so a large group is many tasks'
    and none holds it. A group's ranges are counted; the two ranks at each
    probability are then rows of a known place in a known range. Nulls do not
    count; null keys are a group.
    """
    dealt = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).repartitionByRange(*keys, "_v")
    rows = written(dealt.withColumn("_range", F.spark_partition_id()))
    group = F.struct(*keys) if keys else F.lit(0)
    # one row a group and range
    sizes = rows.groupBy(group.alias("_g"), "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("_all", F.sum("_n").over(Window.partitionBy("_g")))
    at = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), at(p).alias("at"), r(at(p)).cast("long").alias("rank")) for i, p in enumerate(probs) for r in (F.floor, F.ceil)))).alias("w")
    wanted = before.select("_g", "_range", "_n", "_before", ranks).where("w.rank >= _before AND w.rank < _before + _n")
    wanted = wanted.select("_g", "_range", (F.col("w.rank") - F.col("_before")).alias("_place"), "w").distinct()
    place = F.row_number().over(Window.partitionBy("_g", "_range").orderBy("_v")) - 1
    numbered = rows.select(group.alias("_g"), "_range", "_v").withColumn("_place", place)
    met = numbered.join(wanted, (numbered["_g"].eqNullSafe(wanted["_g"])) & (numbered["_range"] == wanted["_range"]) & (numbered["_place"] == wanted["_place"])).select(numbered["_g"], "_v", "w")
    # between the two values at a probability, or the one
    each = met.groupBy("_g", "w.i").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.max("w.at").alias("_at"))
    each = each.withColumn("q", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at")))
    out = each.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_s")).withColumn("_q", F.transform("_s", lambda s: s["q"]))
    return out.select(*(F.col(f"_g.{k}").alias(k) for k in keys), "_q")


def asof_sessions(sessions: DataFrame, targets: DataFrame, entity: str = "entity", modality: str = "modality") -> DataFrame:
    """Of every target (entity, as_of_date) and modality, the latest session up to the date.

    A merge: sessions and targets stand in one order per entity and modality, and
    the last session is carried forward to each target. There is one row a session
    and one a target and modality of its entity, never their product; a
    partition is read as a stream, so a frequent entity needs no memory. A
    session on the date itself counts; a null entity or date has no session.
    """
    dates = sessions.select(entity, modality, "session_date").where(F.col(entity).isNotNull() & F.col("session_date").isNotNull()).distinct()
    asked = targets.select(entity, "as_of_date").where("as_of_date IS NOT NULL").distinct().join(dates.select(entity, modality).distinct(), entity)
    date = dates.schema["session_date"].dataType
    marks = dates.select(entity, modality, F.col("session_date").alias("_at"), "session_date", F.lit(None).cast(asked.schema["as_of_date"].dataType).alias("as_of_date"))
    every = marks.unionByName(asked.select(entity, modality, F.col("as_of_date").alias("_at"), F.lit(None).cast(date).alias("session_date"), "as_of_date"))
    # a session comes before a target of its date
    forward = Window.partitionBy(entity, modality).orderBy("_at", F.col("as_of_date").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = every.withColumn("session_date", F.last("session_date", ignorenulls=True).over(forward))
    return carried.where("as_of_date IS NOT NULL AND session_date IS NOT NULL").select(entity, "as_of_date", modality, "session_date")


def asof_profiles(values: DataFrame, norms: DataFrame, entities: DataFrame, targets: DataFrame, entity: str = "entity") -> DataFrame:
    """Long profiles: ``entity, as_of_date, modality, metric_key, session_date, value, age_group, z``.

    Values are those of the latest session of each modality; a metric that is
    missing there is missing in the profile. ``z`` is null without a norm of the
    entity's group or with a deviation of 0. Norms are as many as metrics times
    groups; Spark broadcasts them by their size.
    """
    latest = asof_sessions(values, targets, entity)
    now = values.join(latest, [entity, "modality", "session_date"]).join(entities.select(entity, "age_group"), entity)
    known = norms.select("modality", "metric_key", "age_group", "mean_value", "std_value")
    out = now.join(known, ["modality", "metric_key", "age_group"], "left")
    return out.select(entity, "as_of_date", "modality", "metric_key", "session_date", "value", "age_group", zscore("value", "mean_value", "std_value").alias("z"))


def profile_maps(profiles: DataFrame, entity: str = "entity") -> DataFrame:
    """Long profiles as maps of raw values, z-scores and source dates; bounded by the catalogue."""
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("metric_key", c)))
    dates = F.map_from_entries(F.array_distinct(F.collect_list(F.struct("modality", "session_date"))))
    return profiles.groupBy(entity, "as_of_date").agg(F.first("age_group").alias("age_group"), entry("value").alias("raw_values"), entry("z").alias("z_scores"), dates.alias("source_dates"))


def latest(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of every key in the given order (spell the null order and a tie-break)."""
    return top(df, keys, 1, *order)


def top(df: DataFrame, keys: Sequence[str], k: int, *order, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key; Spark limits groups before it shuffles them."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def interpolated_percentile(values: DataFrame, breakpoints: DataFrame, value: str = "value", on: Sequence[str] = ("metric",)) -> DataFrame:
    """``values`` with ``percentile`` by linear interpolation between breakpoints (pct, value).

    Below the first and above the last breakpoint the end's percentile holds.
    Breakpoints are a small table: as arrays of one row a metric they are joined
    by an equi join.
    """
    table = breakpoints.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col("value").cast("double").alias("v"), F.col("pct").cast("double").alias("p")))).alias("_b"))
    x = F.col(value)
    below = F.filter("_b", lambda b: b.v <= x)
    above = F.filter("_b", lambda b: b.v > x)
    # the ends are looked at only where they exist
    safe = F.when(x.isNull() | F.col("_b").isNull(), F.lit(None).cast("double")).when(F.size(below) == 0, F.get("_b", F.lit(0)).p).when(F.size(above) == 0, F.element_at("_b", -1).p)
    last, first = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    inner = last.p + (first.p - last.p) * (x - last.v) / (first.v - last.v)
    return values.join(table, list(on), "left").withColumn("percentile", F.coalesce(safe, inner)).drop("_b")
