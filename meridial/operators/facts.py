"""Facts of all modalities as one long table of session values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """One row of the metric catalogue.

    ``value`` is an expression over the source's columns (the functions of
    ``functions.rows`` build the extract types); rows where ``where`` does not
    hold, or the value is null, do not count. ``applies_to`` is a role or both.
    ``per_record`` metrics are not averaged over a session.
    """

    source: str
    modality: str
    key: str
    value: Column
    where: Column | None = None
    applies_to: str = "both"
    per_record: bool = False


def metrics_for_role(spec: Sequence[Metric], role: str) -> list[Metric]:
    """All metrics for ``both``; else those of the role and of both."""
    return [m for m in spec if role == "both" or m.applies_to in (role, "both")]


def long_values(source: DataFrame, metrics: Sequence[Metric], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with ``modality, metric_key, value``: one scan of the source for all its metrics."""
    rows = [F.struct(F.lit(m.modality).alias("modality"), F.lit(m.key).alias("metric_key"), (m.value if m.where is None else F.when(m.where, m.value)).cast("double").alias("value"), F.lit(m.per_record).alias("per_record")) for m in metrics]
    return source.select(*keep, F.explode(F.array(*rows)).alias("x")).select(*keep, "x.*").where("value IS NOT NULL")


def session_values(sources: dict[str, DataFrame], spec: Sequence[Metric], entity: str = "entity", date: str = "session_date") -> DataFrame:
    """``entity, session_date, modality, metric_key, value``: means over a session.

    One scan a source and one shuffle for all metrics together. Metrics that
    are kept per record give a row a record.
    """
    parts = []
    for name, df in sources.items():
        mine = [m for m in spec if m.source == name]
        if mine:
            parts.append(long_values(df, mine, [entity, date]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    keys = [entity, date, "modality", "metric_key"]
    means = every.where("NOT per_record").groupBy(*keys).agg(F.avg("value").alias("value"))
    if not any(m.per_record for m in spec):
        return means
    return means.unionByName(every.where("per_record").select(*keys, "value"))


def wide_values(source: DataFrame, metrics: Sequence[Metric], entity: str = "entity", date: str = "session_date") -> list[tuple[DataFrame, list[Metric]]]:
    """``entity, _v``: a row a session, or a record, with the metrics' values in an array, and which metrics they are.

    Records are dealt by entity once, all values of one in a row, so that
    sessions are averaged and entities joined where they lie.
    """
    out = []
    for each in (False, True):
        mine = [m for m in metrics if m.per_record is each]
        if mine:
            values = F.array(*((m.value if m.where is None else F.when(m.where, m.value)).cast("double") for m in mine))
            rows = source.select(entity, date, values.alias("_v")).repartition(entity)
            if not each:
                rows = rows.groupBy(entity, date).agg(*(F.avg(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(len(mine))))
                rows = rows.select(entity, F.array(*(f"_{i}" for i in range(len(mine)))).alias("_v"))
            out.append((rows.select(entity, "_v"), mine))
    return out


def discover(long: DataFrame, metric: str, entity: str, order: str) -> DataFrame:
    """Of every metric: rows, entities, least and largest order."""
    return long.groupBy(metric).agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"), F.min(order).alias("min_order"), F.max(order).alias("max_order"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def session_pairs(sources: Sequence[DataFrame]) -> DataFrame:
    """Distinct (entity, session_date) of all sources."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every.distinct()


def latest_sessions(sources: Sequence[DataFrame], entity: str = "entity", date: str = "session_date") -> DataFrame:
    """The last date of every entity over all sources; each is reduced before they meet."""
    every = [s.groupBy(entity).agg(F.max(date).alias(date)) for s in sources]
    out = every[0]
    for s in every[1:]:
        out = out.unionByName(s)
    return out.groupBy(entity).agg(F.max(date).alias(date))


def roles(entities: DataFrame, entity: str, flags: dict[str, Column], facts: dict[str, DataFrame]) -> DataFrame:
    """Entities with ``role``: by a flag or by having rows in a role's fact table.

    With two roles a and b: a, b, both or unknown.
    """
    (a, b) = flags
    out = entities
    for name in (a, b):
        present = facts[name].select(entity).distinct().withColumn(f"_{name}", F.lit(True))
        out = out.join(present, entity, "left")
    is_a = F.coalesce(flags[a], F.lit(False)) | F.col(f"_{a}").isNotNull()
    is_b = F.coalesce(flags[b], F.lit(False)) | F.col(f"_{b}").isNotNull()
    role = F.when(is_a & is_b, "both").when(is_a, a).when(is_b, b).otherwise("unknown")
    return out.withColumn("role", role).drop(f"_{a}", f"_{b}")


def asymmetry(df: DataFrame, keys: Sequence[str], side: str, value: str, left: str, right: str) -> DataFrame:
    """Means of both sides and their difference in percent of the larger."""
    out = df.groupBy(*keys).agg(F.avg(F.when(F.col(side) == left, F.col(value))).alias("left_mean"), F.avg(F.when(F.col(side) == right, F.col(value))).alias("right_mean"))
    return out.withColumn("asymmetry_pct", 100 * (F.col("left_mean") - F.col("right_mean")) / F.nullif(F.greatest("left_mean", "right_mean"), F.lit(0.0)))


def best_trial(df: DataFrame, keys: Sequence[str], metric: str, tie: str) -> DataFrame:
    """The whole row with the largest metric of each key; ties by the least ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
