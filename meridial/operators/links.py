"""Rows that refer to each other by way of mail addresses, bridges and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.operators.norms import latest


def on_lower(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` on keys that are equal in lower case; null keys meet nothing.

    The lower-case key is a column of each side, so the join is an equi join.
    """
    a, b = left.withColumn("_low", F.lower(left_key)), right.withColumn("_low", F.lower(right_key))
    return a.join(b, "_low", how).drop("_low")


def back_reference(entities: DataFrame, users: DataFrame, programs: DataFrame, entity: str, email: str, *, user: str = "user_id", user_email: str = "user_email", org: str = "org_id", order: Sequence[Column | str] = ()) -> DataFrame:
    """``entity, user, org``: the user of an entity's address and the organisation of their latest program.

    Of several users with one address the one with the least id counts; what is
    not found is null. Only latest programs meet the users.
    """
    one = latest(users.withColumn("_low", F.lower(user_email)).where("_low IS NOT NULL"), ["_low"], user).select("_low", user)
    last = latest(programs, [user], *order).select(user, org)
    met = entities.select(entity, F.lower(email).alias("_low")).join(one, "_low", "left")
    return met.join(last, user, "left").select(entity, user, org)


def bridged_breakdown(programs: DataFrame, program: str, link: DataFrame, bridge: DataFrame, target: DataFrame, *, link_key: str, bridge_key: str, group: Column, component: str) -> DataFrame:
    """Per program and category: rows and distinct targets, by way of a bridge table.

    ``link`` has program and ``link_key``, ``bridge`` has ``link_key`` and
    ``bridge_key``, ``target`` has ``bridge_key``. Left joins all the way, so what
    leads nowhere is ``unknown``, and a program without links has one such row.
    """
    ways = link.select(program, link_key).join(bridge.select(link_key, bridge_key), link_key, "left")
    rows = programs.select(program).join(ways, program, "left").join(target.withColumn("_category", group), bridge_key, "left")
    # an id that no target has is no target
    known = F.when(F.col("_category").isNotNull(), F.col(bridge_key))
    return rows.groupBy(program, F.lit(component).alias("component"), F.coalesce("_category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"), F.countDistinct(known).alias("unique_count"))


def family_sets(rows: DataFrame, keys: Sequence[str], ident: str, *, separator: str = ".") -> DataFrame:
    """Per key the sorted distinct families, the first parts of its ids."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.split_part(F.col(ident), F.lit(separator), F.lit(1)))).alias("families"))


def curated_prevalence(prescriptions: DataFrame, names: Sequence[str], entity: str, item: str, category: Column, *, averages: Sequence[str] = ()) -> DataFrame:
    """Of the listed items of a category: distinct entities and averages to 1 place."""
    mine = prescriptions.where(category & F.col(item).isin(list(names)))
    return mine.groupBy(item).agg(F.countDistinct(entity).alias("n_entities"), *(F.round(F.avg(a) + 1e-9, 1).alias(f"avg_{a}") for a in averages))


def wide_profiles(profiles: DataFrame, entity: str, metrics: Sequence[str], *, metric: str = "metric_key", value: str = "z") -> DataFrame:
    """One row an entity with a column ``z_<metric>`` of every declared metric; others are left out."""
    wide = profiles.groupBy(entity).pivot(metric, list(metrics)).agg(F.first(value))
    return wide.select(entity, *(F.col(f"`{m}`").alias(f"z_{m}") for m in metrics))


def preferred_days(rows: DataFrame, day: str, mine: Column, *, k: int = 3) -> DataFrame:
    """The ``k`` days with most rows for which ``mine`` holds, days without any included; ties by day."""
    counts = rows.groupBy(day).agg(F.count_if(F.coalesce(mine, F.lit(False))).alias("n"))
    # there are seven days
    return counts.orderBy(F.desc("n"), day).limit(k)
