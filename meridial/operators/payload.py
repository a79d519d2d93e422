"""Recommendations as nested documents, and back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a compiled document looks like: components of sessions of items, the days' sessions, and names without an id.
SCHEMA = """components array<struct<component: string, sessions: array<struct<session: string, items: array<struct<name: string, id: bigint, method: string, dose: string>>>>>>,
    days array<struct<day: int, component: string, session: string>>, unmatched array<string>"""


def compiled(items: DataFrame, resolved: DataFrame, days: DataFrame, entity: str) -> DataFrame:
    """``entity, payload``: one JSON document an entity, nulls written out.

    ``items`` has entity, component, session, place, name and dose; ``resolved``
    has name, id and method (what ``resolve_names`` gives); ``days`` has entity,
    day, component and session. Components and sessions are in the order of
    their names, items in that of their places, then names. An entity without days has an
    empty list of them.
    """
    named = items.join(resolved.select("name", "id", "method"), "name", "left").withColumn("method", F.coalesce("method", F.lit("unmatched")))
    entry = F.struct("name", F.col("id").cast("long").alias("id"), "method", "dose")
    sessions = named.groupBy(entity, "component", "session").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("item")))), lambda x: x["item"]).alias("items"),
        F.collect_set(F.when(F.col("method") == "unmatched", F.col("name"))).alias("lost"),
    )
    parts = sessions.groupBy(entity, "component").agg(F.array_sort(F.collect_list(F.struct("session", "items"))).alias("sessions"), F.array_distinct(F.flatten(F.collect_list("lost"))).alias("lost"))
    trees = parts.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("component", "sessions"))).alias("components"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lost")))).alias("unmatched"))
    weeks = days.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col("day").cast("int").alias("day"), "component", "session"))).alias("days"))
    both = trees.join(weeks, entity, "left").withColumn("days", F.coalesce("days", F.expr("array()").cast("array<struct<day:int,component:string,session:string>>")))
    return both.select(entity, F.to_json(F.struct("components", "days", "unmatched"), {"ignoreNullFields": "false"}).alias("payload"))


def flattened(payloads: DataFrame, entity: str, *, payload: str = "payload") -> DataFrame:
    """``entity, component, session, place, name, id, method, dose``: the items of compiled documents, places from 1.

    Documents that do not parse, and empty ones, give no rows.
    """
    tree = payloads.select(entity, F.from_json(payload, SCHEMA).alias("p")).select(entity, F.explode("p.components").alias("c"))
    sessions = tree.select(entity, F.col("c.component").alias("component"), F.explode("c.sessions").alias("s"))
    items = sessions.select(entity, "component", F.col("s.session").alias("session"), F.posexplode("s.items").alias("place", "i"))
    return items.select(entity, "component", "session", (F.col("place") + 1).alias("place"), "i.name", "i.id", "i.method", "i.dose")


def write_payloads(payloads: DataFrame, path: str, *, payload: str = "payload") -> None:
    """One document a line, as text files."""
    payloads.select(payload).write.mode("overwrite").text(path)
