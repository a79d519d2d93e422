"""Choosing among sources, templates, buckets and runs; screen rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridial.functions.rows import banded
from meridial.functions.text import GROUP_LEVELS, bucket
from meridial.operators.norms import top

# Power-ramp thresholds and kurtosis ranges of the four screens.
RAMP_ELITE = {"dj": 32700.0, "cmj": 25200.0, "ppu": 8000.0, "slv": 18200.0}
KURTOSIS_IDEAL = {"dj": (-1.45, -1.1), "cmj": (-1.3, -0.4), "ppu": (-1.55, -1.25), "slv": (-1.0, -0.2)}


def template_levels(entities: DataFrame, group: str, levels: Mapping[str, Sequence[str]] = GROUP_LEVELS) -> DataFrame:
    """``entities`` once for each template level of their group (in any case); groups without levels go."""
    table = F.create_map(*(x for k, v in levels.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return entities.withColumn("athlete_level", F.explode(F.try_element_at(table, F.upper(F.trim(F.coalesce(group, F.lit("")))))))


def item_buckets(rows: DataFrame, keys: Sequence[str], parent: str, kind: str, order: str) -> DataFrame:
    """Each key's bucket by its first row: the parent's label, else the item's type, else Other."""
    known = lambda c: F.nullif(bucket(c), F.lit("Other"))
    return top(rows, keys, 1, order).select(*keys, F.coalesce(known(parent), known(kind), F.lit("Other")).alias("bucket"))


def first_available(keys: Sequence[str], *sources: DataFrame) -> DataFrame:
    """For every key the rows of the first source that has any."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(*keys).distinct(), list(keys), "left_anti").select(out.columns))
    return out


def template_items(templates: DataFrame, items: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Templates with their items as an ordered array; without items an empty one."""
    listed = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("item")))), lambda x: x["item"]).alias("items"))
    kind = listed.schema["items"].dataType
    return templates.join(listed, key, "left").withColumn("items", F.coalesce("items", F.array().cast(kind)))


def choose_families(candidates: DataFrame, anchors: DataFrame | None, keys: Sequence[str], family: str, n_buckets: str, *, k: int = 1) -> DataFrame:
    """The first ``k`` families of each key: by anchor distance where one is known, then by most buckets, then by id."""
    rows = candidates if anchors is None else candidates.join(anchors.select(*keys, family, "distance"), [*keys, family], "left")
    if anchors is None:
        rows = rows.withColumn("distance", F.lit(None).cast("double"))
    return top(rows, keys, k, F.col("distance").asc_nulls_last(), F.col(n_buckets).desc(), family, rank="place")


def one_per_bucket(templates: DataFrame, keys: Sequence[str], bucket_col: str, *order) -> DataFrame:
    return top(templates, [*keys, bucket_col], 1, *order)


def run_totals(calls: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums over the component calls of a run; missing figures count as 0."""
    return calls.groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(f"total_{c}") for c in columns))


def last_runs(runs: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` runs, oldest first."""
    return runs.orderBy(F.col(key).desc()).limit(n).orderBy(key)


def as_one_category(items: DataFrame, category: str, *, merge: Sequence[str] = ("prep", "me"), into: str = "prep") -> DataFrame:
    """Some categories recoded to one before sets are compared."""
    return items.withColumn(category, F.when(F.col(category).isin(*merge), into).otherwise(F.col(category)))


def screen_flags(trials: DataFrame, test: str) -> DataFrame:
    """``ramp_elite``, ``kurtosis_label`` and ``dominance`` of the best trials of a screen.

    Dominance compares the percentiles of force and velocity at peak power: more
    than 15 points apart it is of the larger one.
    """
    out = trials
    elite = F.create_map(*(F.lit(x) for pair in RAMP_ELITE.items() for x in pair))
    label: Column = F.lit(None).cast("string")
    for name, (low, high) in KURTOSIS_IDEAL.items():
        mine = banded("kurtosis", [(None, low, "Very Flat"), (low, high, "Ideal")], otherwise="Sharp / Peaked")
        label = F.when(F.col(test) == name, mine).otherwise(label)
    gap = F.col("force_pct") - F.col("velocity_pct")
    dominance = F.when(gap > 15, "force").when(gap < -15, "velocity").when(gap.isNotNull(), "balanced")
    return out.withColumn("ramp_elite", F.col("rpd_max_w_per_s") > F.try_element_at(elite, F.col(test))).withColumn("kurtosis_label", label).withColumn("dominance", dominance)


def with_percentile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Percent rank of a value within its group."""
    return df.withColumn(f"{value}_pct", 100 * F.percent_rank().over(Window.partitionBy(*keys).orderBy(value)))
