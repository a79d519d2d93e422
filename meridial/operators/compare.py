"""Recommended against actual item sets, and reports over many comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.functions.text import without_group

# The components' weights in the overall recall.
WEIGHTS = {"lift": 0.30, "plyo": 0.30, "prep": 0.30, "bp": 0.10, "hit": 0.0}


def item_flags(actual: DataFrame, recommended: DataFrame, keys: Sequence[str], item: str, *, dose: str | None = None, order: str | None = None) -> DataFrame:
    """Per key and item: ``in_actual, in_recommended``, and ``dose_match`` if a dose is given.

    A repeated item counts once, with its last dose by ``order``.
    """
    def side(df: DataFrame, flag: str) -> DataFrame:
        aggs = [F.lit(True).alias(flag)]
        if dose:
            aggs.append(F.max_by(dose, order or dose).alias(f"_{flag}"))
        return df.groupBy(*keys, item).agg(*aggs)

    out = side(actual, "in_actual").join(side(recommended, "in_recommended"), [*keys, item], "full_outer")
    out = out.fillna(False, ["in_actual", "in_recommended"])
    if dose:
        out = out.withColumn("dose_match", F.coalesce(F.col("_in_actual") == F.col("_in_recommended"), F.lit(False))).drop("_in_actual", "_in_recommended")
    return out


def overlap(flags: DataFrame, keys: Sequence[str], places: int = 3) -> DataFrame:
    """Counts, precision, recall, F1, Jaccard and dose agreement; null where the denominator is 0."""
    return flags.groupBy(*keys).agg(*overlap_counts("dose_match" in flags.columns)).select(*keys, *_counts("dose_match" in flags.columns), *overlap_measures("dose_match" in flags.columns, places))


def _counts(dose: bool) -> list[str]:
    return ["n_actual", "n_recommended", "n_both", *(["n_dose"] if dose else [])]


def overlap_counts(dose: bool = False) -> list[Column]:
    both = F.col("in_actual") & F.col("in_recommended")
    out = [F.count_if("in_actual").alias("n_actual"), F.count_if("in_recommended").alias("n_recommended"), F.count_if(both).alias("n_both")]
    return out + ([F.count_if(both & F.col("dose_match")).alias("n_dose")] if dose else [])


def overlap_measures(dose: bool = False, places: int = 3) -> list[Column]:
    a, r, b = F.col("n_actual"), F.col("n_recommended"), F.col("n_both")
    part = lambda x, y: F.round(F.try_divide(x, y) + 1e-9, places)
    out = [part(b, r).alias("precision"), part(b, a).alias("recall"), part(2 * b, a + r).alias("f1"), part(b, a + r - b).alias("jaccard")]
    return out + ([part(F.col("n_dose"), b).alias("dose_agreement")] if dose else [])


def grouped_overlap(flags: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Overlap per group and, from the same pass, the total of all groups (``group`` null)."""
    out = flags.groupBy(*keys, group).agg(*overlap_counts())
    total = out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _counts(False)))
    rows = out.select(*keys, group, *_counts(False)).unionByName(total.withColumn(group, F.lit(None).cast(flags.schema[group].dataType)).select(*keys, group, *_counts(False)))
    return rows.select("*", *overlap_measures())


def weighted_recall(measures: DataFrame, keys: Sequence[str], component: str = "component", recall: str = "recall", weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Mean recall of the components by weight, over those that have one; 0 without any. ``me`` never counts."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    w = F.when((F.col(component) != "me") & F.col(recall).isNotNull(), F.coalesce(F.try_element_at(table, F.col(component)), F.lit(0.0))).otherwise(0.0)
    total = F.sum(w)
    return measures.groupBy(*keys).agg(F.coalesce(F.round(F.try_divide(F.sum(w * F.coalesce(recall, F.lit(0.0))), F.nullif(total, F.lit(0.0))) + 1e-9, 3), F.lit(0.0)).alias("overall_recall"))


def component_means(measures: DataFrame, component: str, columns: Sequence[str], *, family: str | None = None) -> DataFrame:
    """Per component the number of runs, the means of their measures to 3 places, and how many distinct families they had."""
    means = [F.round(F.avg(c) + 1e-9, 3).alias(f"mean_{c}") for c in columns]
    families = [F.countDistinct(family).alias("n_families")] if family else []
    return measures.groupBy(component).agg(F.count("*").alias("n_runs"), *means, *families)


def pattern_recall(flags: DataFrame, keys: Sequence[str], pattern: str = "pattern") -> DataFrame:
    """Per key, the share of the actual side's patterns (unclassified left out) that the other side has."""
    per = flags.where(F.col(pattern) != "unclassified").groupBy(*keys, pattern).agg(F.max("in_actual").alias("a"), F.max("in_recommended").alias("r"))
    return per.groupBy(*keys).agg(F.count_if("a").alias("n_patterns"), F.count_if(F.col("a") & F.col("r")).alias("n_found")).withColumn("pattern_recall", F.round(F.try_divide(F.col("n_found"), F.col("n_patterns")) + 1e-9, 3))


def pattern_misses(flags: DataFrame, keys: Sequence[str], pattern: str = "pattern", *, of: str = "in_actual", on: str = "in_recommended") -> DataFrame:
    """Over all keys, how many items of one side have a pattern that the other side lacks."""
    there = flags.where(F.col(on)).select(*keys, pattern).distinct()
    return flags.where(F.col(of)).join(there, [*keys, pattern], "left_anti").groupBy(pattern).agg(F.count("*").alias("n_items"))


def schedule_match(actual: DataFrame, recommended: DataFrame, keys: Sequence[str], day: str = "dow", level: str = "level") -> DataFrame:
    """Days on which both agree by the days that the actual side fills."""
    a = actual.select(*keys, day, F.col(level).alias("_a")).where("_a IS NOT NULL")
    both = a.join(recommended.select(*keys, day, F.col(level).alias("_r")), [*keys, day], "left")
    return both.groupBy(*keys).agg(F.count("*").alias("n_days"), F.count_if(F.col("_a") == F.col("_r")).alias("n_match")).withColumn("agreement", F.round(F.col("n_match") / F.col("n_days") + 1e-9, 3))


def comparison_items(flags: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Long rows of both sides: ``keys, side, item``, a leading group prefix taken off."""
    sides = F.array_compact(F.array(F.when(F.col("in_actual"), "actual"), F.when(F.col("in_recommended"), "recommended")))
    return flags.select(*keys, F.explode(sides).alias("side"), without_group(item).alias("item"))
