"""Prescribed programs: breakdowns, summaries, doses, catalogue tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_breakdown(programs: DataFrame, program: str, link: DataFrame, target: DataFrame, target_key: str, group: Column, *, link_key: str | None = None, component: str = "lift") -> DataFrame:
    """Per program and category: rows and distinct targets, for all programs at once.

    Left joins all the way: a link without a target counts as ``unknown``, and
    a program without links gives one such row with no targets.
    """
    rows = programs.select(program).join(link, program, "left").join(target.withColumn("_category", group), link_key or target_key, "left")
    category = F.coalesce("_category", F.lit("unknown"))
    return rows.groupBy(program, F.lit(component).alias("component"), category.alias("category")).agg(F.count("*").alias("n"), F.countDistinct(target_key).alias("unique_count"))


def program_summaries(breakdown: DataFrame, program: str, components: Sequence[str]) -> DataFrame:
    """Per program: sums of n and of the categories' distinct counts by component, and the breakdowns."""
    out = []
    for c in components:
        mine = F.col("component") == c
        out += [F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"n_{c}"), F.sum(F.when(mine, F.col("unique_count")).otherwise(0)).alias(f"n_unique_{c}")]
        entry = F.when(mine, F.struct((-F.col("n")).alias("minus"), "category", "n", "unique_count"))
        out.append(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x.category.alias("category"), x.n.alias("n"), x.unique_count.alias("unique_count"))).alias(f"{c}_breakdown"))
    return breakdown.groupBy(program).agg(*out)


def breakdown_pivot(breakdown: DataFrame, program: str, categories: Sequence[str]) -> DataFrame:
    """Category counts as columns, 0 where a program lacks one; the list is fixed, so no extra job finds it."""
    return breakdown.groupBy(program).pivot("category", list(categories)).agg(F.sum("n")).fillna(0, list(categories))


def duration_days(start: Column, end: Column) -> Column:
    """Whole days between two times, rounded down; null if one is missing."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(seconds / 86400)


def family_rollup(templates: DataFrame, family: str, item: str, bucket: str) -> DataFrame:
    """Sorted distinct ids and distinct non-null buckets of each family."""
    return templates.groupBy(family).agg(F.array_sort(F.collect_set(item)).alias("items"), F.array_sort(F.collect_set(bucket)).alias("buckets"))


def available_focuses(templates: DataFrame, level: str, focus: str, min_templates: int = 3) -> DataFrame:
    return templates.groupBy(level, focus).agg(F.count("*").alias("n")).where(F.col("n") >= min_templates)


def segment_blocks(rows: DataFrame, sheet: str, row_no: str, is_header: Column, is_empty: Column, *, gap: int = 2) -> DataFrame:
    """Rows with their ``block``: a header starts one; a run of ``gap`` empty rows ends it.

    Rows outside blocks, and empty rows, are left out. Everything is a running
    sum within a sheet.
    """
    w = Window.partitionBy(sheet).orderBy(row_no)
    df = rows.withColumn("_h", is_header.cast("int")).withColumn("_e", (is_empty & ~is_header).cast("int"))
    df = df.withColumn("block", F.sum("_h").over(w)).withColumn("_filled", F.sum(1 - F.col("_e")).over(w))
    # rows of one empty run share the number of filled rows before them
    run = Window.partitionBy(sheet, "_filled").orderBy(row_no)
    df = df.withColumn("_run", F.sum("_e").over(run))
    inside = Window.partitionBy(sheet, "block").orderBy(row_no)
    ended = F.max((F.col("_run") >= gap).cast("int")).over(inside)
    return df.withColumn("_ended", ended).where("block > 0 AND _e = 0 AND _ended = 0").drop("_h", "_e", "_filled", "_run", "_ended")


def stacked_levels(rows: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``keys, level, item, dose`` of sheet rows that hold an item and its dose in a pair of columns for every level.

    One pass over the rows; pairs without an item are left out.
    """
    each = [F.struct(F.lit(level).alias("level"), F.col(item).cast("string").alias("item"), F.col(dose).cast("string").alias("dose")) for level, (item, dose) in pairs.items()]
    return rows.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.*").where("item IS NOT NULL AND trim(item) != ''")


def with_goals(summaries: DataFrame, goals: DataFrame, program: str, goal: str) -> DataFrame:
    """``summaries`` with the sorted distinct goals of each program, an empty list without any."""
    listed = goals.groupBy(program).agg(F.array_sort(F.collect_set(goal)).alias("goals"))
    return summaries.join(listed, program, "left").withColumn("goals", F.coalesce("goals", F.expr("array()").cast("array<string>")))


def index_fold(rows: DataFrame, key: str, row_no: str, description: str, made_for: str) -> DataFrame:
    """One row a key: its first description, and all it was made for in row order."""
    return rows.groupBy(key).agg(F.min_by(description, row_no).alias("description"), F.transform(F.array_sort(F.collect_list(F.struct(row_no, made_for))), lambda x: x[made_for]).alias("made_for"))


def payloads(items: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Nested JSON documents, one a key, nulls written out."""
    entries = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("item"))))
    nested = items.groupBy(*keys).agg(F.transform(entries, lambda e: e["item"]).alias("items"))
    return nested.select(*keys, F.to_json(F.struct(*keys, "items"), {"ignoreNullFields": "false"}).alias("payload"))
