"""Day levels: weekly offsets, phase limits, appearances and progressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridial.functions.text import lookup

# Levels by days since the game day, off-season levels from Sunday, and levels that phases allow.
GAME_OFFSETS = ("P1", "P0", "P0", "P1", "P1", "P0", "P1")
OFF_SEASON = ("P0", "P0", "P1", "P2", "P0", "P1", "P1")
DAYS = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")
PHASE_MAX = {"Recovery": 0, "Rebuild Capacity": 1, "Workload Ramp": 2, "Velocity": 3, "Velocity Phase": 3, "Velocity Transfer": 2, "Preseason Build": 2, "In-Season Maintenance": 2, "Postseason Reset": 0}
PHASE_MIN = {"Preseason Build": 1}


def week(entities: DataFrame, game_day: Column, off_season: Column) -> DataFrame:
    """Seven rows an entity: ``dow`` (Sunday 0), ``day`` and ``level``."""
    at = F.array_position(F.array(*map(F.lit, DAYS)), F.upper(game_day)) - 1
    rows = entities.withColumn("_g", at).withColumn("_off", off_season).withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    levels = lambda x, i: F.element_at(F.array(*map(F.lit, x)), (i + 1).cast("int"))
    level = F.when(F.col("_off"), levels(OFF_SEASON, F.col("dow"))).otherwise(levels(GAME_OFFSETS, (F.col("dow") - F.col("_g") + 7) % 7))
    return rows.withColumn("day", levels(DAYS, F.col("dow"))).withColumn("level", level).drop("_g", "_off")


def phase_gate(level: Column, phase: Column) -> Column:
    """The level (a number) held to what the phase allows; unknown phases allow all."""
    most = lookup(phase, {k: str(v) for k, v in PHASE_MAX.items()}).cast("int")
    least = lookup(phase, {k: str(v) for k, v in PHASE_MIN.items()}).cast("int")
    return F.greatest(F.least(level, F.coalesce(most, F.lit(3))), F.coalesce(least, F.lit(0)))


def appearance_levels(days: DataFrame, appearances: DataFrame, entity: str, day: str = "day") -> DataFrame:
    """``entity, day, gap, level``: P0 the day after an appearance, P1 after 2 or 3 days, P2 from 4 days on or with none before.

    The day of an appearance itself is judged by the one before it. Both lists
    are walked in one window per entity.
    """
    both = days.select(entity, day, F.lit(1).alias("_asked")).unionByName(appearances.select(entity, day, F.lit(0).alias("_asked")).distinct())
    w = Window.partitionBy(entity).orderBy(F.col(day).cast("date").cast("timestamp").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_asked") == 0, F.col(day))).over(w)
    out = both.withColumn("gap", F.date_diff(F.col(day), last)).where("_asked = 1")
    level = F.when(F.col("gap") == 1, "P0").when(F.col("gap") <= 3, "P1").otherwise("P2")
    return out.select(entity, day, "gap", level.alias("level"))


def next_level(last: Column, completed: Column, weeks: Column, pain: Column, ready: Column) -> Column:
    """1 without a history; one less under half done; one more (4 at most) after 80 % and 4 weeks without pain if confirmed; else the same."""
    done = (completed >= 0.8) & (weeks >= 4) & ~F.coalesce(pain, F.lit(False)) & F.coalesce(ready, F.lit(False))
    return F.when(last.isNull(), 1).when(completed < 0.5, F.greatest(F.lit(1), last - 1)).when(done, F.least(F.lit(4), last + 1)).otherwise(last)


def weekly_layout(entities: DataFrame, keys: Sequence[str], template_index: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """Seven days an entity with the day's bucket, level and template, if there are any.

    ``template_index`` has ``keys, bucket, template_id``; ``levels`` day -> bucket.
    """
    days = entities.select(*keys, F.explode(F.array(*map(F.lit, DAYS))).alias("day"))
    return days.withColumn("bucket", lookup("day", dict(levels))).join(template_index, [*keys, "bucket"], "left")
