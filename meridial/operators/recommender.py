"""Recommendations for all entities in one plan: pools by component and level, gates, floors, picks, validation.

What each entity was prescribed is counted once; its neighbours' counts are
added up for every target, component and level in one aggregate. All further
steps look at that pool.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.operators.neighbors import counted, history_pool, lead_one
from meridial.operators.norms import top
from meridial.sources.scratch import release, written

# The component that each category of prescriptions belongs to, and the role that a component is for.
COMPONENTS = {"prep": "prep", "me": "prep", "bp": "bulletproofing", "hit": "hitting", "plyo": "plyo"}
GATES = {"hitting": "hitter", "plyo": "pitcher"}
LEVELS = {0: "P0", 1: "P1", 2: "P2"}
# How many items a component takes at most (of plyo, each level).
TAKES = {"prep": 15, "bulletproofing": 10, "hitting": 10, "plyo": 25}
# What pitchers get whatever their neighbours had.
PITCHER_STAPLES = ("Horizontal Abduction Scorpions", "Young Stretch", "Bretzel 2.0", "Dead Hang", "Sleeper Stretch", "Sleeper Pail/Rail", "Hip Flexor Stretch")
# The accessories behind every lift day of a pitcher.
MOBILITY_CAP = (
    ("Dead Hang", "1 x 30s"), ("Shoulder CAR", "1 x 5 (each side)"), ("Glute Bridge ISO", "1 x 30s"), ("Hip Flexor ISO", "1 x 30s (each side)"),
    ("Wrist Extension ISO", "1 x 20"), ("Wrist Flexion Iso", "1 x 20"), ("Bretzel 2.0", "1 x 5 (each side)"), ("90/90 Hip Shifts", "2 x 8 (each side)"),
)

_SLOT = ["component", "level"]
_ITEM = [*_SLOT, "item", "weight"]


def _said(item: Column | str) -> Column:
    return F.lower(F.trim(item))


def slotted(prescriptions: DataFrame) -> DataFrame:
    """Prescriptions (entity, category, item, weight, intensity, n_sets, avg_reps) with component and level.

    Only plyo has levels and ball weights; of it, umbrella entries and levels
    that are not generated are left out, as is whatever has no item.
    """
    plyo = F.col("category") == "plyo"
    component = F.try_element_at(F.create_map(*(F.lit(x) for kv in COMPONENTS.items() for x in kv)), F.col("category"))
    level = F.try_element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("intensity").cast("int"))
    rows = prescriptions.withColumns({"component": component, "level": F.when(plyo, level).otherwise(""), "weight": F.when(plyo, F.coalesce("weight", F.lit(""))).otherwise("")})
    umbrella = plyo & F.startswith("item", F.lit("Plyo +"))
    return rows.where(F.col("component").isNotNull() & F.col("level").isNotNull() & F.col("item").isNotNull() & ~umbrella)


def pools(neighbours: DataFrame, prescriptions: DataFrame, entities: DataFrame, *, min_entities: int = 2, staples: Sequence[str] = PITCHER_STAPLES, averages: Sequence[str] = ("n_sets", "avg_reps")) -> DataFrame:
    """``target, component, level, item, weight``, prevalence, mean dose (``averages``), ``is_me`` and ``is_staple``.

    ``entities`` has entity, is_pitcher and is_hitter. A component with a gate
    is only for entities of its role. Pitchers have the staples that the corpus
    knows in their bulletproofing pool, with the corpus's prevalence where no
    neighbour has them. What neighbours had is written once.
    """
    given = slotted(prescriptions)
    # what all pools read: an item of an entity once a slot
    per = written(counted(given.withColumn("_me", (F.col("category") == "me").cast("int")), "entity", _ITEM, averages=[*averages, "_me"]))
    roles = entities.select(F.col("entity").alias("target"), F.coalesce("is_pitcher", F.lit(False)).alias("_p"), F.coalesce("is_hitter", F.lit(False)).alias("_h"))
    allowed = F.lit(True)
    for component, role in GATES.items():
        allowed = allowed & ((F.col("component") != component) | F.col("_p" if role == "pitcher" else "_h"))
    # written, as it is the one large table here and all steps after it read it
    history = written(history_pool(neighbours, per, "entity", _ITEM, min_entities=min_entities, averages=averages).join(roles, "target").where(allowed))
    release(per.sparkSession)
    # the curated list is short, so it is named in the plan
    listed = [s.strip().lower() for s in staples]
    own = per.where(F.col("component") == "bulletproofing").where(F.col("item").isin(list(staples)))
    mean = lambda c: (F.sum(f"_sum_{c}") / F.sum(f"_n_{c}")).alias(f"avg_{c}")
    floor = own.groupBy(*_ITEM).agg(F.sum("_times").alias("times_prescribed"), F.countDistinct("entity").alias("n_entities"), *map(mean, averages))
    pitchers = roles.where("_p").withColumn("item", F.explode(F.array(*map(F.lit, staples)).cast("array<string>")))
    floor = pitchers.join(floor, "item").select(history.columns).withColumn("_said", _said("item"))
    # of an item that both have, the neighbours' row stays
    had = history.where(F.col("component") == "bulletproofing").select("target", "component", _said("item").alias("_said")).where(F.col("_said").isin(listed))
    both = history.withColumn("_said", _said("item")).unionByName(floor.join(had, ["target", "component", "_said"], "left_anti"))
    staple = F.col("_p") & (F.col("component") == "bulletproofing") & F.col("_said").isin(listed)
    # one row an item, written so that its size is known
    me = written(per.where("_sum__me > 0").select(F.lit("prep").alias("component"), _said("item").alias("_said"), F.lit(True).alias("is_me")).distinct())
    out = both.withColumn("is_staple", staple).join(me, ["component", "_said"], "left").fillna(False, ["is_me"])
    return out.drop("_said", "_p", "_h")


def picked(pool: DataFrame, takes: dict[str, int] | None = None) -> DataFrame:
    """The picks of a deterministic chooser: staples first, then by prevalence, as many as the component takes."""
    takes = takes or TAKES
    most = F.try_element_at(F.create_map(*(F.lit(x) for kv in takes.items() for x in kv)), F.col("component"))
    order = (F.col("is_staple").desc(), F.col("n_entities").desc(), F.col("times_prescribed").desc(), "item", "weight")
    return top(pool, ["target", *_SLOT], max(takes.values()), *order, rank="place").where(F.col("place") <= most)


def validated(picks: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picks (target, component, level, item, ...) of items of their pool, and those that no pool has."""
    known = pool.select("target", *_SLOT, "item").distinct()
    on = ["target", *_SLOT, "item"]
    return picks.join(known, on, "left_semi"), picks.join(known, on, "left_anti")


def recommended(pool: DataFrame, entities: DataFrame, picks: DataFrame | None = None, *, takes: dict[str, int] | None = None, reverse: str = "(?i)reverse", cap: Sequence[tuple[str, str]] = MOBILITY_CAP) -> tuple[DataFrame, DataFrame]:
    """Recommendations of all targets, and the picks that were dropped.

    ``picks`` are any chooser's (target, component, level, item, weight, place);
    without, the deterministic ones. Of each plyo level the heaviest reverse
    throw comes first and no other stays; movement enhancement ends a prep block.
    A pitcher has the mobility cap as a component of its own.
    """
    known, facts = ["target", *_SLOT, "item"], ["is_staple", "is_me", "n_entities", "times_prescribed"]
    chosen = picked(pool, takes) if picks is None else picks
    # the pool is shuffled once, for what is valid and what is not
    held = pool.select(*known, F.col("weight").alias("_weight"), *(F.col(c).alias(f"_{c}") for c in facts), F.lit(True).alias("_known"))
    met = written(chosen.join(held, known, "left"))
    release(pool.sparkSession)
    dropped = met.where(F.col("_known").isNull()).select(*chosen.columns)
    good = met.where(F.col("weight") == F.col("_weight")).select("target", *_ITEM, "place", *(F.col(f"_{c}").alias(c) for c in facts))
    ordered = good.withColumn("place", F.col("place") + F.when(F.col("is_me"), 1_000_000).otherwise(0))
    throws = (F.col("component") == "plyo") & F.col("item").rlike(reverse)
    # in ounces
    heavy = F.regexp_extract("weight", r"(\d+)", 1).try_cast("int") * F.when(F.ilike("weight", F.lit("%lb%")), 16).otherwise(1)
    rows = lead_one(ordered.withColumnRenamed("place", "_place"), ["target", *_SLOT], "_place", throws, heavy).drop("_place").withColumn("sets_x_reps", F.lit(None).cast("string"))
    tail = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("item"), F.lit(d).alias("sets_x_reps")) for i, (n, d) in enumerate(cap)))
    block = entities.where("is_pitcher").select(F.col("entity").alias("target"), F.explode(tail).alias("c")).select("target", F.lit("lift_mobility_cap").alias("component"), F.lit("").alias("level"), "c.*", F.lit("").alias("weight"))
    return rows.unionByName(block, allowMissingColumns=True).select("target", *_ITEM, "place", "is_staple", "is_me", "n_entities", "times_prescribed", "sets_x_reps"), dropped
