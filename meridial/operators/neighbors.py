"""Nearest profiles, and the pools of items that neighbours were prescribed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridial.operators.grams import containing
from meridial.operators.nearest import nearest
from meridial.operators.norms import top
from meridial.sources.scratch import release, written


def scored(pairs: DataFrame, width: int, min_common: int) -> DataFrame:
    """``target, neighbour, distance, n_common`` of rows with two arrays ``_a`` and ``_b``; nulls are missing."""
    if width <= 128:  # written out, so that it is compiled
        gaps = [F.get("_a", F.lit(i)) - F.get("_b", F.lit(i)) for i in range(width)]
        total = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps), F.lit(0.0))
        common = sum((F.when(g.isNull(), 0).otherwise(1) for g in gaps), F.lit(0))
    else:
        gaps = F.zip_with("_a", "_b", lambda x, y: x - y)
        total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))
        common = F.size(F.array_compact(gaps))
    sums = pairs.select("target", "neighbour", total.alias("_s"), common.cast("long").alias("n_common")).where(F.col("n_common") >= min_common)
    return sums.select("target", "neighbour", F.round(F.sqrt(F.try_divide("_s", "n_common")) + 1e-9, 3).alias("distance"), "n_common")


def ranked(near: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each target with ``place``; a pair without a distance comes last."""
    return top(near, ["target"], k, F.col("distance").asc_nulls_last(), "neighbour", rank="place")


def packed_profiles(profiles: DataFrame, entity: str, block: Sequence[str], *, metric: str = "metric_key", value: str = "z") -> tuple[DataFrame, int]:
    """Long profiles as one array ``_v`` an entity ``_e``, in the order of the catalogue of metrics, and its length."""
    rows = profiles.where(F.col(value).isNotNull())
    catalogue = sorted(r[0] for r in rows.select(metric).distinct().where(F.col(metric).isNotNull()).collect())
    held = rows.groupBy(*block, F.col(entity).alias("_e")).agg(F.map_from_entries(F.collect_list(F.struct(metric, F.col(value).cast("double")))).alias("_m"))
    names = F.array(*map(F.lit, catalogue)) if catalogue else F.array().cast("array<string>")
    return held.select(*block, "_e", F.transform(names, lambda m: F.try_element_at(F.col("_m"), m)).alias("_v")), len(catalogue)


def knn_profiles(profiles: DataFrame, entity: str, block: Sequence[str], *, k: int = 10, min_common: int = 5, metric: str = "metric_key", value: str = "z", targets: DataFrame | None = None) -> DataFrame:
    """``target, neighbour, distance, n_common, place`` within blocks (age group, role).

    Root mean square over the metrics that both have, at least ``min_common``;
    nulls count as missing. Distances are rounded to 3 places before they are
    ranked, then by id. Long profiles are packed into one array an entity, in the
    order of the catalogue of metrics (some hundred names, read by the driver).
    """
    packed, _ = packed_profiles(profiles, entity, block, metric=metric, value=value)
    return ranked(nearest(packed, block, k, min_common, targets=None if targets is None else targets.select(entity)), k)


def knn_dense(vectors: DataFrame, entity: str, vector: str, block: Sequence[str], *, k: int = 10) -> DataFrame:
    """As ``knn_profiles`` for arrays, within blocks: the mean is over the target's length.

    Of arrays with nulls or of different lengths what both have is compared; a
    pair with nothing in common has a null distance and comes last.
    """
    packed = vectors.select(*block, F.col(entity).alias("_e"), F.col(vector).alias("_v"))
    return ranked(nearest(packed, block, k, 0, by_length=True), k).drop("n_common")


#: Anchors that are one array; more are ranked array by array.
ANCHORS_TOGETHER = 1000


def anchor_neighbors(targets: DataFrame, target: str, anchors: DataFrame, family: str, entities: DataFrame, entity: str, name: str, distance: Callable[[Column], Column], *, k: int = 5) -> DataFrame:
    """The nearest families of each target by the entities that their anchors name.

    An anchor (family, anchor) names the entity with the least id whose name
    contains it in any case. ``distance`` takes the entity, a struct of its
    columns, and may use the target's. Anchors are named in templates, so they
    are few: an array of up to ``ANCHORS_TOGETHER`` of them is ranked in each
    target's row, and more of them are arrays whose first families meet in a
    window. A distance is any expression, so each target looks at each anchor.
    """
    e = entities.withColumn("_low", F.lower(name))
    said = containing(anchors.select(family, F.lower("anchor").alias("_anchor")), "_anchor", e, "_low").drop("_low")
    found = written(top(said, [family, "_anchor"], 1, entity).select(F.col(family).alias("family"), F.struct(*entities.columns).alias("entity")))
    kind, key = (found.schema["family"].dataType.simpleString(), found.schema["entity"].dataType[entity].dataType.simpleString())
    blocks = max(1, -(-found.count() // ANCHORS_TOGETHER))
    of = F.pmod(F.xxhash64("family", f"entity.{entity}"), F.lit(blocks))
    best = None
    for b in range(blocks):
        every = found.where(of == b).agg(F.collect_list(F.struct("family", "entity")).alias("a")).scalar()
        scored = F.transform("_a", lambda a: F.struct(F.round(distance(a["entity"]) + 1e-9, 3).alias("distance"), a["family"].alias("family"), a["entity"][entity].alias("anchor")))
        ranked = F.array_sort(F.filter(scored, lambda x: (x["anchor"] != F.col(target)) & x["distance"].isNotNull()))
        each = targets.withColumn("_a", every).select(target, F.explode(_first_of_families(ranked, k, kind, key)).alias("_x"))
        best = each if best is None else best.unionByName(each)
    rows = best.select(target, F.col("_x.family").alias(family), "_x.distance", "_x.anchor")
    rows = top(rows, [target, family], 1, "distance", "anchor") if blocks > 1 else rows
    return top(rows, [target], k, "distance", family, "anchor", rank="place")


def _first_of_families(ranked: Column, k: int, family: str, key: str) -> Column:
    """Of sorted (distance, family, anchor) the first of each family, until there are ``k``."""
    kind = f"struct<distance:double,family:{family},anchor:{key}>"
    done = lambda out, x: (F.size(out) >= k) | F.exists(out, lambda o: o["family"] == x["family"])
    return F.aggregate(ranked, F.array().cast(f"array<{kind}>"), lambda out, x: F.when(done(out, x), out).otherwise(F.concat(out, F.array(x.cast(kind)))))


def counted(prescriptions: DataFrame, entity: str, keys: Sequence[str], *, averages: Sequence[str] = ()) -> DataFrame:
    """One row an entity and item: times, and sums and counts of ``averages``.

    Pools read this instead of the prescriptions, so that what meets other
    tables has an item of an entity once.
    """
    sums = [x for a in averages for x in (F.sum(a).alias(f"_sum_{a}"), F.count(a).alias(f"_n_{a}"))]
    return prescriptions.groupBy(entity, *keys).agg(F.count("*").alias("_times"), *sums)


def _narrow(most: int | None) -> str:
    """The smallest type of whole numbers up to ``most``."""
    return next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if (most or 0) < 1 << bits)


def packed_items(per: DataFrame, entity: str, item: Sequence[str], averages: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``counted`` rows as one row an entity, and the items by code (``*item, _code``).

    Items are codes, and all whole numbers have the smallest type that holds
    them, so that a neighbour's items travel as a few bytes each: ``_codes``,
    ``_more`` (times less 1), and of each average ``_sums_a`` and ``_nulls_a``.
    """
    names = written(per.select(*item).distinct().withColumn("_code", F.monotonically_increasing_id()))
    sums = {a: F.coalesce(F.col(f"_sum_{a}").cast("double"), F.lit(0.0)) for a in averages}
    ends = [F.max("_times"), *(x for a in averages for x in (F.max(F.col("_times") - F.col(f"_n_{a}")), F.max(F.when((sums[a] == F.floor(sums[a])) & (F.abs(sums[a]) < 2**53), F.abs(sums[a])).otherwise(F.lit(2.0**62)))))]
    most, last = per.agg(*ends).first(), names.agg(F.max("_code")).first()[0]
    names = names.withColumn("_code", F.col("_code").cast(_narrow(last)))
    columns = [(F.col("_times") - 1).cast(_narrow(most[0])).alias("_more")]
    for i, a in enumerate(averages):
        whole = most[2 + 2 * i] is not None and most[2 + 2 * i] < 2.0**53
        columns += [sums[a].cast(_narrow(int(most[2 + 2 * i]))).alias(f"_sums_{a}") if whole else sums[a].alias(f"_sums_{a}"), (F.col("_times") - F.col(f"_n_{a}")).cast(_narrow(most[1 + 2 * i])).alias(f"_nulls_{a}")]
    known = names.select(*(F.col(c).alias(f"_item_{c}") for c in item), "_code")
    same = F.lit(True)
    for c in item:
        same = same & F.col(c).eqNullSafe(F.col(f"_item_{c}"))
    coded = per.where(F.col(entity).isNotNull()).join(known, same).select(entity, "_code", *columns)
    lists = [F.collect_list(c).alias("_codes" if c == "_code" else c) for c in coded.columns[1:]]
    return written(coded.groupBy(entity).agg(*lists)), names


def history_pool(neighbours: DataFrame, prescriptions: DataFrame, entity: str, item: Sequence[str], *, min_entities: int = 2, averages: Sequence[str] = ()) -> DataFrame:
    """Per target, the items of its neighbours: times, distinct entities, averages; at least ``min_entities``.

    ``prescriptions`` may be ``counted`` by entity and item already, best as a
    written table. Each neighbour brings its items packed in one row, which is
    dealt by target and unpacked where it is added up: the only shuffle that
    grows with targets times neighbours carries a few bytes an item.
    """
    spark = prescriptions.sparkSession
    per = prescriptions if "_times" in prescriptions.columns else written(counted(prescriptions, entity, item, averages=averages))
    release(spark)
    packed, names = packed_items(per, entity, item, averages)
    near = written(neighbours.select("target", F.col("neighbour").alias(entity)).distinct())
    release(spark)
    entities, slots = packed.count(), spark.sparkContext.defaultParallelism
    parts = 1 + max(entities // 8_000, min(2 * slots, entities // 200))
    arrays = [c for c in packed.columns if c != entity]
    dealt = near.join(packed, entity).select("target", *arrays).repartition(parts, "target").select("target", F.posexplode("_codes").alias("_at", "_code"), *arrays[1:])
    of = lambda c: F.get(c, F.col("_at"))
    means = [F.try_divide(F.sum(of(f"_sums_{a}")), F.sum(of("_more") + F.lit(1) - of(f"_nulls_{a}"))).alias(f"avg_{a}") for a in averages]
    out = dealt.groupBy("target", "_code").agg(F.sum(of("_more") + F.lit(1)).alias("times_prescribed"), F.count("*").alias("n_entities"), *means)
    return out.where(F.col("n_entities") >= min_entities).join(names, "_code").select("target", *item, "times_prescribed", "n_entities", *(f"avg_{a}" for a in averages))


def staple_pool(prescriptions: DataFrame, entity: str, group: Sequence[str], item: str, *, min_entities: int = 10, top_n: int = 6) -> DataFrame:
    """Per group, the items that most entities have. ``prescriptions`` may be ``counted`` already."""
    per = prescriptions if "_times" in prescriptions.columns else counted(prescriptions, entity, [*group, item])
    # an entity may have an item in several slots
    per = per.groupBy(*group, item, entity).agg(F.sum("_times").alias("_times"))
    counts = per.groupBy(*group, item).agg(F.count("*").alias("n_entities"), F.sum("_times").alias("times_prescribed")).where(F.col("n_entities") >= min_entities)
    return top(counts, group, top_n, F.col("n_entities").desc(), item, rank="place")


def merge_pools(keys: Sequence[str], item: str, *pools: DataFrame) -> DataFrame:
    """All pools under another, earlier ones first, each item (in any case) once a key."""
    out = None
    for i, p in enumerate(pools):
        p = p.withColumn("source", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys, F.lower(item)).orderBy("source", "place")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def capped(pool: DataFrame, keys: Sequence[str], cap: int, *order) -> DataFrame:
    return top(pool, keys, cap, *order)


def lead_one(rows: DataFrame, keys: Sequence[str], order: str, special: Column, weight: Column) -> DataFrame:
    """Of the special rows the heaviest stays and comes first, the others keep their order; numbered from 0."""
    df = rows.withColumn("_s", F.coalesce(special, F.lit(False))).withColumn("_w", weight)
    best = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(F.col("_w").desc_nulls_last(), order))
    df = df.withColumn("_b", best).where("NOT _s OR _b = 1")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_s").desc(), order)) - 1
    return df.withColumn("place", place).drop("_s", "_w", "_b")


def valid_picks(picks: DataFrame, pool: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Picks whose key is in the pool, and those that are not."""
    keys = pool.select(*on).distinct()
    return picks.join(keys, list(on), "left_semi"), picks.join(keys, list(on), "left_anti")


def recommend(pools: DataFrame, target: str, slots: dict[str, int], *, slot: str = "slot", item: str = "item", staple: str = "is_staple") -> DataFrame:
    """Per target and slot the first items, staples first, then by prevalence.

    ``slots`` has how many each slot takes; the same item once a slot.
    """
    once = top(pools, [target, slot, item], 1, F.col(staple).desc(), F.col("n_entities").desc())
    w = Window.partitionBy(target, slot).orderBy(F.col(staple).desc(), F.col("n_entities").desc(), F.col("times_prescribed").desc(), item)
    most = F.create_map(*(F.lit(x) for pair in slots.items() for x in pair))
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.try_element_at(most, F.col(slot)))
