"""Exact nearest profiles in large blocks: tiles with ranges of values, and bounds that leave most pairs unscored.

Entities of a block are put into tiles by their two nearest pivots. A first
round scores an entity's own cell (the tiles of its nearest pivot), which bounds
the distance of its k-th neighbour. A tile keeps the range of each metric, and
whether all or any of its entities have it; from these follows the least
distance that any entity of it can have. Pairs of tiles, then pairs of an entity
and a tile, go on only while that is no more than the bound. So the result is
that of all pairs, whatever the tiles are; profiles in clusters are pruned best.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridial.operators.nearest import nearest
from meridial.operators.neighbors import packed_profiles, ranked, scored
from meridial.operators.norms import top
from meridial.sources.scratch import written

#: Distances are ranked when rounded to 3 places, so a bound is wider by more than half of the last place.
_SLACK = 0.001


def _squares(a: Column, b: Column) -> Column:
    """Sum of squared gaps of two arrays, nulls as 0; it chooses tiles only."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def placed_in_tiles(packed: DataFrame, block: Sequence[str], pivots: int) -> DataFrame:
    """``packed`` with ``_cell``, the nearest pivot, and ``_tile``, the two nearest.

    The pivots of a block are the ``pivots`` entities with the least hash, fewer in
    a block of fewer than 64 entities a tile: one row a block, so what is joined
    grows with the number of blocks alone.
    """
    chosen = top(packed, block, pivots, F.xxhash64("_e"), "_e") if block else packed.orderBy(F.xxhash64("_e"), "_e").limit(pivots)
    points = chosen.groupBy(*block).agg(F.sort_array(F.collect_list("_v")).alias("_p"))
    sizes = packed.groupBy(*block).agg(F.count("*").alias("_of"))
    points = points.join(sizes, list(block)) if block else points.crossJoin(sizes)  # one row each
    wanted = F.greatest(F.lit(1), F.least(F.lit(pivots), (F.sqrt("_of") / 8).cast("int")))
    points = points.withColumn("_p", F.slice("_p", F.lit(1), wanted)).drop("_of")
    both = packed.join(points, list(block)) if block else packed.crossJoin(F.broadcast(points))  # one row of ``pivots`` arrays
    near = F.array_sort(F.transform("_p", lambda p, i: F.struct(_squares(F.col("_v"), p).alias("d"), i.alias("i"))))
    first, second = F.get("_n", F.lit(0)).i, F.coalesce(F.get("_n", F.lit(1)).i, F.lit(0))
    return both.withColumn("_n", near).select(*block, "_e", "_v", first.alias("_cell"), (first * pivots + second).alias("_tile"))


def _boxes(placed: DataFrame, block: Sequence[str]) -> DataFrame:
    """Per tile an array of (lo, hi, any, all) by metric: the range, and whether any or all entities have it."""
    keys = [*block, "_cell", "_tile"]
    each = placed.select(*keys, F.posexplode("_v").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("_x").alias("n"), F.count(F.lit(1)).alias("of"))
    one = F.struct("_i", "lo", "hi", (F.col("n") > 0).alias("any"), (F.col("n") == F.col("of")).alias("all"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_box"))


def _least(total: Column, most: Column, min_common: int, bound: Column) -> Column:
    """Whether a pair may be within ``bound``: what must differ, over the most metrics that can be common."""
    return (most >= min_common) & (total <= bound * bound * most)


def _tiles_may_meet(a: str, b: str, min_common: int, bound: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.when(x.all & y.all, F.greatest(F.lit(0.0), x.lo - y.hi, y.lo - x.hi)).otherwise(F.lit(0.0)))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    most = F.size(F.filter(F.zip_with(a, b, lambda x, y: x["any"] & y["any"]), lambda x: x))
    return _least(total, most, min_common, bound)


def _may_be_in(v: str, box: str, min_common: int, bound: Column) -> Column:
    gaps = F.zip_with(v, box, lambda x, y: F.when(x.isNotNull() & y.all, F.greatest(F.lit(0.0), x - y.hi, y.lo - x)).otherwise(F.lit(0.0)))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    most = F.size(F.filter(F.zip_with(v, box, lambda x, y: x.isNotNull() & y["any"]), lambda x: x))
    return _least(total, most, min_common, bound)


def tiled_pairs(packed: DataFrame, width: int, block: Sequence[str], k: int, min_common: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """The scored pairs of cells, and the further pairs (``target, neighbour, _a, _b``) that bounds leave."""
    block = list(block)
    placed = written(placed_in_tiles(packed, block, pivots))
    a = placed.select(*block, F.col("_cell"), F.col("_tile").alias("_at"), F.col("_e").alias("target"), F.col("_v").alias("_a"))
    b = placed.select(*block, F.col("_cell"), F.col("_tile").alias("_bt"), F.col("_e").alias("neighbour"), F.col("_v").alias("_b"))
    own = a.join(b, [*block, "_cell"]).where("target != neighbour").select("target", "neighbour", "_a", "_b")
    first = written(top(scored(own, width, min_common), ["target"], k, "distance", "neighbour"))
    # no bound while fewer than k are known
    bound = first.groupBy("target").agg(F.max("distance").alias("_far"), F.count("*").alias("_known"))
    reach = F.when(F.col("_known") >= k, F.col("_far") + _SLACK).otherwise(F.lit(float("inf")))
    bounded = written(a.join(bound, "target", "left").withColumn("_reach", F.coalesce(reach, F.lit(float("inf")))).drop("_far", "_known"))
    boxes = written(_boxes(placed, block))
    tiles = boxes.select(*block, F.col("_cell").alias("_ac"), F.col("_tile").alias("_at"), F.col("_box").alias("_abox"))
    tiles = tiles.join(bounded.groupBy(*block, "_at").agg(F.max("_reach").alias("_most")), [*block, "_at"])
    others = boxes.select(*block, F.col("_cell").alias("_bc"), F.col("_tile").alias("_bt"), F.col("_box").alias("_bbox"))
    # tiles of a block are at most pivots * pivots, whatever its size
    meet = tiles.join(others, block) if block else tiles.crossJoin(F.broadcast(others))
    meet = meet.where(F.col("_ac") != F.col("_bc")).where(_tiles_may_meet("_abox", "_bbox", min_common, F.col("_most"))).select(*block, "_at", "_bt", "_bbox")
    asks = bounded.join(meet, [*block, "_at"]).where(_may_be_in("_a", "_bbox", min_common, F.col("_reach"))).select(*block, "_bt", "target", "_a")
    more = asks.join(b, [*block, "_bt"]).where("target != neighbour").select("target", "neighbour", "_a", "_b")
    return first, more


def knn_tiled(profiles: DataFrame, entity: str, block: Sequence[str] = (), *, k: int = 10, min_common: int = 5, metric: str = "metric_key", value: str = "z", pivots: int = 32) -> DataFrame:
    """As ``neighbors.knn_profiles``, for blocks (or one block of all) of any size, whose tiles meet in tasks (``nearest``).

    Entities whose block is null have no neighbours, equal profiles are
    neighbours at 0, ties go by id. ``pivots`` a group changes the work only.
    """
    packed, _ = packed_profiles(profiles, entity, block, metric=metric, value=value)
    return ranked(nearest(packed, block, k, min_common, pivots=pivots), k)


def knn_dense_tiled(vectors: DataFrame, entity: str, vector: str, block: Sequence[str] = (), *, width: int, k: int = 10, pivots: int = 32) -> DataFrame:
    """As ``knn_tiled`` for arrays of ``width`` values; null or shorter arrays have what they have."""
    packed = vectors.where(F.col(vector).isNotNull()).select(*block, F.col(entity).alias("_e"), F.slice(vector, 1, width).alias("_v"))
    return ranked(nearest(packed, block, k, 1, pivots=pivots), k).drop("n_common")
