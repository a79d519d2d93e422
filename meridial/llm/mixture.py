"""Mixing sources to target weights by a splitting tree of exact block quotas.

Every source's documents are permuted by a hash and cut into 256 blocks by its
first byte. A source's target decides how many passes over its blocks are drawn;
the last pass ends inside a block, at a document. All drawn blocks are split
among the output shards by a binary tree: at each node the blocks are put in a
random order and the first half goes left, so the sources' counts on the left
are a multivariate hypergeometric draw from the node's quotas. The leaves'
quotas are exact; each shard takes its next blocks of each source's permutation
and shuffles locally. A document is taken as often as shards have drawn it.

Only DataFrame operations are used. Neither documents nor sources nor blocks are
sorted in one place: ranks and running sums are taken within groups by range or
hash, and added to those of the groups before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridial.llm._work import cut, drop

WORDS = r"[^\x20\x09-\x0D]+"


def _hash(*columns) -> F.Column:
    return F.md5(F.concat_ws("|", *columns).cast("binary"))


def running(df: DataFrame, order: list, **sums) -> DataFrame:
    """``df`` with running totals of expressions over ``order``, the row's own included, and ``of_all`` the whole ones.

    Rows are dealt by range and written, so no task has all; one row a
    partition is added up in one place. The sums must be exact in any order.
    """
    dealt = cut(df.select("*", *(x.alias(f"_{n}") for n, x in sums.items())).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(*(F.sum(f"_{n}").alias(f"_t_{n}") for n in sums))
    before, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.sum(f"_t_{n}").over(every).alias(f"of_all_{n}") for n in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.select("*", *(F.sum(f"_{n}").over(within).alias(f"_w_{n}") for n in sums)).join(parts, "_part")
    return dealt.select(*df.columns, *((F.col(f"_b_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums), *(f"of_all_{n}" for n in sums))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``rank, weight, target``.

    Sources by code point, null last, take the weights in turn. The targets sum
    to ``share`` of all sizes; one that would pass ``most`` times its source's
    size stops there, and the excess is shared by weight among the others until
    none is above. With caps sorted by cap / weight, a source is capped if the
    level that the rest would get reaches it.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = running(sizes, [F.col("source").asc_nulls_last()], place=F.lit(1).cast("long")).select("source", "source_size", (F.col("place") - 1).alias("rank"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    # the caps and weights up to a row, its own included
    by = running(ranked, [F.col("ratio"), F.col("rank")], caps=F.col("cap"), weighed=F.col("weight"))
    level = (share * F.col("of_all_caps") / most - (F.col("caps") - F.col("cap"))) / (F.col("of_all_weighed") - F.col("weighed") + F.col("weight"))
    levelled = cut(by.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap")))
    # the level of the first source that is not capped holds for all after it
    free = levelled.where(~F.col("capped")).agg(F.min(F.struct("ratio", "rank", "level")).getField("level")).first()[0] or 0.0
    return levelled.select("source", "source_size", "rank", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(free) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``id, source, size, place``: words of the text and the row's place in its source's permutation.

    Places hash the key, the text and, among rows that agree in all three, the
    row's number, so that every row has a place of its own. Which of such equal
    rows has which number makes no difference.
    """
    base = _hash(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), size.alias("size"), base.alias("base"), F.spark_partition_id().alias("part")))
    # equal rows are numbered within the part that held them, behind those of the parts before
    parts = rows.groupBy("source", "base", "part").agg(F.count("*").alias("n"))
    equal = Window.partitionBy("source", "base")
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(equal.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("of", F.sum("n").over(equal))
    parts = cut(parts.where("of > 1").select(F.col("source").alias("e_source"), F.col("base").alias("e_base"), F.col("part").alias("e_part"), "first"))
    met = rows.join(parts, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("base") == F.col("e_base")) & (F.col("part") == F.col("e_part")), "left")
    single = met.where("first IS NULL").withColumn("number", F.lit(0).cast("long"))
    several = met.where("first IS NOT NULL").withColumn("number", F.col("first") + F.row_number().over(Window.partitionBy("source", "base", "part").orderBy("id")) - 1)
    return single.unionByName(several).select("id", "source", "size", _hash(F.lit(seed), "base", "number").alias("place"))


def _cut_points(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For ``goals`` (source, rest) the place ``stop`` up to which its last pass
    goes, and the place ``filler`` of one more document of that pass.

    Places are walked down by two bytes, a byte at a time: of 256 groups the one
    that holds the goal is entered. Within the last (a 65,536th of a source), the
    documents are taken in order while they fit. The gap that is left is filled
    by the one document behind them whose size is nearest to it, if that helps.
    """
    same = F.col("source").eqNullSafe(F.col("g_source"))
    now = cut(goals.select(F.col("source").alias("g_source"), "rest", F.lit("").alias("prefix")))
    for depth in (1, 2):
        inside = rows.join(now, same & (F.substring("place", 1, 2 * depth - 2) == F.col("prefix")))
        group = inside.groupBy("g_source", F.substring("place", 1, 2 * depth).alias("next")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        order = Window.partitionBy("g_source").orderBy("next")
        group = group.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        group = group.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        now = cut(group.select("g_source", (F.col("rest") - F.col("before")).alias("rest"), F.col("next").alias("prefix")))
    inside = rows.join(now, same & (F.substring("place", 1, 4) == F.col("prefix")))
    order = Window.partitionBy("g_source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size")
    last = inside.select("g_source", "place", "rest", end.alias("end")).where("end <= rest").groupBy("g_source").agg(F.max("place").alias("last"), F.max("end").alias("end"))
    # where no document of the group fits, the pass ends before the group
    stops = now.alias("n").join(last.alias("l"), F.col("n.g_source").eqNullSafe(F.col("l.g_source")), "left")
    stops = cut(stops.select(F.col("n.g_source").alias("g_source"), F.coalesce("last", "prefix").alias("stop"), (F.col("rest") - F.coalesce("end", F.lit(0))).alias("gap")))
    off = F.abs(F.col("size") - F.col("gap"))
    behind = rows.where("size > 0").join(stops, same & (F.col("place") > F.col("stop")) & (off < F.col("gap")))
    filler = behind.groupBy(F.col("g_source").alias("f_source")).agg(F.min(F.struct(off.alias("off"), "place")).getField("place").alias("filler"))
    return stops.join(filler, F.col("g_source").eqNullSafe(F.col("f_source")), "left").select("g_source", "stop", "filler")


def _halved(tree: DataFrame, level: int, seed: str) -> DataFrame:
    """The draws (rank, turn, node) one level down: the first half of a random order of each node goes left.

    The order is cut into 256 groups by the first byte of its hash.
    """
    drawn = tree.withColumn("order", _hash(F.lit(seed), F.lit(level), "rank", "turn")).withColumn("group", F.substring("order", 1, 2))
    node = Window.partitionBy("node")
    groups = drawn.groupBy("node", "group").agg(F.count("*").alias("n"))
    groups = groups.select("node", "group", F.coalesce(F.sum("n").over(node.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(node).alias("all"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("node", "group").orderBy("order", "rank", "turn"))
    out = cut(drawn.join(groups, ["node", "group"]).select("rank", "turn", (F.col("node") * 2 + (place > F.ceil(F.col("all") / 2)).cast("int")).alias("node")))
    drop(tree)
    return out


def draw(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, levels: int = 3, seed: str = "mix") -> DataFrame:
    """What the mix takes of each row of ``docs``.

    Returns ``key, source, size, source_size, target, taken, shards, place``:
    ``shards`` has the output shard (of ``2 ** levels``) of each draw that takes
    the row, ``taken`` is ``size`` times their number, ``target`` the source's.
    Null and empty texts have size 0; a null source is a source of its own; null
    and repeated keys are rows of their own. The same input and ``seed`` give
    the same draws. An empty table gives no rows. Other columns are not read.
    """
    rows = cut(sized(docs, key=key, text=text, source=source, seed=seed))
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most)
    # a source's target may be its whole size but for the rounding of doubles
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0).cast("int")
    rest = F.when(F.col("passes") < most, F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))).otherwise(F.lit(0.0))
    aims = cut(aims.withColumn("passes", passes).withColumn("rest", rest))
    stops = _cut_points(rows, aims.where("rest > 0").select("source", "rest"))
    plan = cut(aims.join(stops, F.col("source").eqNullSafe(F.col("g_source")), "left").select(F.col("source").alias("p_source"), "source_size", "target", "rank", "passes", F.coalesce("stop", F.lit("")).alias("stop"), "filler"))
    # a draw is a source's block in one pass, counted along its permutation
    quota = F.col("passes") * 256 + F.when(F.col("stop") == "", 0).otherwise(F.conv(F.substring("stop", 1, 2), 16, 10).cast("int") + 1)
    quota = quota.cast("int")
    tree = cut(plan.select("rank", quota.alias("quota")).where("quota > 0").select("rank", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("turn"), F.lit(0).alias("node")))
    for level in range(levels):
        tree = _halved(tree, level, seed)
    # the leaves keep their quotas; each takes the next blocks of every permutation
    quotas = tree.groupBy("rank", "node").agg(F.count("*").cast("int").alias("quota"))
    # at most 256 blocks in each of at most ``most`` passes
    leaves = F.array_sort(F.collect_list(F.struct("node", "quota")))
    dealt = quotas.groupBy("rank").agg(F.flatten(F.transform(leaves, lambda x: F.array_repeat(x["node"], x["quota"]))).alias("deal"))
    plan = cut(plan.join(dealt, "rank", "left"))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left")
    # the last block, cut short, also has the document that fills the gap
    fills = F.coalesce(F.col("place") == F.col("filler"), F.lit(False))
    drawn = F.col("passes") + (((F.col("stop") != "") & (F.col("place") <= F.col("stop"))) | fills).cast("int")
    block = F.conv(F.substring("place", 1, 2), 16, 10).cast("int")
    turns = [F.when(drawn > i, F.element_at("deal", F.when(fills & (F.col("passes") == i), quota).otherwise(i * 256 + block + 1))) for i in range(most)]
    out = out.withColumn("shards", F.array_compact(F.array(*turns)))
    return out.select(F.col("id").alias(key), "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", "place")


def mix(docs: DataFrame, *, key: str = "doc_id", seed: str = "mix", **options) -> DataFrame:
    """One row for each time the mix takes a row: ``key, source, size, pass, shard, place, position``.

    ``position`` is a sort key: a random order within the shard and all passes.
    """
    drawn = draw(docs, key=key, seed=seed, **options)
    return drawn.select(key, "source", "size", "place", F.posexplode("shards").alias("pass", "shard")).select(key, "source", "size", "pass", "shard", "place", _hash(F.lit(seed), F.col("pass"), F.col("place")).alias("position"))
