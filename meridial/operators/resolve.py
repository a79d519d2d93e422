"""Names to ids: exact, loose and fuzzy layers, searches and one-to-one matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridial.functions.text import PATTERNS, clean, loose
from meridial.operators.grams import alike, containing, edit_ratio, scorer
from meridial.operators.norms import top
from meridial.sources.scratch import written


def classify_names(names: DataFrame, name: str, rules: list[tuple[str, list[str]]] | None = None, *, out: str = "pattern") -> DataFrame:
    """Distinct names with the label of the first rule that has a keyword in them.

    The same labels as ``functions.text.classify`` gives, for plans in which its
    chain of conditions would be repeated: keywords are rows of a literal table.
    """
    words = [F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.lit(w).alias("w")) for i, (label, keys) in enumerate(rules or PATTERNS) for w in keys]
    # the empty keyword, last, is in every name
    words.append(F.struct(F.lit(1 << 30).alias("i"), F.lit("unclassified").alias("label"), F.lit("").alias("w")))
    asked = names.select(F.col(name)).distinct().withColumn("_clean", F.coalesce(clean(name), F.lit("")))
    hits = asked.withColumn("_k", F.explode(F.array(*words))).where(F.contains("_clean", F.col("_k.w")))
    return hits.groupBy(name).agg(F.min(F.struct("_k.i", "_k.label")).getField("label").alias(out))


def _scored(residue: DataFrame, catalogue: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Pairs that reach the threshold: of the same first token, or of any for names whose token no candidate has."""
    first = lambda c: F.split(c, " ").getItem(0)
    items = catalogue.select("id", F.col("name").alias("matched_name"), F.col("loose").alias("_c"), first("loose").alias("_t"))
    known = items.select("_t").distinct().withColumn("_known", F.lit(True))
    names = residue.withColumn("_first", first("_loose")).join(known.withColumnRenamed("_t", "_first"), "_first", "left")
    met = alike(names, items, "_loose", "_c", threshold, kind).where(F.col("_known").isNull() | (F.col("_first") == F.col("_t")))
    return met.select("name", "id", "matched_name", "score")


def resolve_names(names: DataFrame, catalogue: DataFrame, *, name: str = "name", threshold: float = 0.88, kind: str = "difflib", fold: bool = False) -> DataFrame:
    """Distinct names with ``id, method, matched_name``; method exact, loose, fuzzy or unmatched.

    ``catalogue`` has ``id, name``; the least id wins in each layer. Only what a
    layer leaves reaches the next, and only distinct names are scored.
    """
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("_exact", F.lower(F.trim("name"))).withColumn("_loose", loose("name", fold=fold))
    items = catalogue.select("id", "name", F.lower(F.trim("name")).alias("exact"), loose("name", fold=fold).alias("loose"))
    by_exact = top(items, ["exact"], 1, "id").select(F.col("exact").alias("_exact"), F.col("id").alias("_id"), F.col("name").alias("_m"))
    by_loose = top(items, ["loose"], 1, "id").select(F.col("loose").alias("_loose"), F.col("id").alias("_id2"), F.col("name").alias("_m2"))
    both = asked.join(by_exact, "_exact", "left").join(by_loose, "_loose", "left")
    residue = both.where("_id IS NULL AND _id2 IS NULL AND _loose != ''").select("name", "_loose")
    best = top(_scored(residue, items, threshold, kind), ["name"], 1, F.col("score").desc(), "id").select("name", F.col("id").alias("_id3"), F.col("matched_name").alias("_m3"))
    out = both.join(best, "name", "left")
    method = F.when(F.col("_id").isNotNull(), "exact").when(F.col("_id2").isNotNull(), "loose").when(F.col("_id3").isNotNull(), "fuzzy").otherwise("unmatched")
    return out.select("name", F.coalesce("_id", "_id2", "_id3").alias("id"), method.alias("method"), F.coalesce("_m", "_m2", "_m3").alias("matched_name"))


#: Thresholds at which names look for their nearest, one after the other.
_ROUNDS = (0.75, 0.5, 0.3, 1e-6)


def nearest_names(names: DataFrame, catalogue: DataFrame, *, name: str = "name", top_n: int = 3, kind: str = "difflib") -> DataFrame:
    """The ``top_n`` most similar catalogue names of each name, similarity to 3 places, ties by the least id.

    Names look for what is alike at a high threshold first; those that found
    fewer than ``top_n`` go on to a lower one, the last of which is one shared
    character. What shares none is similar by 0: there the least ids are next.
    """
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("_loose", loose("name"))
    items = catalogue.select("id", F.col("name").alias("matched_name"), loose("name").alias("_c"))
    columns, found = ["name", "id", "matched_name", "similarity"], None
    for least in _ROUNDS:
        # similarities are ranked as rounded, so what rounds up to the threshold must be met too
        met = written(alike(asked, items, "_loose", "_c", max(least - 0.0006, 1e-6), kind).select("name", "id", "matched_name", F.round("score", 3).alias("similarity"), "_loose"))
        enough = met.where(F.col("similarity") >= least).groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") >= top_n).select("name")
        last = least == _ROUNDS[-1]
        done = met if last else met.join(enough, "name", "left_semi")
        found = done.select(columns) if found is None else found.unionByName(done.select(columns))
        if not last:
            asked = written(asked.join(enough, "name", "left_anti"))
    # at most top_n - 1 of the least ids can have been found, so twice as many hold the next
    least_ids = items.orderBy("id").limit(2 * top_n - 1).collect()
    if least_ids:
        rest = asked.withColumn("_i", F.explode(F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in items.columns)) for r in least_ids))))
        rest = rest.select("name", "_i.id", "_i.matched_name", F.round(scorer(kind)(F.col("_loose"), F.col("_i._c")), 3).alias("similarity"))
        found = found.unionByName(rest).distinct()
    return top(found, ["name"], top_n, F.col("similarity").desc(), "id", rank="place").select("name", "id", "matched_name", "similarity", "place")


def lookup_entities(names: DataFrame, entities: DataFrame, *, min_ratio: float = 0.7, kind: str = "difflib") -> DataFrame:
    """Each name's best entity (``id, name``): equal, else containing it (shortest, then by name), else most similar."""
    asked = names.select(F.lower(F.trim("name")).alias("query")).where("query != ''").distinct()
    e = entities.where("name IS NOT NULL").select("id", F.col("name").alias("entity_name"), F.lower(F.trim("name")).alias("_n"))
    hit = containing(asked, "query", e, "_n").withColumn("tier", F.when(F.col("_n") == F.col("query"), 1).otherwise(2))
    hit = top(hit, ["query"], 1, "tier", F.length("entity_name"), "entity_name", "id").select("query", "id", "entity_name", "tier", F.lit(1.0).alias("ratio"))
    rest = alike(asked.join(hit, "query", "left_anti"), e, "query", "_n", min_ratio, kind).withColumnRenamed("score", "ratio")
    rest = top(rest, ["query"], 1, F.col("ratio").desc(), "entity_name", "id").select("query", "id", "entity_name", F.lit(3).alias("tier"), "ratio")
    return hit.unionByName(rest)


def search_names(queries: DataFrame, users: DataFrame, columns: Sequence[str], *, gap: float = 0.05) -> DataFrame:
    """Users of whom a name column, or all of them joined by spaces, contains the query.

    ``ratio`` is by edit distance to the joined names; a query is ambiguous if
    two users are within ``gap`` of the best.
    """
    # the joined names contain whatever a column contains
    u = users.withColumn("_all", F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))))
    hits = containing(queries, "query", u, "_all").withColumn("ratio", edit_ratio("query", "_all"))
    w = Window.partitionBy("query")
    hits = hits.withColumn("_best", F.max("ratio").over(w))
    return hits.withColumn("ambiguous", F.sum((F.col("ratio") >= F.col("_best") - gap).cast("int")).over(w) >= 2).drop("_best", "_all")


def mutual_best(pairs: DataFrame, keys: Sequence[str], left: str, right: str, score: str = "score") -> DataFrame:
    """One-to-one pairs, best first, ties by left, then right: what a walk down the sorted pairs keeps.

    A pair that is the first of both its sides is kept by any such walk; it and
    whatever shares a side with it leave, and the next round looks at the rest,
    until nothing is left. Pairs are distinct; each round is a written table.
    """
    order = (F.col(score).desc(), F.col(left), F.col(right))
    rest, found = written(pairs), None
    while rest.take(1):
        place = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order))
        ranked = rest.withColumn("_l", place(left)).withColumn("_r", place(right))
        kept = written(ranked.where("_l = 1 AND _r = 1").drop("_l", "_r"))
        found = kept if found is None else found.unionByName(kept)
        for side in (left, right):
            rest = rest.join(kept.select(*keys, side), [*keys, side], "left_anti")
        rest = written(rest.select(*pairs.columns))
    return rest if found is None else found


def greedy_match(left: DataFrame, right: DataFrame, keys: Sequence[str], *, name: str = "name", threshold: float = 0.9, kind: str = "difflib") -> DataFrame:
    """One-to-one pairs ``keys, left_name, right_name, score``, best first, each side used once.

    Ties go by left, then right name. Pairs meet within a key (a run's component
    and group) by what the threshold makes them share; a null key meets none.
    """
    a = left.select(*keys, F.col(name).alias("left_name")).where(F.col(name).isNotNull()).distinct()
    b = right.select(*keys, F.col(name).alias("right_name")).where(F.col(name).isNotNull()).distinct()
    pairs = alike(a, b, "left_name", "right_name", threshold, kind, on=keys)
    return mutual_best(pairs.select(*keys, "left_name", "right_name", "score"), keys, "left_name", "right_name")
