"""Texts that are alike or contain one another, found by the grams that they must share."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from meridial.sources.scratch import written


@pandas_udf(DoubleType())
def text_ratio(query: pd.Series, candidate: pd.Series) -> pd.Series:
    """difflib's ratio, arguments in this order."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(query, candidate, strict=True)], dtype="float64")


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance by the longer length; all in the JVM."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def scorer(kind: str):
    return {"difflib": text_ratio, "levenshtein": edit_ratio}[kind]


def _gram_length(least: float, kind: str) -> int:
    """How long grams may be so that texts alike by ``least`` still share some: an edit spoils as many as they are long."""
    return 1 if kind == "difflib" or least < 0.6 else 2 if least < 0.85 else 3


def _with_grams(texts: DataFrame, name: str, q: int) -> DataFrame:
    """Column ``name``: the grams of ``_text`` with marks before and behind it, each with the number of its kind so far, as hashes.

    An empty text has one gram. The sorted grams are a column of their own, so
    that they are not made again for each of them.
    """
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col("_text"), F.lit("\x02" * (q - 1)))
    each = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, F.lit(q))))
    rows = texts.withColumn("_each", F.when(F.length("_text") == 0, F.array(F.lit(""))).otherwise(each))
    numbered = F.transform("_each", lambda g, i: F.xxhash64(F.concat(g, (i - F.array_position("_each", g)).cast("string"))))
    return rows.withColumn(name, numbered).drop("_each")


def _must_share(a: Column, b: Column, least: float, kind: str, q: int) -> Column:
    """The grams that two texts of these lengths share at least if they are alike by ``least``.

    difflib's ratio counts shared characters twice by both lengths. By edit
    distance, each of at most ``(1 - least) * longest`` edits spoils ``q`` grams.
    """
    if kind == "difflib":
        return F.ceil(least * (a + b) / 2 - 1e-9)
    longest = F.greatest(a, b)
    return longest + q - 1 - q * F.floor((1 - least) * longest + 1e-9)


def _prefixes(texts: DataFrame, frequency: DataFrame, least: float, kind: str, q: int, on: Sequence[str]) -> DataFrame:
    """Texts with their grams and the rarest of these, one of which any text alike has among its own."""
    n = F.length("_text")
    # whatever is alike shares this many at least: the bound is least for a text of the same length or, with difflib, the shortest
    share = F.ceil((least / (2 - least) if kind == "difflib" else 1 - q * (1 - least)) * n + (q - 1) - 1e-9)
    each = texts.select(*on, "_text", F.explode("_grams").alias("_gram")).join(frequency, "_gram")
    ranked = each.groupBy(*on, "_text").agg(F.array_sort(F.collect_list(F.struct("_n", "_gram"))).alias("_ranked"))
    grams = F.transform("_ranked", lambda r: r["_gram"])
    rarest = F.slice(grams, F.lit(1), F.greatest(F.size("_ranked") - F.greatest(share, F.lit(1)) + 1, F.lit(1)).cast("int"))
    return _with_grams(ranked.select(*on, "_text", grams.alias("_grams"), rarest.alias("_rarest")), "_chars", 1)


def candidates(left: DataFrame, right: DataFrame, a: str, b: str, least: float, kind: str, on: Sequence[str] = ()) -> DataFrame:
    """``on, _a, _b``: distinct texts that share as many grams as texts alike by ``least`` must.

    An inverted index with a prefix filter: of each text only the rarest grams are
    posted, so many that two texts that share enough have one of them in common;
    a pair is taken where its first common gram is. Then all grams are counted.
    """
    q = _gram_length(least, kind)
    side = lambda df, text: _with_grams(df.select(*on, F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct(), "_grams", q)
    # each side is read three times, and may be a long plan
    x, y = written(side(left, a)), written(side(right, b))
    frequency = x.select("_grams").unionByName(y.select("_grams")).select(F.explode("_grams").alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_n"))
    frequency = written(frequency)
    post = lambda df, name: _prefixes(df, frequency, least, kind, q, on).select(*on, F.col("_text").alias(f"_{name}"), F.col("_grams").alias(f"_{name}_grams"), F.col("_rarest").alias(f"_{name}_rarest"), F.col("_chars").alias(f"_{name}_chars"), F.explode("_rarest").alias("_gram"))
    met = post(x, "a").join(post(y, "b"), [*on, "_gram"])
    la, lb = F.length("_a"), F.length("_b")
    first = F.get(F.array_intersect("_a_rarest", "_b_rarest"), F.lit(0)) == F.col("_gram")
    enough = F.size(F.array_intersect("_a_grams", "_b_grams")) >= _must_share(la, lb, least, kind, q)
    if q > 1:
        # longer grams find pairs, single characters rule more of them out
        enough = enough & (F.size(F.array_intersect("_a_chars", "_b_chars")) >= _must_share(la, lb, least, kind, 1))
    # two empty texts are alike; their one gram stands for no character
    return met.where(first).where(enough | ((la == 0) & (lb == 0))).select(*on, "_a", "_b")


def alike(left: DataFrame, right: DataFrame, a: str, b: str, least: float, kind: str, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of ``left`` and ``right``, of equal ``on``, whose texts ``a`` and ``b`` score ``least`` or more, with ``score``.

    ``least`` is above 0. Each pair of different texts is scored once, whatever
    rows have it; none that reaches ``least`` is lost. A null text is alike to none.
    """
    scored = candidates(left, right, a, b, least, kind, on).withColumn("score", scorer(kind)("_a", "_b")).where(F.col("score") >= least)
    return left.withColumn("_a", F.col(a)).join(scored, [*on, "_a"]).join(right.withColumn("_b", F.col(b)), [*on, "_b"]).drop("_a", "_b")


def containing(queries: DataFrame, query: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs of ``queries`` and ``names`` whose ``name`` contains the ``query``.

    A query of three characters or more meets the names that have the rarest of
    its trigrams, a shorter one those that have it as a gram; then it is looked
    for. An empty query is in every name, a null one in none.
    """
    parts = lambda text, n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    asked = queries.select(F.col(query).alias("_q")).where(F.col(query).isNotNull()).distinct()
    of_query = F.when(F.length("_q") >= 3, F.array_distinct(parts(F.col("_q"), 3))).otherwise(F.array("_q"))
    asked = asked.withColumn("_gram", F.explode(of_query))
    held = names.select(F.col(name).alias("_text")).where(F.col(name).isNotNull()).distinct()
    every = F.array_distinct(F.concat(F.array(F.lit("")), *(parts(F.col("_text"), n) for n in (1, 2, 3))))
    posted = held.select("_text", F.explode(every).alias("_gram")).join(asked.select("_gram").distinct(), "_gram", "left_semi")
    frequency = posted.groupBy("_gram").agg(F.count("*").alias("_n"))
    # a gram that no name has is the rarest: such a query is in none
    rarest = asked.join(frequency, "_gram", "left").groupBy("_q").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    met = rarest.join(posted, "_gram").where(F.contains("_text", F.col("_q"))).select("_q", "_text")
    return queries.join(met, F.col(query) == F.col("_q")).drop("_q").join(names.withColumn("_text", F.col(name)), "_text").drop("_text")
