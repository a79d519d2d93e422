"""Correlations, coverage, clusters and components over long metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridial.operators.norms import top


def corpus_long(profiles: DataFrame, summaries: DataFrame, entities: DataFrame, entity: str = "entity", role: str | None = None) -> DataFrame:
    """Latest profiles of entities that have a program summary and, if given, a role."""
    who = entities if role is None else entities.where(F.col("role").isin(role, "both"))
    return profiles.join(summaries.select(entity).distinct(), entity, "left_semi").join(who.select(entity).distinct(), entity, "left_semi")


def covered(metrics: DataFrame, entity: str, *, min_coverage: float = 0.3, max_missing: float = 0.5) -> DataFrame:
    """Rows of metrics that enough entities have, then of entities that miss few of those."""
    there = metrics.where("value IS NOT NULL")
    n = there.agg(F.countDistinct(entity).alias("_n"))
    share = there.groupBy("metric_key").agg(F.countDistinct(entity).alias("_c")).join(F.broadcast(n)).where(F.col("_c") >= min_coverage * F.col("_n")).select("metric_key")
    kept = there.join(share, "metric_key", "left_semi")
    m = share.agg(F.count("*").alias("_m"))
    who = kept.groupBy(entity).agg(F.countDistinct("metric_key").alias("_k")).join(F.broadcast(m)).where(F.col("_k") >= (1 - max_missing) * F.col("_m")).select(entity)
    return kept.join(who, entity, "left_semi")


def dense_features(features: DataFrame, entity: str, *, min_nonzero: float = 0.05, key: str = "feature", value: str = "value") -> DataFrame:
    """Features that are not zero for at least a share of the entities."""
    n = features.agg(F.countDistinct(entity).alias("_n"))
    some = features.where(F.col(value) != 0).groupBy(key).agg(F.countDistinct(entity).alias("n_nonzero"))
    return some.join(F.broadcast(n)).where(F.col("n_nonzero") >= min_nonzero * F.col("_n")).select(key, "n_nonzero")


def pearson_pairs(metrics: DataFrame, features: DataFrame, entity: str, *, min_pairs: int = 15) -> DataFrame:
    """``metric_key, feature, n_pairs, r`` over entities that have both; drop what is not covered first."""
    m = metrics.where("value IS NOT NULL").select(entity, "metric_key", F.col("value").cast("double").alias("_x"))
    f = features.where("value IS NOT NULL").select(entity, "feature", F.col("value").cast("double").alias("_y"))
    return m.join(f, entity).groupBy("metric_key", "feature").agg(F.count("*").alias("n_pairs"), F.corr("_x", "_y").alias("r")).where(F.col("n_pairs") >= min_pairs)


def standardise(metrics: DataFrame, entity: str) -> DataFrame:
    """Missing values as the metric's mean (0 after centring), then by the population deviation.

    Long form: only present values have rows; the imputed ones are 0. With
    imputation the deviation counts all entities.
    """
    n = metrics.agg(F.countDistinct(entity).alias("_n"))
    each = metrics.groupBy("metric_key").agg(F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"), F.count("value").alias("_c"))
    deviation = F.sqrt(F.col("_var") * F.col("_c") / F.col("_n"))
    stats = each.join(F.broadcast(n)).select("metric_key", "_mean", deviation.alias("_sd"))
    return metrics.join(stats, "metric_key").select(entity, "metric_key", ((F.col("value") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).alias("z"))


def standardised_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """Each place of an array column less its mean by its population deviation (0 deviation: 0).

    Means and deviations of all places come from one aggregate.
    """
    places = vectors.select(F.posexplode(vector).alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    row = places.agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_p"))
    z = F.zip_with(vector, "_p", lambda x, p: F.coalesce((x - p["_m"]) / F.nullif(p["_s"], F.lit(0.0)), F.lit(0.0)))
    return vectors.join(F.broadcast(row)).withColumn(vector, z).drop("_p")


def cluster(vectors: DataFrame, vector: str, *, k: int = 5, seed: int = 42, n_init: int = 10) -> DataFrame:
    """``vectors`` with ``cluster`` of the best of ``n_init`` k-means runs by training cost."""
    df = vectors.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).persist()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="_f", predictionCol="cluster").fit(df) for i in range(n_init)]
    finally:
        df.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(df).drop("_f")


def components(vectors: DataFrame, vector: str, *, k: int = 2) -> DataFrame:
    """``vectors`` with ``components``; of each axis the largest loading is positive."""
    df = vectors.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(df)
    loadings = model.pc.toArray()
    sign = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in loadings.T]
    out = F.zip_with(vector_to_array("_p"), F.array(*map(F.lit, sign)), lambda x, s: x * s)
    return model.transform(df).withColumn("components", out).drop("_f", "_p")


def cluster_means(long: DataFrame, cluster: str, entity: str, places: int = 2) -> DataFrame:
    """Size of every cluster and its means by metric."""
    return long.groupBy(cluster, "metric_key").agg(F.countDistinct(entity).alias("size"), F.round(F.avg("value") + 1e-9, places).alias("mean"))


def pretty(metric: Column) -> Column:
    s = F.translate(F.regexp_replace(metric, "^z_", ""), "_", " ")
    for word, short in (("rotation", "rot"), ("horizontal", "horiz"), ("velocity", "vel")):
        s = F.regexp_replace(s, word, short)
    return s


def label_clusters(means: DataFrame, cluster: str, *, metric: str = "metric_key", mean: str = "mean", high: float = 0.4, low: float = -0.4, most: int = 4) -> DataFrame:
    """A label of each cluster's lowest, then highest metrics, at most ``most`` of each."""
    df = means.where(F.col(mean).isNotNull())
    shown = lambda arrow: F.concat(F.lit(f"{arrow} "), pretty(F.col(metric)), F.lit(" ("), F.format_string("%+.1f", F.col(mean)), F.lit(")"))
    down = top(df.where(F.col(mean) <= low), [cluster], most, F.col(mean).asc(), metric, rank="_n").select(cluster, F.lit(0).alias("_o"), "_n", shown("↓").alias("_t"))
    up = top(df.where(F.col(mean) >= high), [cluster], most, F.col(mean).desc(), metric, rank="_n").select(cluster, F.lit(1).alias("_o"), "_n", shown("↑").alias("_t"))
    said = down.unionByName(up).groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_n", "_t"))), lambda x: x["_t"]), " · ").alias("label"))
    return means.select(cluster).distinct().join(said, cluster, "left").fillna("near-population-average", ["label"])


def strongest(pairs: DataFrame, n: int = 20, by: Sequence[str] = ("metric_key", "feature")) -> DataFrame:
    return pairs.orderBy(F.abs("r").desc_nulls_last(), *by).limit(n)


def share(df: DataFrame, key: str) -> DataFrame:
    """Counts of a key and their percent of all; the window is over the keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))
