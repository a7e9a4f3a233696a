"""Themes: clusters of conversations by their centroids, labelled by the terms of their titles."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V

LABEL_TERMS, ITERATIONS = 3, 25
MIXED = "(mixed)"


def centroids(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(key, n, centroid): the mean of the unit vectors, made a unit vector; one pass of partial sums of whole vectors."""
    units = vectors.where(F.col(column).isNotNull()).select(key, array_to_vector(V.unit(F.col(column))).alias("_v"))
    means = units.groupBy(key).agg(F.count("*").alias("n"), Summarizer.mean(F.col("_v")).alias("mean"))
    return means.select(key, "n", V.unit(vector_to_array("mean")).alias("centroid"))


def cluster(items: DataFrame, k: int, column: str = "centroid", seed: int = 42) -> DataFrame:
    """``items`` with cluster, by distributed k-means with k-means|| seeding; k is at most the number of items."""
    n = items.count()
    if n == 0:
        return items.withColumn("cluster", F.lit(None).cast("int"))
    data = items.withColumn("_v", array_to_vector(column)).persist()  # read in every round
    model = KMeans(k=max(1, min(k, n)), maxIter=ITERATIONS, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data) if min(k, n) > 1 else None
    return (model.transform(data) if model else data.withColumn("cluster", F.lit(0))).drop("_v")


class XorShift:
    """The 64-bit shift generator (13, 7, 17) of the small deterministic clustering."""

    # Fixed value: the seed.
    def __init__(self, seed: int = 0x9E3779B97F4A7C15) -> None:
        self.x = seed | 1

    def next(self) -> int:
        x = self.x
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.x = x
        return x

    def unit(self) -> float:
        return (self.next() >> 11) / float(1 << 53)


def small_kmeans(x: np.ndarray, k: int, rounds: int = ITERATIONS) -> np.ndarray:
    """Deterministic k-means++ on the driver for up to some ten thousand rows in a fixed order; an empty cluster keeps
    its centre."""
    k = min(k, len(x))
    if k == 0:
        return np.zeros(0, int)
    rng = XorShift()
    chosen = [rng.next() % len(x)]
    best = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        at = int(np.searchsorted(np.cumsum(best), rng.unit() * best.sum(), "right")) if best.sum() > 0 else len(chosen)
        chosen.append(min(at, len(x) - 1))
        best = np.minimum(best, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres, label = x[chosen].copy(), np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                centres[c] = x[label == c].mean(axis=0)
    return label


def term_scores(titles: DataFrame, group: str, title: str) -> DataFrame:
    """(group, term, tf, df, score): score = tf * max(0, ln(N / (1 + df))), N the number of titles, df the occurrences of
    the term in all of them."""
    # what is no term of a title is left out after the words have been counted: once a word, not once an occurrence
    words = titles.select(group, F.explode(F.split(F.lower(title), T.NO_WORD)).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    tf = words.where((F.octet_length("term") >= 3) & ~F.col("term").isin(T.STOPWORDS))
    df = tf.groupBy("term").agg(F.sum("tf").alias("df"))
    n = titles.agg(F.count("*").alias("total"))
    scored = tf.join(df, "term").join(F.broadcast(n))  # n is one row
    return scored.select(group, "term", "tf", "df", (F.col("tf") * F.greatest(F.lit(0.0), F.log(F.col("total") / (1 + F.col("df"))))).alias("score"))


def labels(titles: DataFrame, group: str, title: str) -> DataFrame:
    """(group, label): the three best terms, ties by term; (mixed) where none has a positive score."""
    scored = term_scores(titles, group, title).where("score > 0")
    top = scored.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))).where(F.col("rn") <= LABEL_TERMS)
    joined = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda s: s["term"]), " · ").alias("label"))
    return titles.select(group).distinct().join(joined, group, "left").select(group, F.coalesce("label", F.lit(MIXED)).alias("label"))


def themes(items: DataFrame, k: int, samples: int = 3) -> DataFrame:
    """(cluster, size, label, tools, samples) of items (id, title, tool, centroid), the largest first."""
    return described(cluster(items, k), samples)


def described(placed: DataFrame, samples: int = 3) -> DataFrame:
    """What :func:`themes` says of items that have their cluster, whose members are the rows of ``placed`` themselves."""
    named = labels(placed, "cluster", "title")
    # a limit of its own, which reaches the scan: only the first few of a cluster are sorted
    first = placed.select("cluster", "id", "title").withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(F.col("rn") <= samples)
    chosen = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("samples"))
    size = placed.groupBy("cluster").agg(F.count("*").alias("size")).join(chosen, "cluster")
    mix = placed.groupBy("cluster", "tool").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tool"))).alias("tools"))
    return size.join(named, "cluster").join(mix, "cluster").select("cluster", "size", "label", F.transform("tools", lambda t: F.struct(t["tool"].alias("tool"), (-t["less"]).alias("n"))).alias("tools"), "samples").orderBy(F.desc("size"), "label")
