"""Connected components of a table of links, distributed, by alternating stars.

Large star hangs every larger neighbour of a vertex below the smallest neighbour, small star every smaller
one (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).  Each round is a few partial
aggregates and joins; the rounds end when the links no longer change.  Nothing is collected but two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


class Forest:
    """Union-find over 0..n-1; the root of a tree is its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        """The root of every member, by pointer jumping."""
        while True:
            new = self.up[self.up]
            if (new == self.up).all():
                return new
            self.up = new


def local_stars(links: DataFrame) -> DataFrame:
    """Links (u, v) of each partition as stars around the smallest vertex of each of its trees."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            forest = Forest(len(names))
            for i, j in np.unique(np.sort(at.reshape(2, -1).T, axis=1), axis=0).tolist():
                forest.join(i, j)
            roots = forest.roots()
            below = np.flatnonzero(roots != np.arange(len(names)))
            if len(below):
                yield pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(names[roots[below]])], ["u", "v"])

    return links.select("u", "v").mapInArrow(each, "u long, v long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root) for every vertex of ``links`` (u long, v long; none null), root the smallest vertex of its component.

    Self links and repeated ones do no harm; an empty table gives an empty one; a root comes with itself."""
    # a sum of 64-bit hashes in decimal: the same links, the same sum
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = stash(local_stars(links.where("u <> v")).distinct(), "links")
    seen = mark(now)
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a star's centre may have very many rows here, of two numbers each: the planner splits such a partition
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # after the large star every link leads from a vertex to a smaller one, so u's smaller neighbours are its v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    ends = now.groupBy("u").agg(F.min("v").alias("root"))
    return ends.union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct().join(ends.select("u"), "u", "left_anti"))
