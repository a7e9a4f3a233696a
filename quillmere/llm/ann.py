"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Nearest by Euclidean distance is largest by q.x - |x|^2 / 2, an inner product with a known offset.  An inner product
that matters is one with a query near x, so an error along x costs more than one across it: codes and codebooks
minimise |e|^2 + (h - 1) (e.x / |x|)^2 with h = (d - 1) T^2 / (1 - T^2) (Guo et al., "Accelerating Large-Scale
Inference with Anisotropic Vector Quantization", 2020).  A coarse k-means deals vectors to cells; what a cell's
centre leaves of a vector is coded in pairs of dimensions by 4 bits each.  A query builds 16-entry tables, joins them
two and two so that a byte is one lookup, scans the codes of the cells it probes, and measures the best exactly, in
double precision, on the original vectors.

The model is fitted on a sample of at most ``SAMPLE`` vectors (those whose ids hash lowest); every vector is coded.
Equal vectors are one entry with its smallest ids, so a group of copies costs what one vector costs; large cells
and crowds of queries are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Vectors in the sample the model is fitted on, and cells, at most.
SAMPLE, CELLS = 12_000, 4096
#: Entries of a cell, and queries, that one group of work holds, about.
BLOCK, CROWD = 8192, 2048
#: The cosine from which scores matter, which sets the weight of parallel errors; in few dimensions, where that cosine is
#: nothing special, the one that gives them ``LEAST_WEIGHT``.
THRESHOLD, LEAST_WEIGHT = 0.2, 2.0


def parallel_weight(d: int) -> float:
    """How much more an error along a vector of ``d`` dimensions costs than one across it."""
    return max(LEAST_WEIGHT, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centres from distinct random rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, max(len(x), 1), 4096)])


@dataclass
class Model:
    centres: np.ndarray  # cells x d
    books: np.ndarray  # d / 2 pairs x 16 x 2
    weight: float

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 3, rounds: int = 3) -> Model:
        n, d = x.shape
        centres = kmeans(x, min(cells, n), 8, seed)
        rest = x - centres[nearest(x, centres)]
        pairs = rest.reshape(n, -1, 2)
        books = np.stack([np.resize(kmeans(pairs[:, m], 16, 8, seed + m), (16, 2)) for m in range(pairs.shape[1])])
        model = cls(centres, books, parallel_weight(d))
        for _ in range(rounds):
            codes = np.concatenate([model.codes(x[a : a + 1000], rest[a : a + 1000]) for a in range(0, n, 1000)])
            model.refit(x, rest, codes)
        return model

    def refit(self, x: np.ndarray, rest: np.ndarray, codes: np.ndarray) -> None:
        """The codebooks of least anisotropic loss for fixed codes: one weighted least-squares system."""
        n, m = codes.shape
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        size = m * 32
        at = (np.arange(m) * 32 + codes * 2)[:, :, None] + np.arange(2)  # n x m x 2: the entries a vector uses
        at = at.reshape(n, -1)
        normal, right = np.zeros((size, size)), np.zeros(size)
        normal[np.arange(size), np.arange(size)] = np.bincount(at.ravel(), minlength=size) + 1e-6
        for a in range(0, n, 1000):
            z = np.zeros((min(1000, n - a), size))
            np.put_along_axis(z, at[a : a + 1000], u[a : a + 1000], axis=1)
            normal += (self.weight - 1) * z.T @ z
            right += (self.weight - 1) * z.T @ (rest[a : a + 1000] * u[a : a + 1000]).sum(axis=1)
        right += np.bincount(at.ravel(), weights=rest.ravel(), minlength=size) + 1e-6 * self.books.ravel()
        self.books = np.linalg.solve(normal, right).reshape(self.books.shape)

    def codes(self, x: np.ndarray, rest: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of least anisotropic loss: from each pair's nearest, one pair at a time given the others."""
        n, m = len(x), len(self.books)
        u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, m, 2)
        error = rest.reshape(n, m, 2)[:, :, None, :] - self.books[None]  # n x m x 16 x 2
        plain = (error**2).sum(axis=3)
        along = np.einsum("nmkd,nmd->nmk", error, u)
        codes = plain.argmin(axis=2)
        pick = np.arange(n)[:, None], np.arange(m)[None], codes
        total = along[pick].sum(axis=1)
        for _ in range(rounds):
            for j in range(m):
                others = total - along[np.arange(n), j, codes[:, j]]
                best = (plain[:, j] + (self.weight - 1) * ((others[:, None] + along[:, j]) ** 2 - others[:, None] ** 2)).argmin(axis=1)
                codes[:, j] = best
                total = others + along[np.arange(n), j, best]
        return codes

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its codes, two a byte."""
        cell = nearest(x, self.centres)
        codes = np.concatenate([self.codes(x[a : a + 1000], x[a : a + 1000] - self.centres[cell[a : a + 1000]]) for a in range(0, len(x), 1000)])
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return cell, (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query, for each byte of a code its 256 sums."""
        each = np.einsum("qmd,mkd->qmk", q.reshape(len(q), -1, 2), self.books)
        if each.shape[1] % 2:
            each = np.pad(each, ((0, 0), (0, 1), (0, 0)))
        low, high = each[:, 0::2], each[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), low.shape[1], 256).astype(np.float32)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        score = q @ self.centres.T - (self.centres**2).sum(axis=1) / 2
        n = min(n, len(self.centres))
        return np.argpartition(-score, n - 1, axis=1)[:, :n]


def scan(model: Model, cell: int, queries: np.ndarray, x: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, entry position, distance) of the ``k`` best entries of a block, all of one cell, for each
    query.  The entries come in the order of their ids.

    Measured are the best ``rerank`` or fortieth by the tables, and all others whose score is below theirs by less than the
    codes may err: near copies have nearly one score, and only measuring tells them apart."""
    half = ((x**2).sum(axis=1) / 2).astype(np.float32)
    n = min(max(rerank, len(x) // 40), len(x))
    pairs = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(x), -1)[:, : len(model.books)]
    error = np.linalg.norm(x - model.centres[cell] - model.books[np.arange(len(model.books)), pairs].reshape(len(x), -1), axis=1).mean() / np.sqrt(x.shape[1])
    who, which, far = [], [], []

    def measure(at: np.ndarray, best: np.ndarray) -> None:
        best = np.sort(best, axis=1)  # in the order of ids
        d = np.sqrt(((x[best] - queries[at][:, None]) ** 2).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        who.append(np.repeat(at, order.shape[1]))
        which.append(np.take_along_axis(best, order, axis=1).ravel())
        far.append(np.take_along_axis(d, order, axis=1).ravel())

    for start in range(0, len(queries), 64):
        at = np.arange(start, min(start + 64, len(queries)))
        tables = model.tables(queries[at])
        score = np.repeat(-half[None], len(at), axis=0)
        for byte in range(codes.shape[1]):
            score += tables[:, byte][:, codes[:, byte]]
        order = np.argpartition(-score, n - 1, axis=1)[:, :n]
        cut = np.take_along_axis(score, order, axis=1).min(axis=1) - error * np.linalg.norm(queries[at], axis=1)
        close = (score >= cut[:, None]).sum(axis=1)
        few = close <= 2 * n
        if few.any():
            m = int(close[few].max())
            measure(at[few], np.argpartition(-score[few], m - 1, axis=1)[:, :m])
        for i in np.flatnonzero(~few):
            measure(at[i : i + 1], np.flatnonzero(score[i] >= cut[i])[None])
    return np.concatenate(who), np.concatenate(which), np.concatenate(far)


def _matrix(values: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(-1, d)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: with an id, of the usual length, without null or non-finite
    components, not zero."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    # adding 0.0 makes the two zeros one
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: c + F.lit(0.0)).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    usual = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("v") == (usual.d if usual else 0))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, probed: float = 0.6, rerank: int = 32, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each query row, its own id left out.

    ``vectors`` (vec_id, embedding); ``is_query``: a condition on vec_id.  Ties go to the smaller vec_id.  Repeated
    rows are candidates each.  ``probed`` is the share of the cells that a query looks into: vectors without any
    structure, where a true neighbour may lie in any cell, need 0.6 for a recall above 0.9; clustered ones far less.  See :func:`usable` for who takes no part; an empty table gives an empty one."""
    rows = stash(usable(vectors), "vectors")
    spark, schema = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    first = rows.select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    d = int(first[0])
    keep = k + 1  # one may be the query's own
    least = Window.partitionBy("v").orderBy("vec_id")
    groups = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= keep)
    groups = stash(groups.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "v"), "entries")
    asked = stash(rows.where(is_query).join(groups.select("entry", "v"), "v").select(F.col("vec_id").alias("query_id"), "entry"), "asked")

    odd = d % 2
    pad = lambda x: np.pad(x, ((0, 0), (0, odd))) if odd else x
    n = groups.count()
    sample = groups.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    model = Model.fit(pad(sample.flatten().to_numpy().reshape(-1, d).astype(np.float64)), cells or int(min(CELLS, max(1, round(n**0.5)))))
    wide = d + odd

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = pad(part.column(1).flatten().to_numpy().reshape(-1, d).astype(np.float64))
                cell, codes = model.encode(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["entry", "cell", "code", "x"])

    coded = stash(groups.select("entry", "v").mapInArrow(code, "entry long, cell long, code binary, x binary"), "codes")
    askers = asked.select("entry").distinct().join(coded.select("entry", "x"), "entry")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                chosen = model.probes(np.frombuffer(b"".join(part.column(1).to_pylist()), "<f8").reshape(-1, wide), int(np.ceil(probed * len(model.centres))))
                take = pa.array(np.repeat(np.arange(part.num_rows), chosen.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(chosen.ravel())], ["query", "q", "cell"])

    probing = stash(askers.mapInArrow(probe, "query long, q binary, cell long"), "probes")
    # numbers of entries and of queries by cell: as many rows as the model has cells
    blocks = {r.cell: -(-r["count"] // BLOCK) for r in coded.groupBy("cell").count().collect()}
    crowds = {r.cell: -(-r["count"] // CROWD) for r in probing.groupBy("cell").count().collect()}
    plan = spark.createDataFrame([(c, b, crowds[c]) for c, b in blocks.items() if c in crowds], "cell long, blocks long, crowds long")
    entries = coded.join(F.broadcast(plan), "cell")
    entries = entries.withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks"))).withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)))
    seeking = probing.join(F.broadcast(plan), "cell")
    seeking = seeking.withColumn("crowd", F.pmod(F.xxhash64("query"), F.col("crowds"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["cell", "block", "crowd"]

    def search(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(want):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "entry": np.zeros(0, np.int64), "score": np.zeros(0)})
        have = have.sort_values("entry")
        ids = have["entry"].to_numpy()
        codes = np.frombuffer(b"".join(have["code"]), np.uint8).reshape(len(have), -1)
        who, which, far = scan(model, int(have["cell"].iloc[0]), _matrix(want["q"], wide), _matrix(have["x"], wide), codes, keep, rerank)
        return pd.DataFrame({"query": want["query"].to_numpy()[who], "entry": ids[which], "score": far})

    found = entries.select(*key, "entry", "code", "x").groupBy(*key).cogroup(seeking.select(*key, "query", "q").groupBy(*key)).applyInPandas(search, "query long, entry long, score double")
    best = Window.partitionBy("query").orderBy("score", "entry")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep)
    spread = found.join(groups.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("query").orderBy("score", "vec_id")
    short = spread.withColumn("n", F.row_number().over(by_row)).where(F.col("n") <= keep).drop("n")
    answer = Window.partitionBy("query_id").orderBy("score", "vec_id")
    mine = asked.distinct().join(short, F.col("entry") == F.col("query")).where("vec_id <> query_id")
    return mine.withColumn("rank", F.row_number().over(answer)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
