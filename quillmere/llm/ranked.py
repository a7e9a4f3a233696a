"""Ranked lexical search: exact top-k by dual-sorted wavelet trees, a tree a shard of documents.

A shard's postings (document, occurrences) are laid out term after term, within a term by falling impact, and kept as a wavelet
tree over the shard's document numbers, which ascend with doc_id.  A node of the tree stands for a range of documents, and a
term's postings in that range are one range of the node's sequence, still ordered by impact: its first entry is the
greatest impact that the term has among these documents.  So the sum of the first entries, weighted, bounds the score of every
document below the node, and at a leaf it is the score.  The search opens the nodes of the greatest bounds first, many at a time,
intersects the ranges of all query terms with their two children, and ends when no bound reaches the k-th best score.

Two passes read the documents: one counts them, their words, and the documents that hold each query term; the other
builds the trees and searches them where they are, and each task sends its k best documents a query.  Queries reach the executors in parts of
bounded size, each with passes of its own; one part is the rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, PUNCT, U64, as_binary, as_bytes, pieces, release, tidy, word_hashes, word_spans

#: Bytes of query texts that one pass may broadcast.
PART_BYTES = 8 << 20
#: A shard is closed once it has so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
#: Nodes that are opened at a time.
OPENED = 128
IMPACT_BITS = 20


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of the distinct terms of each document, as 64-bit hashes of the words, and each document's number of words."""
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets, PUNCT)
    terms, which = np.unique(word_hashes(data, starts, ends), return_inverse=True)
    n = np.diff(firsts)
    key, count = np.unique(np.repeat(np.arange(len(n)), n) * max(len(terms), 1) + which, return_counts=True)
    return key // max(len(terms), 1), terms[key % max(len(terms), 1)] if len(terms) else np.zeros(0, U64), count, n


def doc_weights(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of ``n`` words: 10 + (90 n N) div L."""
    if not words:
        return np.full(len(n), 10)
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * x * docs // words for x in n.tolist()])
    return 10 + 90 * n * docs // words


class Shard:
    """The postings of some documents as a wavelet tree; documents are numbered from 0 in the order that they are given."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        self.terms, which = np.unique(term, return_inverse=True)
        order = np.lexsort((doc, -impact, which))
        doc, impact = doc[order], impact[order].astype(np.int32)
        self.at = np.searchsorted(which[order], np.arange(len(self.terms) + 1))
        n, self.levels = len(doc), max(docs - 1, 0).bit_length()
        self.width = n + 1
        self.ones = np.zeros((self.levels, n + 1), np.int32)  # ones before each place
        self.first = np.zeros((self.levels + 1, n + 1), np.int32)
        self.zeros = np.zeros(self.levels, np.int32)
        self.opened = 0  # nodes, in all searches
        for level in range(self.levels):
            self.first[level, :n] = impact
            bit = doc >> (self.levels - 1 - level) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, n]
            order = np.concatenate([np.flatnonzero(bit == 0), np.flatnonzero(bit)])
            doc, impact = doc[order], impact[order]
        self.first[self.levels, :n] = impact

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> list[tuple[int, int]]:
        """(score, document) of the ``k`` best documents whose score is ``floor`` or more, equal ones by document number."""
        place = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        held = (self.terms[place] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        place, weights = place[held], weights[held]
        if not len(place):
            return []
        low, high = self.at[place][None].astype(np.int64), self.at[place + 1][None].astype(np.int64)
        level, number = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.first[0][low] @ weights
        ones, first = self.ones.ravel(), self.first.ravel()
        found: list[tuple[int, int]] = []
        while True:
            keep = bound >= floor
            if not keep.all():
                low, high, level, number, bound = low[keep], high[keep], level[keep], number[keep], bound[keep]
            if not len(bound):
                return found
            if len(bound) > OPENED:
                order = np.argpartition(-bound, OPENED)
                now, rest = order[:OPENED], order[OPENED:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            leaf = level[now] == self.levels
            if leaf.any():
                found += zip(bound[now[leaf]].tolist(), number[now[leaf]].tolist(), strict=True)
                found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                if len(found) == k:
                    floor = max(floor, found[-1][0])
                now = now[~leaf]
            self.opened += len(now)
            base = (level[now] * self.width)[:, None]
            a, b = ones[base + low[now]].astype(np.int64), ones[base + high[now]].astype(np.int64)
            zeros = self.zeros[level[now]][:, None] if len(now) else np.zeros((0, 1), np.int64)
            lows, highs = np.concatenate([low[now] - a, zeros + a]), np.concatenate([high[now] - b, zeros + b])
            deeper = np.tile(level[now] + 1, 2)
            top = np.where(highs > lows, first[(deeper * self.width)[:, None] + lows], 0) @ weights
            numbers = np.concatenate([number[now] * 2, number[now] * 2 + 1])
            keep = top >= floor
            low, high = np.concatenate([low[rest], lows[keep]]), np.concatenate([high[rest], highs[keep]])
            level, number = np.concatenate([level[rest], deeper[keep]]), np.concatenate([number[rest], numbers[keep]])
            bound = np.concatenate([bound[rest], top[keep]])


class Queries:
    """Some queries: each one's terms, and of all terms the documents that hold them."""

    def __init__(self, ids: list[int | None], texts: list[list[bytes]]) -> None:
        self.ids, self.terms = ids, []
        for each in texts:
            data, offsets = as_bytes(pa.array(each, pa.large_binary()))
            self.terms.append(np.unique(terms_of(data, offsets)[1]))
        self.all = np.unique(np.concatenate([np.zeros(0, U64), *self.terms]))

    def weigh(self, docs: int, df: np.ndarray) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.weights = [weight[np.searchsorted(self.all, t)] for t in self.terms]


def queries(items: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[Queries]:
    """The items (item_id, text) in parts of about ``part_bytes``; rows of one item_id are one item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    for i in range(parts):
        texts: dict[int | None, list[bytes]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).collect():
            texts.setdefault(r.item_id, []).append(bytes(r.text))
        yield Queries(list(texts), list(texts.values()))


def _counted(rows: DataFrame, asked: Queries) -> tuple[int, int, np.ndarray]:
    """(documents with a term, words of all documents, documents that hold each term of ``asked``)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(len(asked.all), np.int64), 0, 0
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            for x, y in pieces(offsets):
                _, terms, _, n = terms_of(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                docs, words = docs + int((n > 0).sum()), words + int(n.sum())
                if len(asked.all):
                    place = np.minimum(np.searchsorted(asked.all, terms), len(asked.all) - 1)
                    df += np.bincount(place[asked.all[place] == terms], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, words]))], ["term", "n"])

    found = rows.mapInArrow(tidy(each), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True))
    return got.get(-1, 0), got.get(-2, 0), np.array([got.get(i, 0) for i in range(len(asked.all))], np.int64)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, shard_postings: int = SHARD_POSTINGS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best rows of ``docs`` (doc_id, text) for each item (item_id, text), scores above 0
    only; equal scores by ascending doc_id, nulls last.

    Other columns are not looked at.  Null and empty texts have no terms: they are found by nothing, and find nothing.  Rows
    of one item_id (null too) are one item of all their terms; rows of one doc_id stay rows.  Empty tables give an
    empty one; texts of any length are taken whole."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary("text"))

    def search(asked: Queries) -> DataFrame:
        total, words, df = _counted(rows, asked)
        asked.weigh(total, df)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[int, bool, int]]] = [[] for _ in asked.ids]
            held: list[tuple[np.ndarray, ...]] = []

            def close() -> None:
                ids, none = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                order = np.lexsort((ids, none))  # the shard's document numbers ascend with doc_id
                number = np.empty(len(ids), np.int64)
                number[order] = np.arange(len(ids))
                doc = number[np.concatenate([h[2] for h in held])]
                m = doc_weights(np.concatenate([h[5] for h in held])[order], total, words)
                shard = Shard(len(ids), doc, np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), m)
                ids, none = ids[order], none[order]
                for i, (terms, weights) in enumerate(zip(asked.terms, asked.weights, strict=True)):
                    found = shard.best(terms, weights, k, max(1, -best[i][-1][0]) if len(best[i]) == k else 1)
                    if found:
                        best[i] = sorted(best[i] + [(-s, bool(none[d]), int(ids[d])) for s, d in found])[:k]
                held.clear()

            seen = postings = 0
            for b in batches:
                data, offsets = as_bytes(b.column(1))
                ids, none = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
                for x, y in pieces(offsets):
                    doc, terms, tf, n = terms_of(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                    held.append((ids[x:y], none[x:y], doc + seen, terms, tf, n))
                    seen, postings = seen + y - x, postings + len(doc)
                    if postings >= shard_postings or seen >= SHARD_DOCS:
                        close()
                        seen = postings = 0
            if held:
                close()
            out = [(i, None if none else d, -s) for i, mine in enumerate(best) for s, none, d in mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([asked.ids[i] for i, _, _ in out], pa.int64()), pa.array([d for _, d, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.int64())], ["item_id", "doc_id", "score"]
            )
            release()

        return rows.mapInArrow(tidy(each), "item_id long, doc_id long, score long")

    found = reduce(DataFrame.unionByName, [search(q) for q in queries(items, part_bytes)])
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
