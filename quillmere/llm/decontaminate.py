"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so resemblance is useless and containment is asked for: the share of
an item's distinct five-word shingles that a document holds.  Items are partitioned by their number of shingles
(powers of two), and each is kept as the bottom ``m`` of its shingle hashes, where m = n - ceil(t n) + 1 for the
partition's largest n.  A document with t of an item's shingles lacks fewer than m of them, so it holds at least
one of any m: probing every shingle of a document against the bottom-m sketches loses no document.  What is hit is
verified by counting exactly the shingles, as text, that item and document share.

An item of fewer words than a shingle has is one shingle of its own length, looked for among the documents' shingles of that
length: it is found inside any longer text.

A word is a run of ASCII letters and digits and of characters beyond ASCII in the lower-cased text, so case and
punctuation make no difference.  The benchmark reaches the executors in parts of bounded size, each with a pass of
its own over the documents; one part is the rule.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, U64, as_bytes, pieces, shingle_hashes, tidy, word_hashes, word_spans

#: Bytes of item texts that one pass may broadcast.
PART_BYTES = 8 << 20
FILTER_BITS = 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(data, offsets, PUNCT)


def texts_of(data: bytes, k: int) -> set[bytes]:
    """The distinct k-word shingles of a lower-cased text, the whole sequence if it is shorter."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends, _ = _words(raw, np.array([0, len(raw)]))
    words = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


class Sketches:
    """The sketches of the items whose shingles have ``k`` words."""

    def __init__(self, owners: list[int], texts: list[bytes], similarity: float, k: int) -> None:
        self.k = k
        data, offsets = as_bytes(pa.array(texts, pa.large_binary()))
        starts, ends, firsts = _words(data, offsets)
        hashes, at = shingle_hashes(word_hashes(data, starts, ends), firsts, k)
        values, whose = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for n, i in enumerate(owners):
            mine = np.unique(hashes[at[n] : at[n + 1]])
            largest = (1 << int(len(mine)).bit_length()) - 1  # of the item's size partition
            m = largest - int(np.ceil(similarity * largest - 1e-9)) + 1
            values.append(mine[:m])
            whose.append(np.full(min(m, len(mine)), i))
        value, owner = np.concatenate(values), np.concatenate(whose)
        order = np.argsort(value, kind="stable")
        self.values, first = np.unique(value[order], return_index=True)
        self.owners, self.at = owner[order], np.append(first, len(value))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.values & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray, firsts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs with a sketched shingle in common, by position."""
        hashes, at = shingle_hashes(words, firsts, self.k)
        near = np.flatnonzero(self.maybe[(hashes & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.values, hashes[near]), len(self.values) - 1)
        hit = self.values[place] == hashes[near]
        docs = np.searchsorted(at, near[hit], "right") - 1
        pairs = np.unique(np.stack([docs, place[hit]], axis=1), axis=0)
        return {(d, int(i)) for d, v in pairs.tolist() for i in self.owners[self.at[v] : self.at[v + 1]]}


class Finder:
    """Items as sketches, and the documents' search among them."""

    def __init__(self, ids: list[int | None], texts: list[bytes], similarity: float, k: int) -> None:
        self.ids, self.similarity = ids, similarity
        self.sizes = [min(k, len(_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])) for t in texts]  # words a shingle
        self.shingles = [texts_of(t, n) for t, n in zip(texts, self.sizes, strict=True)]
        self.sketches = []
        for n in sorted(set(self.sizes) - {0}):
            mine = [i for i, size in enumerate(self.sizes) if size == n]
            self.sketches.append(Sketches(mine, [texts[i] for i in mine], similarity, n))

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        if not self.sketches:
            return set()
        starts, ends, firsts = _words(data, offsets)
        words = word_hashes(data, starts, ends)
        return set().union(*(s.candidates(words, firsts) for s in self.sketches))

    def find(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(document, item, shingles shared) of every document that holds enough of an item, by position."""
        data, offsets = as_bytes(texts)
        out = []
        for a, b in pieces(offsets):
            part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            held: dict[tuple[int, int], set[bytes]] = {}
            for d, i in sorted(self.candidates(part, local)):
                key = d, self.sizes[i]
                if key not in held:
                    held = {x: s for x, s in held.items() if x[0] == d} | {key: texts_of(part[local[d] : local[d + 1]].tobytes(), self.sizes[i])}
                shared = len(self.shingles[i] & held[key])
                if shared >= self.similarity * len(self.shingles[i]) - 1e-9:
                    out.append((a + d, i, shared))
        return out


def finders(items: DataFrame, similarity: float, k: int, part_bytes: int = PART_BYTES) -> Iterator[Finder]:
    """The items (item_id, text) in parts of about ``part_bytes``; null and empty texts have no shingles."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    for i in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, bytes(r.text)))
        yield Finder([r.item_id for r in rows], [bytes(r.text) for r in rows], similarity, k)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of all pairs whose containment is ``similarity`` or more.

    Rows repeat where rows of either table do.  Null ids stay null; null and empty texts hold nothing and are in
    nothing; an item of fewer than k words is held by every document in which these words follow each other.  Empty tables
    give an empty one; texts of any length are taken whole."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").cast("binary").alias("text"))

    def search(finder: Finder) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if found := finder.find(b.column(1)):
                    d, i, shared = (list(x) for x in zip(*found, strict=True))
                    sizes = [len(finder.shingles[x]) for x in i]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(d)), pa.array([finder.ids[x] for x in i], pa.int64()), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(shared) / np.array(sizes))],
                        ["doc_id", "item_id", "shared", "item_shingles", "containment"],
                    )

        return rows.mapInArrow(tidy(each), "doc_id long, item_id long, shared long, item_shingles long, containment double")

    return reduce(DataFrame.unionByName, [search(f) for f in finders(items, similarity, k)])


def without_contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, k: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that hold ``similarity`` of no item; null and empty texts stay."""
    schema, lower = docs.schema, f"lower_{uuid.uuid4().hex}"
    for finder in finders(items, similarity, k):

        def each(batches: Iterator[pa.RecordBatch], finder: Finder = finder) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, _, _ in finder.find(b.column(b.num_columns - 1))]] = False
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(keep))

        docs = docs.withColumn(lower, F.lower("text").cast("binary")).mapInArrow(tidy(each), schema)
    return docs
