"""SimHash fingerprints and exact near-duplicate links by vantage-point trees.

Two 64-bit fingerprints at Hamming distance d <= k differ by at most k // 4 bits in one of their four 16-bit
words.  For each word a vantage-point tree splits the fingerprints into shards: a node sends what lies within
``mu`` bits of its vantage point inwards and the rest outwards, and the triangle bound says which fingerprints
near that border must also be shown to the shard across it.  Inside a shard the fingerprints are ordered by
their distance from one more vantage point, compared only within the bound of k, on all 64 bits.  So every
linked pair is met in at least one shard, and each shard returns no more links than it has fingerprints.

The trees grow with the number of fingerprints until a leaf is a word with the words one bit from it.  A shard that holds more
than ``most_rows`` all the same (a very frequent word, or a very large table) is dealt out again by the trees over each of the
other three words: one of these too must be within a bit.

Equal fingerprints count once, so groups of copies cost one entry; a dense group of different fingerprints is
first flooded from a member of its own, which takes each member against what the group has not reached yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_binary, release, skew_join, stash, tidy, unsalted
from .components import Forest, components

WORDS, BITS = 4, 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); no words: 0."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and 0x20 and 0x09-0x0D only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)  # digests are big-endian: bit 63 first
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp holds the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), U64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return unsalted(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), as_binary("text")).mapInArrow(tidy(each), "doc_id long, fp long")


def shards(levels: int, radius: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vantage-point tree over all 16-bit words, ``levels`` deep: for each word the shard that is its
    home, then the shards across a border that must see it too, as a flat list with offsets."""
    rng = np.random.default_rng(seed)
    home = np.zeros(1 << BITS, np.int64)
    guests: list[tuple[np.ndarray, int]] = []
    todo, made = [(np.arange(1 << BITS, dtype=np.uint16), np.zeros(0, np.uint16), levels)], 0
    while todo:
        own, over, left = todo.pop()
        if left == 0 or len(own) < 2:
            home[own] = made
            guests.append((over, made))
            made += 1
            continue
        point = own[rng.integers(len(own))]
        d, e = np.bitwise_count(own ^ point), np.bitwise_count(over ^ point)
        cut = int(np.median(d))
        if (d <= cut).all():
            cut -= 1
        inner = d <= cut
        cross = own[~inner & (d <= cut + radius)]
        todo.append((own[inner], np.concatenate([over[e <= cut + radius], cross]), left - 1))
        todo.append((own[~inner], over[e + radius > cut], left - 1))
    word = np.concatenate([g for g, _ in guests])
    shard = np.concatenate([np.full(len(g), s) for g, s in guests])
    order = np.argsort(word, kind="stable")
    return home, shard[order], np.searchsorted(word[order], np.arange((1 << BITS) + 1))


def flood(points: np.ndarray, seed: int, k: int, step: int = 64) -> np.ndarray:
    """True for all that a chain of distances <= k reaches from ``points[seed]``."""
    reached = np.zeros(len(points), bool)
    reached[seed] = True
    rest, front = np.flatnonzero(~reached), [seed]
    while front and len(rest):
        now, front = front[:step], front[step:]
        near = np.zeros(len(rest), bool)
        for p in points[now]:
            near |= np.bitwise_count(points[rest] ^ p) <= k
        new = rest[near]
        reached[new] = True
        rest = rest[~near]
        front += new.tolist()
    return reached


def near_links(own: np.ndarray, over: np.ndarray, k: int, step: int = 64) -> np.ndarray:
    """Links (m x 2) that connect all pairs at distance <= k of which one at least is in ``own``; at most one a point."""
    points, mine = np.concatenate([own, over]), np.arange(len(own) + len(over)) < len(own)
    found = []
    while len(points) > 8192:
        tries = np.random.default_rng(len(points)).integers(len(points), size=16)
        sizes = [int((np.bitwise_count(points ^ points[t]) <= k).sum()) for t in tries]
        if max(sizes) * 32 < len(points):
            break
        hub = int(tries[int(np.argmax(sizes))])
        reached = flood(points, hub, k)
        others = points[reached & (points != points[hub])]
        found.append(np.stack([others, np.full(len(others), points[hub])], axis=1))
        points, mine = points[~reached], mine[~reached]
    n = len(points)
    if n > 1:
        d = np.bitwise_count(points ^ points[0]).astype(np.int64)
        order = np.argsort(d, kind="stable")
        points, mine, d = points[order], mine[order], d[order]
        forest = Forest(n)
        rows = np.flatnonzero(mine)
        for at in range(0, len(rows), step):
            now = rows[at : at + step]
            low, high = np.searchsorted(d, [d[now[0]] - k, d[now[-1]] + k + 1])
            i, j = np.nonzero(np.bitwise_count(points[now][:, None] ^ points[None, low:high]) <= k)
            i, j = now[i], j + low
            keep = i != j
            if keep.any():
                roots = forest.roots()
                pairs = np.unique(np.stack([roots[i[keep]], roots[j[keep]]], axis=1), axis=0)
                for a, b in pairs.tolist():
                    forest.join(a, b)
        roots = forest.roots()
        below = np.flatnonzero(roots != np.arange(n))
        found.append(np.stack([points[below], points[roots[below]]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), U64)


def _dealt(words: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, shard, whether it is at home there) of 16-bit ``words``, for each shard that sees them."""
    home, guest, offsets = tree
    times = offsets[words + 1] - offsets[words]
    which = np.repeat(np.arange(len(words)), times)
    place = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + offsets[words][which]
    return np.concatenate([np.arange(len(words)), which]), np.concatenate([home[words], guest[place]]), np.arange(len(words) + len(which)) < len(words)


def word_of(prints: np.ndarray, w: int) -> np.ndarray:
    """The ``w``-th 16-bit word of each fingerprint, a row of 64-bit numbers."""
    return ((prints[:, w // 4] >> U64(BITS * (w % 4))) & U64(0xFFFF)).astype(np.int64)


def shard_rows(prints: DataFrame, words: int, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many rows each shard of each word gets (words x shards) of ``prints`` (fp long, or binary): from a count of every word, of
    which there are ``words`` times 65,536 at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = pa.types.is_int64(b.column(0).type)
            fp = b.column(0).to_numpy().view(U64)[:, None] if whole else np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8").reshape(b.num_rows, -1)
            value, n = np.unique(np.concatenate([word_of(fp, w) + (w << BITS) for w in range(words)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32)), pa.array(n)], ["word", "n"])

    found = prints.select("fp").mapInArrow(tidy(each), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((words, 1 << BITS), np.int64)
    count.reshape(-1)[found.column("word").to_numpy()] = found.column("n").to_numpy()
    del found
    release()
    home, guest, offsets = tree
    out = np.zeros((words, int(home.max()) + 1), np.int64)
    at = np.repeat(np.arange(1 << BITS), np.diff(offsets))
    for w in range(words):
        out[w] = np.bincount(home, count[w], out.shape[1]) + np.bincount(guest, count[w][at], out.shape[1])
    return out


def hamming_links(prints: DataFrame, k: int = 4, rows: int = 2000, most_rows: int = 500_000) -> DataFrame:
    """Links (u, v) that connect exactly the fingerprints that chains of distances <= ``k`` connect.

    ``prints`` (fp long) must hold each fingerprint once.  A shard has about ``rows`` rows as long as the trees can grow."""
    radius = k // WORDS
    n = prints.count()
    levels = max(0, min(BITS, int(np.ceil(np.log2(max(n, 1) / rows))) if radius < 3 else 0))
    tree = shards(levels, radius)
    made = int(tree[0].max()) + 1
    # the second deal among three words is exact while they too agree within the radius: (k - 0) // 3
    full = np.zeros((WORDS, made), bool)
    if n > most_rows and k // (WORDS - 1) < 3:
        full = shard_rows(prints, WORDS, tree) > most_rows
    again = shards(BITS, k // (WORDS - 1)) if full.any() else tree
    inner = int(again[0].max()) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(U64)
            for w in range(WORDS):
                at, shard, own = _dealt(word_of(fp[:, None], w), tree)
                deep = full[w][shard]
                yield _shard_batch(fp[at[~deep]], (shard[~deep] + w * made) * (WORDS * inner + 1), own[~deep])
                if deep.any():
                    for v in range(WORDS):
                        if v != w:
                            low, part, mine = _dealt(word_of(fp[at[deep]][:, None], v), again)
                            yield _shard_batch(fp[at[deep]][low], (shard[deep][low] + w * made) * (WORDS * inner + 1) + 1 + v * inner + part, mine)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own = pdf["fp"].to_numpy().view(U64), pdf["own"].to_numpy()
        found = near_links(np.sort(fp[own]), np.sort(fp[~own]), k).view(np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return prints.select("fp").mapInArrow(tidy(deal), "shard long, fp long, own boolean").groupBy("shard").applyInPandas(link, "u long, v long")


def _shard_batch(fp: np.ndarray, shard: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp.view(np.int64)), pa.array(own)], ["shard", "fp", "own"])


def simhash_components(docs: DataFrame, shingle: int = 4, k: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are not looked at).

    Null and empty texts have fingerprint zero and link like any other; a null doc_id gets its row too, and
    component_id is the smallest non-null doc_id of the component (null if there is none).  Repeated rows
    stay repeated; texts of any length are taken whole.  An empty table gives an empty one."""
    prints = stash(fingerprints(docs, shingle), "fingerprints")
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(hamming_links(classes, k))
    placed = stash(classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "placed")
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = skew_join(placed.select("fp", "n", "root"), whole, "root", "members", placed.count()).select("fp", "n", "component_id")
    return skew_join(prints, named, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")
