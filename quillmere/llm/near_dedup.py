"""Near-duplicate removal with wide SimHash fingerprints, verified on the shingles themselves.

A text's fingerprint is built from its distinct shingles, as its similarity to others is, so how often a line repeats plays
no part.  Documents of word-shingle similarity 0.8 differ in about 39 of 256 SimHash bits, unrelated ones in 128.  At 39
errors a 16-bit word of the fingerprint is at most one bit off with probability 0.28, so one of the sixteen words is
with 0.995.  The vantage-point shards of :mod:`quillmere.llm.simhash` therefore meet nearly all such pairs: for each
word they deal the fingerprints out by Hamming distance, show each shard what lies just across its borders, and inside a
shard words at most one bit apart are looked up.  A pair within 64 bits is a candidate, in the
first word that shows it.  Fingerprints with candidates go to their shards once more, with their sets of shingles, and
there the similarity of all candidates is counted exactly, on 64-bit hashes of their shingles, but of those that confirmed pairs connect already; a shard
returns a forest of its confirmed pairs.  The components of these are the groups, and the document of the smallest id
stays.

The trees grow with the number of fingerprints until a leaf is a word with the words one bit from it.  A shard that gets more
than ``MOST_ROWS`` all the same is cut into blocks by a hash of the entries, and every pair of blocks is a shard of its own: its
work grows with the square of its rows, its memory does not.

Texts of the same set of shingles are one entry: copies cost nothing but their key.  Different texts of equal
fingerprints are candidates like others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, apply_decisions, as_binary, mix64, numbered, release, skew_join, stash, tidy, write_decisions
from .components import Forest, components
from .simhash import BITS, _dealt, shard_rows, shards, word_of

LANES = 4
#: Bits in which candidates may differ: similarity 0.8 stays within, by four standard deviations.
MOST_BITS = 64
#: Fingerprints in a shard, about, pairs that are looked at at a time, and pairs between two looks at what is connected.
SHARD_ROWS, PAIRS, CHUNK = 250_000, 500_000, 20_000
#: Rows that no shard exceeds.
MOST_ROWS = 500_000
_LANE_SEEDS = (np.arange(LANES, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))[None]


def shingles_of(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each distinct k-word shingle (of the whole text, if that is shorter), sorted; no words: none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, U64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]), ">u8").astype(U64))


def copy_key(shingles: np.ndarray) -> bytes:
    """The same for texts of the same set of shingles, and for no others."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """256 bits: a bit is 1 if it is set in over half of the shingles' hashes; no shingles: zero.

    A shingle has its hash and three mixes of that."""
    total = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(shingles), 4080):
        with np.errstate(over="ignore"):
            lanes = mix64(shingles[at : at + 4080, None] + _LANE_SEEDS)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1).view(np.uint64)  # eight counters a number, full after 255 rows
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(shingles)).tobytes()


def _prints(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u8").reshape(-1, LANES)


def near_pairs(prints: np.ndarray, own: np.ndarray, word: int, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places (i, j) of all pairs, one at least in ``own``, that are at most ``most`` bits apart in all and whose
    ``word`` is their first that is at most one bit apart: over all words and shards each pair comes once."""
    words = ((prints[:, word // 4] >> U64(BITS * (word % 4))) & U64(0xFFFF)).astype(np.uint16)
    order = np.argsort(words, kind="stable")
    sorted_, mine = words[order], np.flatnonzero(own)
    for mask in (0, *(1 << b for b in range(BITS))):
        wanted = words[mine] ^ np.uint16(mask)
        low, high = np.searchsorted(sorted_, wanted, "left"), np.searchsorted(sorted_, wanted, "right")
        count = high - low
        upto = np.cumsum(count)
        at = 0
        while at < len(mine):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            times = count[at:end]
            i = np.repeat(mine[at:end], times)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[at:end], times)]
            keep = ~own[j] | (j < i)
            i, j = i[keep], j[keep]
            differ = prints[i] ^ prints[j]
            keep = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most
            i, j, differ = i[keep], j[keep], differ[keep]
            keep = (np.bitwise_count(differ.astype("<u8").view("<u2")) <= 1).argmax(axis=1) == word
            if keep.any():
                yield i[keep], j[keep]
            at = end


def confirmed(prints: np.ndarray, own: np.ndarray, sets: list[bytes], word: int, similarity: float, most: int = MOST_BITS) -> np.ndarray:
    """Links (m x 2) of places, a forest that connects just what the shard's pairs of at least ``similarity`` connect.

    Every pair is measured on its sets, but those whose ends confirmed ones connect already."""
    sizes, forest = np.array([len(s) for s in sets]), Forest(len(sets))
    for i, j in near_pairs(prints, own, word, most):
        able = np.minimum(sizes[i], sizes[j]) >= (similarity - 1e-12) * np.maximum(sizes[i], sizes[j])  # no more is shared
        i, j = i[able], j[able]
        for at in range(0, len(i), CHUNK):
            roots = forest.roots()
            a, b = i[at : at + CHUNK], j[at : at + CHUNK]
            apart = roots[a] != roots[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                if forest.find(x) != forest.find(y) and resemblance(sets[x], sets[y]) >= similarity - 1e-12:
                    forest.join(x, y)
    roots = forest.roots()
    below = np.flatnonzero(roots != np.arange(len(roots)))
    return np.stack([below, roots[below]], axis=1)


def candidates(classes: DataFrame, most: int = MOST_BITS, rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(shard, word, id, fp, own): of ``classes`` (id long, fp binary) what has candidates in a shard, for each shard where it has."""
    levels = min(BITS, max(4, int(np.ceil(np.log2(max(classes.count(), 1) / rows)))))
    tree = shards(levels, 1)
    made = int(tree[0].max()) + 1
    # blocks of each shard: a pair of them has half of the bound each
    blocks = -(-2 * shard_rows(classes, 4 * LANES, tree) // most_rows)
    blocks[blocks <= 2] = 1
    wide = int(blocks.max(initial=1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, LANES)
            mixed = mix64(b.column(0).to_numpy().view(U64))
            for w in range(4 * LANES):
                at, shard, own = _dealt(word_of(prints, w), tree)
                n = blocks[w][shard]
                which = np.repeat(np.arange(len(at)), n)  # an entry meets each block, in the shard of the two
                other = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                mine = (mixed[at[which]] % n[which].astype(U64)).astype(np.int64)
                pair = np.minimum(mine, other) * wide + np.maximum(mine, other)
                key = (shard[which] + w * made) * (wide * wide) + pair
                take = pa.array(at[which])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(take), w, np.int32)), *(c.take(take) for c in b.columns), pa.array(own[which])], ["shard", "word", "id", "fp", "own"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        met = np.zeros(len(pdf), bool)
        for i, j in near_pairs(_prints(pdf["fp"]), pdf["own"].to_numpy(), int(pdf["word"].iloc[0]), most):
            met[i] = met[j] = True
        out = pdf[met]
        release()
        return out

    schema = "shard long, word int, id long, fp binary, own boolean"
    return classes.select("id", "fp").mapInArrow(tidy(deal), schema).groupBy("shard").applyInPandas(meet, schema)


def shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """(id, s): each text's distinct k-word shingles as sorted 64-bit hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(t, k).astype("<u8").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "s"])

    return rows.select("id", as_binary("text")).mapInArrow(tidy(each), "id long, s binary")


def resemblance(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def near_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, doc_id, group) of every row of ``docs`` (row, doc_id, text): group is the same for rows that chains of
    pairs of at least ``similarity`` connect, else the row's own.

    ``docs`` must be a stored table or one that comes out the same each time, ``row`` numbered by :func:`numbered`.  Null
    and wordless texts are copies of each other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(copy_key(s), wide_fingerprint(s)) for s in (shingles_of(t, k) for t in b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([m[c] for m in made], pa.binary()) for c in (0, 1))], ["row", "doc_id", "copy", "fp"])

    prints = stash(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), as_binary("text")).mapInArrow(tidy(each), "row long, doc_id long, copy binary, fp binary"), "fingerprints")
    first = F.min(F.struct("row", "doc_id"))
    classes = prints.groupBy("copy").agg(first.alias("first"), F.min("fp").alias("fp"), F.count("*").alias("n"))
    classes = stash(classes.select(F.col("first.row").alias("id"), "first.doc_id", "copy", "fp", "n"), "classes")
    met = stash(candidates(classes), "candidates")
    # a join would move all texts
    wanted = write_decisions(classes.join(met.select("id").distinct(), "id").select(F.col("id").alias("row"), "doc_id", F.lit(1).alias("n")))
    sets = stash(shingle_sets(apply_decisions(docs.select("row", F.col("row").alias("id"), "doc_id", "text"), "row", wanted, default=0), k), "sets")

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        found = confirmed(_prints(pdf["fp"]), pdf["own"].to_numpy(), pdf["s"].tolist(), int(pdf["word"].iloc[0]), similarity)
        return pd.DataFrame({"u": ids[found[:, 0]], "v": ids[found[:, 1]]})

    links = met.join(sets, "id").select("shard", "word", "id", "fp", "own", "s").groupBy("shard").applyInPandas(confirm, "u long, v long")
    roots = components(stash(links, "links")).withColumnRenamed("u", "id")
    placed = classes.join(roots, "id", "left").select("copy", "n", F.coalesce("root", "id").alias("group"))
    return skew_join(prints.select("row", "doc_id", "copy"), placed, "copy", "n", prints.count()).select("row", "doc_id", "group")


def one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group the row of the smallest doc_id stays
    (null ids last, then the row that is stored first)."""
    row = f"row_{uuid.uuid4().hex}"
    counted = numbered(docs, row)
    groups = stash(near_groups(counted.select(F.col(row).alias("row"), "doc_id", "text"), k, similarity), "groups")
    first = groups.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).where("n > 1")
    stays = first.select("group", F.col("first.row").alias("stays"), "n")
    gone = skew_join(groups, stays, "group", "n", groups.count()).where("row <> stays").select("row", "doc_id", F.lit(0).alias("n"))
    return apply_decisions(counted, row, write_decisions(gone), default=1)
