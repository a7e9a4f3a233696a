"""Top-k by blocks of postings: those that cannot reach the k-th best score are not read.

A posting's part of a BM25 score is idf * 2.2 / (1 + K1 ((1 - B) / tf + B / mean * length / tf)): it falls with 1 / tf and with
length / tf, whatever the corpus.  A block is a term's postings of one level of that, for a fixed mean; a directory
has for each block its size and the least of the two ratios, from which its greatest score follows for any mean.  A message that holds
all words of a question scores at most its block's greatest for one of them and the greatest of all blocks for the others.  So a first look
at each word's best blocks gives a k-th score, and only blocks whose bound reaches it are read for the answer, which is exact.

The index is stored by bucket of term and sorted by (term, level), so that a block is a run of rows of a file whose pages are
skipped by their statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import B, K1, best_per_conversation, bucket, query_terms

#: Levels of a score's part, and the mean length (in words) by which they are told apart.
LEVELS, MEAN = 64, 100.0
#: Postings of each word that a first look takes, times k.
FIRST = 20


def level(tf: Column, length: Column) -> Column:
    """The block of a posting: 0 has the least part of a score."""
    part = 1 / (1 + K1 * ((1 - B) / tf + B / MEAN * length / tf))
    return F.least(F.floor(part * LEVELS), F.lit(LEVELS - 1)).cast("int")


def directory(postings: DataFrame) -> DataFrame:
    """(bucket, term, level, n, by_tf, by_length) of the blocks of ``postings`` (bucket, term, tf, length, level)."""
    return postings.groupBy("bucket", "term", "level").agg(F.count("*").alias("n"), F.min(1 / F.col("tf")).alias("by_tf"), F.min(F.col("length") / F.col("tf")).alias("by_length"))


@dataclass
class Read:
    """What a search has read of the blocks of its words: (blocks, postings), and how many there are."""

    blocks: int = 0
    of_blocks: int = 0
    postings: int = 0
    of_postings: int = 0


def _asked(rows: DataFrame, levels: dict[str, Sequence[int]]) -> DataFrame:
    """The postings of some levels of each word: equalities on columns by which the index is stored and sorted."""
    each = [(F.col("bucket") == bucket(F.lit(t))) & (F.col("term") == t) & F.col("level").isin(list(ls)) for t, ls in levels.items()]
    return rows.where(reduce(lambda a, b: a | b, each, F.lit(False)))


def search_blocks(postings: DataFrame, blocks: DataFrame, n: int, mean: float, query: str, k: int = 10, key: Sequence[str] = ("conversation_id", "seq")) -> tuple[DataFrame, Read]:
    """The ``k`` best conversations for all words of ``query``, as :func:`~.search.indexed_search` finds them, and what was read.

    ``postings`` (bucket, term, key…, tf, length, level), their directory ``blocks``, and the number and mean length of all
    messages.  Fetched are the directory's rows of the query's words alone, some dozens a word."""
    terms, read = query_terms(query), Read()
    empty = postings.where(F.lit(False)).select(*key, F.lit(0.0).alias("score"))
    found: dict[str, dict[int, tuple[int, float, float]]] = {t: {} for t in terms}
    if not terms:
        return empty, read
    wanted = _asked(blocks, {t: range(LEVELS) for t in terms})
    for r in wanted.groupBy("term", "level").agg(F.sum("n").alias("n"), F.min("by_tf").alias("by_tf"), F.min("by_length").alias("by_length")).collect():
        found[r.term][r.level] = (r.n, r.by_tf, r.by_length)
    df = {t: sum(x[0] for x in b.values()) for t, b in found.items()}
    read.of_blocks, read.of_postings = sum(map(len, found.values())), sum(df.values())
    if not all(df.values()):
        return empty, read
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    bound = {t: {lv: idf[t] * (K1 + 1) / (1 + K1 * ((1 - B) * a + B / mean * c)) for lv, (_, a, c) in b.items()} for t, b in found.items()}
    most = {t: max(b.values()) for t, b in bound.items()}

    def answer(levels: dict[str, list[int]]) -> DataFrame:
        rows = _asked(postings, levels)
        weight = reduce(lambda w, t: w.when(F.col("term") == t, idf[t]), terms, F.when(F.lit(False), 0.0))
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
        scored = rows.groupBy(*key).agg(F.sum(part).alias("score"), F.count("*").alias("held")).where(F.col("held") == len(terms)).drop("held")
        return best_per_conversation(scored, k)

    least, look = -math.inf, FIRST * k
    while True:  # a wider look each time, until k conversations are found or all is read
        levels: dict[str, list[int]] = {}
        for t, b in found.items():
            levels[t], held = [], 0
            for lv in sorted(b, key=lambda x: -bound[t][x]):
                if held >= look:
                    break
                levels[t].append(lv)
                held += b[lv][0]
        whole = all(len(levels[t]) == len(b) for t, b in found.items())
        if whole:
            break
        first = answer(levels).collect()
        if len(first) == k:
            least = first[-1].score * (1 - 1e-9)
            break
        look *= 8
    if not whole:
        levels = {t: [lv for lv in b if bound[t][lv] + sum(most[u] for u in terms if u != t) >= least] for t, b in found.items()}
    read.blocks, read.postings = sum(map(len, levels.values())), sum(found[t][lv][0] for t, ls in levels.items() for lv in ls)
    return answer(levels), read
