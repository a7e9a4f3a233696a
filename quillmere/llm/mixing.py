"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size gives every document of it the same expected number of copies.  The
whole part is taken outright; the fraction is an inclusion probability.  The flight phase moves these
probabilities through the null space of two constraints, the number of documents and their words: of three
undecided documents with sizes a, b, c the direction (c - b, a - c, b - a) changes neither total, and the walk
along it stops when one of them reaches 0 or 1 (Deville and Tille, "Efficient balanced sampling: the cube
method", 2004).  Each bucket of a source flies by itself and leaves a dozen documents undecided at most; these
meet in a second flight of the source, and the dozen left there lands on the choice that misses the totals least.

Every choice comes from a hash of the document's id, so reruns agree however the rows are dealt out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apply_decisions, numbered, stash, write_decisions

#: Documents in a bucket of the first flight, about.
BUCKET = 2000
EPS = 1e-9
#: Undecided documents of a source that its last flight takes, at most.
LAST_FLIGHT = 20_000
#: Documents of a bucket that are left to the landing, besides the two that a flight leaves at most.
HELD = 10


def words(text: str) -> Column:
    """The number of words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Iterable[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs), one row a source.

    The sources in order (code points, null last) weigh ``weights``, repeating, and share the sum of all sizes;
    no target is above ``most`` times its source's size, and the excess is shared again by weight, until none is above:
    each round is one sum over the sources, of which there may be very many.  Their order comes from ranges, each
    numbered by itself after the number of sources in the ranges before."""
    weights = list(weights)
    ranged = stash(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("part").count().collect()):  # as many rows as ranges
        offsets.append((r.part, before))
        before += r["count"]
    offset = F.broadcast(sizes.sparkSession.createDataFrame(offsets, "part int, before long"))
    turn = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    found = stash(ranged.join(offset, "part").select("source", "source_size", "docs", weight.alias("weight"), cap.alias("cap")), "weights")
    total = found.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, capped = (total["size"] / total["weight"] if total["weight"] else 0.0), -1
    while True:
        is_capped = F.col("cap") <= F.col("weight") * F.lit(level)
        now = found.agg(F.count_if(is_capped).alias("n"), F.sum(F.when(is_capped, F.col("cap"))).alias("cap"), F.sum(F.when(~is_capped, F.col("weight"))).alias("weight")).first()
        if now["n"] == capped or not now["weight"]:
            break
        level, capped = (total["size"] - (now["cap"] or 0.0)) / now["weight"], now["n"]
    return found.select("source", "source_size", "docs", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def fly(size: np.ndarray, chance: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """The flight phase: the probabilities after it, all but two at most 0 or 1.

    The documents come in the order given; ``luck`` in [0, 1) decides each step's direction."""
    p = chance.astype(float).copy()
    held: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
            if u == (0.0, 0.0, 0.0):  # equal sizes: any direction of sum zero keeps both totals
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[j]) / w if w > 0 else p[j] / -w) for j, w in zip(held, u, strict=True) if w)
            down = min((p[j] / w if w > 0 else (1 - p[j]) / -w) for j, w in zip(held, u, strict=True) if w)
            step = up if luck[i] * (up + down) < down else -down
            for j, w in zip(held, u, strict=True):
                p[j] = min(1.0, max(0.0, p[j] + step * w))
                if p[j] < EPS:
                    p[j] = 0.0
                elif p[j] > 1 - EPS:
                    p[j] = 1.0
            held = [j for j in held if 0.0 < p[j] < 1.0]
    return p


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the few undecided ones: the choice whose words, and then number, miss the expected ones least."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    miss = np.abs(choices @ size[open_] - float((size[open_] * p[open_]).sum()))
    many = np.abs(choices.sum(axis=1) - float(p[open_].sum()))
    out = p.copy()
    out[open_] = choices[np.argmin(miss / max(1.0, float(size.mean())) + many / 50)]
    return out


def _flight(last: bool):
    """The flight of a bucket.  ``HELD`` documents spread over all sizes wait aside: small enough a number to land
    by trying all choices, of sizes various enough to meet the totals closely."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "luck", "row"], ascending=[False, True, True], kind="stable")
        size, luck = pdf["size"].to_numpy().astype(float), (pdf["luck"].to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
        p = pdf["p"].to_numpy().copy()
        open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        aside = np.unique(open_[np.linspace(0, len(open_) - 1, HELD).astype(int)]) if len(open_) else open_
        flying = np.setdiff1d(np.arange(len(p)), aside)
        p[flying] = fly(size[flying], p[flying], luck[flying])
        return pdf.assign(p=land(size, p) if last else p)

    return run


def mix(docs: DataFrame, weights: Iterable[float] = (1, 2, 3), most: float = 3.0, seed: int = 1) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) for each row of ``docs`` (row, doc_id, source, text).

    ``row`` tells rows apart that are otherwise equal; ``copies`` is how often the mix takes the row, 0 to
    ``most`` rounded up.  Texts of any length count whole.  Null text: size 0, taken or not by the same chances, at no cost in words.  A null
    source is a source, the last.  Null and repeated doc_ids are rows like others.  Empty table: empty."""
    sized = stash(
        docs.select("row", "doc_id", "source", words("text").alias("size")).withColumn("luck", F.xxhash64(F.lit(seed), "doc_id", "size")),
        "sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = targets(sums, weights, most).select(F.col("source").alias("goal_of"), "source_size", "docs", "target")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(F.col("ratio") + EPS)
    asked = sized.join(goals, F.col("source").eqNullSafe(F.col("goal_of"))).withColumn("ratio", ratio)
    asked = asked.withColumn("base", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - whole))
    # rows of one id share a bucket, so that nothing hangs on how rows are numbered, unless they would overfill it
    often = sized.groupBy("doc_id").count().where(F.col("count") > BUCKET).select(F.col("doc_id").alias("often"), F.lit(True).alias("hot"))
    asked = asked.join(often, F.col("doc_id").eqNullSafe(F.col("often")), "left")
    salt = F.when(F.col("hot"), F.col("row")).otherwise(0)
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", salt), F.ceil(F.col("docs") / BUCKET)))
    cols = ["row", "doc_id", "source", "size", "source_size", "target", "base", "luck", "p"]
    schema = "row long, doc_id long, source string, size long, source_size long, target double, base long, luck long, p double"
    first = _flight(last=False)
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    settled = []
    flown = stash(asked.groupBy("source", "bucket").applyInPandas(lambda pdf: first(pdf[cols]), schema), "flown")
    # a very large source leaves more than one flight can take: its undecided ones fly in buckets again
    while (left := flown.where(undecided).groupBy("source").count().agg(F.max("count")).first()[0] or 0) > LAST_FLIGHT:
        settled.append(flown.where(~undecided))
        bucket = F.pmod(F.xxhash64(F.lit(seed + 2 + len(settled)), "doc_id", "row"), F.lit(-(-left // BUCKET)))
        flown = stash(flown.where(undecided).withColumn("bucket", bucket).groupBy("source", "bucket").applyInPandas(lambda pdf: first(pdf[cols]), schema), "flown")
    landed = flown.where(undecided).groupBy("source").applyInPandas(_flight(last=True), schema)
    return (
        reduce(DataFrame.unionByName, [*settled, flown.where(~undecided), landed])
        .select("row", "doc_id", "source", "size", "source_size", "target", (F.col("base") + F.round("p")).cast("long").alias("copies"))
    )


def mixed(docs: DataFrame, weights: Iterable[float] = (1, 2, 3), most: float = 3.0, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    ``docs`` must be a stored table or one that comes out the same each time."""
    row = f"row_{uuid.uuid4().hex}"
    counted = numbered(docs, row)
    taken = mix(counted.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), weights, most, seed)
    return apply_decisions(counted, row, write_decisions(taken.where("copies > 0").select("row", "doc_id", F.col("copies").alias("n"))), default=0)
