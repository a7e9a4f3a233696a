"""Retrieval: keyword (BM25), semantic (cosine), hybrid (rank fusion), filters, facets, federation.

Corpora are DataFrames (conversation_id, seq, content, …).  Filters are applied before any ranking, so that they
reach the scan; ranks are top-k plans (``TakeOrderedAndProject`` and window group limits); what is shown of a hit is
joined on after the ranking, for k rows only.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vector as V

K1, B = 1.2, 0.75
RRF_K = 60
FLOOR = 0.15
#: Seconds that a device has to answer.
DEVICE_SECONDS = 1.5


@dataclass(frozen=True)
class Filters:
    """Conditions on conversations; unset ones hold for all."""

    tool: str | None = None
    kind: str | None = None
    project: str | None = None
    since: str | None = None
    until: str | None = None
    tag: str | None = None

    def of_sessions(self) -> Filters:
        """The same without kind and tag, which metrics do not look at."""
        return replace(self, kind=None, tag=None)

    def condition(self) -> Column:
        """Days are compared inclusively on the date; a missing date fails them; a project is a substring."""
        day = F.date_format("started_at", "yyyy-MM-dd")
        parts = [
            *([F.col("tool") == self.tool] if self.tool else []),
            *([F.col("kind") == self.kind] if self.kind else []),
            *([F.contains(F.col("project"), F.lit(self.project))] if self.project else []),
            *([F.coalesce(day >= self.since, F.lit(False))] if self.since else []),
            *([F.coalesce(day <= self.until, F.lit(False))] if self.until else []),
            *([F.array_contains(F.coalesce(F.col("tags"), F.array().cast("array<string>")), self.tag.strip().lower())] if self.tag else []),
        ]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def query_terms(query: str) -> list[str]:
    """Distinct lower-case runs of letters and digits."""
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def postings(messages: DataFrame, key: Sequence[str] = ("conversation_id", "seq"), content: str = "content") -> DataFrame:
    """The inverted index: (term, key…, tf, length).  Written by term, a query reads its terms' rows alone."""
    rows = messages.select(*key, F.array_sort(T.tokens(content)).alias("words")).withColumn("length", F.size("words"))
    # a message's counts are known within its row: the words in order, each with the place of its first, less that of the next word's
    ends = F.transform("words", lambda w, i: F.when((i == 0) | (w != F.get("words", i - 1)), F.struct(w.alias("term"), (i + 1).cast("long").alias("first"))))
    rows = rows.withColumn("ends", F.filter(ends, lambda e: e.isNotNull())).withColumn("firsts", F.concat(F.transform("ends", lambda e: e["first"]), F.array((F.col("length") + 1).cast("long"))))
    counted = F.transform("ends", lambda e, i: F.struct(e["term"].alias("term"), (F.get("firsts", i + 1) - e["first"]).alias("tf")))
    return rows.select(*key, "length", F.inline(counted)).select("term", *key, "tf", "length")


#: Buckets of terms in a stored index: a query reads those of its own terms.
BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def federated_search(
    devices: dict[str, Callable[[], DataFrame]], k: int = 10, wanted: Sequence[str] | None = None, seconds: float = DEVICE_SECONDS, own: str | None = None
) -> tuple[DataFrame | None, list[str]]:
    """Hits of several devices fused by rank, and the names of those that did not answer.

    ``devices``: for each name a function that searches that device's store; ``wanted``: ask only these.  All are asked at once, each
    under a job tag of its own, and have ``seconds`` to answer.  One that raises or is late is left out and named, and what it still
    runs is cancelled: the search takes as long as the slowest that answers in time.  The ``own`` device has all the time it
    needs.  The hits are few and fetched by the device's
    own thread, so that a device fails there and not later."""
    asked = {name: ask for name, ask in devices.items() if wanted is None or name in wanted}
    context = SparkSession.active().sparkContext
    tags = {name: f"device-{uuid.uuid4().hex}" for name in asked}
    answers: dict[str, tuple[list, StructType]] = {}

    def fetch(name: str, late: threading.Event) -> None:
        context.addJobTag(tags[name])
        context.setInterruptOnCancel(True)
        try:
            hits = asked[name]()
            if not late.is_set():
                got = hits.limit(max(5 * k, 20)).collect(), hits.schema
                if not late.is_set():
                    answers[name] = got
        except Exception:  # noqa: BLE001, S110  a device must not end the search of the others
            pass
        finally:
            context.removeJobTag(tags[name])

    lates = {name: threading.Event() for name in asked}
    threads = {name: InheritableThread(target=fetch, args=(name, lates[name]), daemon=True) for name in asked}
    until = time.monotonic() + seconds
    for t in threads.values():
        t.start()
    for name, t in threads.items():
        t.join(None if name == own else max(0.0, until - time.monotonic()))
        if t.is_alive():
            lates[name].set()
            context.cancelJobsWithTag(tags[name])
    session = SparkSession.active()
    lists = [(name, session.createDataFrame(*answers[name])) for name in asked if name in answers and not lates[name].is_set()]
    there = {name for name, _ in lists}
    return (federated(lists, k) if lists else None), [name for name in asked if name not in there]


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def bm25(messages: DataFrame, query: str, key: Sequence[str] = ("conversation_id", "seq"), content: str = "content") -> DataFrame:
    """(key…, score) of the messages that hold every query term; higher is better; no terms: no rows.

    One scan: document frequencies and mean length come from the same pass as the term counts, by counting the query's
    few terms in each message, so nothing is exploded that the query does not name."""
    terms = query_terms(query)
    words = T.tokens(F.coalesce(F.col(content), F.lit("")))
    rows = messages.select(*key, words.alias("words")).withColumn("length", F.size("words"))
    rows = rows.select(*key, "length", *[_times("words", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    if not terms:
        return rows.where(F.lit(False)).select(*key, F.lit(0.0).alias("score"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    part = [
        F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        for i in range(len(terms))
    ]
    return rows.where(hit).join(F.broadcast(stats)).select(*key, reduce(lambda a, b: a + b, part).alias("score"))  # stats is one row


def bm25_from_postings(index: DataFrame, sizes: DataFrame, query: str, key: Sequence[str] = ("conversation_id", "seq")) -> DataFrame:
    """As :func:`bm25`, from a stored inverted index (term, key…, tf, length, bucket) and the lengths (key…, length) of all messages.

    Only the buckets of the query's terms are read."""
    terms = query_terms(query)
    asked = [F.col("bucket") == bucket(F.lit(t)) for t in terms]
    rows = index.where(F.col("term").isin(terms) & reduce(lambda a, b: a | b, asked, F.lit(False)))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    rows = rows.join(F.broadcast(df), "term").join(F.broadcast(stats))  # a row a query term, and one row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy(*key).agg(F.sum(part).alias("score"), F.count("*").alias("held")).where(F.col("held") == len(terms)).drop("held")


def best_per_conversation(hits: DataFrame, k: int) -> DataFrame:
    """The best message of each conversation, then the best ``k`` conversations; ties to the smaller id and seq."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("score"), "seq")
    first = hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.orderBy(F.desc("score"), "conversation_id").limit(k)


def keyword_search(messages: DataFrame, query: str, k: int = 10, filters: Filters | None = None) -> DataFrame:
    rows = messages.where(filters.condition()) if filters else messages
    return best_per_conversation(bm25(rows, query), k)


def indexed_search(index: DataFrame, sizes: DataFrame, query: str, k: int = 10, conversations: DataFrame | None = None) -> DataFrame:
    """As :func:`keyword_search`, from the stored index, over the messages of ``conversations`` (conversation_id) if given."""
    if conversations is not None:
        wanted = conversations.select("conversation_id")
        index, sizes = index.join(wanted, "conversation_id", "left_semi"), sizes.join(wanted, "conversation_id", "left_semi")
    return best_per_conversation(bm25_from_postings(index, sizes, query), k)


def semantic_search(vectors: DataFrame, query: Sequence[float], k: int = 10, floor: float = FLOOR, filters: Filters | None = None) -> DataFrame:
    """Best message of each conversation by cosine with the query, ``floor`` or more; ``vectors`` (conversation_id, seq, embedding)."""
    rows = vectors.where(filters.condition()) if filters else vectors
    literal = F.array(*[F.lit(float(x)) for x in query])
    same = F.size("embedding") == len(query)
    wrong = F.raise_error(F.concat(F.lit(f"the query has {len(query)} dimensions, a stored vector has "), F.size("embedding").cast("string"))).cast("double")
    scored = rows.withColumn("score", F.when(same | F.col("embedding").isNull(), V.cosine(F.col("embedding"), literal)).otherwise(wrong)).where(F.col("score") >= floor)
    return best_per_conversation(scored.select("conversation_id", "seq", "score"), k)


def ranked(hits: DataFrame, base: int = 0) -> DataFrame:
    """Hits with their rank in the list, from ``base``; hits are few."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "conversation_id")) - 1 + base)


def rrf(lists: Sequence[DataFrame], k: int = 10, constant: int = RRF_K, base: int = 0) -> DataFrame:
    """Reciprocal-rank fusion: (conversation_id, seq, score); the representative is the earliest list's."""
    parts = [ranked(x, base).select("conversation_id", "seq", (1 / (F.lit(constant) + F.col("rank"))).alias("part"), F.lit(i).alias("list")) for i, x in enumerate(lists)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("conversation_id").agg(F.sum("part").alias("score"), F.min_by("seq", "list").alias("seq"))
    return fused.orderBy(F.desc("score"), "conversation_id").limit(k).select("conversation_id", "seq", "score")


def hybrid_search(messages: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], k: int = 10, filters: Filters | None = None) -> DataFrame:
    depth = max(5 * k, 20)
    return rrf([keyword_search(messages, query, depth, filters), semantic_search(vectors, vector, depth, filters=filters)], k)


def federated(lists: Sequence[tuple[str, DataFrame]], k: int = 10) -> DataFrame:
    """Hits of several devices fused by rank, from 1; a conversation's device is the first list's that has it."""
    parts = [ranked(x, 1).select("conversation_id", "seq", (1 / (F.lit(RRF_K) + F.col("rank"))).alias("part"), F.lit(i).alias("list"), F.lit(d).alias("device")) for i, (d, x) in enumerate(lists)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("conversation_id").agg(F.sum("part").alias("score"), F.min_by(F.struct("seq", "device"), "list").alias("first"))
    return fused.orderBy(F.desc("score"), "conversation_id").limit(k).select("conversation_id", F.col("first.seq").alias("seq"), F.col("first.device").alias("device"), "score")


def hydrate(hits: DataFrame, messages: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The hits with their content and metadata, best first.  Hits are few, which the planner finds out for itself."""
    out = messages.join(hits, ["conversation_id", "seq"])
    if conversations is not None:
        out = conversations.join(out, "conversation_id")
    return out.orderBy(F.desc("score"), "conversation_id")


def snippet(content: Column | str, query: str, width: int = 12, start: str = "\u0002", end: str = "\u0003") -> Column:
    """The ``width`` words that hold most different words of the query, the first of equals, hits marked, an ellipsis where words are left out.

    A window that cannot start earlier without losing a word ends with a hit, so one for each hit is looked at, and the first words.
    The words that a window holds are counted by the places of the hits in it."""
    words = F.split(F.trim(F.regexp_replace(F.col(content) if isinstance(content, str) else content, r"\s+", " ")), " ")
    asked = query_terms(query)
    held = lambda w: F.split(F.lower(w), r"[^\p{L}\p{N}]+")
    # (place, which of the query's words stand there), of the words that are hits
    hits = F.filter(F.transform(words, lambda w, i: F.struct((i + 1).alias("at"), F.array_intersect(held(w), F.array(*[F.lit(t) for t in asked])).alias("of"))), lambda h: F.size(h["of"]) > 0)

    def pick(h: Column) -> Column:
        starts = F.array_distinct(F.concat(F.array(F.lit(1)), F.transform(h, lambda x: F.greatest(F.lit(1), x["at"] - width + 1))))
        different = lambda s: F.size(F.array_distinct(F.flatten(F.transform(F.filter(h, lambda x: (x["at"] >= s) & (x["at"] < s + width)), lambda x: x["of"]))))
        return F.array_min(F.transform(starts, lambda s: F.struct((-different(s)).alias("n"), s.alias("s"))))["s"]

    # bound once: a lambda's argument is computed once, a repeated expression may not be
    first = F.element_at(F.transform(F.array(hits), pick), 1) if asked else F.lit(1)
    is_hit = lambda w: F.arrays_overlap(held(w), F.array(*[F.lit(t) for t in asked])) if asked else F.lit(False)

    def shown(at: Column) -> Column:
        marked = F.transform(F.slice(words, at, width), lambda w: F.when(is_hit(w), F.concat(F.lit(start), w, F.lit(end))).otherwise(w))
        return F.concat(F.when(at > 1, "…").otherwise(""), F.concat_ws(" ", marked), F.when(at + width <= F.size(words), "…").otherwise(""))

    return F.element_at(F.transform(F.array(first), shown), 1)


def served(conversations: DataFrame, tools: Sequence[str] = (), projects: Sequence[str] = ()) -> DataFrame:
    """What a peer may see: neither these tools nor projects that contain these strings."""
    hidden = reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.col("project"), F.lit("")), F.lit(p)) for p in projects], F.coalesce(F.col("tool"), F.lit("")).isin(list(tools)) if tools else F.lit(False))
    return conversations.where(~hidden)
