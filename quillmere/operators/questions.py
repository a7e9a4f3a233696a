"""Many questions at once: a table of questions against a whole corpus, each with its own best hits and its own context.

Messages are dealt to shards, in which the words of all questions are looked up, and a shard sends its best hits a question; vectors of questions go to the executors in parts of
bounded size, and each task sends its best hits a question.  All ranks are windows a question, which keep the best of each
task before anything is shuffled; contexts are packed by a fold in the plan, nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..store import cut
from .search import B, FLOOR, K1, RRF_K

#: Words of the messages in a shard, about, and candidates that are looked at at a time.
SHARD_WORDS, CANDIDATES = 1 << 20, 1 << 19
#: Bytes of question vectors that one pass sends to the executors.
PART_BYTES = 8 << 20
#: Scores that a task has at a time, whatever the number of questions.
BLOCK = 1 << 20


def _best(scored: DataFrame, k: int) -> DataFrame:
    """(question_id, conversation_id, seq, score, rank): each question's ``k`` best conversations by their best message; ties to the smaller id and seq."""
    one = Window.partitionBy("question_id", "conversation_id").orderBy(F.desc("score"), "seq")
    first = scored.withColumn("rn", F.row_number().over(one)).where("rn = 1").drop("rn")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "conversation_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sharing(postings: pa.Table, asked: pa.Table, mean: float, k: int, most: int = CANDIDATES) -> pa.Table:
    """(words_id, conversation_id, seq, score): for each of ``asked`` (words_id, words, weights) its ``k`` best conversations among
    ``postings``, the whole messages of a shard.

    The rarest of the words gives the candidates, the others are looked up in these, ``most`` candidates at a time or those of one entry."""
    postings = postings.sort_by([("conversation_id", "ascending"), ("seq", "ascending")]).combine_chunks()
    words = asked.column("words").combine_chunks()
    n, lists = len(postings), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if not n or not len(asked):
        return _hits(postings, asked, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    new_conversation, new_message = np.zeros(n, bool), np.zeros(n, bool)
    for column, at in (("conversation_id", new_conversation), ("seq", new_message)):
        codes = pa.compute.dictionary_encode(postings.column(column).combine_chunks()).indices.to_numpy(zero_copy_only=False)
        at[1:] = codes[1:] != codes[:-1]
    conversation, message = np.cumsum(new_conversation), np.cumsum(new_conversation | new_message)
    terms = pa.compute.dictionary_encode(postings.column("term").combine_chunks())
    term, known = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
    tf, length = (postings.column(c).to_numpy().astype(np.float64) for c in ("tf", "length"))
    below = tf + K1 * (1 - B + B * length / mean)
    order = np.argsort(message * known + term, kind="stable")
    keys = (message * known + term)[order]
    by_term = np.argsort(term, kind="stable")  # the postings of a word, in order of their messages
    df = np.bincount(term, minlength=known)
    firsts = np.cumsum(df) - df
    # (entry, place of the word) as a matrix, -1 where there is none and -2 for a word that the shard does not have
    codes = pa.compute.index_in(words.flatten(), value_set=terms.dictionary).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64)
    entry, place = np.repeat(np.arange(len(lists)), lists), np.arange(lists.sum()) - np.repeat(np.cumsum(lists) - lists, lists)
    of, weights = np.full((len(lists), lists.max()), -1, np.int64), np.zeros((len(lists), lists.max()))
    of[entry, place], weights[entry, place] = codes, asked.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    live = np.flatnonzero((lists > 0) & (of != -2).all(axis=1))
    times = np.where(of[live] >= 0, df[of[live]], n + 1)
    rarest, count = of[live, times.argmin(axis=1)], times.min(axis=1)
    upto, at, found = np.cumsum(count), 0, []
    while at < len(live):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        c = np.repeat(np.arange(at, end), count[at:end])
        row = by_term[np.arange(len(c)) - np.repeat(np.cumsum(count[at:end]) - count[at:end], count[at:end]) + firsts[rarest[c]]]
        score = np.zeros(len(c))
        for j in range(of.shape[1]):  # in the order of the words, so that equal messages score the same
            wanted = of[live[c], j]
            key = message[row] * known + wanted
            there = order[np.minimum(np.searchsorted(keys, key), n - 1)]
            held = (wanted < 0) | ((message[there] == message[row]) & (term[there] == wanted))
            score = score + np.where(wanted < 0, 0.0, weights[live[c], j] * tf[there] * (K1 + 1) / below[there])
            c, row, score = c[held], row[held], score[held]
        if len(c):
            # an entry's messages are in order, so those of a conversation are neighbours
            first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (conversation[row[1:]] != conversation[row[:-1]])))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
            top = np.flatnonzero(score == np.maximum.reduceat(score, first)[group])
            top = top[np.append(True, group[top[1:]] != group[top[:-1]])]
            top = top[np.lexsort((top, -score[top], c[top]))]
            start = np.flatnonzero(np.append(True, c[top[1:]] != c[top[:-1]]))
            rank = np.arange(len(top)) - np.repeat(start, np.diff(np.append(start, len(top))))
            top = top[rank < k]
            found.append((live[c[top]], row[top], score[top]))
        at = end
    return _hits(postings, asked, *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)))


def _hits(postings: pa.Table, asked: pa.Table, entry: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.Table:
    at, of = pa.array(row, pa.int64()), pa.array(entry, pa.int64())
    return pa.table({"words_id": asked.column("words_id").take(of), "conversation_id": postings.column("conversation_id").take(at), "seq": postings.column("seq").take(at), "score": pa.array(score, pa.float64())})


def keyword_hits(postings: DataFrame, sizes: DataFrame, questions: DataFrame, k: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best conversations by BM25 that hold all words of a question; ``questions`` (question_id, text), none twice.

    ``postings`` (term, conversation_id, seq, tf, length), ``sizes`` (conversation_id, seq, length) of all messages.  A question
    without words has no hits.  Questions of the same words are one.  Messages are dealt to shards of about ``shard_words`` words,
    each of which meets every question: what is shuffled is the postings and each shard's best hits, never all messages that a
    word is in once for each question that asks for it."""
    words = F.array_sort(F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))))
    asked = cut(questions.select("question_id", words.alias("words")).where(F.size("words") > 0))
    each = asked.groupBy("words").agg(F.min("question_id").alias("words_id"))
    terms = each.select("words_id", F.size("words").alias("wanted"), F.posexplode("words").alias("place", "term"))
    rows = postings.join(terms.select("term").distinct(), "term", "left_semi").select("term", "conversation_id", "seq", "tf", "length")
    n, mean, total = sizes.agg(F.count("*"), F.avg("length"), F.sum("length")).first()
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(df, "term").groupBy("words_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", weight.alias("weight")))).alias("ws"), F.first("wanted").alias("wanted"))
    weighed = cut(weighed.where(F.size("ws") == F.col("wanted")).select("words_id", F.col("ws.term").alias("words"), F.col("ws.weight").alias("weights")))
    shards = max(1, -(-int(total or 0) // shard_words))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("conversation_id", "seq"), F.lit(shards)))
    sent = weighed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    types = {f.name: f.dataType.simpleString() for f in [*weighed.schema.fields, *rows.schema.fields]}

    def meet(mine: pa.Table, asked: pa.Table) -> pa.Table:
        return _sharing(mine, asked, mean, k)

    met = dealt.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(meet, f"words_id {types['words_id']}, conversation_id {types['conversation_id']}, seq {types['seq']}, score double")
    best = _best(met.withColumnRenamed("words_id", "question_id"), k).withColumnRenamed("question_id", "words_id")
    return asked.join(each, "words").join(best, "words_id").select("question_id", "conversation_id", "seq", "score", "rank")


def semantic_hits(vectors: DataFrame, questions: DataFrame, k: int = 10, floor: float = FLOOR, part_bytes: int = PART_BYTES, block: int = BLOCK) -> DataFrame:
    """The best conversations by cosine, ``floor`` or more; ``questions`` (question_id, embedding), ``vectors`` (conversation_id, seq, embedding).

    A vector that is null, zero or of another length than the questions' raises or scores nothing, as in a search for one question.
    All questions meet all vectors; a task has the scores of ``block`` pairs at a time."""
    questions = questions.where("embedding IS NOT NULL").select("question_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = vectors.where("embedding IS NOT NULL").select("conversation_id", "seq", F.col("embedding").cast("array<double>").alias("embedding"))
    size = questions.agg(F.sum(8 * F.size("embedding"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    types = {f.name: f.dataType.simpleString() for f in [*questions.schema.fields, *rows.schema.fields]}
    schema = f"question_id {types['question_id']}, conversation_id {types['conversation_id']}, seq {types['seq']}, score double"

    def search(asked: pa.Table) -> DataFrame:
        ids = asked.column("question_id").combine_chunks()
        matrix = _matrix(asked.column("embedding").combine_chunks())

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                order = pa.compute.sort_indices(pa.table({"c": b.column(0), "s": b.column(1)}), [("c", "ascending"), ("s", "ascending")]).to_numpy()
                conversation = b.column(0).take(pa.array(order)).dictionary_encode().indices.to_numpy()
                first = np.flatnonzero(np.concatenate([[True], conversation[1:] != conversation[:-1]]))
                ends = np.append(first[1:], len(order))
                held = _matrix(b.column(2), matrix.shape[1])[order]
                few = max(1, block // len(order))
                for low in range(0, len(ids), few):
                    # to twelve places: equal vectors are equal, wherever they stand
                    scores = np.round(matrix[low : low + few] @ held.T, 12)
                    best = np.maximum.reduceat(scores, first, axis=1)
                    asker, at = [], []
                    for q in range(len(scores)):
                        good = np.flatnonzero(best[q] >= floor)
                        # the k best conversations of this batch, with their first message of that score
                        if len(good) > k:
                            good = good[best[q][good] >= np.partition(best[q][good], len(good) - k)[len(good) - k]]
                        good = good[np.lexsort((good, -best[q][good]))][:k]
                        at += [int(first[g] + np.argmax(scores[q, first[g] : ends[g]])) for g in good]
                        asker += [q] * len(good)
                    if at:
                        take = pa.array(order[at])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(asker) + low)), b.column(0).take(take), b.column(1).take(take), pa.array(scores[asker, at])], ["question_id", "conversation_id", "seq", "score"])

        return rows.mapInArrow(each, schema)

    found = [search(questions.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == i).toArrow()) for i in range(parts)]
    return _best(reduce(DataFrame.unionByName, found), k)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a column as rows of length 1; a zero vector stays zero."""
    lengths = {x for x in column.value_lengths().unique().to_pylist() if x is not None}
    if len(lengths) > 1 or (width is not None and lengths - {width}):
        raise ValueError(f"vectors of {sorted(lengths)} dimensions, {width or 'one number'} asked for")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if lengths else np.zeros((0, width or 0))
    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def fused(lists: Sequence[DataFrame], k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion a question, ranks from 0; the representative message is the earliest list's."""
    parts = [x.select("question_id", "conversation_id", "seq", (1 / (constant + F.col("rank") - 1)).alias("part"), F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts).groupBy("question_id", "conversation_id").agg(F.sum("part").alias("score"), F.min_by("seq", "list").alias("seq"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "conversation_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "conversation_id", "seq", "score", "rank")


def hybrid_hits(postings: DataFrame, sizes: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Both kinds of hits fused; ``questions`` (question_id, text, embedding)."""
    depth = max(5 * k, 20)
    return fused([keyword_hits(postings, sizes, questions, depth), semantic_hits(vectors, questions, depth)], k)


def _packed(sections: Column, most: int) -> Column:
    """Sections (strings, in order) within ``most`` bytes, as (out, used, taken, cut): the first is always there, if need be cut."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(0).alias("taken"), F.lit(False).alias("cut"))

    def step(s: Column, body: Column) -> Column:
        over = s["used"] + F.octet_length(body) > most
        fit = F.when(over, T.clip_bytes(body, most)).otherwise(body)
        added = F.struct(F.concat(s["out"], F.array(fit)).alias("out"), (s["used"] + F.octet_length(fit)).alias("used"), (s["taken"] + 1).alias("taken"), (s["cut"] | over).alias("cut"))
        full = F.struct(s["out"].alias("out"), s["used"].alias("used"), s["taken"].alias("taken"), F.lit(True).alias("cut"))
        # once something has been left out, nothing follows
        return F.when((over & (s["taken"] > 0)) | s["cut"], full).otherwise(added)

    return F.aggregate(sections, state, step)


def contexts(hits: DataFrame, messages: DataFrame, conversations: DataFrame, most: int = 6000) -> DataFrame:
    """(question_id, text, sections, chars, tokens, truncated): each question's block of conversations, the best first, within ``most`` bytes.

    ``hits`` (question_id, conversation_id, rank), ``conversations`` (conversation_id, title, tool).  A conversation that several questions
    have found is put together once, from its first messages that fit."""
    wanted = hits.select("conversation_id").distinct()
    w = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = F.octet_length("content")
    held = messages.join(wanted, "conversation_id", "left_semi").withColumn("used", F.coalesce(F.sum(own).over(w) + own, F.lit(0))).where(F.col("used") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.concat_ws(": ", m["role"], m["content"]))
    bodies = held.groupBy("conversation_id").agg(F.array_join(lines, "\n").alias("lines")).join(conversations.select("conversation_id", "title", "tool"), "conversation_id")
    heading = F.concat(F.lit("## "), F.when(F.coalesce("title", F.lit("")) == "", F.col("conversation_id").cast("string")).otherwise(F.col("title")), F.lit(" ("), F.coalesce("tool", F.lit("")), F.lit(")"))
    bodies = bodies.select("conversation_id", F.concat(heading, F.lit("\n"), "lines", F.lit("\n")).alias("body"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"])
    packed = hits.join(bodies, "conversation_id").groupBy("question_id").agg(_packed(ordered, most).alias("p"))
    text = F.array_join("p.out", "\n")
    return packed.select("question_id", text.alias("text"), F.col("p.taken").alias("sections"), F.length(text).alias("chars"), F.floor(F.length(text) / 4).cast("int").alias("tokens"), F.col("p.cut").alias("truncated"))
