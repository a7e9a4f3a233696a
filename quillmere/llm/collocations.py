"""Phrase collocations by pivot partitioning.

The words of each language are counted and ordered, the most frequent first.  A phrase belongs to its rarest word, its pivot:
each occurrence of a frequent word is rewritten as one fragment of text, the word itself, up to four words on its left as long as
they are more frequent, and up to four on its right as long as they are not rarer.  Rarer words end it, infrequent ones and
the ends of a piece too.  All phrases of the fragment that hold that occurrence are the pivot's own (it is their leftmost one of
that word), and no other fragment holds them at this place.  Equal fragments are counted where they arise and go, a few words
on average, to the bucket of their pivot; there the pivots' phrases are counted.  A pivot with very many occurrences is dealt
over several buckets by its fragments, and its counts are added up.

The dictionary of frequent words is sent whole while it is small, by a check of its size; beyond that a scan partition finds the
numbers of its own words in a file that a join has written for it, and no task needs the whole.
Parts of a phrase are at least as frequent as the phrase, so all counts that a score needs are among those kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, PLACE_BITS, U64, as_binary, as_bytes, mix64, part_of, pieces, read_part, release, stash, tidy, word_spans, write_parts

#: Signs that end a piece, and what else ends a word.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = ENDS.copy()
GAP[[0x20, 0x09]] = True
#: Bytes of text that are taken at a time.
PIECE = 8 << 20
#: Occurrences that a bucket holds about, and occurrences of one pivot from which it is dealt over several buckets.
BUCKET, SPLIT = 1 << 20, 1 << 18
#: Bytes of the dictionary up to which every task gets the whole of it.
WHOLE = 32 << 20
#: The language of documents that have none.
UNKNOWN = "und"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some documents, A-Z in lower case, as binary strings, each one's document, and a number that is the same for
    words of one piece."""
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets, GAP)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    inside = data[~GAP[data]]  # words are all that is no gap, so they follow each other here
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(inside.tobytes())])
    return words, doc, np.cumsum(ENDS[data])[starts] + doc


def unique_rows(rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of whole numbers and the sums of their counts: sorted by a hash, or where two different
    rows have one, by themselves."""
    if not len(rows):
        return rows, count
    key = np.zeros(len(rows), U64)
    with np.errstate(over="ignore"):
        for i in range(rows.shape[1]):
            key = mix64(key * U64(0x9E3779B97F4A7C15) + rows[:, i].astype(U64) + U64(i + 1))
    order = np.argsort(key, kind="stable")
    key, sorted_ = key[order], rows[order]
    same = (sorted_[1:] == sorted_[:-1]).all(axis=1)
    if (same != (key[1:] == key[:-1])).any():
        order = np.lexsort(rows.T)
        sorted_ = rows[order]
        same = (sorted_[1:] == sorted_[:-1]).all(axis=1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return sorted_[first], np.add.reduceat(count[order], first)


def fragments(ids: np.ndarray, piece: np.ndarray, reach: int) -> np.ndarray:
    """The fragments (m x (2 reach + 1), the pivot in the middle, -1 where a fragment has ended) of words numbered from the
    most frequent, -1 for infrequent ones; pivots without neighbours have none."""
    left, right = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    on_left, on_right = ids >= 0, ids >= 0
    for j in range(1, reach + 1):
        one_piece, a, b = piece[j:] == piece[:-j], ids[:-j], ids[j:]
        on_left[j:] &= one_piece & (a >= 0) & (a < b)
        on_left[:j] = False
        on_right[: len(ids) - j] &= one_piece & (b >= 0) & (b <= a)
        on_right[max(len(ids) - j, 0) :] = False
        left, right = left + on_left, right + on_right
    at = np.flatnonzero(left + right > 0)
    out = np.full((len(at), 2 * reach + 1), -1, np.int64)
    out[:, reach] = ids[at]
    for j in range(1, reach + 1):
        held = left[at] >= j
        out[held, reach - j] = ids[at[held] - j]
        held = right[at] >= j
        out[held, reach + j] = ids[at[held] + j]
    return out


def own_phrases(found: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases of ``length`` words that hold the pivots of some fragments, and how often they occur in them."""
    reach, phrases, times = found.shape[1] // 2, [], []
    for on_left in range(length):
        at, end = reach - on_left, reach - on_left + length
        held = (found[:, at] >= 0) & (found[:, end - 1] >= 0)
        phrases.append(found[held, at:end])
        times.append(count[held])
    return unique_rows(np.concatenate(phrases), np.concatenate(times))


def _coded(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For runs of documents of a batch (..., lang, text): the distinct words, the number of each word among them, that of its
    language among those of the batch, its piece, and these languages."""
    langs = b.column(b.num_columns - 2).fill_null(UNKNOWN).dictionary_encode()
    lang = langs.indices.to_numpy()
    data, offsets = as_bytes(b.column(b.num_columns - 1))
    for x, y in pieces(offsets, PIECE):
        words, doc, piece = words_of(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
        coded = words.dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy(), lang[x:y][doc], piece, langs.dictionary.to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(part, lang, word binary, n): how often a word occurs in a scan partition, in several rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, word, lang, _, langs in _coded(b):
                key, n = np.unique(lang.astype(np.int64) * max(len(words), 1) + word, return_counts=True)
                names = pa.array(langs, pa.string()).take(pa.array(key // max(len(words), 1)))
                part = np.full(len(key), b.column(0)[0].as_py() >> PLACE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(part), names, words.take(pa.array(key % max(len(words), 1))).cast(pa.binary()), pa.array(n)], ["part", "lang", "word", "n"])

    return docs.select("row", F.col("lang").cast("string"), as_binary("text")).mapInArrow(tidy(each), "part long, lang string, word binary, n long")


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words that occur ``least`` times: numbered from 0, the most frequent first."""
    found = counts.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    placed = stash(found.orderBy(F.desc("f"), "lang", "word").withColumn("row", F.monotonically_increasing_id()), "words")
    # one row a partition
    sizes = placed.groupBy(part_of().alias("part")).agg(F.count("*").alias("rows"))
    before = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn("part", part_of()).join(F.broadcast(before), "part").select("lang", "word", "f", (place + F.col("before")).alias("id"))


class Numbers:
    """The frequent words of a scan partition, or of all (part -1)."""

    def __init__(self, folder: str, part: int) -> None:
        t = read_part(folder, part)
        self.langs, self.expected, self.seen = {}, 0, 0
        self.ids, self.f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if t is not None:
            self.expected = pc.sum(t["n"]).as_py() if part >= 0 else None
            lang = t["lang"].to_pylist()
            cuts = [i for i in range(len(lang)) if not i or lang[i] != lang[i - 1]] + [len(lang)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.langs[lang[a]] = t["word"].slice(a, b - a).combine_chunks().cast(pa.large_binary()), t["id"].slice(a, b - a).to_numpy()
            order = np.argsort(t["id"].to_numpy())
            self.ids, self.f = t["id"].to_numpy()[order], t["f"].to_numpy()[order]

    def of(self, words: pa.Array, word: np.ndarray, lang: np.ndarray, langs: list[str]) -> np.ndarray:
        """The numbers of words, -1 for infrequent ones."""
        number = np.full((len(langs), len(words)), -1, np.int64)
        for i, name in enumerate(langs):
            if name in self.langs:
                values, ids = self.langs[name]
                at = pc.index_in(words, value_set=values).fill_null(-1).to_numpy()
                number[i] = np.where(at >= 0, ids[at], -1)
        found = number[lang, word]
        self.seen += int((found >= 0).sum())
        return found

    def frequency(self, ids: np.ndarray) -> np.ndarray:
        return self.f[np.searchsorted(self.ids, ids)]

    def settle(self) -> None:
        if self.expected is not None and self.seen != self.expected:
            raise ValueError("the words are not those that were counted: the table or its split has changed")


def dealt_fragments(docs: DataFrame, folder: str, whole: bool, buckets: int, reach: int, split: int) -> DataFrame:
    """(bucket, head, ids, n): packed fragments; the words' numbers are in ``folder``, by part or as a whole.  A head has the words on the left and on the right, and whether the pivot is dealt over
    several buckets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = None
        for b in batches:
            numbers = numbers or Numbers(folder, -1 if whole else b.column(0)[0].as_py() >> PLACE_BITS)
            for words, word, lang, piece, langs in _coded(b):
                made = fragments(numbers.of(words, word, lang, langs), piece, reach)
                found, n = unique_rows(made, np.ones(len(made), np.int64))
                parts = 1 + numbers.frequency(found[:, reach]) // split
                with np.errstate(over="ignore"):
                    salt = mix64(found.astype(U64) @ (np.arange(1, 2 * reach + 2, dtype=U64) * U64(0xD6E8FEB86659FD93))) % parts.astype(U64)
                    bucket = (mix64(found[:, reach].astype(U64) + mix64(salt + U64(1))) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                found, n, bucket, parts = found[order], n[order], bucket[order], parts[order]
                held = found >= 0
                head = ((parts > 1) * 128 + held[:, :reach].sum(axis=1) * 8 + held[:, reach + 1 :].sum(axis=1)).astype(np.uint8)
                flat, upto = found[held].astype("<u4"), np.concatenate([[0], np.cumsum(held.sum(axis=1))])
                if len(found) and int(found.max()) >= 1 << 32:
                    raise OverflowError("more frequent words than numbers of 32 bits")
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(bucket))
                spans = list(zip(cuts.tolist(), ends.tolist(), strict=True)) if len(cuts) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts]), pa.array([head[x:y].tobytes() for x, y in spans], pa.binary()),
                        pa.array([flat[upto[x] : upto[y]].tobytes() for x, y in spans], pa.binary()), pa.array([n[x:y].astype("<u4").tobytes() for x, y in spans], pa.binary()),
                    ],
                    ["bucket", "head", "ids", "n"],
                )
        if numbers is not None:
            numbers.settle()

    return docs.select("row", F.col("lang").cast("string"), as_binary("text")).mapInArrow(tidy(each), "bucket long, head binary, ids binary, n binary")


def unpacked(head: np.ndarray, flat: np.ndarray, reach: int) -> np.ndarray:
    """The fragments that heads and words stand for."""
    left, right = head >> 3 & 7, head & 7
    size = (left + right + 1).astype(np.int64)
    row = np.repeat(np.arange(len(head)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((len(head), 2 * reach + 1), -1, np.int64)
    out[row, reach - left[row].astype(np.int64) + place] = flat
    return out


def phrases(docs: DataFrame, words: DataFrame, counts: DataFrame, least: int, longest: int, bucket: int = BUCKET, split: int = SPLIT, most_whole: int = WHOLE) -> DataFrame:
    """(w, a): all phrases of 2 to ``longest`` words, as their words' numbers, that occur ``least`` times."""
    reach = longest - 1
    occurrences, size = words.agg(F.sum("f"), F.sum(F.octet_length("word") + F.octet_length("lang") + 24)).first()
    whole = (size or 0) <= most_whole
    if whole:
        named = words.select(F.lit(-1).cast("long").alias("part"), "lang", "word", "id", "f", F.lit(0).cast("long").alias("n"))
    else:
        named = counts.join(words, ["lang", "word"]).groupBy("part", "lang", "word", "id", "f").agg(F.sum("n").alias("n"))
    folder = write_parts(named, ["lang", "word"])
    buckets = max(32, -(-(occurrences or 0) // bucket))

    def mine(t: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
        head = joined("head", np.uint8)
        each = unpacked(head, joined("ids", "<u4"), reach)
        shared = np.unique(each[head >= 128, reach])
        found, n = unique_rows(each, joined("n", "<u4").astype(np.int64))
        del each
        made = []
        for length in range(2, longest + 1):
            rows, times = own_phrases(found, n, length)
            # what other buckets have of a pivot's phrases is not known here
            keep = (times >= least) | np.isin(rows.max(axis=1, initial=-1), shared)
            rows, times = rows[keep], times[keep]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, length), pa.int32()), pa.array(rows.ravel()))
            made.append(pa.table({"w": lists, "a": pa.array(times)}))
        release()
        return pa.concat_tables(made)

    dealt = dealt_fragments(docs, folder, whole, buckets, reach, split).groupBy("bucket").applyInArrow(mine, "w array<long>, a long")
    return dealt.groupBy("w").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``longest`` (8 at most) words.

    ``docs`` (row, lang, text; other columns are not looked at) must be a stored table or one that comes out the same each time,
    ``row`` numbered by :func:`numbered`.  A null language is ``und``, a null text empty; texts of any length are taken whole; rows that
    repeat count each time; ties are in no doubt, since phrases differ.  Empty tables give an empty one.

    A phrase's cut after its first k words has the score floor(1000 a n / (l r)), of its own count, that of all words, and those of the two
    sides; its lowest cut counts, the first of equals.  Phrases that occur only within one longer phrase are left out."""
    counts = stash(word_counts(docs), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stash(dictionary(counts, least), "dictionary")
    found = stash(phrases(docs, words, counts, least, longest), "phrases")
    # a longer phrase of the same count has one of one word more, of the same count too
    size = F.size("w")
    sides = found.where(size > 2).select("a", F.explode(F.array(F.slice("w", 1, size - 1), F.slice("w", 2, size - 1))).alias("w"))
    kept = found.join(sides.groupBy("w").agg(F.max("a").alias("longer")), "w", "left").where(F.coalesce("longer", F.lit(0)) < F.col("a")).select("w", "a")
    cuts = kept.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("x"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("y"))
    known = found.unionByName(words.select(F.array("id").alias("w"), F.col("f").alias("a")))
    cuts = cuts.join(known.select(F.col("w").alias("x"), F.col("a").alias("l")), "x").join(known.select(F.col("w").alias("y"), F.col("a").alias("r")), "y")
    # the words themselves, and with them the language
    spelt = kept.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "lang", F.col("word").cast("string").alias("word")), "id")
    in_order = F.array_sort(F.collect_list(F.struct("at", "word")))
    spelt = spelt.groupBy("w").agg(F.max("lang").alias("lang"), F.array_join(F.transform(in_order, lambda s: s["word"]), " ").alias("phrase"))
    scored = cuts.join(spelt, "w").join(totals, "lang")
    lowest = F.min(F.struct(_score().alias("score"), "k", "l", "r")).alias("cut")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score() -> Column:
    """floor(1000 a n / (l r)), exactly."""
    wide = "cast({} as decimal(19, 0))".format
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
