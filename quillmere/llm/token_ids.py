"""Token ids in binary shards, with a minimal perfect hash from document keys to places in them.

A shard is two files.  ``shard-….ids`` is nothing but the ids, little-endian and unsigned, of 16 bits where the
vocabulary allows it and of 32 bits otherwise, one document after another in ascending doc_id order.
``shard-….idx`` holds

    magic "QMIX", version, bytes an id, number of documents n, number of documents with a key m, levels   (5 x uint32)
    the perfect hash of the m keys: bits of each level uint64, then (64 bits, set bits before them) uint64 x 2 each
    by slot: fingerprint uint32, place uint32, start uint64, length uint64
    doc_id int64 x n, has_id uint8 x n, start uint64 x (n + 1): in file order, in ids

so a keyed read is about two reads of the hash, one slot and one range of the id file, however large the shard.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MEMORIES, U64, as_binary, as_bytes, filesystem, fresh_dir, mix64, pieces, stash, tidy
from .mph import PerfectHash, fingerprints

MAGIC = b"QMIX"
#: A shard is closed once it has so many bytes of ids or documents.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 18
#: Rows that a shard's doc_id range holds, about.
RANGE_ROWS = 12_000
#: Ranges at most: their bounds are the only thing a driver holds by range.
MOST_RANGES = 200_000
#: Words whose ids a worker remembers from task to task, and bytes of text that are encoded at a time.
REMEMBERED, PIECE = 250_000, 8 << 20
#: Signs of ASCII, and the letters after which they are parted from a word: letters that are one letter in lower case too.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LAST_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"
_CODERS: dict[tuple[str, str, int], Encoder] = {}
MEMORIES.append(_CODERS.clear)


class Encoder:
    """Encodes texts by their distinct words.

    Where the tokenizer's own description says so (see :meth:`_splits`), no token crosses ASCII white space, and signs
    after a letter are cut off: the normaliser composes characters, makes runs of white space one space and
    lowers case, and the splitter keeps letters and other signs apart and drops white space.  A piece of text is split
    and reduced to its distinct words by Arrow, their ids are looked up or made, and one gather lays them out.  Words of
    ASCII signs alone are looked up in lower case, others as they are: "T" and a combining sign do not compose, "t" and
    the sign do.  So are words with "<|", which may hold a special token, whose case counts.  New words are encoded
    many at a time, between NUL characters, which have an id of their own.  Other tokenizers encode whole texts."""

    def __init__(self, path: str, dtype: type = np.uint32, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.remembered = Tokenizer.from_file(path), np.dtype(dtype), remembered
        self.known: dict[bytes, bytes] = {}
        mark = self._ids("\0")
        self.mark = mark[0] if len(mark) == 1 and self._splits() else None

    @classmethod
    def shared(cls, path: str, dtype: type, remembered: int = REMEMBERED) -> Encoder:
        """The encoder of this worker process: later tasks find the words of earlier ones."""
        key = (path, np.dtype(dtype).str, remembered)
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = cls(path, dtype, remembered)
        return _CODERS[key]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _splits(self) -> bool:
        j = json.loads(self.tokenizer.to_str())
        pre = j.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        kinds = {n["type"] for n in (j.get("normalizer") or {}).get("normalizers", [])}
        pattern = (first.get("pattern") or {}).get("Regex", "")
        added = j.get("added_tokens") or []
        return (
            kinds == {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and all("<|" in a["content"] and not a["content"].split()[1:] and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in added)
        )

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not known, as bytes."""
        out, plain, size = {}, [], self.dtype.itemsize
        for w in words:
            if b"\0" in w or b"<|" in w:  # the mark itself, or what may be a special token
                out[w] = np.asarray(self._ids(w.decode("utf-8", "replace")), self.dtype).tobytes()
            else:
                plain.append(w)
        for run in (plain[at : at + 200] for at in range(0, len(plain), 200)):
            (coded,) = self.tokenizer.encode_batch_fast([" \0 ".join([w.decode("utf-8", "replace") for w in run])], add_special_tokens=False)
            ids = np.asarray(coded.ids, self.dtype)
            cut, raw = np.flatnonzero(ids == self.mark) * size, ids.tobytes()
            out.update(zip(run, [raw[a:b] for a, b in zip([0, *(cut + size).tolist()], [*cut.tolist(), len(raw)], strict=True)], strict=True))
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words, as bytes."""
        known = self.known
        out = list(map(known.get, words))
        new = [w for w, ids in zip(words, out, strict=True) if ids is None]
        if new:
            got = self._fresh(new)
            out = [got[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]
            # the words that came first stay: most of them are frequent
            known.update(islice(got.items(), max(0, self.remembered - len(known))))
        return out

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct ``words``, one after another, and their numbers.  Signs of ASCII at the end, after a letter of
        Latin-1, are looked up apart from the rest."""
        plain = pc.invert(pc.match_substring(words, "<|"))
        keys = pc.if_else(pc.and_(pc.string_is_ascii(words), plain), pc.ascii_lower(words), words)
        stems = pc.ascii_rtrim(keys, SIGNS)
        cut = pc.and_(pc.and_(plain, pc.not_equal(pc.binary_length(stems), pc.binary_length(keys))), pc.match_substring_regex(stems, LAST_LETTER))
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        ends = [k[n:] for k, n in zip(keys.take(at).view(pa.binary()).to_pylist(), pc.binary_length(stems.take(at)).to_pylist(), strict=True)]
        signs = {e: i for i, e in enumerate(dict.fromkeys(ends))}
        stems = pc.if_else(cut, stems, keys).dictionary_encode()
        made = [b"", *self._words(list(signs)), *self._words(stems.dictionary.view(pa.binary()).to_pylist())]
        parts = np.zeros((len(words), 2), np.int64)
        parts[:, 0] = stems.indices.to_numpy() + len(signs) + 1
        parts[at, 1] = [signs[e] + 1 for e in ends]
        flat, length = np.frombuffer(b"".join(made), self.dtype), np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
        return _gathered(flat, length, parts.ravel())[0], length[parts].sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (binary; null: none), ``end_id`` after each, and n + 1 places of each text's first."""
        if self.mark is None:
            coded = [e.ids for e in self.tokenizer.encode_batch([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], add_special_tokens=False)]
            at = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)
            return np.fromiter((i for c in coded for i in (*c, end_id)), self.dtype, at[-1]), at
        split = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))
        count = np.zeros(len(texts) + 1, np.int64)
        parts = split.flatten()
        # white space at an end leaves an empty word, which has no ids
        count[1:] = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        del split
        seen = parts.dictionary_encode()
        del parts
        flat, length = self._joined(seen.dictionary)
        # the turn of each word, the end after each text's last
        turn = np.full(count[-1] + len(texts), len(length), np.int32)
        is_word = np.ones(len(turn), bool)
        is_word[count[1:] + np.arange(len(texts))] = False
        turn[is_word] = seen.indices.to_numpy()
        ids, upto = _gathered(np.append(flat, self.dtype.type(end_id)), np.append(length, 1), turn)
        return ids, np.concatenate([[0], upto[count[1:] + np.arange(1, len(texts) + 1)]]).astype(np.int64)


def _gathered(flat: np.ndarray, length: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that lie in ``flat`` one after another, those in ``turn``, and the places where these begin and end."""
    first, size = (np.cumsum(length) - length).astype(np.int32), length.astype(np.int32)[turn]
    upto = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=upto[1:])
    place = np.arange(upto[-1], dtype=np.int32)
    place += np.repeat(first[turn] - upto[:-1], size)
    return flat[place], upto


def _parts(doc_ids: pa.Array, crc: np.ndarray, bounds: np.ndarray, nulls: int) -> np.ndarray:
    """The range of each row: the number of ``bounds`` below its id.  An id that is a bound several times has as many ranges,
    and null ids have the last ``nulls`` ones: there, rows are dealt by the CRC of their ids, by which they are sorted."""
    value = doc_ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(bounds, value, "left"), np.searchsorted(bounds, value, "right")
    spread = lambda n: (crc.astype(np.int64) * n) >> 32
    out = low + np.where(high - low > 1, spread(high - low), 0)
    return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1 + spread(nulls), out).astype(np.int32)


def encode(docs: DataFrame, path: str, end_id: int = 1, cuts: list[int] | None = None, nulls: int = 1, remembered: int = REMEMBERED, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids binary, part) of every row of ``docs`` (doc_id, text): whole texts (null: empty), then ``end_id``.

    ids are uint16 if the vocabulary and the end id fit, else uint32; see :func:`width`.  part: see :func:`_parts`."""
    bounds = np.asarray(cuts or [], np.int64)
    dtype = np.dtype(f"<u{width(path, end_id)}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = Encoder.shared(path, dtype, remembered)
        for b in batches:
            for lo, hi in pieces(as_bytes(b.column(1))[1], piece):
                doc_ids = b.column(0).slice(lo, hi - lo)
                ids, at = coder.encode(b.column(1).slice(lo, hi - lo), end_id)
                coded = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at * dtype.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                hot = len(np.unique(bounds)) < len(bounds) or nulls > 1
                crc = np.fromiter((zlib.crc32(x) for x in coded.to_pylist()), np.int64, hi - lo) if hot else np.zeros(hi - lo, np.int64)
                yield pa.RecordBatch.from_arrays([doc_ids, coded, pa.array(_parts(doc_ids, crc, bounds, nulls))], ["doc_id", "ids", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary("text")).mapInArrow(tidy(each, remembers=True), "doc_id long, ids binary, part int")


def width(path: str, end_id: int = 1) -> int:
    """Bytes an id."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4


def key_hashes(doc_ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """A document's key is its id and the number of rows of that id before it in its shard."""
    with np.errstate(over="ignore"):
        return doc_ids.astype(np.int64).view(U64) + mix64(copies.astype(U64)) * (copies > 0).astype(U64)


HEAD = struct.Struct("<4sIIIII")
SLOT = np.dtype([("print", "<u4"), ("place", "<u4"), ("start", "<u8"), ("length", "<u8")])


def _copies(doc_ids: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The number of rows of the same id right before each."""
    n = len(doc_ids)
    new = np.ones(n, bool)
    new[1:] = (doc_ids[1:] != doc_ids[:-1]) | (has[1:] != has[:-1])
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


def index_bytes(doc_ids: np.ndarray, has: np.ndarray, starts: np.ndarray, each_id: int) -> bytes:
    """The index of a shard; equal doc_ids must be neighbours."""
    placed = np.flatnonzero(has)
    keys = key_hashes(doc_ids[placed], _copies(doc_ids, has)[placed])
    mph = PerfectHash.of(keys)
    slots = np.zeros(len(keys), SLOT)
    at = mph.slots(keys)
    slots["print"][at], slots["place"][at] = fingerprints(keys), placed
    slots["start"][at], slots["length"][at] = starts[placed], (starts[1:] - starts[:-1])[placed]
    return b"".join([
        HEAD.pack(MAGIC, 2, each_id, len(doc_ids), len(keys), len(mph.sizes)), mph.dump(), slots.tobytes(),
        doc_ids.astype("<i8").tobytes(), has.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes(),
    ])


class Index:
    """An index file in memory."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.width, n, m, levels = HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("no token index")
        self.mph, used = PerfectHash.load(data[HEAD.size :], levels)
        at = HEAD.size + used
        self.slots = np.frombuffer(data, SLOT, m, at)
        at += SLOT.itemsize * m
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.has = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)

    def find(self, doc_ids: np.ndarray, copies: np.ndarray | None = None) -> np.ndarray:
        """The slot of each document; -1 if it is not there."""
        doc_ids = np.asarray(doc_ids, np.int64)
        keys = key_hashes(doc_ids, np.zeros(len(doc_ids), np.int64) if copies is None else copies)
        slot = self.mph.slots(keys)
        ok = slot >= 0
        ok[ok] = self.slots["print"][slot[ok]] == fingerprints(keys[ok])
        return np.where(ok, slot, -1)


def keyed_read(shard: str, doc_id: int) -> np.ndarray | None:
    """The ids of a document (of its first row there), by a handful of small reads; None if the shard does not have it."""
    fs, at = filesystem(shard)
    key = key_hashes(np.asarray([doc_id], np.int64), np.zeros(1, np.int64))
    with fs.open_input_file(f"{at}.idx") as f:
        magic, version, each_id, _, m, levels = HEAD.unpack(f.read_at(HEAD.size, 0))
        if magic != MAGIC or version != 2:
            raise ValueError("no token index")
        slot, used = PerfectHash.slot_in_file(lambda n, where: f.read_at(n, HEAD.size + where), levels, key)
        if slot < 0:
            return None
        row = np.frombuffer(f.read_at(SLOT.itemsize, HEAD.size + used + SLOT.itemsize * slot), SLOT)[0]
        docs = HEAD.size + used + SLOT.itemsize * m
        if row["print"] != fingerprints(key)[0] or struct.unpack("<q", f.read_at(8, docs + 8 * int(row["place"])))[0] != doc_id:
            return None
    with fs.open_input_file(f"{at}.ids") as f:
        return np.frombuffer(f.read_at(int(row["length"]) * each_id, int(row["start"]) * each_id), f"<u{each_id}")


SHARDS = "shard string, part long, number long, docs long, ids long, first_id long, last_id long"


def write_shards(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None, range_rows: int = RANGE_ROWS, remembered: int = REMEMBERED, piece: int = PIECE) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text; other columns, whatever their names, are not looked at); the table (shard,
    part, number, docs, ids, first_id, last_id, base).

    Ranges of doc_id are cut at quantiles of the ids alone, so texts are encoded once, and the encoded rows move once.
    A range streams through its writer, sorted by Spark, in shards of bounded size; rows of a null doc_id come after all
    others and have no key.  Rows of one doc_id keep together, in the order of the CRC of their ids; a very frequent id, or
    null, has several ranges.  There are ``MOST_RANGES`` ranges at most, so those of a very large table grow.  ``base`` is the
    number of ids in all shards before: sums over runs of parts, and one over those sums.  An empty table has no shards.
    ``remembered`` and ``piece`` bound a worker's memory, some 200 bytes a word and 10 a byte of text, and change no id.
    Files have their attempt's name, the table lists those of attempts that ended well."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "ids")
    total = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("keyed")).first()
    n = max(1, min(MOST_RANGES, -(-total.keyed // range_rows)))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], max(10_000, 2 * n))).first()[0] if n > 1 else []
    cuts = sorted(cuts or [])
    nulls = max(1, min(MOST_RANGES, -(-(total.n - total.keyed) // range_rows)))
    each_id = width(path, end_id)
    dtype = np.dtype(f"<u{each_id}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, number = TaskContext.get(), None, 0
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)

        def closed() -> pa.RecordBatch:
            out.close()
            ids, has = np.asarray([d or 0 for d in names], np.int64), np.asarray([d is not None for d in names], bool)
            starts = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
            with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as f:
                f.write(index_bytes(ids, has, starts, each_id))
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (f"{folder}/{name}", task.partitionId(), number, len(names), int(starts[-1]))] + [pa.array([x], pa.int64()) for x in (names[0], names[-1])],
                ["shard", "part", "number", "docs", "ids", "first_id", "last_id"],
            )

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    name, names, sizes, size = f"shard-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}", [], [], 0
                    out = fs.open_output_stream(f"{base}/{name}.ids", compression=None)
                out.write(ids)
                names.append(doc_id)
                sizes.append(len(ids) // dtype.itemsize)
                size += len(ids)
                if size >= SHARD_BYTES or len(names) >= SHARD_DOCS:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    rows = encode(docs, path, end_id, cuts, nulls, remembered, piece)
    rows = rows.repartitionById(len(cuts) + 1 + nulls, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.crc32("ids"))
    return _with_base(stash(rows.select("doc_id", "ids").mapInArrow(tidy(write), SHARDS), "shards"))


def _with_base(made: DataFrame, run: int = 1000) -> DataFrame:
    """``made`` with the number of ids in all shards before each, from sums over runs of parts, one row a run."""
    block = F.floor(F.col("part") / run)
    sums = made.groupBy(block.alias("block")).agg(F.sum("ids").alias("all"))
    below = sums.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("below"))
    inside = F.sum("ids").over(Window.partitionBy("block").orderBy("part", "number")) - F.col("ids")
    return stash(made.withColumn("block", block).withColumn("inside", inside).join(below, "block").select(*made.columns, (F.col("inside") + F.col("below")).cast("long").alias("base")), "numbered")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    Each document with a key is fetched through the perfect hash: its slot says where its ids start and how many they
    are.  One without a key is taken in its turn.  ids_crc32 is the CRC of the ids as little-endian unsigned 32-bit numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = filesystem(shard)
                with fs.open_input_stream(f"{at}.idx", compression=None) as f:
                    index = Index(f.read())
                start, length = index.starts[:-1].copy(), np.diff(index.starts)
                keyed = np.flatnonzero(index.has)
                slot = index.find(index.doc_ids[keyed], _copies(index.doc_ids, index.has)[keyed])
                if (slot < 0).any():
                    raise ValueError(f"{shard}: the index does not find its own documents")
                start[keyed], length[keyed] = index.slots["start"][slot], index.slots["length"][slot]
                with fs.open_input_file(f"{at}.ids") as f:
                    for lo in range(0, len(start), 2000):
                        hi = min(lo + 2000, len(start))
                        first, last = int(start[lo:hi].min()), int((start[lo:hi] + length[lo:hi]).max())
                        data = np.frombuffer(f.read_at((last - first) * index.width, first * index.width), f"<u{index.width}")
                        if len(data) != last - first:
                            raise ValueError(f"{shard}: the id file is too short")
                        crc = [zlib.crc32(data[x : x + n].astype("<u4").tobytes()) for x, n in zip((start[lo:hi] - first).tolist(), length[lo:hi].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index.doc_ids[lo:hi], mask=~index.has[lo:hi]), pa.array(start[lo:hi] + base), pa.array(length[lo:hi]), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    rows = shards.select("shard", "base")
    return rows.repartition(max(1, min(rows.count(), 20_000))).mapInArrow(tidy(each), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, shards: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents by key (of their first row, if there are more).

    One pass over the list of shards says which ranges may hold a key; each is then read by :func:`keyed_read`."""
    if not doc_ids:
        return {}
    asked = F.broadcast(spark.createDataFrame([(int(d),) for d in set(doc_ids)], "asked long"))
    held = shards.join(asked, (F.col("first_id") <= F.col("asked")) & (F.col("last_id").isNull() | (F.col("asked") <= F.col("last_id"))))
    out: dict[int, np.ndarray] = {}
    for r in sorted(held.select("asked", "part", "number", "shard").collect()):
        if r.asked not in out and (ids := keyed_read(r.shard, r.asked)) is not None:
            out[r.asked] = ids
    return out
