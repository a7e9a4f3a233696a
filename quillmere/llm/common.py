"""Helpers that the operators share: the shared folder, lineage cuts, byte-level word handling."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but lower-case letters and digits separates words of lower-cased text.
PUNCT = np.ones(256, dtype=bool)
PUNCT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Every byte, A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.  Where that is unset and everything runs
    in this process (tests), a temporary folder is set as the checkpoint folder; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python 2000 at a time, if the session says nothing else: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What workers remember from task to task, as functions that make them forget it.
MEMORIES: list[Callable[[], None]] = []


def tidy(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each``, which maps batches, with :func:`release` after it; unless it ``remembers`` itself, the worker first
    forgets what tasks of another kind have left in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            for forget in MEMORIES:
                forget()
        try:
            yield from each(batches)
        finally:
            release()

    return run


#: Folders below the shared one that this process has made.
_MADE: list[str] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; it goes when the driver ends, or with :func:`clear`."""
    if not _MADE:
        atexit.register(clear, spark)
    _MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> None:
    """Remove all that operators keep in the shared folder: for long sessions, once the results have been written."""
    while _MADE:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def stash(df: DataFrame, what: str = "stash") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; works on executors.  Schemes are those that Arrow knows (file,
    hdfs, viewfs, s3, gs, abfs), and Hadoop's names for S3."""
    path = re.sub("^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and n + 1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes; a longer document is a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 positions of each document's first word among them."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    now = np.append(inside, False)
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS = np.ones(1, U64)
_BASE = U64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(n, 64) - 1, _BASE, U64))])
    return _POWERS


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial in a fixed odd base, then mixed with the length.

    Words are taken a million at a time, so that a very long text needs little more memory than its own."""
    if len(starts) > 1 << 20:
        return np.concatenate([word_hashes(data, starts[a : a + (1 << 20)], ends[a : a + (1 << 20)]) for a in range(0, len(starts), 1 << 20)])
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    powers = _powers(int(lengths.max()))
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        terms = (data[np.repeat(starts, lengths) + place].astype(U64) + U64(1)) * powers[place]
        return mix64(np.add.reduceat(terms, first) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles (of the whole sequence, if that is shorter; none for no
    words), and n + 1 positions of each document's first shingle among them."""
    counts = np.diff(firsts)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(made)])
    if not at[-1]:
        return np.zeros(0, U64), at
    doc = np.repeat(np.arange(len(counts)), made)
    place = firsts[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    short = np.minimum(counts, k)[doc]
    out = np.zeros(at[-1], U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            ok = i < short
            out = np.where(ok, mix64(out + words[np.minimum(place + i, len(words) - 1)] + U64(i + 1)), out)
    return out, at


def as_binary(name: str) -> F.Column:
    """A text column as UTF-8 bytes: no decoding on the way to Python."""
    return F.col(name).cast("binary").alias(name)


def unsalted(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the columns an operator works on; others, whatever their names, stay out of its way."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number for each row in the column ``row``: its partition, and its place in that.

    ``docs`` must be a stored table or one that comes out the same each time.  How a scan is split would follow the
    number of executors, so that is pinned for the session: the numbers hold when an executor is lost."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return docs.withColumn(row, F.monotonically_increasing_id())


#: Bits of a row's number that are its place in its partition.
PLACE_BITS = 33


def write_decisions(decisions: DataFrame) -> str:
    """Write (row, doc_id, n), rows numbered as by :func:`numbered`, to one file a partition of the table they are of, with a
    hash of their doc_id.

    :func:`decided` brings them to the rows without moving the table itself.  A file is moved to its name when
    it is whole, and each attempt writes the same."""
    folder = fresh_dir(decisions.sparkSession, "decisions")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, held = None, []

        def close() -> pa.RecordBatch:
            rows = np.concatenate(held)
            temp = f"{base}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temp, compression=None) as out:
                out.write(rows.astype("<i8").tobytes())
            fs.move(temp, f"{base}/{part}.rows")
            return pa.RecordBatch.from_arrays([pa.array([int(part)]), pa.array([len(rows)])], ["part", "rows"])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
            for p in np.unique(rows[:, 0] >> PLACE_BITS).tolist():
                if part is not None and p != part:
                    yield close()
                    held = []
                part = p
                held.append(rows[rows[:, 0] >> PLACE_BITS == p])
        if held:
            yield close()

    part = part_of()
    rows = decisions.select("row", F.xxhash64(F.col("doc_id").cast("long")).alias("key"), F.col("n").cast("long").alias("n"))
    stash(rows.repartition(part).sortWithinPartitions("row").mapInArrow(each, "part long, rows long"), "written")
    return folder


def decided(folder: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function of row numbers and hashes of doc_ids that gives (n, whether there is a decision), from the files of
    :func:`write_decisions`.  A row that is not the one that was decided on is an error."""
    fs, base = filesystem(folder)
    known: dict[int, np.ndarray] = {}

    def find(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known
        n, there = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for p in np.unique(rows >> PLACE_BITS).tolist():
            if p not in known:
                path, made = f"{base}/{p}.rows", np.zeros((0, 3), np.int64)
                if fs.get_file_info(path).type == pafs.FileType.File:
                    with fs.open_input_stream(path, compression=None) as f:
                        made = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                known = {p: made}
            made = known[p]
            if len(made):
                place = np.minimum(np.searchsorted(made[:, 0], rows), len(made) - 1)
                hit = made[place, 0] == rows
                if (made[place[hit], 1] != keys[hit]).any():
                    raise ValueError("a row is not the one that was decided on: the table or its split has changed")
                n[hit] = made[place[hit], 2]
                there |= hit
        return n, there

    return find


def part_of(row: str = "row") -> F.Column:
    """The scan partition of a row that :func:`numbered` has numbered."""
    return F.shiftright(row, PLACE_BITS)


def write_parts(rows: DataFrame, order: list[str]) -> str:
    """Write the rows (part long, ...) of each part as one Arrow file ``<part>.arrow``, ordered by ``order``; returns the folder.

    A task that scans a part of a table finds there just what it needs: no broadcast, and no join with the table itself.  A
    file is moved to its name when it is whole, and each attempt writes the same."""
    folder = fresh_dir(rows.sparkSession, "parts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, temp, out, n = None, "", None, 0

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(temp, f"{base}/{part}.arrow")
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], ["part", "rows"])

        for b in batches:
            parts = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if part != parts[a]:
                    if out is not None:
                        yield close()
                    part, temp, n = int(parts[a]), f"{base}/{uuid.uuid4().hex}.tmp", 0
                    out = pa.ipc.new_file(fs.open_output_stream(temp, compression=None), b.schema)
                out.write_batch(b.slice(a, z - a))
                n += z - a
        if out is not None:
            yield close()

    stash(rows.repartition("part").sortWithinPartitions("part", *order).mapInArrow(each, "part long, rows long"), "written")
    return folder


def read_part(folder: str, part: int) -> pa.Table | None:
    """What :func:`write_parts` has written for a part; None where it had no rows."""
    fs, base = filesystem(folder)
    path = f"{base}/{part}.arrow"
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def apply_decisions(docs: DataFrame, row: str, folder: str, default: int) -> DataFrame:
    """The rows of ``docs``, numbered in its column ``row``, each ``n`` times, or ``default`` times without a decision;
    the number goes."""
    at, key = docs.columns.index(row), f"key_{uuid.uuid4().hex}"
    schema = docs.drop(row).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = decided(folder)
        for b in batches:
            n, there = find(*(b.column(i).to_numpy(zero_copy_only=False) for i in (at, b.num_columns - 1)))
            take = pa.array(np.repeat(np.arange(len(n)), np.where(there, n, default)))
            cols = [i for i in range(b.num_columns - 1) if i != at]
            yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in cols], names=[b.schema.names[i] for i in cols])

    return docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"))).mapInArrow(tidy(each), schema)


#: Rows of a key from which a join sends the other side to all tasks: at least so many, and at least this part of all rows, so
#: that there are ten thousand such keys at most.
HEAVY_ROWS, HEAVY_SHARE = 1000, 10_000


def skew_join(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has each ``key`` once and in ``size`` its number of rows in ``left``, which has
    ``total`` rows.  The few keys that have many rows are broadcast, so no task gets all rows of one."""
    least, flag = max(HEAVY_ROWS, -(-total // HEAVY_SHARE)), f"heavy_{uuid.uuid4().hex}"
    more = [c for c in right.columns if c not in (key, size)]
    met = left.join(F.broadcast(right.where(F.col(size) >= least).drop(size).withColumn(flag, F.lit(True))), key, "left")
    light = met.where(F.col(flag).isNull()).drop(flag, *more).join(right.where(F.col(size) < least).drop(size), key)
    return met.where(flag).drop(flag).unionByName(light)
