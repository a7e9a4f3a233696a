"""State as versioned Parquet tables: a write makes a new version and then a new pointer, so readers keep what they read.

Pointers are numbered and never change: a reader takes the largest, a writer makes the next by renaming a whole file to
its name, which fails if another writer was first.  So a crash at any time leaves the last whole state.

What is deleted stays on disk until a sweep: that marks folders to which no pointer leads, and removes those that have been marked for
longer than a grace time, so that readers of an older state, and writers that have not made their pointer yet, can finish."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

SCHEMAS = {
    "conversations": schema.CONVERSATIONS, "messages": schema.MESSAGES, "embeddings": schema.EMBEDDINGS, "user_state": schema.USER_STATE, "forgotten": schema.FORGOTTEN, "threads": schema.THREADS,
    "membership": schema.MEMBERSHIP, "links": schema.LINKS, "rejections": schema.REJECTIONS, "room_log": schema.ROOM_LOG, "room_agents": schema.ROOM_AGENTS, "claims": schema.CLAIMS,
    "tasks": schema.TASKS, "notes": schema.NOTES, "kv": "key string, value string, version long",
    "room_sessions": schema.ROOM_SESSIONS, "scanned": schema.SCANNED, "postings": schema.POSTINGS, "sizes": schema.SIZES,
}


#: Columns by which tables are laid out in folders, so that a query reads the folders it needs, and by which rows are dealt to files and
#: sorted in them, so that it reads the pages it needs and no task writes all rows of a folder.
LAYOUT = {"postings": (["bucket"], ["term", "level", "conversation_id", "seq"])}
#: What is kept beside a table, part by part, and of which table.
DERIVED = {"blocks": "postings", "totals": "sizes"}
#: Pointers that are kept for readers that hold an older one, and parts of a table from which it is written anew.
KEPT, MOST_PARTS = 5, 64
#: Tables of which only the last row of a key counts (key, order): they are written anew without the others.
LAST = {"kv": ("key", "version")}
#: Seconds for which a sweep leaves what no table holds any more.
GRACE = 3600.0


class Conflict(RuntimeError):
    """Another writer has changed the table meanwhile: read it again and repeat."""


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that all machines share: below ``spark.checkpoint.dir``, or a temporary one where all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="store-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table below the shared folder, its lineage cut."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables below ``root``.  ``<table>/pointer-<n>.json`` lists the folders that make up the table as of its n-th change."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(name)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self, table: str) -> list[int]:
        p, fs = self._path(f"{self.root}/{table}")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"pointer-(\d+)\.json", n)))

    def _parts(self, table: str) -> tuple[int, list[str]]:
        """The number of the table's last change, and its folders."""
        numbers = self._pointers(table)
        if not numbers:
            return 0, []
        return numbers[-1], self._parts_of(table, numbers[-1])

    def _parts_of(self, table: str, n: int) -> list[str]:
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/{table}/pointer-{n:012d}.json").first()
        return json.loads(text[0])

    def _point(self, table: str, after: int, parts: list[str]) -> None:
        temp, fs = self._path(f"{self.root}/{table}/pointer-{uuid.uuid4().hex}.tmp")
        for p in parts:
            if not fs.exists(self._path(f"{self.root}/{table}/{p}")[0]):
                raise Conflict(f"{table}: {p} has been swept away before it was part of the table")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        final, _ = self._path(f"{self.root}/{table}/pointer-{after + 1:012d}.json")
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise Conflict(f"{table} has changed since it was read")
        for n in self._pointers(table)[:-KEPT]:
            fs.delete(self._path(f"{self.root}/{table}/pointer-{n:012d}.json")[0], False)

    def read(self, table: str) -> DataFrame:
        return self._frame(table, self._parts(table)[1])

    def _frame(self, table: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[table])
        read = self.spark.read.option("mergeSchema", "true")
        if table in LAYOUT:  # folders are read one by one: each is the root of its own layout
            frames = [read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{p}") for p in parts]
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f)
            return out
        return read.parquet(*[f"{self.root}/{table}/{p}" for p in parts])

    def _write(self, table: str, df: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        if table in LAYOUT:
            folders, order = LAYOUT[table]
            df.repartitionByRange(*folders, *order).sortWithinPartitions(*folders, *order).write.partitionBy(*folders).parquet(f"{self.root}/{table}/{name}")
        else:
            df.write.parquet(f"{self.root}/{table}/{name}")
        return name

    def derived(self, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """What ``make`` says of each part of the table that ``name`` is derived from (see ``DERIVED``), made once a part, since parts
        never change; None where the table has none.  A part that is rewritten is another part, so nothing is ever stale."""
        table, frames = DERIVED[name], []
        for p in self._parts(table)[1]:
            path = f"{self.root}/{name}/{p}"
            final, fs = self._path(path)
            if not fs.exists(final):
                temp, _ = self._path(f"{self.root}/{name}/made-{uuid.uuid4().hex}")
                make(self._frame(table, [p])).write.parquet(str(temp.toString()))
                if fs.exists(final) or not fs.rename(temp, final):
                    fs.delete(temp, True)  # another was first
            frames.append(self.spark.read.parquet(path))
        return reduce(DataFrame.unionByName, frames) if frames else None

    def append(self, table: str, df: DataFrame) -> None:
        n, parts = self._parts(table)
        if len(parts) >= MOST_PARTS:
            whole = self._frame(table, parts).unionByName(df, allowMissingColumns=True)
            if table in LAST:
                key, order = LAST[table]
                whole = whole.groupBy(key).agg(F.max_by(F.struct(*whole.columns), order).alias("row")).select("row.*")
            self._point(table, n, [self._write(table, whole)])
        else:
            self._point(table, n, [*parts, self._write(table, df)])

    def replace(self, table: str, df: DataFrame) -> None:
        """``df`` may read the table it replaces."""
        self._point(table, self._parts(table)[0], [self._write(table, df)])

    def delete(self, table: str, gone: DataFrame, key: str) -> bool:
        """The rows whose ``key`` is in ``gone`` go from the table; whether there were any.  Only the parts that hold some are written anew."""
        n, parts = self._parts(table)
        wanted = gone.select(key).distinct()
        each = [self._frame(table, [p]).select(key, F.lit(p).alias("part")) for p in parts]
        hit = {r.part for r in reduce(DataFrame.unionByName, each).join(wanted, key, "left_semi").select("part").distinct().collect()} if each else set()
        if hit:
            rest = self._frame(table, [p for p in parts if p in hit]).join(wanted, key, "left_anti")
            self._point(table, n, [*(p for p in parts if p not in hit), self._write(table, rest)])
        return bool(hit)

    def sweep(self, grace: float = GRACE) -> int:
        """Remove from disk what no table holds any more, once it has been so for ``grace`` seconds; the number of folders removed.

        The first sweep that finds a folder without a pointer marks it, and a later one removes it.  Older pointers go too,
        once the next one is older than that.  With no grace all goes at once: nothing else may use the store then, nor may a
        DataFrame that was made before be read.  Running it twice, or again after a crash, does no harm."""
        root, fs = self._path(self.root)
        if not fs.exists(root):
            return 0
        probe, _ = self._path(f"{self.root}/probe-{uuid.uuid4().hex}")
        fs.create(probe, True).close()
        until = fs.getFileStatus(probe).getModificationTime() - 1000 * grace  # by the clock of the file system
        fs.delete(probe, False)
        removed = 0
        for table in [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]:
            at = {f.getPath().getName(): f for f in fs.listStatus(self._path(f"{self.root}/{table}")[0])}
            numbers = self._pointers(table)
            for n, after in zip(numbers, numbers[1:], strict=False):
                if at[f"pointer-{after:012d}.json"].getModificationTime() <= until:
                    fs.delete(at[f"pointer-{n:012d}.json"].getPath(), False)
            of = DERIVED.get(table, table)
            held = {p for n in self._pointers(of) for p in self._parts_of(of, n)}
            for name, f in at.items():
                mark, _ = self._path(f"{self.root}/{table}/gone-{name}")
                if name in held:
                    fs.delete(mark, False)
                elif f.isDirectory():
                    if not fs.exists(mark):
                        fs.create(mark, True).close()
                    if fs.getFileStatus(mark).getModificationTime() <= until or grace <= 0:
                        fs.delete(f.getPath(), True)
                        fs.delete(mark, False)
                        removed += 1
                elif name.endswith(".tmp") and f.getModificationTime() <= until:
                    fs.delete(f.getPath(), False)
        return removed

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table, its lineage cut."""
        path = f"{self.root}/_kept/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def get(self, key: str) -> str | None:
        """The value of the last version of a key."""
        row = self.read("kv").where(F.col("key") == key).orderBy(F.desc("version")).first()
        return row.value if row else None

    def put(self, key: str, value: str) -> None:
        held = self.read("kv").where(F.col("key") == key).agg(F.max("version")).first()[0]
        self.append("kv", self.spark.createDataFrame([(key, value, (held or 0) + 1)], SCHEMAS["kv"]))
