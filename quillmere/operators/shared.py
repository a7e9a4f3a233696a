"""Last-writer-wins state shared by devices.

Each field is a register (value, at, by); merging takes, field by field, the value of the largest (at, by), so the
result does not depend on the order of arrival.  Tombstones are values and stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of notes.
NOTE_KINDS = ["note", "decision", "question", "todo"]
NOTE_CHARS, BATCH = 4000, 2000


def merge_registers(rows: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row a key; a field f is f, f_at, f_by.  Rows without a field's time say nothing about it."""
    aggs = []
    for f in fields:
        value = F.when(F.col(f"{f}_at").isNotNull(), F.struct(F.col(f).alias("v"), F.col(f"{f}_at").alias("at"), F.col(f"{f}_by").alias("by")))
        # the value last breaks a tie of equal time and writer
        aggs.append(F.max_by(value, F.when(F.col(f"{f}_at").isNotNull(), F.struct(F.col(f"{f}_at"), F.coalesce(F.col(f"{f}_by"), F.lit("")), F.col(f).cast("string")))).alias(f"_{f}"))
    out = rows.groupBy(*key).agg(*aggs)
    cols = [c for f in fields for c in (F.col(f"_{f}.v").alias(f), F.col(f"_{f}.at").alias(f"{f}_at"), F.col(f"_{f}.by").alias(f"{f}_by"))]
    return out.select(*key, *cols)


def merge_rows(rows: DataFrame, key: Sequence[str], at: str = "updated", by: str = "updated_by") -> DataFrame:
    """One row a key: the whole row of the largest (at, by)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, by)).alias("r")).select(*key, "r.*")


def merge_notes(notes: DataFrame, incoming: DataFrame) -> DataFrame:
    valid = incoming.where(F.col("kind").isin(NOTE_KINDS)).withColumn("text", F.substring("text", 1, NOTE_CHARS))
    return merge_rows(notes.unionByName(valid, allowMissingColumns=True), ["note_id"])


def changes_since(parts: dict[str, DataFrame], since: int, batch: int = BATCH) -> tuple[dict[str, DataFrame], int | None]:
    """Of each kind the first ``batch`` rows updated after ``since``, and up to when a puller has seen everything: just
    before the last row of a kind whose batch is full, None where nothing is.

    Where a full batch has rows of one time only, a puller could never pass it: then all rows of that time are given."""
    out, upto = {}, []
    for name, df in parts.items():
        page = df.where(F.col("updated") > since).orderBy("updated", *[c for c in df.columns if c != "updated"][:1]).limit(batch)
        n, first, last = page.agg(F.count("*"), F.min("updated"), F.max("updated")).first()
        if n == batch and first == last:
            page = df.where(F.col("updated") == last)
            upto.append(last)
        elif n:
            upto.append(last - 1 if n == batch else last)
        out[name] = page
    return out, (min(upto) if upto else None)


def resolve_roots(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` (device, part, …) with root: where their part has been joined to, else the part itself.

    ``parts`` (device, part, root, gone)."""
    p = parts.where(~F.coalesce("gone", F.lit(False))).select("device", "part", F.col("root").alias("_root"))
    return rows.join(p, ["device", "part"], "left").withColumn("root", F.coalesce("_root", F.col("part"))).drop("_root")


def fold(rows: DataFrame) -> DataFrame:
    """One row a root over devices: sums, spans, unions in order of devices, the most urgent state."""
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("device", "part", F.col(c)))), lambda x: x[c])))
    return rows.groupBy("root").agg(
        F.sum("messages").alias("messages"), F.sum("sessions").alias("sessions"), F.min("started_at").alias("started_at"), F.max("last_activity").alias("last_activity"),
        ordered("tools").alias("tools"), F.array_sort(F.collect_set("device")).alias("devices"), F.max_by("state", F.struct(urgency(F.col("state")), "device")).alias("state"),
    )


def urgency(state: Column) -> Column:
    ranks = {"needs_you": 3, "running": 2, "listening": 1, "idle": 1}
    return reduce(lambda acc, kv: F.when(state == kv[0], kv[1]).otherwise(acc), ranks.items(), F.lit(0))


def overlay(folded: DataFrame, registers: DataFrame) -> DataFrame:
    """Shared titles and statuses over derived ones; deleted threads go."""
    r = registers.select(F.col("thread_id").alias("root"), F.col("title").alias("_title"), F.col("status").alias("_status"), F.coalesce("deleted", F.lit(False)).alias("_gone"))
    out = folded.join(r, "root", "left").where(~F.coalesce("_gone", F.lit(False)))
    has = set(folded.columns)
    title = F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("title")) if "title" in has else F.col("_title")
    return out.withColumn("title", title).withColumn("status", F.coalesce("_status", F.lit("active"))).drop("_title", "_status", "_gone")


def join_parts(parts: DataFrame, source: str, into: str, at: int, by: str) -> DataFrame:
    """The part and all that follow it follow ``into``: new register values, older ones stay in the log."""
    return parts.withColumn("root", F.when((F.col("part") == source) | (F.col("root") == source), into).otherwise(F.col("root"))).withColumn("updated", F.lit(at)).withColumn("updated_by", F.lit(by))


def split_part(parts: DataFrame, part: str, at: int, by: str) -> DataFrame:
    mine = F.col("part") == part
    return parts.withColumn("gone", mine | F.coalesce("gone", F.lit(False))).withColumn("updated", F.when(mine, at).otherwise(F.col("updated"))).withColumn("updated_by", F.when(mine, by).otherwise(F.col("updated_by")))


def handoff_tokens(messages: DataFrame, marker: str = "handoff:") -> DataFrame:
    """(conversation_id, seq, token) of user messages that carry a handoff marker with a valid token."""
    found = messages.where((F.col("role") == "user") & F.contains("content", F.lit(marker)))
    token = F.regexp_extract("content", marker.replace(":", r":\s*") + r"([a-z]{2}_[0-9a-z]{4,32})\b", 1)
    return found.select("conversation_id", "seq", token.alias("token")).where("token <> ''")


def edit(registers: DataFrame, thread_id: str, field: str, value: str | None, at: int, by: str) -> DataFrame:
    """The log of registers with one write more; merging decides what it is worth."""
    new = registers.sparkSession.createDataFrame([(thread_id, value, at, by)], f"thread_id string, {field} string, {field}_at long, {field}_by string")
    return registers.unionByName(new, allowMissingColumns=True)


def take_shared(threads: DataFrame, merged: DataFrame) -> DataFrame:
    """Local threads with the shared titles and statuses where there are any."""
    m = merged.select("thread_id", F.col("title").alias("_title"), F.col("status").alias("_status"))
    out = threads.join(m, "thread_id", "left")
    return out.withColumn("title", F.coalesce("_title", "title")).withColumn("status", F.coalesce("_status", "status")).drop("_title", "_status")


def whole_thread(rows: DataFrame, parts: DataFrame, notes: DataFrame) -> DataFrame:
    """One row a root over devices, as :func:`fold`, with the notes of all its parts, the oldest first.

    ``rows`` (device, part, …), ``notes`` (note_id, thread_id, kind, text, created)."""
    placed = resolve_roots(rows, parts)
    held = placed.select("root", F.col("part").alias("thread_id")).union(placed.select("root", F.col("root"))).distinct()
    told = notes.join(held, "thread_id").groupBy("root").agg(F.array_sort(F.collect_set(F.struct("created", "note_id", "kind", "text"))).alias("notes"))
    return fold(placed).join(told, "root", "left")


def handoff_joins(tokens: DataFrame, members: DataFrame, device: str) -> tuple[DataFrame, DataFrame]:
    """What handoff markers ask for: (session_key, thread_id) of sessions that begin here from a thread of this device, and
    (part, root) of threads that go on from another device's.

    ``tokens`` (conversation_id, token, from_device), ``members`` (conversation_id, session_key, thread_id)."""
    found = tokens.join(members, "conversation_id").where(F.col("thread_id") != F.col("token"))
    here = F.col("from_device").isNull() | (F.col("from_device") == device)
    return found.where(here).select("session_key", F.col("token").alias("thread_id")).distinct(), found.where(~here).select(F.col("thread_id").alias("part"), F.col("token").alias("root")).distinct()


def add_note(notes: DataFrame, note_id: str, thread_id: str, kind: str, text: str, at: int, by: str) -> DataFrame:
    """The notes with one more, or with another text for one; its time is later than that of any version that is known."""
    if kind not in NOTE_KINDS:
        raise ValueError(f"no kind of note: {kind}")
    held = notes.where(F.col("note_id") == note_id).agg(F.max("updated").alias("updated"), F.min("created").alias("created"))
    new = held.select(
        F.lit(note_id).alias("note_id"), F.lit(thread_id).alias("thread_id"), F.lit(kind).alias("kind"), F.lit(text[:NOTE_CHARS]).alias("text"), F.coalesce("created", F.lit(at)).cast("long").alias("created"),
        F.greatest(F.lit(at), F.coalesce(F.col("updated") + 1, F.lit(at))).cast("long").alias("updated"), F.lit(by).alias("updated_by"),
    )
    return notes.where(F.col("note_id") != note_id).unionByName(new)


def notes_of(notes: DataFrame, threads: DataFrame) -> DataFrame:
    """The notes of several threads, the oldest first."""
    return notes.join(threads.select("thread_id"), "thread_id", "left_semi").orderBy("created", "note_id")


def markers_since(messages: DataFrame, since: int, page: int = 500, marker: str = "handoff:") -> tuple[DataFrame, int]:
    """The next page of messages after a watermark that carry handoff markers, and the watermark after it.

    ``messages`` (id, conversation_id, seq, role, content)."""
    rows = messages.where(F.col("id") > since).orderBy("id").limit(page)
    top = rows.agg(F.max("id")).first()[0]
    return handoff_tokens(rows, marker), since if top is None else top
