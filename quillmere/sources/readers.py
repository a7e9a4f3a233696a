"""Readers: folders of history files as DataFrames of sessions and messages.

Files are scanned by Spark (``binaryFile``).  What is lines or JSON is a plan (:mod:`.file_plans`), other forms are parsed in Arrow batches; one
file's failure is an error row of its own.
"""

from __future__ import annotations

import os.path
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import SESSION
from .file_plans import PLANS
from .parsers import PARSERS, Session, markdown_folder

# Which files each source consists of.
GLOBS = {
    "claude-code": "*.jsonl", "codex": "*.jsonl", "cursor": "{*.vscdb,workspace.json}", "windsurf": "*.vscdb", "aider": ".aider.chat.history.md", "cline": "api_conversation_history.json",
    "copilot": "*.json*", "gemini": "session-*.json*", "grok": "{*.jsonl,summary.json}", "skills": "SKILL.md", "codex-prompts": "*.md", "antigravity": "*.md",
}


#: Sessions that a task hands on at a time.
AT_A_TIME = 64


def _row(s: Session) -> dict:
    ms = [{"seq": i, "role": m.role, "content": m.content, "ts": m.ts, "tools": m.tools, "snippets": []} for i, m in enumerate(s.messages)]
    return {k: getattr(s, k) for k in ("tool", "kind", "path", "native_id", "title", "project", "branch", "model", "started_at", "ended_at")} | {"error": None, "messages": ms}


def _failed(tool: str, path: str, e: Exception) -> dict:
    return dict.fromkeys(("native_id", "title", "project", "branch", "model", "started_at", "ended_at")) | {"tool": tool, "kind": "thread", "path": path, "error": str(e)[:500], "messages": []}


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["tool", "kind", "path", "native_id", "title", "project", "branch", "model", "started_at", "ended_at", "error", "messages"])
    for c in ("started_at", "ended_at"):
        out[c] = pd.to_datetime(out[c], utc=True).dt.tz_convert(None)
    return out


def _with_snippets(sessions: DataFrame) -> DataFrame:
    """The fenced blocks of each message beside it."""
    return sessions.withColumn("messages", F.transform("messages", lambda m: m.withField("snippets", T.fenced(m["content"]))))


#: How many folders deep Markdown folders are looked for.
MOST_DEPTH = 6


def read_sessions(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """The sessions of a source's files below ``folder``; rows with an error have no messages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOBS[source]).load(folder)
    return parse_files(files, source, folder)


def parse_files(files: DataFrame, source: str, folder: str = "/") -> DataFrame:
    """The sessions of ``files`` (path, content, modificationTime) below ``folder``."""
    files = files.select("path", "content", "modificationTime")
    if source in PLANS:
        return PLANS[source](files)
    if source in ("antigravity", "grok", "cursor"):
        return _read_folders(files, source, folder)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, modified in zip(pdf["path"], pdf["content"], pdf["modificationTime"], strict=True):
                try:
                    more = {"modified": modified.tz_localize("UTC").to_pydatetime()} if source in ("skills", "codex-prompts") else {}
                    rows += [_row(s) for s in PARSERS[source](path, content, **more)]
                except Exception as e:  # noqa: BLE001  a file must not end the others
                    rows.append(_failed(source, path, e))
                if len(rows) >= AT_A_TIME:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return _with_snippets(files.mapInPandas(each, SESSION))


def outermost(files: DataFrame, root: str) -> DataFrame:
    """``files`` (folder, …) without those whose folder lies below another one that holds files itself, or too deep."""
    depth = F.size(F.split(F.rtrim(F.regexp_replace("folder", "^[a-z0-9]+:/*", "/"), F.lit("/")), "/")) - len(("/" + root.split(":")[-1].strip("/")).rstrip("/").split("/"))
    held = files.withColumn("_deep", depth).where(F.col("_deep") <= MOST_DEPTH)
    folders = held.select("folder", "_deep").distinct()
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.col("_deep")), lambda i: F.array_join(F.slice(steps, 1, F.size(steps) - i), "/"))
    up = folders.where("_deep > 0").select("folder", F.explode(above).alias("up"))
    nested = up.join(folders.select(F.col("folder").alias("up")), "up").select("folder").distinct()
    return held.join(nested, "folder", "left_anti").drop("_deep")


def _read_folders(files: DataFrame, source: str, root: str) -> DataFrame:
    """Sources whose session is a folder of files, or a file with others beside it."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        folder = pdf["folder"].iloc[0]
        held = {os.path.basename(p): c for p, c in zip(pdf["path"], pdf["content"], strict=True)}
        rows = []
        for path in [f"{folder}/{n}" for n in held if n.endswith(".vscdb")] if source == "cursor" else [folder]:
            try:
                if source == "antigravity":
                    found = markdown_folder(folder, {n: c.decode("utf-8", "replace") for n, c in held.items()})
                elif source == "cursor":
                    found = PARSERS["cursor"](path, held[os.path.basename(path)], held.get("workspace.json"))  # type: ignore[call-arg]
                else:
                    found = PARSERS["grok"](f"{folder}/chat_history.jsonl", held.get("chat_history.jsonl", b""), held.get("updates.jsonl"), held.get("summary.json"))  # type: ignore[call-arg]
                rows += [_row(s) for s in found]
            except Exception as e:  # noqa: BLE001
                rows.append(_failed(source, path, e))
        return _frame(rows)

    rows = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    rows = outermost(rows, root) if source == "antigravity" else rows
    return rows.select("folder", "path", "content").groupBy("folder").applyInPandas(whole, SESSION).transform(_with_snippets)


def messages_of(sessions: DataFrame) -> DataFrame:
    return sessions.select("path", "native_id", F.explode("messages").alias("m")).select("path", "native_id", "m.*")


def read_quota(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("tool string, used double, resets_at timestamp").json(folder)


def read_message_log(spark: SparkSession, source: bytes | list[tuple]) -> DataFrame:
    """A foreign message table as a room log: a SQLite database, or rows of a log.

    Such a database is one machine's history, small enough for the driver."""
    from ..schema import ROOM_LOG

    if isinstance(source, list):
        return spark.createDataFrame(source, ROOM_LOG)
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(source)
        rows = con.execute("SELECT id, ts, room, author, recipient, text, human FROM msg ORDER BY id").fetchall()
    finally:
        con.close()
    return spark.createDataFrame([(i, room, author, None, i, to, text, bool(human), int(ts)) for i, ts, room, author, to, text, human in rows], ROOM_LOG)
