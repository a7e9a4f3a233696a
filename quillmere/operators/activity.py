"""Counts over dated sessions: facets, status, activity by day and week, saved lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def activity(sessions: DataFrame, bucket: str = "day", kind: str | None = "thread") -> DataFrame:
    """(bucket, n, by_tool) in order of time; by_tool an array of (tool, n), the busiest first.  Undated ones are left out."""
    rows = sessions.where(F.col("started_at").isNotNull())
    rows = rows.where(F.col("kind") == kind) if kind and "kind" in sessions.columns else rows
    named = T.week_bucket("started_at") if bucket == "week" else T.day_bucket("started_at")
    each = rows.groupBy(named.alias("bucket"), "tool").agg(F.count("*").alias("n"))
    busiest = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "tool", "n"))), lambda s: F.struct(s["tool"].alias("tool"), s["n"].alias("n")))
    return each.groupBy("bucket").agg(F.sum("n").alias("n"), busiest.alias("by_tool"))


def activity_flat(sessions: DataFrame, bucket: str = "day", kind: str | None = None) -> DataFrame:
    """As :func:`activity`, a row a tool."""
    return activity(sessions, bucket, kind).select("bucket", F.col("n").alias("total"), F.posexplode("by_tool").alias("pos", "x")).select("bucket", "total", (F.col("pos") + 1).alias("place"), "x.tool", "x.n")


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values with their counts, the most frequent first."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def tag_facet(user_state: DataFrame) -> DataFrame:
    return user_state.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def status(sessions: DataFrame) -> DataFrame:
    """By tool: skills, and everything else as threads."""
    is_skill = F.col("kind") == "skill"
    return sessions.groupBy("tool").agg(F.count_if(~is_skill).alias("threads"), F.count_if(is_skill).alias("skills")).orderBy(F.desc("threads"), "tool")


def longest_version(conversations: DataFrame) -> DataFrame:
    """Of each session_key the version with most messages; of equal ones the one indexed last, then the smallest id."""
    w = Window.partitionBy("session_key").orderBy(F.desc("message_count"), F.desc_nulls_last("indexed_at"), "conversation_id")
    return conversations.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def saved(user_state: DataFrame, conversations: DataFrame) -> DataFrame:
    """Flagged sessions with their last indexed version: pinned first, then the newest."""
    marked = user_state.where("bookmarked OR pinned OR note IS NOT NULL OR size(tags) > 0")
    last = conversations.groupBy("session_key").agg(F.max_by(F.struct(*[c for c in conversations.columns if c != "session_key"]), F.struct("indexed_at", "conversation_id")).alias("c")).select("session_key", "c.*")
    return marked.join(last, "session_key").orderBy(F.desc("pinned"), F.desc_nulls_last("started_at"), "session_key")


def recent(conversations: DataFrame, n: int) -> DataFrame:
    return conversations.orderBy(F.desc_nulls_last("started_at"), "conversation_id").limit(n)


def recent_folders(conversations: DataFrame, n: int = 15) -> DataFrame:
    """Folders by their last activity."""
    return conversations.where("project IS NOT NULL AND project <> ''").groupBy("project").agg(F.max("started_at").alias("last")).orderBy(F.desc_nulls_last("last"), "project").limit(n)


def parse_error_histogram(errors: DataFrame, n: int = 4) -> DataFrame:
    """Messages with what looks like an id or a path made equal, the most frequent."""
    plain = F.regexp_replace(F.regexp_replace("message", r"[0-9a-fA-F]{8}[0-9a-fA-F-]*", "<id>"), r"\d+", "<n>")
    return errors.groupBy(plain.alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(n)


def board_progress(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("room").agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))


def latest_in_folder(conversations: DataFrame, cwd: str) -> DataFrame:
    """The conversation of the folder or of one above it: the newest, of equal ones that of the longest path."""
    cwd = cwd.rstrip("/\\")
    here = F.lit(cwd)
    project = F.rtrim(F.col("project"), F.lit("/"))
    inside = (project == here) | here.startswith(F.concat(project, F.lit("/"))) | here.startswith(F.concat(project, F.lit("\\")))
    return conversations.where(inside & (project != "")).orderBy(F.desc_nulls_last("last_activity"), F.desc(F.length("project")), "conversation_id").limit(1)


def of_source_path(conversations: DataFrame, path: str) -> DataFrame:
    """The fullest version of the session that a file holds."""
    return conversations.where(F.col("path") == path).orderBy(F.desc("message_count"), "conversation_id").limit(1)
