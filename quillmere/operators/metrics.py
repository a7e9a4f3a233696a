"""Behavioural metrics of sessions, exact, from two tables.

``sessions`` (session_id, tool, project, model, started_at, ended_at) and ``messages`` (session_id, seq, role, content,
ts, tools array<string>).  One aggregation by session over the first 2000 characters of each message, ordered by seq
through ``min_by``/``max_by`` and one small window over user turns; then one aggregation over sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

READ_CHARS = 2000


def session_metrics(sessions: DataFrame, messages: DataFrame, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a session, also for those without messages.

    ``markers`` may replace the lists ``correction``, ``constraint``, ``error``, ``test`` and ``commit``."""
    lists = {"correction": T.CORRECTION_MARKERS, "constraint": T.CONSTRAINT_MARKERS, "error": T.ERROR_MARKERS, "test": T.TEST_MARKERS, "commit": T.COMMIT_MARKERS} | (markers or {})
    m = messages.withColumn("content", F.substring(F.coalesce("content", F.lit("")), 1, READ_CHARS)).withColumn("is_user", F.lower("role").isin("user", "human"))
    m = m.withColumn("user_rn", F.when(F.col("is_user"), F.count_if("is_user").over(Window.partitionBy("session_id").orderBy("seq"))))
    corrected = T.has_any("content", lists["correction"])
    user = F.col("is_user")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(user, F.struct("seq", c.alias("c"))))), lambda x: x["c"])
    first_user_ts = F.min(F.when(F.col("user_rn") == 1, F.col("ts")))
    per = m.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.count_if(user).alias("user_turns"),
        F.count_if(user & (F.col("user_rn") > 1) & corrected).alias("corrections"),
        F.coalesce(F.max(F.when(F.col("user_rn") == 2, corrected)), F.lit(False)).alias("first_prompt_miss"),
        F.coalesce(~F.max_by("is_user", "seq"), F.lit(False)).alias("resolved"),
        F.coalesce(F.max(F.when(F.col("user_rn") == 1, F.length("content"))), F.lit(0)).alias("first_prompt_chars"),
        F.coalesce(F.max(F.when(F.col("user_rn") == 1, T.has_any("content", lists["constraint"]))), F.lit(False)).alias("specific"),
        F.array_join(ordered(F.col("content")), "\n").alias("whole"),
        F.array_distinct(F.flatten(ordered(T.languages("content")))).alias("languages"),
        F.flatten(F.collect_list(F.coalesce("tools", F.array().cast("array<string>")))).alias("actions"),
        first_user_ts.alias("first_user_ts"),
        F.min(F.when(F.col("user_rn") == 1, F.col("seq"))).alias("first_user_seq"),
        F.array_sort(F.collect_list(F.when((F.lower("role") == "assistant") & F.col("ts").isNotNull(), F.struct("seq", "ts")))).alias("replies"),
    )
    out = sessions.join(per, "session_id", "left")
    whole = F.coalesce("whole", F.lit(""))
    reply = F.get(F.filter("replies", lambda r: r["seq"] > F.col("first_user_seq")), F.lit(0))["ts"]
    wait = F.unix_timestamp(reply) - F.unix_timestamp("first_user_ts")
    minutes = (F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")) / 60.0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select(
        "session_id", "tool", "project", "model", "started_at",
        zero("messages"), zero("user_turns"), zero("corrections"), no("first_prompt_miss"), no("resolved"), zero("first_prompt_chars"), no("specific"),
        T.has_code(whole).alias("pasted_code"),
        T.has_any(whole, lists["error"]).alias("pasted_error"),
        T.has_any(whole, lists["test"]).alias("mentions_test"),
        T.has_any(whole, lists["commit"]).alias("mentions_commit"),
        F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
        F.coalesce("actions", F.array().cast("array<string>")).alias("actions"),
        (F.coalesce("user_turns", F.lit(0)) + 2 * F.coalesce("corrections", F.lit(0))).alias("friction"),
        F.when((minutes >= 0) & (minutes <= 1440), minutes).alias("minutes"),
        F.when((wait >= 0) & (wait <= 3600), wait).alias("first_response_secs"),
    )


def work_metrics(per: DataFrame) -> DataFrame:
    """One row over all sessions of :func:`session_metrics`; zeros for none.

    A median is exact: it counts each different value, partly in each task, and turns and whole seconds within a day or an hour are no
    more than 86,401 different ones, however many sessions there are."""
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda c: F.count_if(c) / n
    whole = per.agg(
        F.count("*").alias("sessions"),
        F.count_distinct("project").alias("projects"),
        F.coalesce(F.sum("user_turns"), F.lit(0)).alias("user_turns"),
        F.coalesce(F.median("user_turns"), F.lit(0.0)).alias("median_turns"),
        F.coalesce(F.avg("user_turns"), F.lit(0.0)).alias("mean_turns"),
        share(F.col("corrections") > 0).alias("correction_rate"),
        share(F.col("first_prompt_miss")).alias("first_prompt_miss_rate"),
        share(~F.col("resolved")).alias("abandonment_rate"),
        F.coalesce(F.avg("first_prompt_chars"), F.lit(0.0)).alias("avg_first_prompt_chars"),
        share(F.col("specific")).alias("specificity_rate"),
        share(F.col("pasted_code")).alias("code_paste_rate"),
        share(F.col("pasted_error")).alias("error_paste_rate"),
        share(F.col("mentions_test")).alias("test_mention_rate"),
        share(F.col("mentions_commit")).alias("commit_mention_rate"),
        F.coalesce(F.try_divide(F.count_if(F.col("pasted_error") & F.col("resolved")), F.count_if("pasted_error")), F.lit(0.0)).alias("error_recovery_rate"),
        (F.coalesce(F.sum(F.size("actions")), F.lit(0)) / n).alias("avg_tool_actions"),
        F.count_distinct("tool").alias("tools_used"),
        F.coalesce(F.median("minutes"), F.lit(0.0)).alias("median_session_minutes"),
        F.count("minutes").alias("timed_sessions"),
        F.coalesce(F.median("first_response_secs"), F.lit(0.0)).alias("median_time_to_first_response_secs"),
    )
    days = per.where("started_at IS NOT NULL AND project IS NOT NULL").groupBy(F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("project").alias("n"))
    busy = days.agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_projects_per_active_day"))
    return whole.crossJoin(F.broadcast(busy))  # one row each


def top(per: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Most frequent values of a column, or of the elements of an array column; ties by name."""
    value = F.explode(column) if dict(per.dtypes)[column].startswith("array") else F.col(column)
    out = per.select(value.alias("value")).where("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(n) if n else out


def by_hour(per: DataFrame) -> DataFrame:
    return per.where("started_at IS NOT NULL").groupBy(F.hour("started_at").alias("hour")).agg(F.count("*").alias("n")).orderBy("hour")


def high_friction_projects(per: DataFrame, n: int = 6, least: int = 3) -> DataFrame:
    """Projects of ``least`` sessions or more by their mean number of user turns."""
    return per.where("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("sessions"), F.avg("user_turns").alias("avg_turns")).where(F.col("sessions") >= least).orderBy(F.desc("avg_turns"), "project").limit(n)


def rough_and_smooth(per: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` sessions of most friction, and the ``n`` resolved ones of least."""
    rough = per.orderBy(F.desc("friction"), "session_id").limit(n).select(F.lit("rough").alias("kind"), "session_id", "friction")
    return rough.unionByName(per.where("resolved AND messages > 0").orderBy("friction", "session_id").limit(n).select(F.lit("smooth").alias("kind"), "session_id", "friction"))


def summary(whole: DataFrame, per: DataFrame) -> str:
    """The metrics as a block of lines: one row of :func:`work_metrics`, and the most frequent tools, models and so on."""
    m = whole.first()
    pct = lambda x: f"{x * 100:.0f}%"
    named = lambda column, n: ", ".join(f"{r.value} {r.n}" for r in top(per, column, n).collect()) or "—"
    hours = by_hour(per).orderBy(F.desc("n"), F.desc("hour")).first()
    rough = ", ".join(f"{r.project} ({r.avg_turns:.1f} turns)" for r in high_friction_projects(per, 3).collect())
    lines = [
        f"Sessions analyzed: {m.sessions} across {m.projects} project(s).",
        f"Tools: {named('tool', None)}.",
        f"User turns per session: median {m.median_turns:.0f}, mean {m.mean_turns:.1f}.",
        f"Correction rate: {pct(m.correction_rate)} (first-prompt miss: {pct(m.first_prompt_miss_rate)}).",
        f"Abandoned/unresolved: {pct(m.abandonment_rate)}.",
        f"Opening prompt: avg {m.avg_first_prompt_chars:.0f} chars, {pct(m.specificity_rate)} state explicit constraints.",
        f"Pasted code: {pct(m.code_paste_rate)}; pasted errors: {pct(m.error_paste_rate)}.",
        f"Mentions tests: {pct(m.test_mention_rate)}; mentions commits/git: {pct(m.commit_mention_rate)}.",
        f"Agent actions per session: avg {m.avg_tool_actions:.1f} — top: {named('actions', 5)}.",
        f"Languages: {named('languages', 6)}.",
        f"Models: {named('model', 4)}.",
        "Median session length: " + (f"{m.median_session_minutes:.0f} min" if m.median_session_minutes > 0 else "—") + ".",
        "Time to first response: " + (f"{m.median_time_to_first_response_secs:.0f}s" if m.median_time_to_first_response_secs > 0 else "—") + ".",
        f"Error-recovery rate: {pct(m.error_recovery_rate)}.",
        f"Context switching: {m.avg_projects_per_active_day:.1f} projects/active-day.",
        f"Busiest hour: {f'{hours.hour:02d}:00' if hours else '—'}.",
        f"Highest-friction projects (avg user turns): {rough}.",
    ]
    return "\n".join(lines)
