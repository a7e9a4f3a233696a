"""Reports over metrics: trends, levers, verdicts, the optimise loop, fluency, glance, weekly review.

Metrics come as one-row DataFrames of :func:`quillmere.operators.metrics.work_metrics`; scores are expressions on them,
and every date is an argument.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import session_metrics, work_metrics

WINDOW_DAYS, GRADE_DAYS, LOG_MOST, STALE_DAYS = 30, 7, 30, 7
# Metric, label, whether lower is better, whether a share.
TREND_METRICS = [
    ("correction_rate", "Rework rate", True, True),
    ("first_prompt_miss_rate", "First-prompt miss", True, True),
    ("abandonment_rate", "Unresolved rate", True, True),
    ("specificity_rate", "Prompt specificity", False, True),
    ("test_mention_rate", "Tests mentioned", False, True),
    ("avg_projects_per_active_day", "Projects per active day", True, False),
    ("median_turns", "Median turns", True, False),
]


def window(sessions: DataFrame, now: dt.date, back: int, days: int) -> DataFrame:
    """Sessions of the ``days`` before ``back`` days ago; both ends belong to it."""
    day = F.date_format("started_at", "yyyy-MM-dd")
    return sessions.where(day.between((now - dt.timedelta(days=back + days)).isoformat(), (now - dt.timedelta(days=back)).isoformat()))


def metrics_of(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return work_metrics(session_metrics(sessions, messages.join(sessions.select("session_id"), "session_id", "left_semi")))


def trends(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(metric, label, current, previous, delta, improved, is_pct) of the seven trend metrics."""
    names = [m for m, *_ in TREND_METRICS]
    both = current.select(*[F.col(n).cast("double").alias(f"c_{n}") for n in names]).join(previous.select(*[F.col(n).cast("double").alias(f"p_{n}") for n in names]))
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.lit(label).alias("label"), F.col(f"c_{m}").alias("current"), F.col(f"p_{m}").alias("previous"), F.lit(low).alias("lower"), F.lit(pct).alias("is_pct")) for i, (m, label, low, pct) in enumerate(TREND_METRICS)])
    out = both.select(F.explode(rows).alias("r")).select("r.*")
    change = F.col("current") - F.col("previous")
    delta = F.when(F.abs("previous") > 1e-9, change / F.abs("previous")).otherwise(0.0)
    return out.select("place", "metric", "label", "current", "previous", delta.alias("delta"), (F.when(F.col("lower"), change < 0).otherwise(change > 0) & (F.abs(change) > 1e-9)).alias("improved"), "is_pct").orderBy("place").drop("place")


def levers(metrics: DataFrame) -> DataFrame:
    """(weight, lever, metric) of every lever whose threshold is crossed."""
    # Lever, metric, condition and weight.
    catalog: list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]]] = [
        ("front_load", "first_prompt_miss_rate", lambda x: x > 0.20, lambda x: x),
        ("close_loops", "abandonment_rate", lambda x: x > 0.25, lambda x: x),
        ("review_plan", "correction_rate", lambda x: x > 0.40, lambda x: x * 0.9),
        ("ask_tests", "test_mention_rate", lambda x: x < 0.15, lambda x: 0.15 - x),
        ("batch_projects", "avg_projects_per_active_day", lambda x: x > 3.0, lambda x: (x - 3.0) / 5.0),
    ]
    found = F.array(*[F.when(cond(F.col(m)), F.struct(weight(F.col(m)).cast("double").alias("weight"), F.lit(i).alias("place"), F.lit(name).alias("lever"), F.lit(m).alias("metric"))) for i, (name, m, cond, weight) in enumerate(catalog)])
    return metrics.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.weight", "x.place", "x.lever", "x.metric")


def top_lever(metrics: DataFrame) -> DataFrame:
    """The lever of most weight, of equal ones the last of the catalog; no row where no threshold is crossed."""
    return levers(metrics).orderBy(F.desc("weight"), F.desc("place")).limit(1).select("lever", "metric", "weight")


def verdict(baseline: Column, result: Column, lower_is_better: Column) -> Column:
    """A relative move of a tenth counts; from a baseline of zero any rise of what should rise is an improvement."""
    better = F.when(lower_is_better, result < baseline * 0.9).otherwise((result > baseline * 1.1) | ((baseline < 1e-9) & (result > 0)))
    worse = F.when(lower_is_better, result > baseline * 1.1).otherwise(result < baseline * 0.9)
    return F.when(better, "improved").when(worse, "regressed").otherwise("no clear change")


def optimise(state: dict | None, metrics: dict, lever: dict | None, now: dt.date, force: bool = False) -> dict:
    """One step of the loop: grade what was prescribed (after a week, or when forced), log it, prescribe anew.

    ``state`` {active: {lever, metric, baseline, since} or None, log: […]}; the log keeps the last 30 entries."""
    state = {"active": None, "log": []} | (state or {})
    active, low = state["active"], {m: lower for m, _, lower, _ in TREND_METRICS}
    if active and not force and (now - dt.date.fromisoformat(active["since"])).days < GRADE_DAYS:
        return state
    if active:
        b, r, lower = active["baseline"], metrics[active["metric"]], low[active["metric"]]
        better = r < b * 0.9 if lower else r > b * 1.1 or (b < 1e-9 and r > 0)
        worse = r > b * 1.1 if lower else r < b * 0.9
        entry = active | {"result": r, "until": now.isoformat(), "verdict": "improved" if better else "regressed" if worse else "no clear change"}
        state = state | {"log": [*state["log"], entry][-LOG_MOST:]}
    new = {"lever": lever["lever"], "metric": lever["metric"], "baseline": metrics[lever["metric"]], "since": now.isoformat()} if lever else None
    return state | {"active": new}


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _up(c: str, low: float, high: float) -> Column:
    return _clamp((F.col(c) - low) / (high - low))


def _down(c: str, low: float, high: float) -> Column:
    return _clamp((high - F.col(c)) / (high - low))


def fluency(metrics: DataFrame) -> DataFrame:
    """(delegation, description, discernment, diligence, overall), each 0 to 100."""
    breadth = F.when(F.col("avg_tool_actions") > 0, _up("avg_tool_actions", 0, 8)).otherwise(_up("tools_used", 1, 3))
    tests = _up("test_mention_rate", 0, 0.4)
    parts = {
        "delegation": (breadth + _down("avg_projects_per_active_day", 1, 5)) / 2,
        "description": (_up("specificity_rate", 0, 0.5) + _down("first_prompt_miss_rate", 0, 0.4)) / 2,
        "discernment": (_down("correction_rate", 0, 0.6) + _down("abandonment_rate", 0, 0.5)) / 2,
        "diligence": F.when(F.col("error_paste_rate") >= 0.05, (tests * 2 + _clamp(F.col("error_recovery_rate"))) / 3).otherwise(tests),
    }
    out = metrics.select(*[F.round(x * 100).cast("int").alias(n) for n, x in parts.items()])
    return out.withColumn("overall", F.round(sum((F.col(n) for n in parts), F.lit(0)) / 4.0).cast("int"))


def fluency_report(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(dimension, score, delta): delta null where the previous window has no sessions."""
    names = ["delegation", "description", "discernment", "diligence"]
    now, before = fluency(current), fluency(previous).join(previous.select("sessions")).select(*[F.when(F.col("sessions") > 0, F.col(n)).alias(f"p_{n}") for n in names])
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("dimension"), F.col(n).alias("score"), (F.col(n) - F.col(f"p_{n}")).alias("delta")) for i, n in enumerate(names)])
    return now.join(before).select(F.explode(rows).alias("r")).select("r.*").orderBy("place").drop("place")


def weakest(report: DataFrame) -> DataFrame:
    """(dimension, score) of the lowest score of :func:`fluency_report`; of equal ones the first."""
    names = F.array(*[F.lit(n) for n in ("delegation", "description", "discernment", "diligence")])
    return report.orderBy("score", F.array_position(names, F.col("dimension"))).limit(1).select("dimension", "score")


def unresolved(week: DataFrame) -> DataFrame:
    """(unresolved): how many sessions of a week's metrics ended without an answer."""
    return week.select(F.round(F.col("abandonment_rate") * F.col("sessions")).cast("long").alias("unresolved"))


def reflection(metrics: DataFrame) -> DataFrame:
    """(dimension) of the first open question that the data raise; null for none."""
    m = F.col
    first = (
        F.when((m("avg_tool_actions") >= 4.0) & (m("test_mention_rate") < 0.15), "diligence")
        .when(m("avg_projects_per_active_day") > 3.0, "delegation")
        .when(m("correction_rate") > 0.40, "discernment")
        .when(m("first_prompt_miss_rate") > 0.20, "description")
    )
    return metrics.select(first.alias("dimension"))


def glance(sessions: DataFrame, now: dt.date) -> DataFrame:
    """(tool, today, week, month, per_day): sessions of the day, of the last 7 and 30 days, the busiest first."""
    day = F.to_date("started_at")
    since = lambda n: day.between(now - dt.timedelta(days=n), now)
    out = sessions.where(since(WINDOW_DAYS)).groupBy("tool").agg(F.count_if(day == now).alias("today"), F.count_if(since(7)).alias("week"), F.count("*").alias("month"))
    return out.withColumn("per_day", F.col("month") / F.lit(float(WINDOW_DAYS))).orderBy(F.desc("today"), F.desc("week"), "tool")


def quota(sidecar: DataFrame, now: Column) -> DataFrame:
    """Quota rows that are valid and at most a day past their reset."""
    return sidecar.where(F.col("used").between(0, 100) & (F.col("resets_at") + F.expr("INTERVAL 24 HOURS") >= now))


def weekly_review(cache: dict | None, now: dt.date, sessions: int, summary: str, corpus: str = "", write: Callable[[str], str] | None = None, force: bool = False) -> dict:
    """The review of the seven days before ``now``, from the cache while that is less than a week old.

    ``write`` may be a model, which gets the figures and samples; without one, or where it fails, the figures stand.  The
    period is named by its first day."""
    if cache and not force and (now - dt.date.fromisoformat(cache["made"])).days < STALE_DAYS:
        return cache
    text, by_model = "No sessions in the last 7 days — nothing to review.", False
    if sessions:
        text = f"## This week, by the numbers\n\n{summary}"
        if write is None:
            text += "\n\n_Give a model for a review in words and a suggestion._"
        else:
            try:
                asked = f"Metrics of the last 7 days:\n\n{summary}\n\nSome of the sessions:\n{corpus}\n\nWrite a short weekly review in Markdown: what was worked on, how (with two or three of the figures), and one thing to try next week."
                text, by_model = write(asked), True
            except Exception:  # noqa: BLE001  the figures stand where the model fails
                pass
    return {"made": now.isoformat(), "period": (now - dt.timedelta(days=STALE_DAYS)).isoformat(), "text": text, "by_model": by_model}


def deliver(review: dict, folder: str, delivered: str | None, put: Callable[[str, str], None]) -> tuple[str, bool]:
    """The review as ``weekly-<period>.md`` in ``folder``, written anew each time, and whether its period had been ``delivered``."""
    path = f"{folder.rstrip('/')}/weekly-{review['period']}.md"
    put(path, review["text"])
    return path, delivered == review["period"]
