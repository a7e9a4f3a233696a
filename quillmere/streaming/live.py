"""Live session state from hook events, as a batch expression and as a stream with timers.

Events (path, event, message, ts).  An event may set a state; a running session that is quiet for 20 minutes is idle by
inference, and a session is forgotten 12 hours after its last event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

QUIET_MINUTES, FORGET_HOURS, ACTIVE_HOURS, INFER_SECONDS = 20, 12, 24, 45
# What an event makes of a session.
STATES = {
    "sessionstart": "idle", "userpromptsubmit": "running", "pretooluse": "running", "posttooluse": "running", "stop": "idle", "sessionend": "ended",
    "roomlisten": "listening", "roomwake": "running",
}
OUTPUT = "path string, state string, since timestamp, seen timestamp, inferred boolean"


def transition(event: Column, message: Column) -> Column:
    """The state an event sets; null where it sets none."""
    kind, text = F.lower(event), F.lower(F.coalesce(message, F.lit("")))
    asked = F.when(text.contains("permission") | text.contains("approv"), "needs_you").when(text.contains("waiting for your input"), "idle")
    out = F.when(kind == "notification", asked)
    for name, state in STATES.items():
        out = out.when(kind == name, state)
    return out


def next_state(event: str, message: str | None) -> str | None:
    kind, text = event.lower(), (message or "").lower()
    if kind != "notification":
        return STATES.get(kind)
    return "needs_you" if "permission" in text or "approv" in text else "idle" if "waiting for your input" in text else None


def live_states(events: DataFrame, now: Column) -> DataFrame:
    """(path, state, since, seen, inferred) of each session as of ``now``; a session starts idle, also after it was forgotten."""
    rows = events.where(F.trim(F.coalesce("path", F.lit(""))) != "").where(F.col("ts") <= now)
    w = Window.partitionBy("path").orderBy("ts", "event")
    gap = F.col("ts") - F.expr(f"INTERVAL {FORGET_HOURS} HOURS") >= F.lag("ts").over(w)
    rows = rows.withColumn("life", F.sum(F.when(gap, 1).otherwise(0)).over(w)).withColumn("sets", transition(F.col("event"), F.col("message")))
    rows = rows.withColumn("life_now", F.max("life").over(Window.partitionBy("path"))).where("life = life_now")
    in_order = Window.partitionBy("path").orderBy("ts", "event")
    state = F.coalesce(F.last("sets", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("idle"))
    rows = rows.withColumn("state", state).withColumn("changed", ~F.col("state").eqNullSafe(F.lag("state").over(in_order)))
    last = rows.groupBy("path").agg(F.max_by("state", F.struct("ts", "event")).alias("state"), F.max(F.when(F.col("changed"), F.col("ts"))).alias("since"), F.max("ts").alias("seen"))
    last = last.where(F.col("seen") + F.expr(f"INTERVAL {FORGET_HOURS} HOURS") > now)
    quiet = (F.col("state") == "running") & (F.col("seen") + F.expr(f"INTERVAL {QUIET_MINUTES} MINUTES") < now)
    return last.select("path", F.when(quiet, "idle").otherwise(F.col("state")).alias("state"), F.when(quiet, F.col("seen")).otherwise(F.col("since")).alias("since"), "seen", quiet.alias("inferred"))


# Tools that keep a file for each session, whose time of change says something about it.
FILE_TOOLS = ["claude-code", "codex", "gemini", "grok"]


def inferred_running(sessions: DataFrame, files: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """(path, state, since, seen, inferred) of sessions without a live state that must be running: active within a day, in a tool
    with a file for each session, and that file changed within 45 seconds.

    ``sessions`` (path, tool, last_activity), ``files`` (path, modificationTime), ``live`` (path, …)."""
    recent = sessions.where(F.col("tool").isin(FILE_TOOLS) & (F.col("last_activity") + F.expr(f"INTERVAL {ACTIVE_HOURS} HOURS") >= now)).select("path").distinct()
    fresh = files.where(F.col("modificationTime") + F.expr(f"INTERVAL {INFER_SECONDS} SECONDS") >= now).select("path", F.col("modificationTime").alias("seen"))
    found = recent.join(fresh, "path").join(live.select("path"), "path", "left_anti")
    return found.select("path", F.lit("running").alias("state"), F.col("seen").alias("since"), "seen", F.lit(True).alias("inferred"))


HELD = "state string, since timestamp, seen timestamp"
EVENT = "event string, message string, ts timestamp"


@dataclass(frozen=True)
class Live:
    """A session's state as of its last event; none before the first."""

    state: str | None = None
    since: pd.Timestamp | None = None
    seen: pd.Timestamp | None = None

    def after(self, event: str, message: str | None, ts: pd.Timestamp) -> Live:
        forgotten = self.seen is None or (ts - self.seen).total_seconds() >= FORGET_HOURS * 3600
        new = next_state(event, message)
        if forgotten or self.state is None:
            return Live(new or "idle", ts, ts)
        return Live(new, ts, ts) if new and new != self.state else Live(self.state, self.since, ts)

    def row(self) -> tuple:
        return self.state, self.since.to_pydatetime(), self.seen.to_pydatetime()  # type: ignore[union-attr]

    @classmethod
    def of(cls, row: tuple | None) -> Live:
        return cls(row[0], pd.Timestamp(row[1]), pd.Timestamp(row[2])) if row else cls()

    def as_of(self, now: float) -> tuple[str, pd.Timestamp, bool] | None:
        """(state, since, inferred) at ``now`` (ms): idle where a running one has been quiet, None where it is forgotten."""
        if self.state is None or now >= self.until(FORGET_HOURS * 60):
            return None
        if self.state == "running" and now > self.until(QUIET_MINUTES):
            return "idle", self.seen, True  # type: ignore[return-value]
        return self.state, self.since, False  # type: ignore[return-value]

    def until(self, minutes: int) -> float:
        return self.seen.timestamp() * 1000 + minutes * 60_000  # type: ignore[union-attr]


def replayed(base: Live, pending: list[tuple], watermark: float) -> tuple[Live, list[tuple], Live]:
    """What is settled, what is not, and the state after all: events before the ``watermark`` (ms) come no more, so those are
    folded into ``base``; later ones are kept in order, since others may still come between them."""
    pending = sorted(pending, key=lambda e: (e[2], e[0]))
    settled = [e for e in pending if e[2].timestamp() * 1000 < watermark]
    for e in settled:
        base = base.after(*e)
    now, rest = base, pending[len(settled) :]
    for e in rest:
        now = now.after(*e)
    return base, rest, now


def _events(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows))


def _tuples(events: pd.DataFrame) -> list[tuple]:
    return [(e, None if m is None or m != m else m, pd.Timestamp(t)) for e, m, t in events[["event", "message", "ts"]].itertuples(index=False)]


class LiveProcessor(StatefulProcessor):
    """The same machine over a stream keyed by path, whatever order events arrive in within the watermark: event-time timers make
    quiet sessions idle and forget old ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("live", HELD)
        self.pending = handle.getListState("pending", EVENT)

    def _held(self) -> tuple[Live, list[tuple]]:
        waiting = [(e, m, pd.Timestamp(t)) for e, m, t in self.pending.get()] if self.pending.exists() else []
        return Live.of(self.base.get() if self.base.exists() else None), waiting

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        base, waiting = self._held()
        base, waiting, now = replayed(base, waiting + _tuples(_events(rows)), timerValues.getCurrentWatermarkInMs())
        if base.state is not None:
            self.base.update(base.row())
        if waiting:
            self.pending.put([(e, m, t.to_pydatetime()) for e, m, t in waiting])
        else:
            self.pending.clear()
        _timers(self.handle, [now])
        yield self._row(key, now.state, now.since, now.seen, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = replayed(*self._held(), 0)[2]
        if now.state is None:
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        found = now.as_of(at)
        if found is None:
            self.base.clear()
            self.pending.clear()
            yield self._row(key, "forgotten", now.seen, now.seen, True)
        elif found[2]:
            yield self._row(key, *found[:2], now.seen, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: Any, state: Any, since: Any, seen: Any, inferred: bool) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "state": [state], "since": [pd.Timestamp(since)], "seen": [pd.Timestamp(seen)], "inferred": [inferred]})


def _timers(handle: StatefulProcessorHandle, lives: list[Live]) -> None:
    """Wake up when a running session has been quiet for long enough, and when one is to be forgotten."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    times = {int(x.until(FORGET_HOURS * 60)) for x in lives} | {int(x.until(QUIET_MINUTES)) + 1 for x in lives if x.state == "running"}
    for t in sorted(times):
        handle.registerTimer(t)


def live_stream(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """The states of a stream of events as they change; events later than ``delay`` are not waited for."""
    keyed = events.where(F.trim(F.coalesce("path", F.lit(""))) != "").withWatermark("ts", delay).groupBy("path")
    return keyed.transformWithStateInPandas(LiveProcessor(), OUTPUT, "Update", "EventTime")


URGENCY = {"needs_you": 3, "running": 2, "listening": 1, "idle": 1}
THREAD_OUTPUT = "thread_id string, state string, path string, seen timestamp"


def most_urgent(states: list[tuple[str, str]]) -> tuple[str, str] | None:
    """Of (path, state) the most pressing; of equals the largest path."""
    return max(((s, p) for p, s in states), key=lambda x: (URGENCY.get(x[0], 0), x[1]), default=None)


class ThreadProcessor(StatefulProcessor):
    """The most urgent state of each thread: all its sessions' machines in one keyed state, so that a thread falls back when the
    session that pressed it does, by an event or by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bases = handle.getMapState("bases", "path string", HELD)
        self.waiting = handle.getMapState("waiting", "path string", f"events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>")
        self.told = handle.getValueState("told", "state string, path string")

    def _sessions(self) -> dict[str, tuple[Live, list[tuple]]]:
        bases = {k[0]: Live.of(v) for k, v in self.bases.iterator()} if self.bases.exists() else {}
        waiting = {k[0]: [(e[0], e[1], pd.Timestamp(e[2])) for e in v[0]] for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        return {p: (bases.get(p, Live()), waiting.get(p, [])) for p in {*bases, *waiting}}

    def _tell(self, key: Any, lives: dict[str, Live], at: float) -> Iterator[pd.DataFrame]:
        found = most_urgent([(p, s[0]) for p, x in lives.items() if (s := x.as_of(at))])
        told = tuple(self.told.get()) if self.told.exists() else None
        seen = max((x.seen for x in lives.values() if x.seen is not None), default=pd.NaT)
        if found != told:
            if found:
                self.told.update(found)
            else:
                self.told.clear()
            state, path = found or ("forgotten", None)
            yield pd.DataFrame({"thread_id": [key[0]], "state": [state], "path": [path], "seen": [seen]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, new, lives = self._sessions(), _events(rows), {}
        came = {p: _tuples(x) for p, x in new.groupby("path")}
        for path in {*held, *came}:
            base, waiting = held.get(path, (Live(), []))
            base, waiting, lives[path] = replayed(base, waiting + came.get(path, []), timerValues.getCurrentWatermarkInMs())
            if base.state is not None:
                self.bases.updateValue((path,), base.row())
            if waiting:
                self.waiting.updateValue((path,), ([(e, m, t.to_pydatetime()) for e, m, t in waiting],))
            elif path in held:
                self.waiting.removeKey((path,))
        _timers(self.handle, list(lives.values()))
        # as of the last event that is known of the thread
        yield from self._tell(key, lives, max(x.seen.timestamp() * 1000 for x in lives.values()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        lives = {p: replayed(*x, 0)[2] for p, x in self._sessions().items()}
        yield from self._tell(key, lives, max([at, *(x.seen.timestamp() * 1000 for x in lives.values() if x.seen is not None)]))
        for path, x in lives.items():
            if x.as_of(at) is None:
                self.bases.removeKey((path,))
                self.waiting.removeKey((path,))

    def close(self) -> None:
        pass


def urgency_stream(events: DataFrame, membership: DataFrame, delay: str = "24 hours") -> DataFrame:
    """(thread_id, state, path, seen): the most urgent state of each thread whenever it changes, ``forgotten`` where none is left.

    ``events`` is a stream, ``membership`` (path, thread_id) a table; what belongs to no thread is left out."""
    known = events.where(F.trim(F.coalesce("path", F.lit(""))) != "").join(membership.select("path", "thread_id"), "path")
    return known.withWatermark("ts", delay).groupBy("thread_id").transformWithStateInPandas(ThreadProcessor(), THREAD_OUTPUT, "Update", "EventTime")


def deduplicated(messages: DataFrame, delay: str = "24 hours") -> DataFrame:
    """A stream of relayed messages, each (device, origin_seq) once."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["device", "origin_seq"])
