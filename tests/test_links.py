"""Copied content by winnowed hashes, chains of links in few rounds, candidates of very long sessions, late events, urgency as a stream."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere import schema
from quillmere.functions.winnow import GRAM, LEAST, WINDOW, fingerprints, rolling, winnowed
from quillmere.operators import threads
from quillmere.operators.components import smallest
from quillmere.operators.shared import urgency
from quillmere.store import cut
from quillmere.streaming import live

NOW = dt.datetime(2026, 1, 1, 12, 0)


# ---------------------------------------------------------------- winnowing


def test_rolling_hashes_depend_on_the_characters_alone():
    rng = random.Random(1)
    text = "".join(rng.choice("abé ü\U0001f600") for _ in range(500))
    whole = rolling(text)
    assert len(whole) == 500 - GRAM + 1 and len(rolling("x" * (GRAM - 1))) == 0
    for at in (0, 1, 77, 460):
        assert rolling(text[at : at + GRAM])[0] == whole[at]
    assert len(set(rolling("abcdefghij" * 30).tolist())) == 10


def test_what_two_texts_share_has_the_same_fingerprint():
    rng = random.Random(2)
    for _ in range(60):
        shared = "".join(rng.choice("ab ") for _ in range(rng.randint(LEAST, 160)))
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(0, 300))) for _ in range(2))
        hashes, places = winnowed(shared[:LEAST])
        assert len(hashes) == 1
        found = dict(zip(*(x.tolist() for x in reversed(winnowed(a + shared + b))), strict=True))
        assert any(h == hashes[0] and p - places[0] == len(a) for p, h in found.items())
    assert len(winnowed("")[0]) == len(winnowed(None)[0]) == 0


def test_fingerprints_are_few(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(20_000))
    n = spark.createDataFrame([(text,)], "t string").select(F.size(fingerprints("t"))).first()[0]
    assert 20_000 / WINDOW < n < 3 * 20_000 / WINDOW


# ---------------------------------------------------------------- containment


def said(conversation, seq, role, content, minutes):
    return (conversation, seq, role, content, NOW + dt.timedelta(minutes=minutes))


def test_copied_content_is_found_without_a_scan_of_every_opening(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(14, 60)))
    lines = {c: [line() for _ in range(8)] for c in ("a", "b", "c")}
    sessions, messages = [], []
    for i, (c, ls) in enumerate(lines.items()):
        sessions.append((f"s{c}", c, "r", "x", NOW + dt.timedelta(minutes=i * 10), NOW + dt.timedelta(minutes=i * 10 + 9)))
        messages += [said(c, j, "assistant" if j % 2 else "user", t, i * 10 + j) for j, t in enumerate(ls)]
    openings = {
        "whole": " ".join(lines["a"]), "case and space": "\n\n".join(t.upper().replace(" ", "  ") for t in lines["b"][2:]), "half": " ".join(lines["c"][5:]) + line(), "one": lines["a"][7],
        "twice": lines["b"][7] * 2 + lines["b"][5] + lines["b"][3] + lines["b"][1], "none": line(), "cut": " ".join(t[:70] for t in lines["a"]),
    }
    for i, (name, text) in enumerate(openings.items()):
        sessions.append((f"l{i}", f"o{i}", "r", "x", NOW + dt.timedelta(minutes=60 + i), NOW + dt.timedelta(minutes=90)))
        messages.append(said(f"o{i}", 0, "user", text, 60 + i))
    s = spark.createDataFrame(sessions, "session_key string, conversation_id string, repo_key string, tool string, started_at timestamp, last_activity timestamp")
    m = spark.createDataFrame(messages, "conversation_id string, seq int, role string, content string, ts timestamp")
    later = s.where("session_key LIKE 'l%'")
    found = threads.link_candidates(later, s)
    prints = threads.tail_fingerprints(found, m)
    texts = threads.opening_text(m).withColumnRenamed("conversation_id", "later_conversation")
    got = {(r.later, r.earlier, r.place) for r in threads.contained(prints, texts).collect()}
    want = {(r.later, r.earlier, r.place) for r in prints.join(texts, "later_conversation").where(F.contains("opening", F.col("print"))).collect()}
    assert got == want and len(want) > 15
    links = threads.detect_links(later, s, m)
    assert {(r.later, r.earlier) for r in links.collect() if r.applied} == {("l0", "sa"), ("l1", "sb"), ("l4", "sb")}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    one, other = links.where("applied").select(F.col("earlier").alias("a"), F.col("later").alias("b")).where("b = 'l0'"), spark.createDataFrame([("l1", "sb")], "a string, b string")
    assert {(r.later, r.earlier) for r in threads.detect_links(later, s, m, one, other).collect() if r.applied} == {("l4", "sb")}


def test_sessions_that_go_on_for_years_are_candidates(spark):
    day = lambda n: NOW + dt.timedelta(days=n)
    rows = [("long", "r", day(0), day(2000)), ("wrong", "r", day(5), day(-5)), ("late", "r", day(1500), day(1500)), ("other", "q", day(1500), day(1500)), ("after", "r", day(2001), day(2002)), ("gone", "r", day(2002), day(2002))]
    s = spark.createDataFrame([(k, k, r, "t", a, b) for k, r, a, b in rows], "session_key string, conversation_id string, repo_key string, tool string, started_at timestamp, last_activity timestamp")
    found = {(r.later, r.earlier) for r in threads.link_candidates(s, s).collect()}
    assert found == {("wrong", "long"), ("late", "long"), ("after", "long"), ("gone", "after")}


# ---------------------------------------------------------------- chains


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = rng.integers(0, 60, (45, 2)).tolist()
    up = list(range(60))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    found = {r.node: r.root for r in smallest(spark.createDataFrame(links, "u long, v long"), cut).collect()}
    assert found == {i: find(i) for i in {x for p in links for x in p}}


def test_a_chain_of_a_thousand_takes_few_rounds(spark, tmp_path):
    """Sessions that were continued a thousand times; the rounds are those of its logarithm, not of its length."""
    n, rounds = 1000, []
    order = list(range(n))
    random.Random(5).shuffle(order)  # names say nothing about time
    key = lambda i: f"k{order[i]:04d}"

    def keep(df):
        rounds.append(1)
        path = str(tmp_path / str(len(rounds)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    members = spark.createDataFrame([(key(i), f"th_{key(i)}", NOW + dt.timedelta(hours=i)) for i in range(n)], "session_key string, thread_id string, started_at timestamp")
    found = spark.createDataFrame([(key(i), key(i - 1), "continued", 0.9, True) for i in range(1, n)], "later string, earlier string, kind string, confidence double, applied boolean")
    none = threads.State(*(spark.createDataFrame([], x) for x in (schema.THREADS, schema.MEMBERSHIP, schema.LINKS, schema.REJECTIONS)))
    state = threads.apply_links(none, members, found, keep)
    assert {r.thread_id for r in state.membership.collect()} == {f"th_{key(0)}"} and state.membership.count() == n
    assert len(rounds) < 20


# ---------------------------------------------------------------- streams


def event(path, name, minutes, message=None):
    return (path, name, message, NOW + dt.timedelta(minutes=minutes))


def run(spark, tmp_path, name, events, make, batches):
    """The last rows that a stream gives, its events in so many micro-batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / name
    for i in range(batches):
        spark.createDataFrame(events[i::batches], schema.HOOK_EVENTS).coalesce(1).write.mode("append").parquet(str(source / "in"))
    stream = spark.readStream.schema(schema.HOOK_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source / "in"))
    out = []
    q = make(stream).writeStream.foreachBatch(lambda df, i: out.extend((i, *r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(source / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_late_events_do_not_overwrite_later_ones(spark, tmp_path):
    rng = random.Random(6)
    names = ["UserPromptSubmit", "Notification", "Stop", "PreToolUse", "SessionStart", "RoomListen"]
    events = [event(f"p{i % 4}", rng.choice(names), -300 + i * 5, rng.choice(["needs permission", "hello", None])) for i in range(40)]
    rng.shuffle(events)
    rows = run(spark, tmp_path, "late", events, live.live_stream, 4)
    last = {}
    for _, path, state, since, _, _ in rows:
        last[path] = state, since
    df = spark.createDataFrame(events, schema.HOOK_EVENTS)
    now = max(e[3] for e in events)
    # what is quiet is told by timers, which wait for the watermark
    want = {r.path: r.state for r in live.live_states(df, F.lit(now)).where("NOT inferred").collect()}
    assert want and {p: s for p, (s, _) in last.items() if p in want} == want


def test_urgency_follows_the_sessions_of_a_thread(spark, tmp_path):
    members = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("c", "t2"), ("d", "t2")], "path string, thread_id string")
    events = [
        event("a", "UserPromptSubmit", -19), event("b", "Notification", -18, "please approve"), event("b", "PostToolUse", -15), event("c", "SessionStart", -14), event("d", "Stop", -13),
        event("b", "Stop", -12), event("x", "PreToolUse", -11), event("a", "Notification", -10, "permission"), event("a", "Stop", -5), event("c", "PreToolUse", -4), event(None, "Stop", -3), event("d", "SessionEnd", -2),
    ]
    shuffled = events[:]
    random.Random(9).shuffle(shuffled)
    ranked = spark.createDataFrame(events, schema.HOOK_EVENTS)
    states = live.live_states(ranked, F.lit(NOW - dt.timedelta(minutes=2))).join(members, "path")
    want = {r.thread_id: r.state for r in states.groupBy("thread_id").agg(F.max_by("state", F.struct(urgency(F.col("state")), "path")).alias("state")).collect()}
    for name, given, batches in (("in order", events, 12), ("shuffled", shuffled, 3)):
        given = given if batches == 3 else [e for i in range(12) for e in [given[i]]]
        rows = run(spark, tmp_path, name.replace(" ", "_"), given, lambda s: live.urgency_stream(s, members), batches)
        last = {r[1]: r[2] for r in rows}
        assert last == want == {"t1": "idle", "t2": "running"}
        if batches == 12:  # it pressed, and fell back
            assert [r[2] for r in rows if r[1] == "t1"] == ["running", "needs_you", "running", "running", "needs_you", "idle"]  # the fourth by another session


def test_a_thread_is_forgotten_with_its_last_session(spark, tmp_path):
    members = spark.createDataFrame([("a", "t1"), ("b", "t2")], "path string, thread_id string")
    events = [event("a", "PreToolUse", 0), event("b", "Stop", 10), event("b", "Stop", 40), event("b", "Stop", 14 * 60), event("b", "Stop", 14 * 60 + 1)]
    rows = run(spark, tmp_path, "gone", events, lambda s: live.urgency_stream(s, members, "1 minute"), 5)
    assert [r[2] for r in rows if r[1] == "t1"] == ["running", "idle", "forgotten"]


def test_states_replayed_from_the_middle_are_those_of_the_whole():
    rng = random.Random(7)
    names = ["UserPromptSubmit", "Notification", "Stop", "PreToolUse"]
    import pandas as pd

    events = [(rng.choice(names), rng.choice(["permission", None]), pd.Timestamp(NOW) + pd.Timedelta(hours=i * 3 + rng.random())) for i in range(30)]
    whole = live.replayed(live.Live(), events, 0)[2]
    base, waiting = live.Live(), []
    for cut in range(0, 30, 7):
        come = events[cut : cut + 7]
        rng.shuffle(come)
        base, waiting, now = live.replayed(base, waiting + come, come[0][2].timestamp() * 1000 - 10_000_000)
    assert now == whole and len(waiting) < 30
