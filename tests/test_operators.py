import collections
import dataclasses
import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere import schema
from quillmere.operators import activity, ingest, metrics, rooms, search, shared, themes, threads
from quillmere.plans import context, reports
from quillmere.streaming.ingest import sizes


def t(minutes, day=1):
    return dt.datetime(2026, 1, day) + dt.timedelta(minutes=minutes)


# ---- search

CORPUS = [("c1", 0, "the parser fails on unicode input", "codex", "p/one"), ("c1", 1, "parser parser fixed", "codex", "p/one"), ("c2", 0, "a parser for dates", "aider", "p/two"), ("c3", 0, "nothing to see", "codex", None), ("c4", 0, None, "codex", "x")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "conversation_id string, seq int, content string, tool string, project string")


def test_keyword_search_ranks_and_collapses(corpus):
    out = search.keyword_search(corpus, "Parser!", 10).collect()
    assert [(r.conversation_id, r.seq) for r in out] == [("c1", 1), ("c2", 0)] and out[0].score > out[1].score > 0
    assert [r.conversation_id for r in search.keyword_search(corpus, "parser fails", 10).collect()] == ["c1"]
    assert search.keyword_search(corpus, " -- ", 10).collect() == []
    assert [r.conversation_id for r in search.keyword_search(corpus, "parser", 10, search.Filters(tool="aider", project="two")).collect()] == ["c2"]


def test_index_gives_the_same_scores(corpus):
    direct = {(r.conversation_id, r.seq): r.score for r in search.bm25(corpus, "parser fails").collect()}
    index, lengths = search.postings(corpus).withColumn("bucket", search.bucket(F.col("term"))), sizes(corpus)
    found = lambda q: {(r.conversation_id, r.seq): pytest.approx(r.score) for r in search.bm25_from_postings(index, lengths, q).collect()}
    assert found("parser fails") == direct and direct and found("nowhere") == found("--") == {}
    plain = collections.Counter((r.conversation_id, r.seq, w) for r in corpus.select("conversation_id", "seq", F.explode(search.T.tokens("content")).alias("w")).collect() for w in [r.w])
    assert {(r.conversation_id, r.seq, r.term): r.tf for r in index.collect()} == dict(plain)
    some = corpus.where("tool = 'aider'")
    assert [tuple(r) for r in search.indexed_search(index, lengths, "parser", 5, some).collect()] == [pytest.approx(tuple(r)) for r in search.keyword_search(some, "parser", 5).collect()]


def test_search_of_devices_names_those_that_fail(spark):
    hits = spark.createDataFrame([("x", 1, 9.0)], "conversation_id string, seq int, score double")

    def broken():
        raise OSError("gone")

    found, lost = search.federated_search({"a": lambda: hits, "b": broken, "c": lambda: hits.where("raise_error('no') is null")}, 5)
    assert [(r.conversation_id, r.device) for r in found.collect()] == [("x", "a")] and lost == ["b", "c"]
    assert search.federated_search({"a": lambda: hits, "b": broken}, 5, ["b"]) == (None, ["b"])


def test_semantic_floor_and_needle(spark):
    rng = np.random.default_rng(0)
    q = np.zeros(16)
    q[0] = 1
    noise = [(f"n{i}", 0, np.concatenate([[0.0], rng.standard_normal(15)]).tolist()) for i in range(2000)]
    df = spark.createDataFrame([*noise, ("needle", 3, (q + 0.1).tolist()), ("zero", 0, [0.0] * 16)], "conversation_id string, seq int, embedding array<double>")
    assert [(r.conversation_id, r.seq) for r in search.semantic_search(df, q.tolist(), 5).collect()] == [("needle", 3)]


def test_fusion_prefers_what_both_lists_have(spark):
    hits = lambda *xs: spark.createDataFrame([(c, s, v) for c, s, v in xs], "conversation_id string, seq int, score double")
    a, b = hits(("x", 1, 9.0), ("y", 2, 8.0)), hits(("y", 5, 0.9), ("z", 0, 0.8))
    out = search.rrf([a, b]).collect()
    assert [(r.conversation_id, r.seq) for r in out] == [("y", 2), ("x", 1), ("z", 0)] and math.isclose(out[0].score, 1 / 61 + 1 / 60)
    fed = search.federated([("d1", a), ("d2", b)]).collect()
    assert [(r.conversation_id, r.device) for r in fed] == [("y", "d1"), ("x", "d1"), ("z", "d2")] and math.isclose(fed[0].score, 1 / 62 + 1 / 61)


def test_snippet_marks_hits(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " parser " + " ".join(f"v{i}" for i in range(40))
    out = spark.createDataFrame([(text,)], "content string").select(search.snippet("content", "parser", start="[", end="]").alias("s")).first().s
    assert out.startswith("…") and out.endswith("…") and "[parser]" in out and len(out.strip("…").split()) == 12


def test_serving_hides_tools_and_projects(corpus):
    assert [r.conversation_id for r in search.served(corpus, ["aider"], ["one"]).collect()] == ["c3", "c4"]


# ---- metrics

SESSIONS = [("s1", "codex", "p", "m", t(0), t(30)), ("s2", "aider", "p", None, t(0, 2), t(-5, 2)), ("s3", "codex", "q", "m", None, None), ("s4", "codex", "p", "m", t(0, 3), t(2000, 3))]
MESSAGES = [
    ("s1", 0, "user", "You must fix the Error\n```python\nx\n```", t(0), None), ("s1", 1, "assistant", "done", t(2), ["edit", "run"]), ("s1", 2, "user", "no, actually undo", t(3), None), ("s1", 3, "assistant", "ok", t(4), ["edit"]),
    ("s2", 0, "human", "write a pytest, then git push", None, None), ("s2", 1, "user", "revert", None, None), ("s4", 0, "assistant", "hello", t(0, 3), None), ("s4", 1, "user", "x" * 3000 + " must", t(200, 3), None), ("s4", 2, "assistant", "bye", t(201, 3), None),
]


@pytest.fixture(scope="module")
def per(spark):
    s = spark.createDataFrame(SESSIONS, "session_id string, tool string, project string, model string, started_at timestamp, ended_at timestamp")
    m = spark.createDataFrame(MESSAGES, "session_id string, seq int, role string, content string, ts timestamp, tools array<string>")
    return metrics.session_metrics(s, m).cache()


def test_session_metrics(per):
    r = {x.session_id: x for x in per.collect()}
    assert (r["s1"].user_turns, r["s1"].corrections, r["s1"].first_prompt_miss, r["s1"].resolved, r["s1"].specific, r["s1"].pasted_code, r["s1"].pasted_error, r["s1"].languages, r["s1"].friction, r["s1"].minutes, r["s1"].first_response_secs) == (2, 1, True, True, True, True, True, ["python"], 4, 30.0, 120)
    assert sorted(r["s1"].actions) == ["edit", "edit", "run"] and r["s1"].first_prompt_chars == len(MESSAGES[0][3])
    assert (r["s2"].user_turns, r["s2"].corrections, r["s2"].resolved, r["s2"].mentions_test, r["s2"].mentions_commit, r["s2"].minutes) == (2, 1, False, True, True, None)
    assert (r["s3"].messages, r["s3"].resolved, r["s3"].user_turns, r["s3"].friction) == (0, False, 0, 0)
    assert (r["s4"].minutes, r["s4"].specific, r["s4"].first_prompt_chars, r["s4"].first_response_secs) == (None, False, 2000, 60)


def test_work_metrics(spark, per):
    m = metrics.work_metrics(per).first()
    assert (m.sessions, m.projects, m.user_turns, m.median_turns, m.correction_rate, m.abandonment_rate, m.error_recovery_rate, m.avg_tool_actions, m.median_session_minutes, m.avg_projects_per_active_day) == (4, 2, 5, 1.5, 0.5, 0.5, 1.0, 0.75, 30.0, 1.0)
    zero = metrics.work_metrics(per.limit(0)).first()
    assert all(not v for v in zero)
    assert [(r.value, r.n) for r in metrics.top(per, "tool").collect()] == [("codex", 3), ("aider", 1)] and metrics.top(per, "actions", 1).first().value == "edit"
    assert [r.project for r in metrics.high_friction_projects(per).collect()] == ["p"]
    assert [r.session_id for r in metrics.rough_and_smooth(per, 1).collect()] == ["s1", "s4"]


def test_reports(spark, per):
    m = metrics.work_metrics(per)
    rows = {r.metric: r for r in reports.trends(m, metrics.work_metrics(per.limit(0))).collect()}
    assert rows["correction_rate"].delta == 0 and not rows["correction_rate"].improved and rows["test_mention_rate"].improved
    assert {r.lever for r in reports.levers(m).collect()} == {"close_loops", "review_plan", "front_load"} and reports.top_lever(m).first().lever == "close_loops"
    f = reports.fluency(m).first()
    assert (f.discernment, f.overall) == (8, round((f.delegation + f.description + f.discernment + f.diligence) / 4))
    assert [r.delta for r in reports.fluency_report(m, metrics.work_metrics(per.limit(0))).collect()] == [None] * 4
    v = spark.createDataFrame([(0.5, 0.4, True), (0.5, 0.6, True), (0.5, 0.52, True), (0.0, 0.1, False), (0.5, 0.4, False)], "b double, r double, low boolean")
    assert [r.v for r in v.select(reports.verdict(F.col("b"), F.col("r"), F.col("low")).alias("v")).collect()] == ["improved", "regressed", "no clear change", "improved", "regressed"]
    day, values = dt.date(2026, 1, 1), {"abandonment_rate": 0.5}
    lever = {"lever": "close_loops", "metric": "abandonment_rate"}
    s = reports.optimise(None, values, lever, day)
    assert s["active"]["baseline"] == 0.5 and reports.optimise(s, values, lever, day + dt.timedelta(days=3)) == s
    s = reports.optimise(s, {"abandonment_rate": 0.1}, None, day + dt.timedelta(days=7))
    assert s["log"][0]["verdict"] == "improved" and s["active"] is None
    for _ in range(40):
        s = reports.optimise(reports.optimise(s, values, lever, day), values, lever, day, force=True)
    assert len(s["log"]) == 30
    w = reports.weekly_review(None, day, 3, "facts")
    assert w["text"].startswith("## This week, by the numbers\n\nfacts") and w["period"] == "2025-12-25" and reports.weekly_review(w, day + dt.timedelta(days=6), 3, "new") is w
    assert reports.weekly_review(w, day + dt.timedelta(days=7), 3, "new", "c", lambda x: x[:7])["text"] == "Metrics"
    assert reports.weekly_review(w, day, 3, "new", "c", lambda x: 1 / 0, force=True) == w | {"text": "## This week, by the numbers\n\nnew"}
    assert reports.weekly_review(None, day, 0, "")["text"].startswith("No sessions")
    scores = spark.createDataFrame([("delegation", 40), ("description", 20), ("diligence", 20)], "dimension string, score int")
    assert tuple(reports.weakest(scores).first()) == ("description", 20)


# ---- threads

S = "session_key string, conversation_id string, tool string, repo_key string, branch string, started_at timestamp, last_activity timestamp, title string, message_count int, project string"


def session(key, tool="codex", repo="r", branch="main", start=0, end=None, title=None):
    return (key, "cv_" + key, tool, repo, branch, None if start is None else t(start), None if end is None else t(end), title, 2, "p")


def heads(spark, *rows):
    out = threads.sessionise(spark.createDataFrame(rows, S), "repo_key", "branch", "started_at", "last_activity", "session_key")
    return {r.session_key: r.head for r in out.collect()}


def test_gaps(spark):
    assert heads(spark, session("a", end=10), session("b", start=190), session("c", start=190 + 181)) == {"a": "a", "b": "a", "c": "c"}
    assert heads(spark, session("a", end=1000), session("b", start=10, end=20), session("c", start=1100)) == {"a": "a", "b": "a", "c": "a"}
    assert heads(spark, session("a", branch="feat"), session("b", branch="feat", start=9000), session("c", start=9000)) == {"a": "a", "b": "a", "c": "c"}
    assert heads(spark, session("a", start=None), session("b", start=None), session("c", repo=None), session("d", repo=None)) == {k: k for k in "abcd"}


def test_threads_and_summaries(spark):
    rows = spark.createDataFrame([session("sk_a", end=5, title="First"), session("sk_b", tool="aider", start=60, title="Second"), session("sk_c", start=9000)], S)
    out = threads.threads_of(rows)
    ids = {r.session_key: r.thread_id for r in out.collect()}
    assert ids["sk_a"] == ids["sk_b"] and ids["sk_a"].startswith("th_w") and ids["sk_c"].startswith("th_w") and ids["sk_c"] != ids["sk_a"]
    alone = threads.threads_of(rows.where("session_key = 'sk_a'")).first().thread_id
    assert alone == ids["sk_a"]  # the same, whether another session has joined or not
    assert threads.threads_of(rows.where("session_key = 'sk_a'").withColumn("repo_key", F.lit(None).cast("string"))).first().thread_id == "th_a"
    s = {r.thread_id: r for r in threads.summarise(out).collect()}
    assert (s[ids["sk_a"]].title, s[ids["sk_a"]].tools, s[ids["sk_a"]].messages, s[ids["sk_a"]].last_activity) == ("First", ["codex", "aider"], 4, t(60))
    member = spark.createDataFrame([("sk_c", ids["sk_a"])], schema.MEMBERSHIP)
    assert {r.thread_id for r in threads.threads_of(rows, member).collect()} == {ids["sk_a"]}
    listed = threads.thread_list(threads.summarise(out).withColumn("status", F.lit("active")), tools=["aider"], repo="R")
    assert [r.thread_id for r in listed.collect()] == [ids["sk_a"]]


LONG = ["A long passage number %d, which the %s wrote at some length so that its opening can serve as a print of it." % (i, who) for i, who in enumerate(["user", "assistant"] * 3)]


def links_of(spark, later_text, **kw):
    s = spark.createDataFrame([session("a", end=60), session("b", tool="aider", start=kw.get("start", 80))], S)
    m = [("cv_a", 0, "user", "hi", t(0))] + [("cv_a", i + 1, ["user", "assistant"][i % 2], x, t(i + 1)) for i, x in enumerate(LONG)] + [("cv_b", 0, "user", later_text, t(kw.get("start", 80)))]
    messages = spark.createDataFrame(m, "conversation_id string, seq int, role string, content string, ts timestamp")
    fresh = s.where("session_key = 'b'")
    return [tuple(r) for r in threads.detect_links(fresh, s, messages, kw.get("links"), kw.get("rejections")).collect()]


def test_link_detection(spark):
    everything = "  Pasted:\n" + "\n\n".join(x.upper() for x in LONG)
    assert links_of(spark, everything) == [("b", "a", "continued", 0.9, True)]
    users = "\n".join(LONG[::2])
    assert links_of(spark, users) == [("b", "a", "continued", 0.5, False)]  # only what the user wrote: no more than nearness
    assert links_of(spark, users, start=91) == [] and links_of(spark, users, start=90) == [("b", "a", "continued", 0.5, False)]
    assert links_of(spark, everything, rejections=spark.createDataFrame([("b", "a")], schema.REJECTIONS)) == []
    assert links_of(spark, everything, links=spark.createDataFrame([("a", "b", "related", "manual", 1.0, True)], schema.LINKS)) == []
    assert links_of(spark, everything, start=60 + 1441) == []


def test_feature_branches_have_one_thread_on_every_device(spark):
    far = [session("sk_a", title="First"), session("sk_b", start=50_000), session("sk_c", start=None)]
    rows = spark.createDataFrame(far, S).withColumn("branch", F.lit("feat/x"))
    ids = {r.thread_id for r in threads.threads_of(rows).collect()}
    other = {r.thread_id for r in threads.threads_of(rows.where("session_key = 'sk_b'")).collect()}
    assert len(ids) == 1 and ids == other
    heads = threads.sessionise(rows, "repo_key", "branch", "started_at", "last_activity", "session_key")
    assert {r.head for r in heads.collect()} == {"sk_a"}
    # case counts: Main is a branch of its own, main is not
    for branch, n in (("Main", 1), ("main", 3), ("", 3)):
        assert len({r.thread_id for r in threads.threads_of(rows.withColumn("branch", F.lit(branch))).collect()}) == n


def state(spark, members):
    """A state in which nothing has been said, and the sessions (key, thread, started_at) as they are grouped."""
    of = lambda cols: spark.createDataFrame([], cols)
    rows = spark.createDataFrame([(k, th, None if at is None else t(at)) for k, th, at in members], "session_key string, thread_id string, started_at timestamp")
    return threads.State(of(schema.THREADS), of(schema.MEMBERSHIP), of(schema.LINKS), of(schema.REJECTIONS)), rows


def held(s):
    return {r.session_key: r.thread_id for r in s.membership.collect()}, {r.thread_id: r.title for r in s.threads.collect()}, {(r.a, r.b, r.kind, r.applied) for r in s.links.collect()}, {tuple(r) for r in s.rejections.collect()}


def test_links_merge_threads_and_part_again(spark):
    s, members = state(spark, [("sk_a", "th_w1", 50), ("sk_b", "th_b", 10), ("sk_c", "th_b", None), ("sk_d", "th_d", 20)])
    assert threads.ordered_pair(members, "sk_a", "sk_b") == ("sk_b", "sk_a") and threads.ordered_pair(members, "sk_c", "sk_a") == ("sk_a", "sk_c") and threads.ordered_pair(members, "sk_c", "sk_x") == ("sk_c", "sk_x")
    with pytest.raises(ValueError):
        threads.put_link(s, members, "sk_a", "sk_b", "no such kind", "explicit", 1.0, True)
    one = threads.put_link(s, members, "sk_a", "sk_b", "continued", "detected", 0.5, False)
    assert held(one) == ({}, {}, {("sk_b", "sk_a", "continued", False)}, set())
    assert held(threads.reject_link(one, "sk_b", "sk_a")) == ({}, {}, set(), {("sk_a", "sk_b")})
    # on purpose: whatever was rejected, the thread of the earlier session takes the later one in
    two = threads.link_sessions(threads.reject_link(one, "sk_a", "sk_b"), members, "sk_a", "sk_b")
    assert held(two) == ({"sk_b": "th_b", "sk_a": "th_b"}, {"th_b": None}, {("sk_b", "sk_a", "related", True)}, set())
    assert held(threads.reject_link(two, "sk_a", "sk_b"))[2:] == ({("sk_b", "sk_a", "related", True)}, {("sk_a", "sk_b")}) and threads.link_sessions(two, members, "sk_a", "sk_a") is two
    # a session that had been put somewhere brings all of that with it, and its title
    now = spark.createDataFrame([("sk_a", "th_b", t(50)), ("sk_b", "th_b", t(10)), ("sk_d", "th_n1", t(20)), ("sk_e", "th_n1", t(30))], members.schema)
    put = threads.State(threads.create_thread(two.threads, "th_n1", "Mine", "g", "/f"), two.membership.unionByName(spark.createDataFrame([("sk_d", "th_n1"), ("sk_e", "th_n1")], schema.MEMBERSHIP)), two.links, two.rejections)
    three = threads.link_sessions(put, now, "sk_d", "sk_a", "continued")
    assert held(three)[:2] == ({k: "th_n1" for k in ("sk_a", "sk_b", "sk_d", "sk_e")}, {"th_n1": "Mine"})
    four = threads.merge_threads(put, now, "th_n1", "th_b")
    assert held(four)[:2] == ({k: "th_b" for k in ("sk_a", "sk_b", "sk_d", "sk_e")}, {"th_b": "Mine"}) and [tuple(r) for r in threads.origin(put.threads).collect()] == [("th_n1", "/f", "g")]


def test_a_session_that_leaves(spark):
    s, members = state(spark, [("sk_a", "th_w1", 10), ("sk_b", "th_w1", 20), ("sk_z", "th_z", 5)])
    assert threads.unlink_session(s, members, "sk_z") is s
    assert held(threads.unlink_session(s, members, "sk_b"))[0] == {"sk_b": "th_b"}  # grouped by itself: pinned
    put = threads.put_link(s, members.where("session_key <> 'sk_b'").unionByName(spark.createDataFrame([("sk_b", "th_b", t(20))], members.schema)), "sk_z", "sk_a", "continued", "detected", 0.9, True)
    now = spark.createDataFrame([("sk_z", "th_z", t(5)), ("sk_a", "th_z", t(10))], members.schema)
    left = threads.unlink_session(put, now, "sk_a")
    assert held(left) == ({"sk_a": "th_a"}, {}, set(), {("sk_a", "sk_z")})  # one plain session is left: dissolved
    titled = dataclasses.replace(put, threads=threads.set_title(put.threads, "th_z", "T"))
    assert held(threads.unlink_session(titled, now, "sk_z"))[:2] == ({"sk_a": "th_a", "sk_z": "th_z"}, {"th_a": "T"})  # its name goes with it


def test_many_links_at_once(spark):
    s, members = state(spark, [(f"sk_{i}", f"th_{i}", i) for i in range(8)])
    s = dataclasses.replace(s, threads=threads.create_thread(s.threads, "th_5", "Five", None, None))
    found = spark.createDataFrame([("sk_4", "sk_3", 0.9, True), ("sk_5", "sk_4", 0.9, True), ("sk_6", "sk_5", 0.9, True), ("sk_2", "sk_1", 0.5, False)], "later string, earlier string, confidence double, applied boolean").withColumn("kind", F.lit("continued"))
    got = held(threads.apply_links(s, members, found))
    assert got[0] == {f"sk_{i}": "th_3" for i in (3, 4, 5, 6)} and got[1] == {"th_3": "Five"} and len(got[2]) == 4
    assert held(threads.apply_links(s, members, found.limit(0)))[0] == {}
    merged = spark.createDataFrame([("sk_1", "th_1"), ("sk_2", "th_1")], schema.MEMBERSHIP)
    links = spark.createDataFrame([("sk_1", "sk_2", "continued", "detected", 0.5, False)], schema.LINKS)
    assert [tuple(r) for r in threads.pending_suggestions(links, merged).collect()] == [("th_1", 1)] and threads.links_of_thread(links, merged).first().inside
    th = threads.create_thread(spark.createDataFrame([], schema.THREADS), "th_9", "T", "goal", "/f")
    assert threads.set_title(threads.set_status(th, "th_9", "done"), "th_9", " ").first()[1:5] == (None, "goal", "/f", "done")


def test_related(spark):
    rows = [("x", "r", "feat", ["d1"], t(0), "active"), ("y", "r", "feat", ["d2"], t(60), "active"), ("z", "r", "feat", ["d1"], t(30), "active"), ("w", "r", "main", ["d3"], t(0), "active"), ("v", "r", "feat", ["d4"], t(60 * 49), "active"), ("u", "r", "feat", ["d5"], t(5), "done")]
    out = threads.related(spark.createDataFrame(rows, "thread_id string, repo_key string, branch string, devices array<string>, last_activity timestamp, status string"))
    assert {(r.thread_id, r.other) for r in out.collect()} == {("x", "y"), ("y", "x"), ("z", "y"), ("y", "z"), ("v", "y"), ("y", "v")}


# ---- rooms

LOG = [(1, "r", "a", "d1", 1, None, "hi", False, 10), (2, "r", "b", "d1", 2, None, "ok", False, 20), (3, "r", "b", "d1", 3, None, "done: first", False, 30), (4, "r", "a", "d1", 4, "b", "again", False, 40), (5, "r", "me", "d1", 5, None, "human here", True, 50), (6, "r", "b", "d2", 6, "a@d1", "yes", False, 60), (7, "r", "a", "d1", 7, None, "DONE", False, 70), (8, "q", "a", "d1", 8, None, "x", False, 5)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, schema.ROOM_LOG)


def test_rooms(spark, log):
    e = {r.id: (r.exchange, r.turn) for r in rooms.exchanges(log).collect()}
    assert e == {1: (0, 1), 2: (0, 2), 3: (0, 0), 4: (1, 1), 5: (1, 0), 6: (1, 1), 7: (1, 0), 8: (0, 1)}
    assert [r.id for r in rooms.exchange_of(log, "r", 7).collect()] == [4, 5, 6, 7]
    assert {r.room: r.turns for r in rooms.turns_now(log).collect()} == {"r": 0, "q": 1} and {r.room: r.closed for r in rooms.closed(log).collect()} == {"r": True, "q": False}
    agents = spark.createDataFrame([("r", "a", 2, 65), ("r", "b", 0, 5), ("empty", "c", 0, 99)], schema.ROOM_AGENTS)
    found = rooms.unread(log, agents, "d1")
    assert {(r.reader, r.id) for r in found.collect()} == {("a", 3), ("a", 5), ("a", 6), ("b", 1), ("b", 4), ("b", 5), ("b", 7)}
    last = rooms.last_unread(found, 2).where("reader = 'b'").collect()
    assert {(r.id, r.skipped) for r in last} == {(5, 2), (7, 2)}
    assert {r.name: r.cursor for r in rooms.mark_read(agents, log, "r", "a").collect()} == {"a": 7, "b": 0, "c": 0}
    assert [(r.room, r.messages) for r in rooms.rooms_list(log, agents).collect()] == [("empty", 0), ("r", 7), ("q", 1)]
    assert rooms.receive(log, log.limit(3)).count() == 8 and [r.id for r in rooms.history(log, "r", 2).collect()] == [6, 7] and [r.id for r in rooms.page_after(log, "r", 2, 2).collect()] == [3, 4]
    foreign = [(1, "q", "z", None, 1, None, "t", False, 1), (2, "new", "z", None, 2, None, "t", False, 3), (3, "new", "me", None, 3, None, "t", True, 4)]
    more, there = rooms.import_log(log, agents, spark.createDataFrame(foreign, schema.ROOM_LOG))
    assert sorted(r.id for r in more.collect()) == [*range(1, 9), 10, 11] and [tuple(r) for r in there.where("room = 'new'").collect()] == [("new", "z", 11, 3)] and there.count() == 4
    assert rooms.send_allowed(5, 5, "x")[0] is False and rooms.send_allowed(5, 5, "done")[0] and rooms.send_allowed(3, 5, "x")[1]
    assert {(r.a, r.b) for r in rooms.conversed(log.where("room = 'r'").withColumn("exchange", F.lit(0))).collect()} == {("a", "b"), ("a", "me"), ("b", "me")}
    view = {r.room: r for r in rooms.room_view(log, agents, spark.createDataFrame([], schema.CLAIMS), spark.createDataFrame([], schema.TASKS)).collect()}
    assert [a.name for a in view["r"].agents] == ["a", "b"] and view["r"].claims is None


def test_exchanges_in_runs_are_those_of_whole_rooms(spark):
    rng = random.Random(4)
    rows = [(i, f"r{rng.randint(0, 2)}", rng.choice("ab"), None, i, None, rng.choice(["DONE", "x", "x", "y"]), rng.random() < 0.2, i) for i in range(400)]
    log = spark.createDataFrame(rows, schema.ROOM_LOG)
    want, done, turns = {}, collections.Counter(), collections.Counter()
    for i, room, _, _, _, _, text, human, _ in rows:
        edge = human or text == "DONE"
        turns[room] = 0 if edge else turns[room] + 1
        want[i] = (done[room], turns[room])
        done[room] += text == "DONE" and not human
    for run in (7, 50, 4096):
        assert {r.id: (r.exchange, r.turn) for r in rooms.exchanges(log, run).collect()} == want


def test_claims_and_tasks(spark):
    claims = spark.createDataFrame([("r", "x", "/src", 100), ("r", "y", "/doc/a.md", 100), ("r", "z", "/old", 1)], schema.CLAIMS)
    want = spark.createDataFrame([("r", "y", "/src/a.rs"), ("r", "x", "/doc"), ("r", "x", "/src/b"), ("r", "x", "/old"), ("q", "x", "/doc")], "room string, holder string, path string")
    assert {(r.path, r.other) for r in rooms.conflicts(claims, want, F.lit(50)).collect()} == {("/src/a.rs", "x"), ("/doc", "y")}
    assert rooms.release(claims, "r", "x").count() == 2
    task = lambda s, u, by: ("r", "1", "t", "o", s, ["f"], 1, u, by)
    for order in itertools.permutations([task("todo", 1, "a"), task("doing", 2, "a"), task("done", 2, "b"), task("nonsense", 9, "z")]):
        got = rooms.merge_tasks(spark.createDataFrame([], schema.TASKS), spark.createDataFrame(list(order), schema.TASKS)).collect()
        assert [r.status for r in got] == ["done"]
    board = spark.createDataFrame([("r", "1", "t", "bob", "todo", ["/f"], 1, 1, "a"), ("r", "2", "u", "", "blocked", [], 1, 1, "a")], schema.TASKS)
    assert [(r.recipient, r.text.splitlines()[:2]) for r in rooms.plan_messages(board, "a").collect()] == [("bob", ["Task 1 for you: t", "Files: /f (claim them before editing)"])]
    assert tuple(rooms.gather(board).first()) == ("r", False, ["1 (bob, todo)"]) and rooms.gather(rooms.change_task(board, "1", "bob", 9, "done")).first().finished
    with pytest.raises(ValueError):
        rooms.change_task(board, "1", "bob", 9, "lost")
    assert rooms.board_finished(spark.createDataFrame([task("done", 1, "a")], schema.TASKS)).first().finished


# ---- shared state


def test_registers_do_not_depend_on_order(spark):
    rows = [("k", "a", 1, "x", "s1", 5, "x"), ("k", "b", 2, "x", "s2", 4, "x"), ("k", "c", 2, "y", None, None, None), ("k", None, None, None, None, 6, "z")]
    want = {("k", "c", 2, "y", None, 6, "z")}
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(list(order), "id string, title string, title_at long, title_by string, status string, status_at long, status_by string")
        assert {tuple(r) for r in shared.merge_registers(df, ["id"], ["title", "status"]).collect()} == want


def test_changes_page_conservatively(spark):
    df = spark.createDataFrame([(i, 10 + i // 2) for i in range(10)], "id int, updated long")
    page, upto = shared.changes_since({"a": df, "b": df.limit(0)}, 10, batch=3)
    assert page["a"].count() == 3 and upto == 11 and shared.changes_since({"a": df}, 99)[1] is None and shared.changes_since({"a": df}, 9)[1] == 14


def test_fold_and_overlay(spark):
    rows = spark.createDataFrame([("d1", "p1", ["codex"], 3, 1, t(0), t(5), "idle"), ("d2", "p2", ["aider", "codex"], 4, 2, t(1), t(9), "needs_you")], "device string, part string, tools array<string>, messages long, sessions long, started_at timestamp, last_activity timestamp, state string")
    parts = spark.createDataFrame([("d2", "p2", "p1", False, 1, "x")], "device string, part string, root string, gone boolean, updated long, updated_by string")
    r = shared.fold(shared.resolve_roots(rows, parts)).first()
    assert (r.root, r.messages, r.tools, r.devices, r.state, r.last_activity) == ("p1", 7, ["codex", "aider"], ["d1", "d2"], "needs_you", t(9))
    assert shared.fold(shared.resolve_roots(rows, shared.split_part(parts, "p2", 2, "y"))).count() == 2
    over = shared.overlay(shared.fold(shared.resolve_roots(rows, parts)), spark.createDataFrame([("p1", "Name", "done", False)], "thread_id string, title string, status string, deleted boolean")).first()
    assert (over.title, over.status) == ("Name", "done")


# ---- ingest, activity, themes, context


def test_ingest(spark):
    s = spark.createDataFrame([("1", "codex", "/a", "p"), ("2", "codex", "/b", "p"), ("3", "codex", "/a", "p/.helper")], "session_id string, tool string, path string, project string")
    m = spark.createDataFrame([(i, q, "user", f"say {q} token = abcdefgh9") for i in "12" for q in (0, 1)], "session_id string, seq int, role string, content string")
    found = ingest.identify(ingest.without_helper_projects(s), ingest.redact_messages(m))
    rows = found.collect()
    assert len(rows) == 2 and rows[0].content_hash == rows[1].content_hash and rows[0].session_key != rows[1].session_key and rows[0].message_count == 2
    one = ingest.deduplicate(found)
    assert [r.session_id for r in one.collect()] == ["1"] and ingest.deduplicate(found, one).count() == 0 and [r.session_id for r in ingest.deduplicate(found, None, one.select("session_key")).collect()] == ["2"]


def test_superseded_versions_must_be_prefixes(spark):
    m = spark.createDataFrame([(c, i, "user", x) for c, xs in {"v1": "ab", "v2": "abc", "v3": "xbcd", "w1": "ab"}.items() for i, x in enumerate(xs)], "conversation_id string, seq int, role string, content string")
    v = spark.createDataFrame([("v1", "k", 2), ("v2", "k", 3), ("v3", "k", 4), ("w1", "other", 2)], "conversation_id string, session_key string, message_count int")
    assert [r.conversation_id for r in ingest.superseded(m, v).collect()] == ["v1"]
    assert {r.conversation_id for r in ingest.collapse_versions(m, v).collect()} == {"v2", "v3", "w1"}


def test_upserts(spark):
    state = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, at long, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "old"), ("c", 1, "n")], "k string, at long, v string")
    assert {(r.k, r.v) for r in ingest.upsert(state, new, ["k"], "at").collect()} == {("a", "z"), ("b", "y"), ("c", "n")}
    flags = spark.createDataFrame([("s", True, "note")], "session_key string, pinned boolean, note string")
    change = spark.createDataFrame([("s", None, "new"), ("t", True, None)], "session_key string, pinned boolean, note string")
    assert {tuple(r) for r in ingest.patch(flags, change, "session_key").collect()} == {("s", True, "new"), ("t", True, None)}


def test_activity(spark):
    rows = spark.createDataFrame([("a", t(0), "thread"), ("b", t(1), "thread"), ("b", t(2), "thread"), ("a", None, "thread"), ("a", t(0, 2), "skill")], "tool string, started_at timestamp, kind string")
    out = activity.activity(rows).collect()
    assert [(r.bucket, r.n, [tuple(x) for x in r.by_tool]) for r in out] == [("2026-01-01", 3, [("b", 2), ("a", 1)])]
    assert {(r.tool, r.threads, r.skills) for r in activity.status(rows).collect()} == {("a", 2, 1), ("b", 2, 0)}
    errors = spark.createDataFrame([("bad id 0123abcd-ef line 5",), ("bad id ffff0000 line 77",), ("other",)], "message string")
    assert activity.parse_error_histogram(errors).first() == ("bad id <id> line <n>", 2)


def test_themes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"{'compiler parser' if i % 2 else 'deploy cluster'} the {i}", "t", (np.eye(4)[i % 2] + rng.normal(0, 0.01, 4)).tolist()) for i in range(20)]
    out = themes.themes(spark.createDataFrame(rows, "id int, title string, tool string, centroid array<double>"), 2).collect()
    assert sorted(r["size"] for r in out) == [10, 10] and len(out[0].samples) == 3
    assert {r.label for r in themes.labels(spark.createDataFrame([("g", "the and"), ("g", "you")], "g string, title string"), "g", "title").collect()} == {"(mixed)"}
    x = np.array([r[3] for r in rows])
    label = themes.small_kmeans(x, 2)
    assert len({*label[::2]}) == 1 and len({*label[1::2]}) == 1 and (label == themes.small_kmeans(x, 2)).all() and len(themes.small_kmeans(x[:1], 5)) == 1


def test_context_keeps_its_budget(spark):
    m = spark.createDataFrame([("c1", i, ["user", "assistant"][i % 2], f"é line {i} " + "x" * 100) for i in range(20)] + [("c2", 0, "user", "<noise>"), ("c2", 1, "user", "the ask"), ("c2", 2, "assistant", "the reply")], "conversation_id string, seq int, role string, content string")
    c = spark.createDataFrame([("c1", "One", "codex", t(0)), ("c2", "Two", "aider", t(1))], "conversation_id string, title string, tool string, started_at timestamp")
    hits = spark.createDataFrame([("c1", 0, 2.0), ("c2", 1, 1.0)], "conversation_id string, seq int, score double")
    for most in (300, 1000, 6000):
        b = context.context(hits, m, c, most)
        assert b.sections >= 1 and len(b.text.encode()) <= most + 10 and b.chars == len(b.text) and b.tokens == b.chars // 4
    s = {r.conversation_id: r for r in context.standing(m).collect()}
    assert (s["c2"].asked, s["c2"].answered) == ("the ask", "the reply")
    h = context.handoff({"repo": "r"}, ["s1"], "ask " * 500, [f"m{i} " + "y" * 300 for i in range(50)], 3000)
    assert len(h.text.encode()) <= 3200 and "m49" in h.text and "m0 " not in h.text
    assert context.salvage_json('x {"a": 1} y') == {"a": 1} and context.salvage_json("none") is None
    assert "One" in context.recent_corpus(c, m, 5, 400) and context.ask("q", hits, m, c, answer=lambda q, text: q + str(len(text) > 0)) == "qTrue"
    assert context.resume_command("codex", "u", "/p") == "cd /p && codex resume u"


def test_a_puller_passes_more_rows_of_one_time_than_a_batch(spark):
    """Pulled page by page, every row comes, in batches of three, though five share one time."""
    times = [1, 2, 5, 5, 5, 5, 5, 6, 9, 9]
    rows = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(times)], "note_id string, updated long")
    got, since, pulls = set(), 0, 0
    while True:
        pages, upto = shared.changes_since({"notes": rows}, since, batch=3)
        got |= {r.note_id for r in pages["notes"].collect()}
        if upto is None:
            break
        assert upto > since and (pulls := pulls + 1) < 10
        since = upto
    assert got == {f"n{i}" for i in range(len(times))} and since == 9
    assert shared.changes_since({"notes": rows.limit(0)}, 0)[1] is None
