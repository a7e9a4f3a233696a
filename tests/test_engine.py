import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillmere.engine import Engine
from quillmere.operators import activity, rooms, shared
from quillmere.operators.search import Filters
from quillmere import schema
from quillmere.store import Conflict, Store


def write(path, name, project, turns, day=1, extra=""):
    rows = [{"type": "user" if i % 2 == 0 else "assistant", "cwd": project, "timestamp": f"2026-01-{day:02d}T10:{i:02d}:00Z", "message": {"role": "user" if i % 2 == 0 else "assistant", "content": t}} for i, t in enumerate(turns)]
    (path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + extra)


def test_from_files_to_answers(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    write(src, "one", "/w/alpha", ["fix the unicode parser, password = hunter2222", "parser fixed, test added", "no, undo that", "undone"])
    write(src, "two", "/w/beta", ["deploy the cluster", "deployed"], day=20)
    (src / "bad.jsonl").write_text("nothing")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.index("claude-code", str(src)) == {"indexed": 2, "failed": 1} and e.index("claude-code", str(src))["indexed"] == 0
    hits = e.search("unicode parser", "lexical").collect()
    assert len(hits) == 1 and "[REDACTED]" in hits[0].content and "parser" in hits[0].snippet and hits[0].project == "/w/alpha"
    assert e.search("deploy cluster", "semantic").first().project == "/w/beta" and e.search("parser", filters=Filters(project="beta")).where("project = '/w/alpha'").count() == 0
    m = e.metrics().first()
    assert (m.sessions, m.corrections if "corrections" in m else m.correction_rate, m.test_mention_rate) == (2, 0.5, 0.0)
    assert e.facets()["project"] == [("/w/alpha", 1), ("/w/beta", 1)] and e.status().first().threads == 2
    assert [(r.bucket, r.n) for r in e.activity("week").orderBy("bucket").collect()] == [("2026-W00", 1), ("2026-W03", 1)]
    t = {r.metric: r for r in e.trends(dt.date(2026, 1, 25), 10).collect()}
    assert t["correction_rate"].current == 0 and t["correction_rate"].previous == 0
    assert len(e.fluency(dt.date(2026, 1, 25)).collect()) == 4 and e.glance(dt.date(2026, 1, 20)).first().today == 1
    assert e.optimise(dt.date(2026, 1, 25))["active"] is not None and e.optimise(dt.date(2026, 1, 25)) == e.optimise(dt.date(2026, 1, 26))
    assert "unicode" in e.context("unicode parser").text and e.recall("unicode")[0].startswith("- ") and e.ask("unicode", answer=lambda q, c: q) == "unicode"
    assert len(e.threads().collect()) == 2 and e.detect_links() == 0 and sum(r["size"] for r in e.themes(2).collect()) == 2
    write(src, "one", "/w/alpha", ["fix the unicode parser, password = hunter2222", "parser fixed, test added", "no, undo that", "undone", "thanks"])
    assert e.index("claude-code", str(src))["indexed"] == 1 and e.table("conversations").count() == 2
    key = e.search("unicode", "lexical").first().session_key
    e.flag(key, pinned=True, tags="B, a")
    e.flag(key, note="n")
    r = e.saved().first()
    assert (r.pinned, r.note, r.tags) == (True, "n", ["a", "b"]) and e.search("unicode", "lexical", filters=Filters(tag="A")).count() == 1
    gone = e.table("conversations").where(f"session_key = '{key}'").first().conversation_id
    e.forget([key])
    for name in ("conversations", "messages", "embeddings", "postings", "sizes"):
        assert e.table(name).where(f"conversation_id = '{gone}'").count() == 0 and e.table(name).count() > 0, name
    assert e.conversation(gone).collect() == [] and e.search("unicode", "lexical").count() == 0
    assert e.table("conversations").count() == 1 and e.index("claude-code", str(src))["indexed"] == 0
    e.post("r", "a", "hello", 5)
    e.post("r", "b", "done", 6)
    assert [r.id for r in e.table("room_log").orderBy("id").collect()] == [1, 2] and e.rooms().first().messages == 2


def test_a_model_of_ones_own_embeds_all(spark, tmp_path):
    def lengths(texts):
        return [[float(len(t)), 1.0, float(t.count("e"))] for t in texts]

    (tmp_path / "src").mkdir()
    write(tmp_path / "src", "one", "/w/a", ["some words here", "and there"])
    e = Engine(spark, str(tmp_path / "store"), embed=lengths, model="lengths")
    e.index("claude-code", str(tmp_path / "src"))
    assert {(len(r.embedding), r.model) for r in e.table("embeddings").collect()} == {(3, "lengths")}
    assert e.search("some words here", "semantic").first().seq == 0
    other = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="384 dimensions"):
        other.search("words", "semantic").collect()
    other.embed_pending()
    assert {(len(r.embedding), r.model) for r in e.table("embeddings").collect()} == {(384, "hash")} and other.search("and there", "semantic").first().seq == 1


def test_metrics_look_at_neither_kind_nor_tag(spark, tmp_path):
    (tmp_path / "src").mkdir()
    write(tmp_path / "src", "one", "/w/a", ["do it", "done"])
    e = Engine(spark, str(tmp_path / "store"))
    e.index("claude-code", str(tmp_path / "src"))
    assert [e.metrics(f).first().sessions for f in (Filters(kind="skill"), Filters(tag="x"), Filters(project="zzz"))] == [1, 1, 0]
    text = e.summary()
    assert text.startswith("Sessions analyzed: 1 across 1 project(s).\nTools: claude-code 1.") and "Busiest hour: 10:00." in text and len(text.splitlines()) == 17
    r = e.weekly_review(dt.date(2026, 1, 5), folder=str(tmp_path / "out"))
    assert r["text"].startswith("## This week, by the numbers") and not r["already_delivered"] and (tmp_path / "out" / "weekly-2025-12-29.md").read_text() == r["text"]
    assert e.weekly_review(dt.date(2026, 1, 6), lambda _: "new", str(tmp_path / "out"))["already_delivered"] and e.weekly_review(dt.date(2026, 1, 6), lambda _: "new", force=True)["text"] == "new"
    assert e.weekly_review(dt.date(2026, 6, 6), force=True)["text"].startswith("No sessions")
    assert e.weakest(dt.date(2026, 1, 5)).first().dimension == "diligence" and e.unresolved(dt.date(2026, 1, 5)).first().unresolved == 0
    assert "ROUGH SESSIONS" in e.insight("coach") and "[claude-code]" in e.insight("work") and e.insight("loops", len) > 100 and e.insight("miner")
    hits, lost = e.search_devices({"far": Engine(spark, "/proc/none/there"), "bad": None}, "done", k=3)
    assert hits.first().device == "here" and lost == ["bad"]


def test_rooms_from_posts_to_archives(spark, tmp_path):
    (tmp_path / "src").mkdir()
    write(tmp_path / "src", "one", "/w/a", ["do it", "done"])
    write(tmp_path / "src", "two", "/w/b", ["look", "seen"], day=9)
    e = Engine(spark, str(tmp_path / "store"))
    e.index("claude-code", str(tmp_path / "src"))
    paths = {r.project: r.path for r in e.table("conversations").collect()}
    e.bind("r", "ann", paths["/w/a"])
    e.bind("r", "bob", paths["/w/b"])
    assert e.claim("r", "ann", "/src", 100) == [] and e.claim("r", "bob", "/src/x", 100) == ["ann"]
    assert e.send("r", "ann", "hello bob", 101, cap=3) is None
    e.send("r", "bob", "hello ann", 102, recipient="ann")
    assert "DONE" in e.send("r", "ann", "more", 103, cap=1)
    e.send("r", "ann", "DONE all well", 104)
    assert e.table("claims").count() == 0 and e.claim("r", "bob", "/src/x", 105) == []
    c = e.table("conversations").where("kind = 'exchange'").first()
    assert (c.tool, c.title, c.message_count) == ("rooms", "r: hello bob", 3)
    assert [(m.role, m.content) for m in e.conversation(c.conversation_id).collect()] == [("assistant", "ann: hello bob"), ("assistant", "bob → ann: hello ann"), ("assistant", "ann: DONE all well")]
    assert e.archive("r") == 0 and [(r.kind, r.applied) for r in e.table("links").collect()] == [("conversed", True)]
    assert e.threads().where("sessions = 2").count() == 1 and e.search("hello", "lexical").first().tool == "rooms"
    assert [m.text for m in e.history("r", 2).collect()] == ["hello ann", "DONE all well"]
    e.plan("r", "ann", [{"id": "t1", "title": "build", "owner": "bob", "files": ["/x"]}, {"id": "t2", "title": "rest"}], 110)
    assert [m.recipient for m in e.history("r", 1).collect()] == ["bob"] and e.gather("r").first().waiting == ["t1 (bob, todo)", "t2 (unassigned, todo)"]
    e.task("r", "t1", "bob", 111, "done")
    e.task("r", "t2", "ann", 111, "blocked")
    assert e.gather("r").first().finished and [m.text for m in e.history("r", 1).collect()] == ["t1 is done: build"]
    key = next(r.session_key for r in e.table("links").select(F.col("b").alias("session_key")).collect())
    e.unlink(key)
    assert e.threads().where("sessions = 2").count() == 0 and e.table("links").count() == 0


def test_a_crash_between_tables_leaves_everything_once(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    write(tmp_path / "src", "one", "/w/a", ["do it", "done"])
    e = Engine(spark, str(tmp_path / "store"))
    append = e.store.append

    def failing(table, df):
        if table == "conversations":
            raise RuntimeError("crash")
        append(table, df)

    monkeypatch.setattr(e.store, "append", failing)
    with pytest.raises(RuntimeError):
        e.index("claude-code", str(tmp_path / "src"))
    monkeypatch.setattr(e.store, "append", append)
    assert e.index("claude-code", str(tmp_path / "src"))["indexed"] == 1
    assert e.table("messages").count() == 2 == e.table("sizes").count() and e.table("postings").count() == 3


def test_writers_that_met_another_are_told(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.put("it's", "1")
    a.put("it's", "2")
    assert b.get("it's") == "2" and b.get("other") is None
    n, parts = a._parts("kv")
    a._point("kv", n, parts)
    with pytest.raises(Conflict):
        b._point("kv", n, parts)
    for i in range(70):
        a._point("kv", a._parts("kv")[0], parts)
    assert len(a._pointers("kv")) == 5 and b.get("it's") == "2"


def test_folders_and_commands(spark):
    c = spark.createDataFrame([("a", "/w", dt.datetime(2026, 1, 1), 3, "/f"), ("b", "/w/x", dt.datetime(2026, 1, 1), 5, "/f"), ("c", "/wx", dt.datetime(2026, 2, 1), 1, "/g")], "conversation_id string, project string, last_activity timestamp, message_count int, path string")
    assert activity.latest_in_folder(c, "/w/x/y/").first().conversation_id == "b" and activity.latest_in_folder(c, "/w/z").first().conversation_id == "a" and activity.of_source_path(c, "/f").first().conversation_id == "b"
    agents = rooms.touch(rooms.touch(spark.createDataFrame([], schema.ROOM_AGENTS), "r", "a", 9), "r", "a", 5)
    assert [tuple(r) for r in agents.collect()] == [("r", "a", 0, 9)]
    claims, no = rooms.claim(spark.createDataFrame([], schema.CLAIMS), "r", "a", "/src", 100)
    assert no == [] and rooms.claim(claims, "r", "b", "/src/x", 200)[1] == ["a"] and rooms.claim(claims, "r", "b", "/src/x", 99_999)[1] == []
    reg = spark.createDataFrame([], "thread_id string, title string, title_at long, title_by string")
    reg = shared.edit(shared.edit(reg, "t", "title", "new", 5, "a"), "t", "title", "old", 4, "z")
    merged = shared.merge_registers(reg, ["thread_id"], ["title"]).withColumn("status", F.lit("done"))
    assert shared.take_shared(spark.createDataFrame([("t", "x", "active")], "thread_id string, title string, status string"), merged).first()[1:] == ("new", "done")
    m = spark.createDataFrame([(1, "c", 0, "user", "x handoff: th_abc123 y"), (2, "c", 1, "user", "none"), (3, "c", 2, "assistant", "handoff: th_zzzz9")], "id long, conversation_id string, seq int, role string, content string")
    found, upto = shared.markers_since(m, 0)
    assert [r.token for r in found.collect()] == ["th_abc123"] and upto == 3 and shared.markers_since(m, 3)[1] == 3
