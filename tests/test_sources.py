import datetime as dt
import json
import sqlite3

import pytest

from quillmere.functions import text as T
from quillmere.sources import parsers as P
from quillmere.sources.readers import messages_of, parse_files, read_message_log, read_sessions


def lines(*xs):
    return "\n".join(x if isinstance(x, str) else json.dumps(x) for x in xs).encode()


CLAUDE = lines(
    {"type": "summary", "summary": "A title"}, {"type": "user", "cwd": "/w/p", "gitBranch": "feat", "timestamp": "2026-01-01T10:00:00Z", "message": {"role": "user", "content": "do it"}},
    {"type": "assistant", "timestamp": "2026-01-01T10:01:00Z", "message": {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Edit", "input": {}}]}},
    "not json", {"type": "user", "timestamp": "2026-01-01T10:02:00Z", "message": {"role": "user", "content": [{"type": "tool_result", "content": "done"}]}},
    {"type": "assistant", "timestamp": "2026-01-01T10:03:00Z", "message": {"role": "assistant", "content": "```py\n1\n```"}},
)


def planned(spark, source, path, content):
    """The sessions of one file of a source that is a plan."""
    rows = parse_files(spark.createDataFrame([(path, bytearray(content), dt.datetime(2026, 1, 1))], "path string, content binary, modificationTime timestamp"), source).collect()
    rows.sort(key=lambda r: r.native_id or "")
    if any(r.error for r in rows):
        raise ValueError(rows[0].error)
    return rows


def fenced(spark, text):
    return [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(T.fenced("t")).first()[0]]


def said(sessions):
    (s,) = sessions
    return [(m.role, m.content) for m in s.messages]


def test_claude_code(spark):
    (s,) = planned(spark, "claude-code", "/x/abc.jsonl", CLAUDE)
    assert [m.role for m in s.messages] == ["user", "assistant", "tool", "assistant"] and s.messages[1].tools == ["Edit"]
    assert (s.title, s.project, s.branch, s.model, s.native_id) == (None, "/w/p", "feat", "m1", "abc") and (s.ended_at - s.started_at).seconds == 180
    at = lambda minute, **more: {"timestamp": f"2026-01-01T10:{minute:02d}:00Z", **more}
    message = lambda *blocks, role="user": {"message": {"role": role, "content": list(blocks)}}
    (s,) = planned(spark, "claude-code", "x.jsonl", lines(
        at(30, type="summary"), at(5, type="user", **message({"type": "text", "text": "a"}, {"type": "text", "text": "b"})), at(1, type="progress"),
        message({"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "seen"}, role="assistant"), message({"type": "thinking", "thinking": "hm"}, role="assistant"),
        message({"type": "tool_result", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}), {"type": "custom", "message": {"content": "bare"}}, {"type": "user", "message": {"role": "odd", "content": "odd"}},
    ))
    assert [(m.role, m.content) for m in s.messages] == [("user", "a\n\nb"), ("assistant", "seen"), ("tool", "x\n\ny"), ("user", "bare"), ("user", "odd")]
    assert (s.started_at.minute, s.ended_at.minute) == (1, 30)  # every line's time counts, in any order


def test_codex(spark):
    (s,) = planned(spark, "codex", "r.jsonl", lines(
        {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "u1", "cwd": "/p"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}},
        {"type": "response_item", "payload": {"type": "reasoning"}}, {"type": "response_item", "payload": {"type": "function_call", "name": "sh", "arguments": "{}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "out"}}, {"type": "message", "role": "assistant", "content": "bare"},
    ))
    assert [(m.role, m.content) for m in s.messages] == [("user", "q"), ("tool", "sh({})"), ("tool", "out"), ("assistant", "bare")] and s.project == "/p" and s.messages[1].tools == ["sh"]
    item = lambda **p: {"type": "response_item", "payload": p}
    (s,) = planned(spark, "codex", "r.jsonl", lines(
        {"timestamp": "2026-01-01T09:00:00Z", **item(type="message", role="system", content=[{"text": "a"}, {"text": "b"}])}, {"timestamp": "2026-01-01T08:00:00Z", **item(type="web_search_call", name="w", cwd="/late", model="m")},
        item(type="local_shell_call", arguments={"a": [1, "é"]}), item(type="custom_tool_call", name="n"), item(type="local_shell_call_output", content=["x", "y"]), item(type="custom_tool_call_output", output="no"), item(type="message", role="developer", content="d"),
    ))
    assert [(m.role, m.content) for m in s.messages] == [("system", "a\n\nb"), ("tool", 'tool({"a":[1,"é"]})'), ("tool", "n()"), ("tool", "xy"), ("user", "d")]
    assert (s.project, s.model, s.started_at.hour, s.ended_at.hour) == ("/late", "m", 8, 9)


def test_aider(spark):
    a, b = planned(spark, "aider", "/p/.aider.chat.history.md", b"# aider chat started at 2026-01-01 10:00:00\n> Model: gpt\n#### hi\n#### there\nanswer\nmore\n# aider chat started at 2026-01-02 10:00:00\n#### x\ny\n")
    assert [(m.role, m.content) for m in a.messages] == [("user", "hi\nthere"), ("assistant", "answer\nmore")] and len(b.messages) == 2 and a.native_id != b.native_id and a.model == "gpt"
    first, second = planned(spark, "aider", "/p/h.md", b"text before\n# aider chat started at 2026-01-01 10:00:00\n#### q\n####\n#### r\n##### heading\n> note\nrest\n")
    assert [(m.role, m.content) for m in first.messages] == [("assistant", "text before")] and first.started_at is None
    assert [(m.role, m.content) for m in second.messages] == [("user", "q\n\nr"), ("assistant", "##### heading\nrest")] and second.started_at.hour == 10
    assert said(planned(spark, "aider", "/p/h.md", b"#### only\nanswer")) == [("user", "only"), ("assistant", "answer")]
    with pytest.raises(ValueError):
        planned(spark, "aider", "/p/h.md", b"> notes\n\n")


def test_cline(spark):
    history = lambda *xs: planned(spark, "cline", "/t/1767225600000/api_conversation_history.json", json.dumps(list(xs)).encode())
    (c,) = history({"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "tool_use", "name": "run", "input": {"a": 1}}, {"type": "image", "text": "alt"}, {"type": "image"}]}, {"role": "odd", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}, {"type": "tool_result", "content": " "}]})
    assert [(m.role, m.content) for m in c.messages] == [("user", "q"), ("assistant", '[tool: run] {"a":1}\n\nalt'), ("user", "x\n\ny")] and c.started_at.year == 2026
    for bad in ([], {}):
        with pytest.raises(ValueError):
            planned(spark, "cline", "/t/1/x.json", json.dumps(bad).encode())


def test_copilot():
    (p,) = P.copilot("s.jsonl", lines(
        {"kind": 1, "k": ["x"], "v": 1}, {"kind": 0, "v": {"sessionId": "s", "computedTitle": "T", "requests": []}}, {"kind": 2, "k": ["requests"], "v": [{"message": {"text": "a"}, "response": [{"value": "b"}]}]},
        {"kind": 1, "k": ["requests", 1], "v": {"message": {"text": "c"}, "response": []}}, {"kind": 1, "k": ["customTitle"], "v": "Mine"}, {"kind": 3, "k": ["computedTitle"]}, {"kind": 2, "k": ["none"], "v": [1]}, {"k": [], "v": {}},
        {"kind": 1, "k": ["requests", 9], "v": {}}, {"kind": 2, "k": ["requests", 1, "response"], "v": {"value": "lost"}}, {"kind": 2, "k": ["requests", 1, "response"], "i": 0, "v": "kept"},
    ))
    assert [m.content for m in p.messages] == ["a", "b", "c", "kept"] and p.title == "Mine"
    parts = ["Bare ", {"value": "and "}, {"kind": "markdownContent", "content": {"value": "held."}}, {"kind": "toolInvocation", "value": {"x": 1}}, {"content": "no"}, 7]
    requests = [{"message": "legacy", "response": parts}, {"message": {"text": "second"}, "response": "one string"}, {"message": {"text": ""}, "response": {"value": "one object"}}]
    (p,) = P.copilot("s.json", json.dumps({"sessionId": "s", "creationDate": 1767225600000, "customTitle": "", "computedTitle": "T", "requests": requests}).encode())
    assert [(m.role, m.content) for m in p.messages] == [("user", "legacy"), ("assistant", "Bare and held."), ("user", "second"), ("assistant", "one string"), ("assistant", "one object")]
    assert (p.title, p.started_at.year, p.native_id) == (None, 2026, "s")


def test_gemini(spark):
    head = {"sessionId": "g", "startTime": "2026-01-01T00:00:00Z"}
    log = lambda *xs: planned(spark, "gemini", "session-1.jsonl", lines(*xs))
    assert said(log(head, {"id": "1", "type": "user", "content": "a"}, {"id": "2", "type": "gemini", "content": "b"}, {"id": "3", "type": "user", "content": "c"}, {"$rewindTo": "2"}, {"$rewindTo": "9"})) == [("user", "a"), ("assistant", "b")]
    late = log({"sessionId": "g", "messages": [{"type": "user", "content": "first"}]}, {"$set": {"startTime": "2026-01-02T00:00:00Z", "messages": []}}, {"type": "model", "content": {"text": "one object"}}, {"type": "info", "content": "row"}, {"content": "no type"}, {"type": "assistant", "content": ["bare", {"text": "part"}, {"functionCall": {}}]})
    assert said(late) == [("user", "first"), ("assistant", "one object"), ("assistant", "bare\n\npart")] and late[0].started_at.day == 2
    assert said(planned(spark, "gemini", "session-1.json", json.dumps(head | {"messages": [{"type": "user", "content": [{"text": "q"}]}, {"type": "gemini", "content": "r"}]}).encode())) == [("user", "q"), ("assistant", "r")]


def test_grok():
    up = lines(*({"update": {"sessionUpdate": k, "content": {"text": t}, "title": "sh"}} for k, t in (("user_message_chunk", "he"), ("user_message_chunk", "y"), ("agent_message_chunk", "a"), ("tool_call", ""), ("agent_message_chunk", "b"))))
    (k,) = P.grok("/s/%2Fhome%2Fme/id1/chat_history.jsonl", lines({"role": "assistant", "content": "x"}), up)
    assert [(m.role, m.content, m.tools) for m in k.messages] == [("user", "hey", []), ("assistant", "a", ["sh"]), ("assistant", "b", [])] and k.project == "/home/me"
    whole = lines(
        {"timestamp": 1767225600, "update": {"sessionUpdate": "user_message", "content": "all at once"}}, {"params": {"update": {"sessionUpdate": "tool_call", "kind": "read"}}}, {"sessionUpdate": "agent_message", "content": [{"text": "p"}, "q"]}, {"sessionUpdate": "plan"},
        {"sessionUpdate": "user_message", "content": " "},
    )
    about = json.dumps({"title": " T ", "model": "g", "created_at": "2025-12-31T00:00:00Z", "updated_at": 1767225600000}).encode()
    (k,) = P.grok("/s/place/id1/chat_history.jsonl", b"", whole, about)
    assert [(m.role, m.content, m.tools) for m in k.messages] == [("user", "all at once", []), ("assistant", "", ["read"]), ("assistant", "p\n\nq", [])]
    assert (k.title, k.model, k.project, k.started_at.year, k.ended_at.year) == ("T", "g", None, 2025, 2026)
    (k,) = P.grok("/s/p/id/chat_history.jsonl", lines({"message": {"role": "user", "content": [{"text": "a"}, {"text": "b"}]}}, {"role": "system", "content": "s"}, {"role": "assistant", "content": "", "tool_calls": [{"function": {"name": "f"}}, {"name": "bare"}]}))
    assert [(m.role, m.content, m.tools) for m in k.messages] == [("user", "a\n\nb", []), ("assistant", "", ["f", "bare"])]


def database(tmp_path, tables):
    path = tmp_path / "state.vscdb"
    con = sqlite3.connect(path)
    for t, rows in tables.items():
        con.execute(f"CREATE TABLE {t} (key TEXT, value TEXT)")
        con.executemany(f"INSERT INTO {t} VALUES (?, ?)", [(k, json.dumps(v)) for k, v in rows.items()])
    con.commit()
    con.close()
    return path.read_bytes()


def test_cursor(tmp_path):
    data = database(tmp_path, {
        "ItemTable": {P.LEGACY_KEY: {"tabs": [{"tabId": "t", "chatTitle": "old", "bubbles": [{"type": "user", "text": "a"}, {"type": "ai", "text": " b "}, {"type": "tool", "text": "no"}]}, {"bubbles": []}]}},
        "cursorDiskKV": {
            "composerData:c1": {"composerId": "c1", "name": "in", "createdAt": 1767225600000, "conversation": [{"type": 1, "text": "x"}, {"type": 2, "text": " ", "bubbleId": "b2"}, {"bubbleId": "b3"}]},
            "composerData:c2": {"fullConversationHeadersOnly": [{"bubbleId": "b1"}, {"bubbleId": "none"}]}, "bubbleId:c2:b1": {"type": 2, "text": "y"}, "bubbleId:c1:b2": {"type": 1, "text": "z"}, "bubbleId:c1:b3": {"type": 2, "text": "w"},
        },
    })
    found = P.cursor("s.vscdb", data, b'{"folder": "file:///w/p"}')
    assert [(s.native_id, [(m.role, m.content) for m in s.messages]) for s in found] == [("t", [("user", "a"), ("assistant", "b")]), ("c1", [("user", "x"), ("assistant", "z"), ("assistant", "w")]), ("c2", [("assistant", "y")])]
    assert {s.project for s in found} == {"/w/p"} and {s.project for s in P.cursor("s.vscdb", data, b"[]")} == {None} and found[1].started_at.year == 2026


def test_windsurf(tmp_path):
    tab = {"tabId": "t", "name": "second", "title": "third", "createdAt": 1767225600000, "messages": [{"type": "user", "rawText": "a", "text": "not this"}, {"type": 2, "text": "b"}, {"role": "bot", "content": [{"type": "text", "text": "c"}, {"text": "d"}, {"type": "image"}]}, {"type": "function", "text": "e"}, {"role": "tool", "rawText": [], "content": "f"}, {"type": 1, "text": " "}]}
    data = database(tmp_path, {"ItemTable": {"aiChat.chatdata": {"tabs": [tab, {"bubbles": [{"text": "g"}]}]}, "chat.data": {"tabs": [{"tabId": "never", "messages": [{"text": "x"}]}]}}})
    a, b = P.windsurf("w.vscdb", data)
    assert [(m.role, m.content) for m in a.messages] == [("user", "a"), ("assistant", "b"), ("assistant", "c\n\nd"), ("tool", "e"), ("tool", "f")] and (a.title, a.started_at.year) == ("second", 2026)
    assert [(m.role, m.content) for m in b.messages] == [("user", "g")] and (b.native_id, b.title) == ("1", None)


def test_skills_folders_and_fences(spark):
    now = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    (s,) = P.skill("/k/deploy/SKILL.md", b"---\nname: 'ship'\ndescription: ships it\n---\n\nBody\n", modified=now)
    assert (s.kind, s.native_id, s.title, s.messages[0].role, s.messages[0].content, s.started_at, s.ended_at) == ("skill", "ship", "ship", "system", "ships it\n\nBody", now, now)
    (s,) = P.skill("/k/deploy/SKILL.md", b" plain ")
    assert (s.title, s.messages[0].content) == ("deploy", "plain")
    (s,) = P.PARSERS["codex-prompts"]("/k/review.md", b"---\nname: no\n---\nDo it")
    assert (s.tool, s.title, s.messages[0].content) == ("codex", "review", "---\nname: no\n---\nDo it")
    (f,) = P.markdown_folder("/a/0123-4567", {"plan.md": "p", "task.md": "# The task\n", "zzz.md": " "})
    assert f.title == "The task" and [m.content for m in f.messages] == ["## task.md\n\n# The task\n", "## plan.md\n\np"]
    assert P.markdown_folder("/a/0123-4567", {"plan.md": "p"})[0].title == "Antigravity 0123"
    assert fenced(spark, "a\n```py x=1\n1\n```\nb\n  ```\nin\n  ```\n```\n```\n```rs\nopen\n\nend") == [("py", "1"), ("", "in"), ("", ""), ("rs", "open\n\nend")] and fenced(spark, "```") == []


def test_folders_of_sessions(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    for name in ("ag/s1/task.md", "ag/s1/nested/more.md", "ag/brain/s2/plan.md", "ag/1/2/3/4/5/6/7/deep.md", "ag/1/2/3/4/5/six.md"):
        put(name, f"# {name}")
    found = read_sessions(spark, "antigravity", str(tmp_path / "ag")).collect()
    assert {(r.native_id, r.title, len(r.messages)) for r in found} == {("s1", "ag/s1/task.md", 1), ("s2", "ag/brain/s2/plan.md", 1), ("5", "ag/1/2/3/4/5/six.md", 1)}
    put("gr/%2Fw/one/updates.jsonl", json.dumps({"update": {"sessionUpdate": "user_message", "content": "hi"}}))
    put("gr/%2Fw/one/summary.json", json.dumps({"title": "T"}))
    put("gr/%2Fw/two/chat_history.jsonl", "nothing")
    assert {(r.title, r.project, r.error) for r in read_sessions(spark, "grok", str(tmp_path / "gr")).collect()} == {("T", "/w", None), (None, None, "no messages")}
    (tmp_path / "cu" / "x").mkdir(parents=True)
    (tmp_path / "cu" / "x" / "state.vscdb").write_bytes(database(tmp_path, {"ItemTable": {}, "cursorDiskKV": {"composerData:c": {"conversation": [{"text": "q"}]}}}))
    put("cu/x/workspace.json", json.dumps({"folder": "file:///w"}))
    assert [(r.project, r.messages[0].content) for r in read_sessions(spark, "cursor", str(tmp_path / "cu")).collect()] == [("/w", "q")]
    put("sk/deploy/SKILL.md", "body")
    put("sk/deploy/other.md", "not a skill")
    (r,) = read_sessions(spark, "skills", str(tmp_path / "sk")).collect()
    assert r.title == "deploy" and r.started_at == r.ended_at is not None


def test_message_log_of_another_tool(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "log.db")
    con.execute("CREATE TABLE msg (id INTEGER, ts REAL, room TEXT, author TEXT, recipient TEXT, text TEXT, human INTEGER)")
    con.executemany("INSERT INTO msg VALUES (?, ?, ?, ?, ?, ?, ?)", [(2, 20.7, "r", "b", "a", "two", 0), (1, 10.0, "r", "me", None, "one", 1)])
    con.commit()
    con.close()
    rows = read_message_log(spark, (tmp_path / "log.db").read_bytes()).collect()
    assert [(r.id, r.room, r.author, r.recipient, r.text, r.human, r.ts, r.origin_seq) for r in rows] == [(1, "r", "me", None, "one", True, 10, 1), (2, "r", "b", "a", "two", False, 20, 2)]


def test_reader_keeps_failures_apart(spark, tmp_path):
    (tmp_path / "good.jsonl").write_bytes(CLAUDE)
    (tmp_path / "bad.jsonl").write_bytes(b"nothing here")
    out = {r.path.rsplit("/", 1)[1]: r for r in read_sessions(spark, "claude-code", str(tmp_path)).collect()}
    assert out["bad.jsonl"].error and not out["bad.jsonl"].messages and out["good.jsonl"].error is None
    rows = messages_of(read_sessions(spark, "claude-code", str(tmp_path))).orderBy("seq").collect()
    assert len(rows) == 4 and rows[3].snippets[0].language == "py" and rows[0].ts.hour == 10


def test_lines_end_with_line_feeds_alone(spark):
    odd = "one\u2028two\u2029three\u0085four\x0bfive\x1c"
    content = json.dumps({"type": "user", "timestamp": "2026-01-01T10:00:00Z", "message": {"role": "user", "content": odd}}, ensure_ascii=False).encode()
    assert odd.encode()[:5] in content  # as it is, not escaped
    assert [m.content for m in planned(spark, "claude-code", "/c/1.jsonl", content)[0].messages] == [odd]
    assert [m.content for m in planned(spark, "claude-code", "/c/1.jsonl", b"7\r\n" + content + b"\r\n[]\n")[0].messages] == [odd]
    assert fenced(spark, "```py\nx = 1\u2028y\n```\r\nend") == [("py", "x = 1\u2028y")] and P.lines("") == [] and P.lines("a\r\n\nb\u0085") == ["a", "", "b\u0085"]
    assert [m.content for m in planned(spark, "aider", "/w/h.md", "#### do\u2028it\nyes\u0085sure".encode())[0].messages] == ["do\u2028it", "yes\u0085sure"]


def test_odd_records_are_left_out(spark):
    said = [{"type": "user", "id": "a", "content": "hello"}, 7, None, "x", {"type": "gemini", "id": "b", "content": "yes"}, {"type": "user", "id": "c", "content": "no"}]
    log = "\n".join(map(json.dumps, [{"sessionId": "s", "messages": said}, 5, {"$rewindTo": "b"}, {"type": "user", "content": "again"}]))
    assert [m.content for m in planned(spark, "gemini", "/g/1.jsonl", log.encode())[0].messages] == ["hello", "yes", "again"]
    assert [m.content for m in planned(spark, "gemini", "/g/1.json", json.dumps(said).encode())[0].messages] == ["hello", "yes", "no"]
    for broken in (b"", b"7", b"{}", b'{"messages": 3}', b"[]"):
        with pytest.raises(ValueError):
            planned(spark, "gemini", "/g/1.jsonl", broken)


def test_odd_values_of_json_lines(spark):
    """Values of other kinds than are meant count as missing, and a file without a message is a failure."""
    odd = lines(
        {"type": 5, "cwd": 7, "gitBranch": "", "timestamp": 5, "message": {"role": "", "model": 3, "content": [5, "s", {"type": "tool_use", "name": 7}, {"type": "text", "text": None}, {"text": "untyped"}]}},
        {"timestamp": "bad", "message": "s"}, {"message": {"content": ["", {"type": "tool_result", "content": {"text": "o"}}]}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": ""}, {"type": "text", "text": "```py\n1"}]}},
    )
    (s,) = planned(spark, "claude-code", "/c/a.b.jsonl", odd)
    assert [(m.role, m.content, m.tools) for m in s.messages] == [("user", "", [""]), ("assistant", "```py\n1", [])] and (s.native_id, s.project, s.branch, s.model, s.started_at) == ("a.b", None, None, None, None)
    assert [tuple(x) for x in s.messages[1].snippets] == [("py", "1")]
    for nothing in (b"", b"\n\n", b"[]", b'{"a": 1}', b"\xff\xfe"):
        with pytest.raises(ValueError, match="no messages"):
            planned(spark, "codex", "/c/1.jsonl", nothing)
    (s,) = planned(spark, "codex", "", lines({"type": "message", "content": "caf\u00e9"}).replace(b"\\u00e9", b"\xe9"))
    assert s.messages[0].content == "caf\ufffd" and s.native_id == ""
    assert fenced(spark, "```\n\n") == [("", "")] and fenced(spark, "") == fenced(spark, "x ```\ny") == [] and fenced(spark, "```a\r\nb\r\n```\r\nc") == [("a", "b")]
