"""Parsers: the content of one file of an assistant's history as sessions.

Each parser is a pure function of (path, content) and returns a list of :class:`Session`; it raises ValueError where a file
is no history, which the reader turns into an error row of its own.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import sqlite3
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any
from urllib.parse import unquote


@dataclass
class Message:
    role: str
    content: str
    ts: dt.datetime | None = None
    tools: list[str] = field(default_factory=list)


@dataclass
class Session:
    tool: str
    path: str
    messages: list[Message]
    kind: str = "thread"
    native_id: str | None = None
    title: str | None = None
    project: str | None = None
    branch: str | None = None
    model: str | None = None
    started_at: dt.datetime | None = None
    ended_at: dt.datetime | None = None


def lines(text: str) -> list[str]:
    """The lines of a text: they end with a line feed, or both signs, and nothing else, since JSON strings may hold what else ends lines."""
    out = [x.removesuffix("\r") for x in text.split("\n")]
    return out[:-1] if out[-1] == "" else out


def when(value: Any) -> dt.datetime | None:
    """A time from RFC 3339 text, or seconds or milliseconds since 1970."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        try:
            return dt.datetime.fromtimestamp(value / 1000 if abs(value) > 1e11 else value, dt.UTC)
        except (OverflowError, OSError, ValueError):
            return None
    try:
        t = dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=dt.UTC)


def json_lines(text: str) -> Iterable[dict]:
    """The objects of a JSON-lines text; lines that are none are left out."""
    for line in lines(text):
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if isinstance(x, dict):
            yield x


def _span(s: Session) -> Session:
    times = [m.ts for m in s.messages if m.ts]
    s.started_at, s.ended_at = s.started_at or (min(times) if times else None), s.ended_at or (max(times) if times else s.started_at)
    if not s.messages:
        raise ValueError("no messages")
    return s


def _strings(*values: Any) -> str | None:
    """The first value that is a non-empty string."""
    return next((v for v in values if isinstance(v, str) and v), None)


def _part(part: Any) -> str | None:
    """The text of a part: a string, or an object with a text."""
    if isinstance(part, str):
        return part
    return part["text"] if isinstance(part, dict) and isinstance(part.get("text"), str) else None


def _parts(content: Any) -> str:
    """The text of a string, a part, or a list of parts, a blank line between these."""
    if isinstance(content, list):
        return "\n\n".join(t for p in content if (t := _part(p)) is not None)
    return _part(content) or ""


def _inside(state: Any, path: list) -> Any:
    """What lies at a path of keys and places; None where it leads nowhere."""
    for key in path:
        if isinstance(state, dict) and isinstance(key, str) and key in state:
            state = state[key]
        elif isinstance(state, list) and isinstance(key, int) and 0 <= key < len(state):
            state = state[key]
        else:
            return None
    return state


def replay(entries: Iterable[dict]) -> Any:
    """The state that a mutation log leaves: 0 sets the root, 1 a value at a path, 2 truncates a list and extends it, 3
    deletes a key.  What does not fit the state is left out."""
    state: Any = None
    for e in entries:
        kind, path, value = e.get("kind"), e.get("k"), e.get("v")
        if kind == 0:
            state = value
        elif state is None or not isinstance(path, list):
            continue
        elif kind == 1 and not path:
            state = value
        elif kind == 2 and isinstance(held := _inside(state, path), list):
            if isinstance(e.get("i"), int):
                del held[e["i"] :]
            held.extend(value if isinstance(value, list) else [] if value is None else [value])
        elif kind in (1, 3) and path:
            holder, last = _inside(state, path[:-1]), path[-1]
            if isinstance(holder, dict) and isinstance(last, str):
                if kind == 1:
                    holder[last] = value
                else:
                    holder.pop(last, None)
            elif kind == 1 and isinstance(holder, list) and isinstance(last, int) and 0 <= last <= len(holder):
                holder[last : last + 1] = [value]
    return state


def copilot(path: str, content: bytes) -> list[Session]:
    text = content.decode("utf-8", "replace")
    state = replay(json_lines(text)) if path.endswith(".jsonl") else json.loads(text)
    if not isinstance(state, dict):
        raise ValueError("no chat session")
    title = state["customTitle"] if "customTitle" in state else state.get("computedTitle")
    s = Session("copilot", path, [], native_id=_strings(state.get("sessionId"), PurePosixPath(path).stem), title=_strings(title), started_at=when(state.get("creationDate")))
    s.ended_at = s.started_at

    def shown(part: Any) -> str:
        """Text, or Markdown as an object; other parts of an answer (calls, references) have none."""
        if isinstance(part, dict):
            inner = part.get("content")
            part = part["value"] if isinstance(part.get("value"), str) else inner.get("value") if isinstance(inner, dict) else None
        return part if isinstance(part, str) else ""

    for r in state.get("requests") or []:
        if isinstance(r, dict):
            answer = r.get("response")
            answer = "".join(map(shown, answer)) if isinstance(answer, list) else shown(answer)
            s.messages += [Message(role, t) for role, t in (("user", _part(r.get("message")) or ""), ("assistant", answer)) if t.strip()]
    return [_span(s)]


# Updates that say something.
SAID = {"user_message_chunk": "user", "user_message": "user", "agent_message_chunk": "assistant", "agent_message": "assistant"}


def grok(path: str, content: bytes, updates: bytes | None = None, summary: bytes | None = None) -> list[Session]:
    """The chat history; where no user speaks in it, the stream of updates, whose neighbouring chunks are one message."""
    folder = PurePosixPath(path).parent
    try:
        about = json.loads(summary or b"{}")
    except ValueError:
        about = {}
    about = about if isinstance(about, dict) else {}
    place = unquote(folder.parent.name)
    s = Session("grok", path, [], native_id=folder.name, project=place if place.startswith("/") or ":\\" in place or ":/" in place else None)
    for x in json_lines(content.decode("utf-8", "replace")):
        x = x["message"] if isinstance(x.get("message"), dict) else x
        if x.get("role") in ("user", "assistant"):
            calls = [c.get("function", c) for c in x.get("tool_calls") or [] if isinstance(c, dict)]
            m = Message(x["role"], _parts(x.get("content")), when(x.get("timestamp")), [c["name"] for c in calls if isinstance(c, dict) and isinstance(c.get("name"), str)])
            if m.content.strip() or m.tools:
                s.messages.append(m)
    if not any(m.role == "user" for m in s.messages):
        s.messages = []
        for x in json_lines((updates or b"").decode("utf-8", "replace")):
            u = (x.get("params") or {}).get("update") or x.get("update") or x
            kind, ts = u.get("sessionUpdate"), when(x.get("timestamp")) or when(u.get("timestamp"))
            last = s.messages[-1] if s.messages else None
            if kind == "tool_call":
                if last is None or last.role != "assistant":
                    s.messages.append(last := Message("assistant", "", ts))
                last.tools.append(_strings(u.get("title", u.get("kind"))) or "tool")
            elif role := SAID.get(kind):
                if last is not None and last.role == role and not last.tools:
                    last.content += _parts(u.get("content"))
                else:
                    s.messages.append(Message(role, _parts(u.get("content")), ts))
        s.messages = [m for m in s.messages if m.content.strip() or m.tools]
    s.title, s.model = (_strings(about.get("title")) or "").strip() or None, _strings(about.get("model"))
    if s.messages:
        s.started_at = when(about.get("created_at")) or s.messages[0].ts
        s.ended_at = when(about.get("updated_at")) or next((m.ts for m in reversed(s.messages) if m.ts), None) or s.started_at
    return [_span(s)]


def markdown_folder(path: str, files: dict[str, str]) -> list[Session]:
    """A folder that directly holds Markdown files: task.md first, then by name, each under its name as a heading."""
    order, name = [n for n in sorted(files, key=lambda n: (n != "task.md", n)) if files[n].strip()], PurePosixPath(path).name
    heads = (next((line.strip().lstrip("#").strip() for line in files[n].splitlines() if line.strip().startswith("#")), "") for n in order)
    title = next((h for h in heads if h), f"Antigravity {name.split('-')[0]}" if name else None)
    return [_span(Session("antigravity", path, [Message("assistant", f"## {n}\n\n{files[n]}") for n in order], native_id=name, title=title))]


def skill(path: str, content: bytes, tool: str = "claude-code", modified: dt.datetime | None = None) -> list[Session]:
    """A skill: its name, and description and body as one message.  A prompt of the other tool has no head: its file's name,
    and all of it."""
    text, p = content.decode("utf-8", "replace"), PurePosixPath(path)
    name, body, about = p.stem, text, ""
    if tool == "claude-code":
        m = re.match(r"\ufeff*---(.*?)\n---\n*", text, re.S)
        front = {k: v.strip().strip("\"'").strip() for k, v in re.findall(r"^[ \t]*(\w+)[ \t]*:(.*)$", m[1], re.M)} if m else {}
        name, about, body = front.get("name") or p.parent.name, front.get("description", ""), text[m.end() :] if m else text
    said = (f"{about}\n\n" if about else "") + body.strip()
    return [Session(tool, path, [Message("system", said)], kind="skill", native_id=name, title=name, started_at=modified, ended_at=modified)]


def _key_values(content: bytes, table: str) -> dict[str, Any]:
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(content)
        out = {}
        for k, v in con.execute(f"SELECT key, value FROM {table}"):  # noqa: S608  a fixed name
            try:
                out[k] = json.loads(v)
            except (TypeError, ValueError):
                continue
        return out
    except sqlite3.Error:
        return {}
    finally:
        con.close()


def cursor(path: str, content: bytes, workspace: bytes | None = None) -> list[Session]:
    """Chats of the old panel, and composers, whose turns hold their text or name the row that does.  ``workspace`` is the
    description beside the database, which names the project."""
    items, disk = _key_values(content, "ItemTable"), _key_values(content, "cursorDiskKV")
    try:
        folder = _strings(json.loads(workspace or b"{}").get("folder"))
    except (ValueError, AttributeError):
        folder = None
    out = []

    def add(native: str, title: Any, ms: list[Message], at: Any) -> None:
        ms = [m for m in ms if m.content]
        if ms:
            t = when(at)
            out.append(Session("cursor", path, ms, native_id=native, title=_strings(title), project=folder and folder.removeprefix("file://"), started_at=t, ended_at=t))

    text = lambda b: b["text"].strip() if isinstance(b, dict) and isinstance(b.get("text"), str) else ""
    by_name, by_number = {"user": "user", "ai": "assistant", "assistant": "assistant"}, lambda kind: "assistant" if kind == 2 else "user"
    legacy = items.get(LEGACY_KEY)
    for tab in legacy.get("tabs") or [] if isinstance(legacy, dict) else []:
        if isinstance(tab.get("tabId"), str):
            bubbles = [b for b in tab.get("bubbles") or [] if isinstance(b, dict)]
            add(tab["tabId"], tab.get("chatTitle"), [Message(by_name[b["type"]], text(b)) for b in bubbles if b.get("type") in by_name], None)
    for key, c in disk.items():
        if not key.startswith("composerData:") or not isinstance(c, dict):
            continue
        cid, ms = key.partition(":")[2], []
        turns = c["conversation"] if isinstance(c.get("conversation"), list) else c.get("fullConversationHeadersOnly")
        for t in turns if isinstance(turns, list) else []:
            if isinstance(t, dict):
                row = {} if text(t) else disk.get(f"bubbleId:{cid}:{t.get('bubbleId')}") or {}
                ms.append(Message(by_number(t.get("type", row.get("type"))), text(t) or text(row)))
        add(cid, c.get("name"), ms, c.get("createdAt"))
    if not out:
        raise ValueError("no conversations")
    return out


# Keys under which the chats may stand.
LEGACY_KEY = "workbench.panel.aichat.view.aichat.chatdata"
WINDSURF_KEYS = [LEGACY_KEY, "aiChat.chatdata", "chat.data", "cascade.chatdata"]


def windsurf(path: str, content: bytes) -> list[Session]:
    """The tabs of the first key that is there."""
    items, out = _key_values(content, "ItemTable"), []
    data = next((items[k] for k in WINDSURF_KEYS if k in items), None)
    roles = {"assistant": "assistant", "ai": "assistant", "bot": "assistant", "tool": "tool", "function": "tool"}

    def text(b: dict) -> str:
        for key in ("rawText", "text", "content"):
            if isinstance(b.get(key), str):
                return b[key]
            if isinstance(b.get(key), list) and (found := [p for p in b[key] if isinstance(p, dict) and _part(p) is not None]):
                return _parts(found)
        return ""

    for n, tab in enumerate(data.get("tabs") or [] if isinstance(data, dict) else []):
        ms = []
        for b in tab.get("messages", tab.get("bubbles")) or []:
            if isinstance(b, dict) and text(b).strip():
                kind = b.get("type")
                role = roles.get(kind if isinstance(kind, str) else b.get("role"), "user") if not isinstance(kind, int) else "assistant" if kind == 2 else "user"
                ms.append(Message(role, text(b)))
        if ms:
            t = when(tab.get("createdAt"))
            title = next((tab[k] for k in ("chatTitle", "name", "title") if k in tab), None)
            out.append(Session("windsurf", path, ms, native_id=str(tab.get("tabId", n)), title=_strings(title), started_at=t, ended_at=t))
    if not out:
        raise ValueError("no conversations")
    return out


PARSERS: dict[str, Callable[..., list[Session]]] = {
    "cursor": cursor, "windsurf": windsurf, "copilot": copilot,
    "grok": grok, "skills": skill, "codex-prompts": lambda p, c, **more: skill(p, c, "codex", **more),
}
