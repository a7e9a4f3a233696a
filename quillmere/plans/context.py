"""Text assembly on the driver: context blocks, handoffs, standings, insight corpora, answers.

What is retrieved is bounded before it is collected: by k conversations and by a running sum of bytes in the plan.
Budgets are bytes, reported sizes characters, tokens a quarter of these.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CONTEXT_CHARS, HANDOFF_CHARS, BRIEF_CHARS, TAIL = 6000, 8000, 1500, 12


@dataclass
class Block:
    text: str
    sections: int
    chars: int
    tokens: int
    truncated: bool


def _fit(text: str, most: int) -> str:
    """At most ``most`` bytes, no character cut in two."""
    return text if len(text.encode()) <= most else text.encode()[:most].decode("utf-8", "ignore").rstrip() + " …"


def assemble(sections: list[tuple[str, list[str]]], most: int) -> Block:
    """Sections (heading, lines) in order within ``most`` bytes; the first is always there, if need be cut."""
    out, used, taken, cut = [], 0, 0, False
    for heading, lines in sections:
        body = heading + "\n" + "\n".join(lines) + "\n"
        size = len(body.encode())
        if used + size > most:
            cut = True
            if taken:
                break
            body = _fit(body, most)
            size = len(body.encode())
        out.append(body)
        used, taken = used + size, taken + 1
    text = "\n".join(out)
    return Block(text, taken, len(text), len(text) // 4, cut)


def within(messages: DataFrame, most: int, newest: bool = True) -> DataFrame:
    """Each conversation's messages while their bytes fit, the newest or the oldest first; one at least."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("seq") if newest else F.col("seq"))
    used = F.sum(F.octet_length("content")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("_used", F.coalesce(used + F.octet_length("content"), F.lit(0))).where(F.col("_used") <= most).drop("_used")


def context(hits: DataFrame, messages: DataFrame, conversations: DataFrame, most: int = CONTEXT_CHARS) -> Block:
    """A block of the conversations in ``hits`` (conversation_id, score), the best first."""
    held = within(messages.join(hits.select("conversation_id").distinct(), "conversation_id"), most, newest=False)
    rows = held.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("ms"))
    best = hits.groupBy("conversation_id").agg(F.max("score").alias("score"))
    found = rows.join(best, "conversation_id").join(conversations.select("conversation_id", "title", "tool", "started_at"), "conversation_id").orderBy(F.desc("score"), "conversation_id").collect()
    return assemble([(f"## {r.title or r.conversation_id} ({r.tool})", [f"{m.role}: {m.content}" for m in r.ms]) for r in found], most)


def recent_corpus(conversations: DataFrame, messages: DataFrame, n: int, per_record: int, most: int = 300_000) -> str:
    """The latest ``n`` conversations as role: text lines, each cut at a budget, all together within ``most`` bytes."""
    last = conversations.orderBy(F.desc_nulls_last("started_at"), "conversation_id").limit(n)
    held = within(messages.join(last.select("conversation_id"), "conversation_id", "left_semi"), per_record, newest=False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    rows = held.groupBy("conversation_id").agg(F.substring(text, 1, per_record).alias("text")).join(last, "conversation_id")
    rows = rows.orderBy(F.desc_nulls_last("started_at"), "conversation_id").select("title", "text").collect()
    return _fit("\n\n".join(f"# {r.title}\n{r.text}" for r in rows), most)


def samples(conversations: DataFrame, messages: DataFrame, n: int, per_record: int, most: int) -> tuple[str, list[str]]:
    """The latest conversations under their tools and titles, until ``most`` characters are passed, and their ids."""
    last = conversations.orderBy(F.desc_nulls_last("started_at"), "conversation_id").limit(n)
    rows = texts(last, messages, per_record).orderBy(F.desc_nulls_last("started_at"), "conversation_id").collect()
    out, ids = "", []
    for r in rows:
        out += f"\n### [{r.tool}] {r.title or '(untitled)'}\n{r.text.strip()}\n"
        ids.append(r.conversation_id)
        if len(out.encode()) > most:
            break
    return out, ids


def texts(conversations: DataFrame, messages: DataFrame, per_record: int) -> DataFrame:
    """Conversations with text: their first messages as role: content lines, cut at a number of characters."""
    held = within(messages.join(conversations.select("conversation_id"), "conversation_id", "left_semi"), per_record, newest=False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return conversations.join(held.groupBy("conversation_id").agg(F.substring(text, 1, per_record).alias("text")), "conversation_id")


def coach_corpus(per: DataFrame, conversations: DataFrame, messages: DataFrame, n: int = 3, per_record: int = 3500) -> tuple[str, list[str]]:
    """The sessions of most friction and the resolved ones of least, under two headings; ``per``: session metrics."""
    rough = per.orderBy(F.desc("friction"), "session_id").limit(n)
    smooth = per.where("resolved AND user_turns >= 1").orderBy("friction", "session_id").limit(n)
    out, ids = "", []
    for head, rows, way in (("## ROUGH SESSIONS (high friction)", rough, -1), ("\n## SMOOTH SESSIONS (low friction)", smooth, 1)):
        chosen = rows.select(F.col("session_id").alias("conversation_id"), "friction", "user_turns", "corrections")
        found = texts(conversations.join(chosen, "conversation_id"), messages, per_record).collect()
        out += head + "\n"
        for r in sorted(found, key=lambda r: (way * r.friction, r.conversation_id)):
            turns = f"{r.user_turns} user turns" + (f", {r.corrections} corrections" if way < 0 else "")
            out += f"\n### {r.title or '(untitled)'} ({turns})\n{r.text}\n"
            ids.append(r.conversation_id)
    return out, ids


def miner_corpus(found: DataFrame, conversations: DataFrame, messages: DataFrame, least: int = 3, areas: int = 8, each: int = 2, per_record: int = 3000, most: int = 60_000) -> tuple[str, list[str]]:
    """Examples of the largest themes of ``least`` sessions or more; ``found``: themes (label, size, samples)."""
    rows = found.where(F.col("size") >= least).orderBy(F.desc("size"), "label").limit(areas).select("label", "size", F.slice("samples", 1, each)["id"].alias("ids")).collect()
    wanted = messages.sparkSession.createDataFrame([(i,) for r in rows for i in r.ids], "conversation_id string")
    known = {r.conversation_id: r for r in texts(conversations.join(wanted.distinct(), "conversation_id"), messages, per_record).collect()}
    out, ids = "", []
    for r in rows:
        out += f"\n## Recurring area: {r.label} ({r['size']} sessions)\n"
        for i in (i for i in r.ids if i in known):
            out += f"### example: {known[i].title or '(untitled)'}\n{known[i].text}\n"
            ids.append(i)
        if len(out.encode()) > most:
            break
    return out, ids


def open_loops(per: DataFrame, messages: DataFrame, n: int = 20) -> DataFrame:
    """(session_id, asked, answered) of the latest sessions that ended on a question."""
    last = per.where("NOT resolved AND messages > 0").orderBy(F.desc_nulls_last("started_at"), "session_id").limit(n)
    said = standing(messages.join(last.select(F.col("session_id").alias("conversation_id")), "conversation_id", "left_semi"))
    return said.withColumnRenamed("conversation_id", "session_id")


def tail(messages: DataFrame, n: int = TAIL) -> DataFrame:
    """The last ``n`` user and assistant messages of each conversation that are the person's and the assistant's own."""
    own = messages.where(F.col("role").isin("user", "assistant") & ~T.is_noise("content"))
    w = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    return own.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def standing(messages: DataFrame) -> DataFrame:
    """(conversation_id, asked, answered): the last question and the last reply, clipped."""
    t = tail(messages)
    pick = lambda role, most: T.clip(F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("seq"))), most)
    return t.groupBy("conversation_id").agg(pick("user", 220).alias("asked"), pick("assistant", 200).alias("answered"))


def handoff(facts: dict[str, str], sessions: list[str], ask: str, recent: list[str], most: int = HANDOFF_CHARS) -> Block:
    """A handoff: facts, the sessions, what was asked first, and the newest of the tail that fits."""
    first = _fit(ask, max(300, min(2000, most // 5)))
    head = [("# Handoff", [f"- {k}: {v}" for k, v in facts.items()]), ("## Sessions", [f"- {s}" for s in sessions]), ("## First ask", [first])]
    left = most - sum(len((h + "\n".join(x)).encode()) for h, x in head)
    kept: list[str] = []
    for line in reversed(recent):
        if left - len(line.encode()) < 0 and kept:
            break
        kept.insert(0, _fit(line, max(left, 200)))
        left -= len(line.encode())
    return assemble([*head, ("## Latest", kept)], max(most, 500))


def brief(summary: dict, notes: list[str], others: list[str], most: int = BRIEF_CHARS) -> Block | None:
    """What someone who joins a thread should know; nothing where there is nothing to say."""
    if not notes and not others and summary.get("sessions", 0) < 2:
        return None
    facts = [f"- {k}: {v}" for k, v in summary.items() if v]
    return assemble([("# Thread", facts), *([("## Notes", [f"- {n}" for n in notes])] if notes else []), *([("## Related", [f"- {o}" for o in others])] if others else [])], most)


def recall(hits: DataFrame, messages: DataFrame, conversations: DataFrame, query: str, k: int = 5) -> list[str]:
    """One line a hit: where, when, and the words around the match."""
    from ..operators.search import hydrate, snippet

    rows = hydrate(hits.limit(k), messages, conversations.select("conversation_id", "title", "tool", "started_at")).withColumn("snippet", snippet("content", query, start="**", end="**")).collect()
    return [f"- {r.title or r.conversation_id} ({r.tool}, {r.started_at:%Y-%m-%d}): {r.snippet}" if r.started_at else f"- {r.title or r.conversation_id} ({r.tool}): {r.snippet}" for r in rows]


def ask(question: str, hits: DataFrame, messages: DataFrame, conversations: DataFrame, k: int = 12, answer: Callable[[str, str], str] | None = None) -> str:
    """An answer by ``answer`` (a model behind a function) over retrieved context, or the context itself."""
    block = context(hits.limit(k), messages, conversations, max(9000, min(1400 * k, 24_000)))
    return answer(question, block.text) if answer else block.text


def salvage_json(text: str) -> dict | None:
    """The object between the first and the last brace of a model's reply."""
    m = re.search(r"\{.*\}", text, re.S)
    try:
        return json.loads(m[0]) if m else None
    except ValueError:
        return None


def resume_command(tool: str, native_id: str | None, project: str | None) -> str:
    """How to take a session up again in its own tool; else how to show it."""
    commands = {"claude-code": "claude --resume {}", "codex": "codex resume {}", "gemini": "gemini --resume {}"}
    if tool in commands and native_id:
        return (f"cd {project} && " if project else "") + commands[tool].format(native_id)
    return f"open {project}" if project else "reveal"
