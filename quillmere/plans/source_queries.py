"""Registered queries of the sources: the conversations of the test tables, written out in each tool's own form, read again by its
parser, and held against the table."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rooms
from ..sources.parsers import LEGACY_KEY
from ..sources.readers import parse_files
from . import adapters as A
from . import reports
from .queries import query

#: Messages as they stand in the table; the roles are those that a form can hold.
_SAID = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, {role} AS role, {text} AS text FROM conversations WHERE role IN ({roles}) AND trim(text) <> ''"""


def said(roles: tuple[str, ...] = ("user", "assistant", "system"), role: str = "role", text: str = "text") -> str:
    return _SAID.format(roles=", ".join(f"'{r}'" for r in roles), role=role, text=text)


def _turns(spark, sf_dir: str) -> DataFrame:
    """(conv_id, ms): each conversation's messages in order."""
    c = A.table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))


def _json(value: Column) -> Column:
    return F.to_json(value)


def _files(turns: DataFrame, path: Column, content: Column) -> DataFrame:
    return turns.select(path.alias("path"), content.cast("binary").alias("content"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("modificationTime"))


def _lines(line) -> Column:
    return F.array_join(F.transform("ms", lambda m: _json(line(m))), "\n")


def _read(files: DataFrame, source: str, number: Column | None = None) -> DataFrame:
    """(conv_id, seq, role, text) of what a parser finds; the number is in the path if nowhere else."""
    found = parse_files(files, source).where("error IS NULL")
    number = F.regexp_extract("path", r"/(\d+)(?:/[^/]*)?(?:\.[a-z]+)?$", 1) if number is None else number
    return found.select(number.cast("long").alias("conv_id"), F.explode("messages").alias("m")).select("conv_id", F.col("m.seq").cast("long").alias("seq"), "m.role", F.col("m.content").alias("text"))


def _path(before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col("conv_id").cast("string"), F.lit(after))


def _text_block(m: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text")))


@query(said())
def src_claude_code(spark, sf_dir):
    line = lambda m: F.struct(m["role"].alias("type"), F.lit("/w").alias("cwd"), F.struct(m["role"].alias("role"), _text_block(m).alias("content")).alias("message"))
    return _read(_files(_turns(spark, sf_dir), _path("/c/", ".jsonl"), _lines(line)), "claude-code")


@query(said())
def src_codex(spark, sf_dir):
    line = lambda m: F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), m["role"].alias("role"), _text_block(m).alias("content")).alias("payload"))
    return _read(_files(_turns(spark, sf_dir), _path("/c/", ".jsonl"), _lines(line)), "codex")


#: Signs that end a line elsewhere, and that JSON strings hold as they are.
_SIGNS = "\u2028\u2029\u0085\u000b\u001c"


@query(said(text="replace(text, ' a', chr(8232) || 'a' || chr(8233) || chr(133))"))
def src_odd_lines(spark, sf_dir):
    """Texts that hold signs which end lines elsewhere, between lines that are no objects and lines that end with both signs."""
    odd = lambda m: F.replace(m["text"], F.lit(" a"), F.lit(_SIGNS[0] + "a" + _SIGNS[1] + _SIGNS[2]))
    line = lambda m: F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), odd(m).alias("text"))).alias("content")).alias("payload"))
    content = F.concat(F.lit('42\r\n"x"\n[1]\nnull\n{"cut\n'), F.array_join(F.transform("ms", lambda m: _json(line(m))), "\r\n"), F.lit("\n7\n"))
    return _read(_files(_turns(spark, sf_dir), _path("/c/", ".jsonl"), content), "codex")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
  g AS (SELECT conv_id, role, min(turn) AS turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM m GROUP BY conv_id, role, island)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role, text FROM g""")
def src_aider(spark, sf_dir):
    ahead = lambda m: F.when(m["role"] == "user", "#### ").when(m["role"] == "system", "> ").otherwise("")
    body = F.array_join(F.transform("ms", lambda m: F.array_join(F.transform(F.split(m["text"], "\n"), lambda x: F.concat(ahead(m), x)), "\n")), "\n")
    return _read(_files(_turns(spark, sf_dir), _path("/p/", "/.aider.chat.history.md"), F.concat(F.lit("# aider chat started at 2026-01-01 10:00:00\n"), body)), "aider", F.regexp_extract("project", r"(\d+)$", 1))


@query(said())
def src_cline(spark, sf_dir):
    both = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), _text_block(m).alias("content")))
    return _read(_files(_turns(spark, sf_dir), _path("/t/", "/api_conversation_history.json"), _json(both)), "cline", F.col("native_id"))


def _requests(m: Column) -> Column:
    half = F.floor(F.length(m["text"]) / 2).cast("int")
    parts = F.array(F.substring(m["text"], F.lit(1), half), F.substring(m["text"], half + 1, F.length(m["text"])))
    answer = F.when(m["role"] == "assistant", F.transform(parts, lambda p: F.struct(p.alias("value"))))
    return F.struct(F.struct(F.when(m["role"] == "user", m["text"]).otherwise("").alias("text")).alias("message"), answer.alias("response"))


@query(said(("user", "assistant")))
def src_copilot(spark, sf_dir):
    state = F.struct(F.transform("ms", _requests).alias("requests"))
    return _read(_files(_turns(spark, sf_dir), _path("/c/", ".json"), _json(state)), "copilot")


@query(said(("user", "assistant")))
def src_copilot_log(spark, sf_dir):
    start = F.lit('{"kind":0,"v":{"requests":[{"message":"goes"}]}}\n{"kind":2,"k":["requests"],"i":0}\n')
    line = lambda m: F.struct(F.lit(2).alias("kind"), F.array(F.lit("requests")).alias("k"), F.array(_requests(m)).alias("v"))
    return _read(_files(_turns(spark, sf_dir), _path("/c/", ".jsonl"), F.concat(start, _lines(line))), "copilot")


@query(said(("user", "assistant")))
def src_gemini(spark, sf_dir):
    kind = lambda m: F.when(m["role"] == "assistant", "gemini").when(m["role"] == "system", "info").otherwise(m["role"])
    line = lambda m: F.struct(m["turn"].cast("string").alias("id"), kind(m).alias("type"), F.struct(m["text"].alias("text")).alias("content"))
    more = F.concat(F.lit('\n{"id":"gone","type":"user","content":"taken back"}\n{"$rewindTo":"'), F.element_at("ms", -1)["turn"].cast("string"), F.lit('"}'))
    return _read(_files(_turns(spark, sf_dir), _path("/c/", ".jsonl"), F.concat(F.lit('{"startTime":"2026-01-01T00:00:00Z"}\n'), _lines(line), more)), "gemini")


@query(said(("user", "assistant")))
def src_grok(spark, sf_dir):
    line = lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(m["text"].alias("text"))).alias("content"))
    return _read(_files(_turns(spark, sf_dir), _path("/s/%2Fw/", "/chat_history.jsonl"), _lines(line)), "grok", F.col("native_id"))


@query(said(("user", "assistant", "system"), "'assistant'", "'## ' || lpad(turn::VARCHAR, 4, '0') || '.md' || chr(10) || chr(10) || text"))
def src_antigravity(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    return _read(_files(c, F.concat(_path("/a/", "/"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".md")), F.col("text")), "antigravity", F.col("native_id"))


@query("SELECT conv_id, turn, 's' || conv_id || '-' || turn AS title, 'system' AS role, role || chr(10) || chr(10) || text AS text FROM conversations WHERE trim(text) <> ''")
def src_skills(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    name = F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    found = parse_files(_files(c, F.concat(F.lit("/k/"), name, F.lit("/SKILL.md")), F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: "), F.col("role"), F.lit("\n---\n"), F.col("text"))), "skills")
    number = lambda i: F.regexp_extract("title", r"^s(\d+)-(\d+)$", i).cast("long")
    return found.select(number(1).alias("conv_id"), number(2).alias("turn"), "title", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("text"))


#: Databases that a task has at a time.
DATABASES = 64


def _databases(turns: DataFrame, cursor: bool) -> DataFrame:
    """(conv_id, content): chats as the key-value tables of an editor, few at a time."""

    def make(i: int, turns: list[dict]) -> bytes:
        con, disk, kinds = sqlite3.connect(":memory:"), {}, {"user": 1, "assistant": 2}
        bubbles = [{"type": kinds[m["role"]], "text": m["text"]} for m in turns if m["role"] in kinds]
        if cursor:
            disk[f"composerData:{i}"] = {"fullConversationHeadersOnly": [{"bubbleId": f"b{n}"} for n in range(len(bubbles))]}
            disk |= {f"bubbleId:{i}:b{n}": b for n, b in enumerate(bubbles)}
        tables = {"ItemTable": {} if cursor else {LEGACY_KEY: {"tabs": [{"tabId": str(i), "messages": bubbles}]}}, "cursorDiskKV": disk}
        for name, rows in tables.items():
            con.execute(f"CREATE TABLE {name} (key TEXT, value TEXT)")
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [(k, json.dumps(v)) for k, v in rows.items()])
        con.commit()
        out = con.serialize()
        con.close()
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, DATABASES):
                few = b.slice(at, DATABASES)
                made = [make(i, ms) for i, ms in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(made, pa.binary())], ["conv_id", "content"])

    return turns.select("conv_id", "ms").mapInArrow(each, f"conv_id {dict(turns.dtypes)['conv_id']}, content binary")


@query(said(("user", "assistant")))
def src_cursor(spark, sf_dir):
    return _read(_files(_databases(_turns(spark, sf_dir), True), _path("/w/", "/state.vscdb"), F.col("content")), "cursor", F.col("native_id"))


@query(said(("user", "assistant")))
def src_windsurf(spark, sf_dir):
    return _read(_files(_databases(_turns(spark, sf_dir), False), _path("/w/", "/state.vscdb"), F.col("content")), "windsurf", F.col("native_id"))


@query("SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, place, CASE place WHEN 0 THEN role ELSE '' END AS language, CASE place WHEN 0 THEN text ELSE role END AS text FROM conversations, (VALUES (0), (1)) p(place) WHERE trim(text) <> ''")
def src_fences(spark, sf_dir):
    fenced = lambda m: F.concat(F.lit("see\n```"), m["role"], F.lit(" x=1\n"), m["text"], F.lit("\n  ```\nthen\n```\n"), m["role"])
    line = lambda m: F.struct(F.struct(F.lit("user").alias("role"), fenced(m).alias("content")).alias("message"))
    found = parse_files(_files(_turns(spark, sf_dir), _path("/c/", ".jsonl"), _lines(line)), "claude-code")
    rows = found.select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("conv_id"), F.explode("messages").alias("m")).select("conv_id", F.col("m.seq").cast("long").alias("seq"), F.posexplode("m.snippets").alias("place", "s"))
    return rows.select("conv_id", "seq", "place", "s.language", "s.text")


@query("""WITH l AS (SELECT conv_id * 1000 + turn AS id, conv_id::VARCHAR AS room, role AS author, role = 'user' AS human, conv_id * 100 + turn AS ts FROM conversations),
  t AS (SELECT max(id) AS top FROM l WHERE room::BIGINT % 3 = 0), f AS (SELECT id + top AS id, room, author, human, ts FROM l, t WHERE room::BIGINT % 3 <> 0)
  SELECT room, author AS name, (SELECT max(id) FROM f g WHERE g.room = f.room) AS cursor, max(ts) AS seen, count(*) AS messages FROM f WHERE NOT human GROUP BY room, author""")
def import_log(spark, sf_dir):
    log = A.room_log(spark, sf_dir).withColumn("author", F.regexp_replace("author", r"\d$", ""))
    log, agents = rooms.import_log(log.where("CAST(room AS BIGINT) % 3 = 0"), spark.createDataFrame([], "room string, name string, cursor long, seen long"), log)
    n = log.where("NOT human").groupBy("room", F.col("author").alias("name")).agg(F.count("*").alias("messages"))
    return agents.join(n, ["room", "name"])


@query("SELECT event_id FROM events WHERE value BETWEEN 0 AND 100 AND ts + INTERVAL 24 HOURS >= TIMESTAMP '2024-01-05 00:00:00'")
def quota(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("used"), F.col("ts").cast("timestamp").alias("resets_at"))
    return reports.quota(e, F.lit("2024-01-05 00:00:00").cast("timestamp")).select("event_id")
