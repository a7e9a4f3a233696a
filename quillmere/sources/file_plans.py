"""Sources whose files are lines or JSON as plans: they are parsed into VARIANT values by Spark, and messages, sessions and their spans are columns and aggregates.

A file of lines is split at line feeds alone and each line parsed by itself, so what is no object is left out and nothing
else is lost; a session is put together again by its path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MESSAGE = "struct<seq:int,role:string,content:string,ts:timestamp,tools:array<string>,snippets:array<struct<language:string,text:string>>>"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _string(v: Column, path: str = "$") -> Column:
    """A string at a path; null for anything else."""
    return F.when(_is(_at(v, path), "STRING"), F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str = "$") -> Column:
    """An array at a path as variants; null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _part(v: Column) -> Column:
    """The text of a part: a string, or an object with a text."""
    return F.coalesce(_string(v), _string(v, "$.text"))


def _joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n\n")


def _says(c: Column) -> Column:
    """Whether there is anything but white space."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def _text(files: DataFrame) -> DataFrame:
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _lines(files: DataFrame) -> DataFrame:
    """(path, at, v): the objects of files of JSON lines; a file without any keeps one row, without an object."""
    rows = _text(files).select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.select("path", "at", F.try_parse_json("line").alias("v"))
    return rows.where(_is(F.col("v"), "OBJECT") | (F.col("at") == 0)).withColumn("v", F.when(_is(F.col("v"), "OBJECT"), F.col("v")))


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("at")))


def _stem() -> Column:
    return F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def _sessions(rows: DataFrame, tool: str, native: Column, more: dict[str, Column]) -> DataFrame:
    """Sessions of ``rows`` (path, at, role, content, ts, seen, tools, …), a message where role is set; files without a message are failures."""
    said = F.collect_list(F.when(F.col("role").isNotNull(), F.struct("at", "role", "content", "ts", "tools")))
    whole = rows.groupBy("path").agg(
        F.array_sort(said).alias("said"), F.coalesce(native, F.first(_stem())).alias("native_id"), F.min("seen").alias("started_at"), F.max("seen").alias("ended_at"),
        *[c.alias(name) for name, c in more.items()],
    )
    messages = F.transform("said", lambda m, i: F.struct(i.alias("seq"), m["role"].alias("role"), m["content"].alias("content"), m["ts"].alias("ts"), m["tools"].alias("tools"), T.fenced(m["content"]).alias("snippets")))
    null = lambda name, kind="string": F.col(name) if name in more else F.lit(None).cast(kind).alias(name)
    return whole.select(
        F.lit(tool).alias("tool"), F.lit("thread").alias("kind"), "path", "native_id", null("title"), null("project"), null("branch"), null("model"), "started_at", "ended_at",
        F.when(F.size("said") == 0, "no messages").alias("error"), messages.cast(f"array<{MESSAGE}>").alias("messages"), *[n for n in more if n in ("good", "file")],
    )


def claude_code(files: DataFrame) -> DataFrame:
    rows, v = _lines(files), F.col("v")
    blocks = F.coalesce(_list(v, "$.message.content"), F.array().cast("array<variant>"))
    rows = rows.select("path", "at", "v", blocks.alias("blocks"))
    kind = lambda b: F.coalesce(_string(b, "$.type"), F.lit(""))

    def said(b: Column) -> Column:
        result = _at(b, "$.content")
        inner = F.coalesce(F.when(_is(result, "STRING"), _string(result)), F.array_join(F.filter(F.transform(_list(result), lambda p: _string(p, "$.text")), lambda t: t.isNotNull()), "\n\n"), F.lit(""))
        empty = result.isNull() | F.is_variant_null(result) | (_string(result) == "") | (F.size(_list(result)) == 0)
        return F.when(kind(b) == "text", _string(b, "$.text")).when((kind(b) == "tool_result") & ~F.coalesce(empty, F.lit(False)), inner)

    texts = F.filter(F.concat(F.array(_string(v, "$.message.content")), F.transform("blocks", said)), lambda t: t.isNotNull())
    # an empty first text leaves no blank line
    text = F.array_join(F.filter(texts, lambda t, i: (t != "") | (i > 0)), "\n\n")
    tools = F.transform(F.filter("blocks", lambda b: kind(b) == "tool_use"), lambda b: F.coalesce(_string(b, "$.name"), F.lit("")))
    role = F.coalesce(_filled(_string(v, "$.message.role")), _filled(_string(v, "$.type")), F.lit("user"))
    role = F.when(role.isin("assistant", "system"), role).otherwise("user")
    silent = ~F.exists("blocks", lambda b: kind(b).isin("text", "tool_use", "thinking")) & (F.size("blocks") > 0)
    rows = rows.select(
        "path", "at", text.alias("content"), tools.alias("tools"), F.when((role == "user") & silent, "tool").otherwise(role).alias("role"), _is(_at(v, "$.message"), "OBJECT").alias("held"),
        _time(_string(v, "$.timestamp")).alias("ts"), _filled(_string(v, "$.cwd")).alias("cwd"), _filled(_string(v, "$.gitBranch")).alias("branch"), _filled(_string(v, "$.message.model")).alias("model"),
    )
    rows = rows.withColumn("role", F.when(F.col("held") & (_says(F.col("content")) | (F.size("tools") > 0)), F.col("role"))).withColumn("seen", F.col("ts"))
    none = F.lit(None).cast("string")
    return _sessions(rows, "claude-code", none, {"project": _first(F.col("cwd")), "branch": _first(F.col("branch")), "model": _first(F.col("model"))})


# The items of a rollout that are calls and results of tools.
CALLS, RESULTS = ("function_call", "local_shell_call", "custom_tool_call"), ("function_call_output", "local_shell_call_output")


def codex(files: DataFrame) -> DataFrame:
    rows, v = _lines(files), F.col("v")
    payload = F.when(_is(_at(v, "$.payload"), "OBJECT"), _at(v, "$.payload")).otherwise(v)
    rows = rows.select("path", "at", "v", payload.alias("p"))
    p = F.col("p")

    def text(path: str) -> Column:
        """Strings follow each other, objects start a paragraph."""
        parts = F.filter(F.transform(_list(p, path), lambda b: F.struct(_part(b).alias("t"), _is(b, "STRING").alias("plain"))), lambda x: x["t"].isNotNull())
        whole = F.aggregate(parts, F.lit(""), lambda acc, x: F.concat(acc, F.when(x["plain"] | (acc == ""), x["t"]).otherwise(F.concat(F.lit("\n\n"), x["t"]))))
        return F.coalesce(_string(p, path), whole, F.lit(""))

    kind, name = _string(p, "$.type"), F.coalesce(_string(p, "$.name"), F.lit("tool"))
    given = _at(p, "$.arguments")
    arguments = F.coalesce(_string(given), F.when(~F.is_variant_null(given), F.to_json(given)), F.lit(""))
    called, said = F.concat(name, F.lit("("), arguments, F.lit(")")), text("$.content")
    output = F.when(_at(p, "$.output").isNotNull(), text("$.output")).otherwise(said)
    meta = F.coalesce(_string(v, "$.type") == "session_meta", F.lit(False))
    spoke = _string(p, "$.role")
    role = (
        F.when(meta, None).when((kind == "message") & _says(said), F.when(spoke.isin("assistant", "system", "tool"), spoke).otherwise("user"))
        .when(kind.isin(*CALLS), "tool").when(kind.isin(*RESULTS) & _says(output), "tool")
    )
    content = F.when(kind == "message", said).when(kind.isin(*CALLS), called).otherwise(output)
    tools = F.when(kind.isin(*CALLS), F.array(name)).otherwise(F.array().cast("array<string>"))
    at = F.when(_at(v, "$.timestamp").isNotNull(), _string(v, "$.timestamp")).otherwise(_string(p, "$.timestamp"))
    rows = rows.select(
        "path", "at", role.alias("role"), content.alias("content"), tools.alias("tools"), F.lit(None).cast("timestamp").alias("ts"), _time(at).alias("seen"), F.when(meta, _filled(_string(p, "$.id"))).alias("id"),
        _filled(_string(p, "$.cwd")).alias("cwd"), _filled(_string(p, "$.model")).alias("model"),
    )
    last = F.max_by("id", F.when(F.col("id").isNotNull(), F.col("at")))
    return _sessions(rows, "codex", last, {"project": _first(F.col("cwd")), "model": _first(F.col("model"))})


def _document(files: DataFrame) -> DataFrame:
    """(path, v): files of one JSON value; null where it is none."""
    return _text(files).select("path", F.try_parse_json("text").alias("v"))


def _compact(v: Column) -> Column:
    return F.when(F.is_variant_null(v), "null").otherwise(F.to_json(v))


def _block(b: Column, depth: int) -> Column:
    """The text of a block: calls by name and input, results by what they hold (blocks again), others by their text."""
    kind, call, given = F.coalesce(_string(b, "$.type"), F.lit("")), _at(b, "$.name"), _at(b, "$.input")
    name = F.when(call.isNull(), "tool").otherwise(F.coalesce(_string(call), _compact(call)))
    used = F.concat(F.lit("[tool: "), name, F.lit("] "), F.coalesce(_compact(given), F.lit("")))
    inner = _blocks(_at(b, "$.content"), depth - 1) if depth else F.lit(None).cast("string")
    other = F.when(~kind.isin("tool_use", "tool_result"), _string(b, "$.text"))
    return F.when(_is(b, "OBJECT"), F.when(kind == "tool_use", used).when((kind == "tool_result") & _says(inner), inner).otherwise(other))


def _blocks(v: Column, depth: int = 2) -> Column:
    """The text of a string or a list of blocks; results within results within results are looked at no further."""
    return F.coalesce(_string(v), _joined(F.transform(_list(v), lambda b: _block(b, depth))), F.lit(""))


def cline(files: DataFrame) -> DataFrame:
    whole = _document(files).select("path", "v", _is(F.col("v"), "ARRAY").alias("good"))
    rows = whole.select("path", "good", F.posexplode_outer(_list(F.col("v"))).alias("at", "x"))
    x, folder = F.col("x"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    spoke, text = _string(x, "$.role"), _blocks(_at(x, "$.content"))
    role = F.when(_is(x, "OBJECT") & _says(text), F.when(spoke.isin("assistant", "system"), spoke).otherwise("user"))
    number = F.when(folder.rlike(r"^\d+$"), F.try_to_number(folder, F.lit("9" * 30)).cast("double"))
    began = F.when(number < 1e14, F.timestamp_micros((F.when(number > 1e11, number / 1000).otherwise(number) * 1_000_000).cast("long")))
    rows = rows.select(
        "path", "good", "at", role.alias("role"), text.alias("content"), F.lit(None).cast("timestamp").alias("ts"), began.alias("seen"), F.array().cast("array<string>").alias("tools"), folder.alias("folder")
    )
    out = _sessions(rows, "cline", F.first("folder"), {"good": F.first("good")})
    return out.withColumn("error", F.when(~F.col("good"), "not an array").otherwise(F.col("error"))).drop("good")


def gemini(files: DataFrame) -> DataFrame:
    """A document, or a log of records that may be taken back to an earlier one."""
    lined = F.endswith("path", F.lit(".jsonl"))
    log = _lines(files.where(lined)).where("v IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", F.to_json("v").alias("line")))).alias("held"))
    log = log.select("path", F.transform("held", lambda h: F.parse_json(h["line"])).alias("held"))
    head, rest = F.element_at("held", 1), F.slice("held", 2, F.size("held"))
    none = F.array().cast("array<variant>")

    def step(acc: Column, e: Column) -> Column:
        back = _string(e, "$['$rewindTo']")
        # the last place that stays: that of the first record of this id
        place = F.array_position(F.transform(acc, lambda m: F.coalesce(_string(m, "$.id"), F.lit(""))), back)
        settled = _is(_at(e, "$['$set']"), "OBJECT")
        record = _at(e, "$.type").isNotNull() | _at(e, "$.content").isNotNull()
        return F.when(settled, acc).when(back.isNotNull(), F.when(place > 0, F.slice(acc, F.lit(1), place.cast("int"))).otherwise(acc)).when(record, F.concat(acc, F.array(e))).otherwise(acc)

    sets = F.filter(F.transform(rest, lambda e: F.when(_is(_at(e, "$['$set']"), "OBJECT"), F.struct(_string(e, "$['$set'].startTime").alias("t")))), lambda x: x.isNotNull())
    began = F.when(_at(head, "$.startTime").isNotNull(), _string(head, "$.startTime")).otherwise(F.get(sets, F.lit(0))["t"])
    log = log.select("path", F.aggregate(rest, F.coalesce(_list(head, "$.messages"), none), step).alias("records"), began.alias("began"), _string(head, "$.sessionId").alias("id"))
    empty = _text(files.where(lined)).select("path").join(log.select("path"), "path", "left_anti")
    empty = empty.select("path", none.alias("records"), F.lit(None).cast("string").alias("began"), F.lit(None).cast("string").alias("id"))
    v = F.col("v")
    whole = _document(files.where(~lined)).select("path", F.coalesce(_list(v), _list(v, "$.messages"), none).alias("records"), _string(v, "$.startTime").alias("began"), _string(v, "$.sessionId").alias("id"))
    both = log.unionByName(empty).unionByName(whole)
    rows = both.select("path", "began", "id", F.posexplode_outer("records").alias("at", "x"))
    x = F.col("x")
    kind, content = _string(x, "$.type"), _at(x, "$.content")
    said = F.coalesce(_part(content), _joined(F.transform(_list(content), _part)), F.lit(""))
    role = F.when(_says(said), F.when(kind == "user", "user").when(kind.isin("gemini", "assistant", "model"), "assistant"))
    rows = rows.select("path", F.coalesce("at", F.lit(0)).alias("at"), role.alias("role"), said.alias("content"), F.lit(None).cast("timestamp").alias("ts"), _time(F.col("began")).alias("seen"), _filled(F.col("id")).alias("id"), F.array().cast("array<string>").alias("tools"))
    return _sessions(rows, "gemini", F.first("id"), {})


def aider(files: DataFrame) -> DataFrame:
    """Markdown with a marker a session.  Lines before a first marker are a session of their own, without a time; notes (``>``) are no messages."""
    mark = "# aider chat started at "
    text = F.regexp_replace("text", r"\n\z", "")
    lines = _text(files).select("path", F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    begins = F.startswith("line", F.lit(mark))
    in_file = Window.partitionBy("path").orderBy("at")
    # numbered from 0, whether the first begins with a marker or not
    lines = lines.withColumn("n", F.count_if(begins).over(in_file) - F.first(begins.cast("int")).over(in_file))
    note = F.startswith("line", F.lit(">"))
    model = F.when(note, _filled(F.regexp_extract(F.get(F.split(F.substring("line", 2, 1_000_000), "Model:"), F.lit(1)), r"^\s*(\S+)", 1)))
    about = lines.groupBy("path", "n").agg(F.max(F.when(begins, F.substring("line", len(mark) + 1, 100))).alias("began"), F.min_by(model, F.when(model.isNotNull(), F.col("at"))).alias("model"))
    said = lines.where(~begins & ~note)
    user = (F.col("line") == "####") | F.startswith("line", F.lit("#### "))
    said = said.select("path", "n", "at", F.when(user, "user").otherwise("assistant").alias("role"), F.when(user, F.substring("line", 6, 10_000_000)).otherwise(F.col("line")).alias("line"))
    in_session = Window.partitionBy("path", "n").orderBy("at")
    turns = said.withColumn("turn", F.count_if(~F.col("role").eqNullSafe(F.lag("role").over(in_session))).over(in_session))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    turns = turns.groupBy("path", "n", "turn").agg(F.min("at").alias("at"), F.first("role").alias("role"), F.regexp_replace(text_of, r"(?U)\A\s+|\s+\z", "").alias("content"))
    began = _time(F.replace(F.trim("began"), F.lit(" "), F.lit("T")))
    rows = about.withColumn("ts", began).join(turns, ["path", "n"], "left").select(
        F.concat("path", F.lit("#"), F.col("n").cast("string")).alias("path"), F.coalesce("at", F.lit(0)).alias("at"), F.when(F.col("content") != "", F.col("role")).alias("role"), "content",
        F.lit(None).cast("timestamp").alias("ts"), F.col("ts").alias("seen"), "model", F.array().cast("array<string>").alias("tools"), F.col("path").alias("file"),
    )
    parent = F.when(F.col("file").contains("/"), F.coalesce(_filled(F.regexp_extract("file", r"^(.*)/[^/]*$", 1)), F.lit("/"))).otherwise(".")
    out = _sessions(rows, "aider", F.first("path"), {"model": F.first("model"), "project": F.first(parent), "file": F.first("file")})
    out = out.withColumn("path", F.regexp_replace("path", r"#\d+$", ""))
    # a session without messages is none; a file without any is a failure
    good = out.where("error IS NULL").drop("file")
    bad = _text(files).select("path").join(good.select("path").distinct(), "path", "left_anti")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("native_id", "string"), ("title", "string"), ("project", "string"), ("branch", "string"), ("model", "string"), ("started_at", "timestamp"), ("ended_at", "timestamp"))]
    return good.unionByName(bad.select(F.lit("aider").alias("tool"), F.lit("thread").alias("kind"), "path", *none, F.lit("no sessions").alias("error"), F.array().cast(f"array<{MESSAGE}>").alias("messages")))


#: Sources that are plans.
PLANS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude-code": claude_code, "codex": codex, "aider": aider, "cline": cline, "gemini": gemini}
