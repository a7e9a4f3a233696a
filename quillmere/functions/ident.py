"""Identity functions, as SHA-256 over NUL-separated parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLE_BYTES = {"user": 1, "assistant": 2, "tool": 3, "system": 4}


def _bytes(c: Column) -> Column:
    return c.cast("binary")


def role_byte(role: Column) -> Column:
    """One byte a role; unknown roles are the last."""
    out = F.unhex(F.lit("04"))
    for name, b in ROLE_BYTES.items():
        out = F.when(F.lower(role) == name, F.unhex(F.lit(f"{b:02x}"))).otherwise(out)
    return out


def conversation_hash(tool: Column, messages: Column) -> Column:
    """Of the tool and the ordered messages (array of structs role, content): no times, no paths."""
    nul = F.unhex(F.lit("00"))
    body = F.aggregate(messages, F.concat(_bytes(tool), nul), lambda acc, m: F.concat(acc, role_byte(m["role"]), _bytes(m["content"]), nul))
    return F.sha2(body, 256)


def conversation_id(content_hash: Column) -> Column:
    return F.concat(F.lit("cv_"), F.substring(content_hash, 1, 16))


def session_key(tool: Column, path: Column, first_message: Column) -> Column:
    nul = F.unhex(F.lit("00"))
    return F.concat(F.lit("sk_"), F.substring(F.sha2(F.concat(_bytes(tool), nul, _bytes(path), nul, _bytes(first_message)), 256), 1, 16))


def work_id(*parts: Column, salt: str = "quillmere-work-v1") -> Column:
    nul = F.unhex(F.lit("00"))
    joined = _bytes(F.lit(salt))
    for p in parts:
        joined = F.concat(joined, nul, _bytes(F.coalesce(p, F.lit(""))))
    return F.concat(F.lit("th_w"), F.substring(F.sha2(joined, 256), 1, 16))


def implicit_id(key: Column) -> Column:
    return F.concat(F.lit("th_"), F.regexp_replace(key, "^sk_", ""))


def derived_title(title: Column, first_user: Column, project: Column, tool: Column, most: int = 80) -> Column:
    """The title, else the first user message's first line, else the project, else the tool."""
    line = F.trim(F.substring_index(F.trim(first_user), "\n", 1))
    clipped = F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most), F.lit("…")))
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(title), blank(clipped), blank(project), tool)
