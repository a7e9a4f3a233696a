"""Text expressions: all Columns, so that they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substring markers of user turns, as lower-case text.
CORRECTION_MARKERS = [
    "no,", "no.", "nope", "actually", "that's wrong", "thats wrong", "that's not", "thats not", "not what i", "not quite", "incorrect",
    "undo", "revert", "rollback", "go back", "try again", "that didn't work", "that didnt work", "doesn't work", "doesnt work",
    "still broken", "instead", "i meant",
]
CONSTRAINT_MARKERS = ["must", "should", "only", "don't", "dont", "never", "always", "exactly", "ensure", "require", "without", "instead of", "make sure"]
ERROR_MARKERS = ["error", "traceback", "exception", "panicked", "stack trace", "undefined", "cannot find"]
TEST_MARKERS = ["test", "pytest", "jest", "cargo test", "unit test"]
COMMIT_MARKERS = ["commit", "git add", "git push"]
# Words that say nothing in a title.
STOPWORDS = [
    "the", "and", "for", "with", "you", "your", "how", "this", "that", "from", "are", "was", "can", "use", "using", "add", "fix", "new", "get",
    "set", "run", "make", "via", "out", "all", "not", "now", "into", "what", "when", "where", "why", "should", "would", "could", "did", "does",
    "have", "has",
]
# How the tool itself opens a message.
NOISE_OPENINGS = ["<", "Caveat:", "[Request interrupted", "This session is being continued"]
# Secrets and what takes their place, in the order of application.
REDACTED = "[REDACTED]"
REDACTION_RULES = [
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", REDACTED),
    (r"sk-ant-[A-Za-z0-9_-]{20,}", REDACTED),
    (r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}", REDACTED),
    (r"gh[posru]_[A-Za-z0-9]{20,}", REDACTED),
    (r"github_pat_[A-Za-z0-9_]{22,}", REDACTED),
    (r"xox[baprs]-[A-Za-z0-9-]{10,}", REDACTED),
    (r"AKIA[0-9A-Z]{16}", REDACTED),
    (r"AIza[0-9A-Za-z_-]{35}", REDACTED),
    (r"(?:sk|rk)_live_[A-Za-z0-9]{20,}", REDACTED),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", REDACTED),
    (r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}", "Bearer [REDACTED]"),
    (r"(?i)\b([a-z][a-z0-9+.\-]*://[^\s/:@]+):[^\s/@]+@", "$1:[REDACTED]@"),
    (r"(?i)(\b(?:api[_-]?key|secret|access[_-]?token|auth[_-]?token|token|password|passwd|pwd|client[_-]?secret)\b)\s*[:=]\s*[\"']?[A-Za-z0-9._\-/+]{8,}[\"']?", "$1=[REDACTED]"),
]


#: What every secret has, in any case of letters: texts without any of it are left as they are, at the price of one pass.
REDACTION_CUE = r"(?i)private key-|sk-|gh[posru]_|github_pat_|xox[baprs]-|akia|aiza|[sr]k_live_|eyj|bearer|://|api[_-]?key|secret|token|passw|pwd"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_any(text: Column | str, markers: list[str]) -> Column:
    """Whether the lower-cased text contains any of the markers; null: false."""
    low = F.lower(_col(text))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers]), F.lit(False))


def redact(text: Column | str) -> Column:
    """Every secret replaced, rule after rule."""
    done = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), REDACTION_RULES, _col(text))
    return F.when(F.rlike(_col(text), F.lit(REDACTION_CUE)), done).otherwise(_col(text))


def normalize(text: Column | str) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(_col(text), r"\s+", " ")))


#: What lies between words.
NO_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(_col(text)), NO_WORD), lambda t: t != "")


def title_terms(text: Column | str) -> Column:
    """Terms of a title: three bytes or more, no stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(text), lambda t: (F.octet_length(t) >= 3) & ~F.array_contains(stop, t))


def clip(text: Column | str, most: int) -> Column:
    """One line of ``most`` characters, an ellipsis where more was there."""
    flat = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def clip_bytes(text: Column | str, most: int) -> Column:
    """At most ``most`` bytes, no character cut in two, an ellipsis where more was there."""
    c = _col(text)
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), 1, most).cast("string"))
    whole = F.regexp_replace(cut, "\ufffd+$", "")  # what is left of a character that was cut in two
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(F.rtrim(whole), F.lit(" …")))


def fenced(text: Column | str) -> Column:
    """The fenced blocks of a text as (language, text), whose fences may be indented; the first word after a fence is the language; an
    empty block counts if it is closed, the last block may be open.

    The places of the fences say which lines belong to which block."""
    lines = F.split(F.regexp_replace(F.regexp_replace(_col(text), r"\r\n", "\n"), r"\n\z", ""), "\n")
    mark = r"^\s*```"

    def blocks(held: Column) -> Column:
        marks = F.filter(F.transform(held, lambda x, i: F.when(x.rlike(mark), i + 1)), lambda i: i.isNotNull())

        def paired(at: Column) -> Column:
            def block(j: Column) -> Column:
                start, end = F.get(at, 2 * j), F.get(at, 2 * j + 1)
                body = F.slice(held, start + 1, F.greatest(F.lit(0), F.coalesce(end, F.size(held) + 1) - start - 1))
                whole = F.struct(F.regexp_extract(F.get(held, start - 1), r"^\s*```\s*(\S*)", 1).alias("language"), F.array_join(body, "\n").alias("text"))
                return F.when(end.isNotNull() | (F.size(body) > 0), whole)

            found = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(at) - 1) / 2).cast("int"))), block)
            return F.when(F.size(at) > 0, F.filter(found, lambda b: b.isNotNull())).otherwise(F.array().cast("array<struct<language:string,text:string>>"))

        return F.element_at(F.transform(F.array(marks), paired), 1)

    return F.element_at(F.transform(F.array(lines), blocks), 1)


def clip_plain(text: Column | str, most: int) -> Column:
    return F.substring(F.trim(_col(text)), 1, most)


def plain_snippet(text: Column | str, most: int = 160) -> Column:
    return clip(text, most)


def is_noise(text: Column | str) -> Column:
    """The tool talking, not the person."""
    t = F.ltrim(F.coalesce(_col(text), F.lit("")))
    return reduce(lambda a, b: a | b, [t.startswith(p) for p in NOISE_OPENINGS], t == "")


def is_done(text: Column | str) -> Column:
    return F.upper(F.trim(F.coalesce(_col(text), F.lit("")))).startswith("DONE")


def has_code(text: Column | str) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    runs = F.size(F.split(t, "    ", -1)) - 1
    return F.contains(t, F.lit("```")) | (runs > 3) | F.contains(t, F.lit(");\n"))


def languages(text: Column | str) -> Column:
    """Distinct languages named at the opening of fenced blocks."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), "```", -1)
    opened = F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.lower(F.regexp_extract(p, r"^([\p{L}\p{N}+#]*)", 1)))), lambda x: x.isNotNull() & (x != "") & (F.octet_length(x) <= 16))
    return F.array_distinct(opened)


def overlaps(a: Column | str, b: Column | str) -> Column:
    """Two paths are equal, or one contains the other."""
    a, b = F.rtrim(_col(a), F.lit("/")), F.rtrim(_col(b), F.lit("/"))
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def week_bucket(ts: Column | str) -> Column:
    """Year and Monday-based week of the year, 00 to 53."""
    t = _col(ts)
    return F.concat(F.date_format(t, "yyyy"), F.lit("-W"), F.lpad(F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("string"), 2, "0"))


def day_bucket(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def tags(text: Column | str) -> Column:
    """A comma-separated string as sorted distinct lower-case tags."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(_col(text), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def normalize_remote(url: Column | str) -> Column:
    """A git remote as host/path, or null where there is none."""
    u = F.trim(_col(url))
    scheme = F.lower(F.regexp_extract(u, r"^([^:/]*)://", 1))
    scp = F.regexp_extract(u, r"^([^/:]{2,}):(?!\\)(.*)$", 1)
    rest = F.when(F.contains(u, F.lit("://")), F.when(scheme != "file", F.regexp_replace(u, r"^[^:/]*://", ""))).when(scp != "", F.regexp_replace(u, r"^([^/:]{2,}):", "$1/"))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)/", 1), r"^.*@", ""), r":.*$", "")
    path = F.trim(F.regexp_replace(F.trim(F.regexp_extract(rest, r"^[^/]*/(.*)$", 1), F.lit("/")), r"\.git$", ""), F.lit("/"))
    return F.when((host != "") & (path != ""), F.lower(F.concat(host, F.lit("/"), path)))


def repo_label(key: Column | str) -> Column:
    """owner/repo of a remote, the last segment of a path, a short hash of a root commit."""
    k = _col(key)
    local = k.startswith("path:")
    body = F.regexp_replace(k, "^path:", "")
    parts = F.filter(F.split(body, r"[/\\]"), lambda p: p != "")
    keep = F.when(local, 1).otherwise(2)
    label = F.concat_ws("/", F.slice(parts, F.greatest(F.lit(1), F.size(parts) - keep + 1), keep))
    return F.when(k.startswith("root:"), F.concat(F.lit("repo "), F.substring(k, 6, 8))).otherwise(F.when(label == "", body).otherwise(label))


def relative_time(ts: Column | str, now: Column) -> Column:
    """How long ago, in the largest fitting unit."""
    s = F.unix_timestamp(now) - F.unix_timestamp(_col(ts))
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(f" {name} ago"))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "min")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def percent_decode(text: Column | str) -> Column:
    """Percent escapes decoded; a plus stays one."""
    return F.url_decode(F.replace(_col(text), F.lit("+"), F.lit("%2B")))
