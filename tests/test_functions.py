import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import ident as I
from quillmere.functions import text as T
from quillmere.functions import vector as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


REDACTED = [
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED]"), ("sk-ant-" + "a" * 20, "[REDACTED]"), ("sk-proj-" + "b" * 20, "[REDACTED]"), ("ghp_" + "c" * 20, "[REDACTED]"),
    ("github_pat_" + "d" * 22, "[REDACTED]"), ("xoxb-" + "1" * 10, "[REDACTED]"), ("AKIA" + "A" * 16, "[REDACTED]"), ("AIza" + "e" * 35, "[REDACTED]"), ("sk_live_" + "f" * 20, "[REDACTED]"),
    ("eyJ" + "a" * 8 + "." + "b" * 8 + "." + "c" * 8, "[REDACTED]"), ("Authorization: Bearer " + "x" * 16, "Authorization: Bearer [REDACTED]"), ("postgres://me:pw@host/db", "postgres://me:[REDACTED]@host/db"),
    ("API_KEY = 'abcdefgh1'", "API_KEY=[REDACTED]"),
]
KEPT = ["sk-ant-short", "sk-" + "a" * 5, "ghp_short", "github_pat_x", "xoxb-1", "AKIA123", "AIzaX", "sk_live_x", "eyJa.b.c", "Bearer short", "https://host/path", "token = abc", "-----BEGIN PUBLIC KEY-----"]


@pytest.mark.parametrize("text, want", [*REDACTED, *[(k, k) for k in KEPT]])
def test_redaction(spark, text, want):
    assert one(spark, T.redact("t"), t=text) == want


@pytest.mark.parametrize("url, want", [
    ("https://user:tok@GitHub.com:443/Owner/Repo.git/", "github.com/owner/repo"), ("git@github.com:owner/repo.git", "github.com/owner/repo"), ("ssh://git@host:22/a/b", "host/a/b"), ("file:///tmp/x", None),
    ("C:\\repo", None), ("/local/path", None), ("", None), ("https://host", None),
])
def test_remotes(spark, url, want):
    assert one(spark, T.normalize_remote("u"), u=url) == want


def test_labels_clips_and_terms(spark):
    assert [one(spark, T.repo_label("k"), k=k) for k in ("github.com/o/r", "path:/a/b/c", "root:0123456789ab")] == ["o/r", "c", "repo 01234567"]
    assert one(spark, T.clip("t", 5), t="  abc   def ") == "abc d…" and one(spark, T.clip("t", 20), t=" a\n b ") == "a b"
    assert one(spark, T.title_terms("t"), t="Fix the parser, AND é éé x1y") == ["parser", "éé", "x1y"]
    assert one(spark, T.tags("t"), t=" B, a,b,, ") == ["a", "b"]
    assert one(spark, T.languages("t"), t="x```python\n1\n``` y ```Rust\n``` ```\nz``` ```python\n```") == ["python", "rust"]
    assert [one(spark, T.has_code("t"), t=t) for t in ("```", "    " * 4, "    " * 3, "f();\n", "f()")] == [True, True, False, True, False]
    assert [one(spark, T.is_done("t"), t=t) for t in (" done: x", "DONE", "undone", None)] == [True, True, False, False]
    assert [one(spark, T.is_noise("t"), t=t) for t in (" <x>", "Caveat: y", "hello", "")] == [True, True, False, True]
    assert [one(spark, T.overlaps("a", "b"), a=a, b=b) for a, b in (("/a/b", "/a"), ("/a", "/a/b/"), ("/a", "/ab"), ("/a", "/a"))] == [True, True, False, True]


def test_weeks(spark):
    import datetime as dt

    days = [dt.datetime(2023, 12, 30) + dt.timedelta(days=i) for i in range(800)]
    got = spark.createDataFrame([(d,) for d in days], "d timestamp").select(T.week_bucket("d").alias("w")).collect()
    assert [r.w for r in got] == [d.strftime("%Y-W%W") for d in days]


def test_identity_ignores_nothing_else(spark):
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("yo").alias("content")))
    want = hashlib.sha256(b"codex\0\x01hi\0\x02yo\0").hexdigest()
    assert one(spark, I.conversation_hash(F.lit("codex"), messages), a="") == want
    assert one(spark, I.conversation_id(F.lit(want)), a="") == "cv_" + want[:16]
    assert one(spark, I.session_key(F.lit("t"), F.lit("p"), F.lit("m")), a="") == "sk_" + hashlib.sha256(b"t\0p\0m\0".rstrip(b"\0")).hexdigest()[:16]
    title = lambda t, u, p: one(spark, I.derived_title(F.col("t"), F.col("u"), F.col("p"), F.lit("tool")), t=t, u=u, p=p)
    assert [title("T", "u", "p"), title(" ", "first\nsecond", "p"), title(None, " ", "p"), title(None, None, None), title(None, "x" * 90, None)] == ["T", "first", "p", "tool", "x" * 80 + "…"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("z"), V.unit(F.col("a")).alias("u"), V.squared_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert (round(r.c, 9), r.z, r.u, r.d) == (0.96, 0.0, [0.6, 0.8], 2.0)
    out = V.embed(spark.createDataFrame([("Hello hello world",), ("",), (None,)], "content string")).collect()
    assert np.allclose(out[0].embedding, V.hash_vector(["hello", "hello", "world"])) and abs(np.linalg.norm(out[0].embedding) - 1) < 1e-6 and not any(out[1].embedding) and not any(out[2].embedding)
