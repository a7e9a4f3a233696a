import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, target int, fp string"


def words(rng, n, base="abcdefghij"):
    return " ".join("".join(rng.choice(base) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Small documents with copies, near copies, nulls, ties, repeats, a very long text, and columns of clashing names."""
    rng = random.Random(5)
    langs = {"en": "abcdefghij", "de": "klmnopqrst"}
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        out.append((i, words(rng, rng.randint(30, 120), langs[lang]), lang, f"s{i % 5}"))
    long = words(rng, 20_000)
    near = out[3][1].split()
    near[40 % len(near)] = "zzz"
    out += [
        (100, out[1][1], "en", "s1"), (101, " ".join(near), "en", "s1"), (102, None, "en", "s1"), (103, "", None, None), (104, " \t\n", "de", None), (105, "123 456 !!!", "en", "s2"),
        (106, "ab", None, "s0"), (106, "ab", None, "s0"), (None, out[5][1], "en", "s3"), (107, long, "en", "s4"), (108, "one two three", "en", "é"), (109, "x" * 5000, "en", "s0"),
    ]
    return [(*r, len(r[1] or ""), "size", "row", 1, "fp") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
