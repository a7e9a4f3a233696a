"""The pipeline against a brute-force version of its stages, and the registered queries."""

import os
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillmere.llm.common import stash
from quillmere.llm.queries import ORACLES, QUERIES, tokenizer

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The fixture documents, some of them with a benchmark item inside, and the benchmark."""
    path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(30))
    leak = [(200, f"{rows[0][1]} {item}", "en", "s1", 1), (201, f"{item[: len(item) // 2]} {rows[2][1]} qq", "en", "s2", 1)]
    documents = [(*r[:4], r[4]) for r in rows] + leak
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "never there at all in any text")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), documents, item


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_match_brute_force(spark, folder):
    path, documents, item = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, path), name)
        kept[name] = [tuple(r) for r in docs.collect()]
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted((d for d in documents if d[1] and any(c.isalpha() for c in d[1])), key=key)
    assert sorted(kept["language"], key=key) == want
    up = list(range(len(want)))
    sets = [shingles(d[1]) for d in want]
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(want)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = [d for i, d in enumerate(want) if find(i) == i]
    assert sorted(kept["near_dedup"], key=key) == want
    words = re.findall(r"[a-z0-9]+", item)
    asked = {tuple(words[i : i + 5]) for i in range(26)}

    def holds(text):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        return len(asked & {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) >= 0.8 * len(asked)

    want = [d for d in want if not holds(d[1])]
    assert sorted(kept["decontaminate"], key=key) == want and 200 not in {d[0] for d in want} and 201 in {d[0] for d in want}
    mixed = kept["mix"]
    assert set(mixed) <= set(want) and all(mixed.count(d) <= 3 for d in set(mixed))
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0
    ids = {}
    for d in mixed:
        ids.setdefault(d[0], []).append(plain.encode(d[1], add_special_tokens=False).ids + [1])
    got = sorted(kept["tokens"], key=lambda r: r[1])
    assert sorted((d[0] for d in mixed), key=lambda x: (x is None, x or 0)) == [r[0] for r in got]
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in [(len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())) for i in ids[doc_id]]
        start += n
    again = sorted(tuple(r) for r in corpus_pipeline.run(spark, path).where("doc_id IS NOT NULL").collect())
    assert again == sorted(tuple(r) for r in kept["tokens"] if r[0] is not None)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
    assert docs.collect() == []


def test_stages_keep_columns_of_any_name(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder[0]).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_queries_are_registered():
    assert [n for n in QUERIES] and {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [int(n) for n in range(4, 6)] and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall()))
