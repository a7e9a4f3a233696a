"""The contract of the entry file, with and without the training-data package, and every query against its SQL."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from quillmere.plans.queries import ORACLES, QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_works_without_the_training_data_package(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q) and len(q) > 100"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
    assert done.returncode == 0, done.stderr
    if len(gone) == 2:  # its other tests pass there too: some that need little time
        run = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_functions.py", "tests/test_sources.py", "-p", "no:cacheprovider"]
        done = subprocess.run(run, cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
        assert done.returncode == 0, done.stdout[-2000:]


def test_a_missing_library_takes_only_its_queries_down(monkeypatch):
    monkeypatch.setitem(sys.modules, "xxhash", None)
    for name in [n for n in sys.modules if n.startswith("quillmere.llm.near_dedup") or n.startswith("quillmere.llm.simhash") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert "pipeline" not in entry.queries() and "kw_search" in entry.queries()


def test_nothing_else_imports_the_package():
    for folder, _, names in os.walk(os.path.join(REPO, "quillmere")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert not re.search(r"\bllm\b", f.read()), n


@needs_tables
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["conversation_id", "seq", "score"] and df.count() > 0


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in result.fetchall())
        assert got == want
    else:
        assert got
