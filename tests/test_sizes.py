"""What a query holds and makes where its input is large."""

import datetime as dt
import random
import threading
import time

import numpy as np
import psutil
import pyarrow as pa
import pyarrow.parquet as pq

from quillmere.functions import vector as V
from quillmere.operators import questions, threads
from quillmere.plans import queries as core


def grown_by(act) -> float:
    """MB that the Python workers of this machine grow by, at most, while ``act`` runs."""

    def held() -> float:
        found = 0
        for p in psutil.Process().children(recursive=True):
            try:
                found += p.memory_info().rss if "python" in p.name() else 0
            except psutil.Error:
                pass
        return found / 1e6

    before, most, done = held(), [0.0], threading.Event()

    def watch() -> None:
        while not done.is_set():
            most[0] = max(most[0], held())
            time.sleep(0.02)

    t = threading.Thread(target=watch)
    t.start()
    try:
        act()
    finally:
        done.set()
        t.join()
    return most[0] - before


def warm(spark, n: int = 1) -> None:
    """Workers that have Arrow and numpy."""
    spark.range(n).repartition(n).mapInArrow(lambda bs: bs, "id long").collect()


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def most_rows(df) -> int:
    """The most rows that a node of the plan has made."""

    def walk(p) -> int:
        name = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, inner)])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


ROWS = "thread_id int, repo_key string, branch string, devices array<string>, last_activity timestamp, status string"


def test_related_threads_make_no_pairs(spark):
    t = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i)
    rows = spark.createDataFrame([(i, "r", "feat", [f"d{i % 2}"], t(i), "active") for i in range(2000)], ROWS)
    out = threads.related(rows)
    assert most_rows(out) < 100_000
    assert {(r.thread_id, r.other, r.apart) for r in out.collect() if r.thread_id in (0, 7)} == {(0, 1, 1), (0, 3, 3), (0, 5, 5), (7, 6, 1), (7, 8, 1), (7, 4, 3)}


def test_related_threads_are_those_of_all_pairs(spark):
    r = random.Random(5)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "a", "a"], [], ["c", None], [None], None]
    rows = [(i, "r" + str(i % 2), "feat", r.choice(kinds), dt.datetime(2026, 1, 1) + dt.timedelta(hours=r.randrange(150) if i % 3 else 50), None) for i in range(400)]

    def apart(x, y):
        if x is None or y is None or ({*x} - {None}) & ({*y} - {None}):
            return False
        return not x or not y or not (None in x or None in y)

    want = set()
    for a in rows:
        met = [(abs((a[4] - b[4]).total_seconds()), b[0]) for b in rows if b[0] != a[0] and b[1] == a[1] and abs(a[4] - b[4]) <= dt.timedelta(hours=48) and apart(a[3], b[3])]
        want |= {(a[0], o, int(s)) for s, o in sorted(met)[:3]}
    assert {tuple(x) for x in threads.related(spark.createDataFrame(rows, ROWS)).collect()} == want


def vectors(spark, n: int):
    x = np.random.default_rng(1).normal(size=(n, 4))
    return spark.createDataFrame(pa.table({"conversation_id": np.arange(n), "seq": np.zeros(n, np.int64), "embedding": pa.array(x.tolist())})).coalesce(1)


def test_many_questions_meet_few_at_a_time(spark):
    v = vectors(spark, 8000)
    asked = v.selectExpr("conversation_id AS question_id", "embedding")
    found = questions.semantic_hits(v, asked, 2)
    warm(spark)
    assert grown_by(lambda: noop(found)) < 400  # all scores at once are 512 MB, and twice that on the way
    few = asked.where("question_id < 50")
    key = lambda rows: sorted((r.question_id, r["rank"], r.conversation_id) for r in rows)
    assert key(questions.semantic_hits(v, few, 2, block=1).collect()) == key(questions.semantic_hits(v, few, 2).collect()) == key(found.where("question_id < 50").collect())


def test_hash_embeddings_of_long_texts_stay_small(spark):
    said = spark.range(0, 8000, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 400), i -> concat('w', (i * 7 + id) % 5000)), ' ') AS content")
    warm(spark)
    assert grown_by(lambda: noop(V.embed(said))) < 170  # 258 with words as Python strings, 92 as arrays
    r = V.embed(said).where("id = 4321").first()
    assert np.array_equal(np.array(r.embedding, np.float32), V.hash_vector(r.content.split()))


def test_editor_databases_go_few_at_a_time(spark, tmp_path):
    n = 12_000
    pq.write_table(pa.table({"conv_id": np.arange(n), "turn": np.zeros(n, np.int64), "role": ["user"] * n, "text": ["hello there"] * n}), tmp_path / "conversations.parquet")
    warm(spark, 4)
    for name in ("src_windsurf", "src_cursor"):
        grown = grown_by(lambda: noop(core.QUERIES[name](spark, str(tmp_path))))
        assert grown < 380, (name, grown)
