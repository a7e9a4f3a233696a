"""Deletion from disk, the index in blocks, many questions at once, snippets, devices asked at once, models loaded once."""

import datetime as dt
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.engine import Engine
from quillmere.functions.vector import hash_vector
from quillmere.operators import blocks, questions, search
from quillmere.store import Conflict, Store, scratch
from quillmere.streaming.ingest import indexed, sizes
from tests.test_engine import write

MESSAGES = "conversation_id string, seq int, role string, content string, ts timestamp, tools array<string>"


def talk(spark, n=400, seed=1, vocabulary="the a of cat dog sat mat on in red blue green".split()):
    rng = random.Random(seed)
    rows = [(f"c{i % 97:03d}", i // 97, "user" if i % 2 else "assistant", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), None, []) for i in range(n)]
    return spark.createDataFrame(rows, MESSAGES)


def bytes_below(root, *needles):
    """Files below a folder that hold one of some texts."""
    found = []
    for folder, _, names in os.walk(root):
        for name in names:
            with open(os.path.join(folder, name), "rb") as f:
                data = f.read()
            if any(n.encode() in data for n in needles):
                found.append(os.path.join(folder, name))
    return found


# ---------------------------------------------------------------- deletion


@pytest.fixture
def readable(spark):
    """Parquet files whose bytes are those of the texts."""
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    spark.conf.set(key, "uncompressed")
    yield
    spark.conf.set(key, before)


def test_what_is_forgotten_leaves_the_disk(spark, tmp_path, readable):
    (tmp_path / "src").mkdir()
    write(tmp_path / "src", "one", "/w/a", ["rotate the zebracadabra credentials", "rotated the zebracadabra"])
    write(tmp_path / "src", "two", "/w/b", ["look at the giraffomatic", "seen"], day=9)
    root = str(tmp_path / "store")
    e = Engine(spark, root)
    e.index("claude-code", str(tmp_path / "src"))
    key = e.search("zebracadabra", "lexical").first().session_key
    e.flag(key, note="about the zebracadabra")
    e.search("giraffomatic", "lexical").collect()
    assert len(bytes_below(root, "zebracadabra")) > 3
    reader = e.table("messages")  # made before, read after
    e.forget([key])
    assert reader.count() == 4 and e.table("messages").count() == 2 and e.search("zebracadabra").where("project = '/w/a'").count() == 0
    assert bytes_below(root, "zebracadabra") and e.sweep() == 0
    assert reader.count() == 4
    assert e.sweep(0) > 0
    assert bytes_below(root, "zebracadabra", "zebra") == [] and bytes_below(root, "giraffomatic")
    assert e.search("giraffomatic", "lexical").first().project == "/w/b" and e.table("user_state").count() == 0
    assert e.index("claude-code", str(tmp_path / "src"))["indexed"] == 0 and e.sweep(0) >= 0 and bytes_below(root, "zebracadabra") == []
    e.forget(["no such key"], grace=0)
    assert e.table("messages").count() == 2 and e.table("forgotten").count() == 2


def test_a_sweep_waits_for_readers_and_writers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.replace("notes", spark.createDataFrame([("n", "t", "k", "old", 1, 1, "me")], s.read("notes").schema))
    old = s.read("notes")
    s.replace("notes", s.read("notes").withColumn("text", F.lit("new")))
    written = s._write("notes", old)  # a writer that has no pointer yet
    assert s.sweep(3600) == 0 and old.first().text == "old" and len(s._pointers("notes")) == 2
    s._point("notes", *[2, [written]])
    assert s.sweep(3600) == 0 and s.read("notes").first().text == "old"  # its mark is taken away again
    assert not os.path.exists(tmp_path / "notes" / f"gone-{written}")
    late = s._write("notes", old)
    assert s.sweep(0) == 3 and s.read("notes").first().text == "old"
    with pytest.raises(Conflict, match="swept away"):
        s._point("notes", 3, [late])
    assert s.sweep(0) == 0 and Store(spark, str(tmp_path / "none")).sweep() == 0


def test_marks_grow_old(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.keep(spark.range(3))
    assert s.sweep(2) == 0 and s.sweep(2) == 0
    time.sleep(3.1)
    assert s.sweep(2) == 1 and s.sweep(2) == 0


def test_only_parts_with_rows_to_delete_are_written_anew(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for at in range(3):
        s.append("sizes", spark.createDataFrame([(f"c{at}", 0, 5), (f"d{at}", 0, 6)], s.read("sizes").schema))
    before = s._parts("sizes")[1]
    gone = spark.createDataFrame([("c1",), ("c1",), ("x",)], "conversation_id string")
    assert s.delete("sizes", gone, "conversation_id") and not s.delete("sizes", gone, "conversation_id") and not s.delete("notes", gone.withColumnRenamed("conversation_id", "note_id"), "note_id")
    after = s._parts("sizes")[1]
    assert after[:2] == [before[0], before[2]] and len(after) == 3 and sorted(r.conversation_id for r in s.read("sizes").collect()) == ["c0", "c2", "d0", "d1", "d2"]


def test_key_values_are_compacted_to_the_last(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillmere.store.MOST_PARTS", 3)
    s = Store(spark, str(tmp_path))
    for i in range(4):
        s.put("a", str(i))
    assert s.get("a") == "3" and s.read("kv").count() == 1
    s.put("b", "x")
    assert (s.get("a"), s.get("b")) == ("3", "x")


def test_scratch_needs_a_shared_folder(spark):
    assert "/x-" in scratch(spark, "x")


# ---------------------------------------------------------------- blocks


def test_blocks_give_the_same_rows_and_few_are_read(spark):
    m = talk(spark, 3000).persist()
    index = indexed(m).persist()
    directory = blocks.directory(index).persist()
    n, mean = sizes(m).agg(F.count("*"), F.avg("length")).first()
    for query, ks in (("the", (1, 200)), ("The cat", (3, 50)), ("the a of cat dog sat mat on in red blue green", (5,)), ("the zzz", (3,)), ("...", (3,))):
        for k in ks:
            found, read = blocks.search_blocks(index, directory, n, mean, query, k)
            want = search.indexed_search(index, sizes(m), query, k)
            assert [(r.conversation_id, r.seq, round(r.score, 9)) for r in found.collect()] == [(r.conversation_id, r.seq, round(r.score, 9)) for r in want.collect()], (query, k)
            assert 0 <= read.blocks <= read.of_blocks and read.postings <= read.of_postings
    _, read = blocks.search_blocks(index, directory, n, mean, "the", 3)
    assert 0 < read.blocks < read.of_blocks / 2 and read.postings < read.of_postings / 2
    for df in (m, index, directory):
        df.unpersist()


def test_a_block_is_a_run_of_rows_in_the_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for seed in (1, 2):
        s.append("postings", indexed(talk(spark, 600, seed)))
    made = s.derived("blocks", blocks.directory)
    assert made.agg(F.sum("n")).first()[0] == s.read("postings").count()
    files = [r.f for r in s.read("postings").select(F.input_file_name().alias("f")).distinct().collect()]
    for f in files:
        rows = [(r.term, r.level) for r in spark.read.parquet(f).select("term", "level").collect()]
        assert rows == sorted(rows)
    # made once a part, and again for a part that is rewritten
    stamp = {p: os.path.getmtime(tmp_path / "blocks" / p) for p in os.listdir(tmp_path / "blocks")}
    s.delete("postings", spark.createDataFrame([("c001",)], "conversation_id string"), "conversation_id")
    again = s.derived("blocks", blocks.directory)
    assert again.agg(F.sum("n")).first()[0] == s.read("postings").count()
    assert len(os.listdir(tmp_path / "blocks")) == 3 and all(os.path.getmtime(tmp_path / "blocks" / p) == t for p, t in stamp.items())
    s.sweep(0)
    assert len(os.listdir(tmp_path / "blocks")) == 1
    plan = blocks._asked(s.read("postings"), {"cat": [5]})._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(term,cat)" in plan


def test_the_engine_reads_blocks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for i in range(6):
        write(tmp_path / "src", f"s{i}", f"/w/{i}", [f"the parser {'parser ' * i}and more", "done " * (i + 1)], day=i + 1)
    e = Engine(spark, str(tmp_path / "store"))
    e.index("claude-code", str(tmp_path / "src"))
    want = search.indexed_search(e.table("postings"), e.table("sizes"), "parser", 2).collect()
    assert e.hits("parser", "lexical", 2).collect() == want and e.read.of_postings == 6 and e.hits("", "lexical").count() == 0
    assert Engine(spark, str(tmp_path / "other")).hits("parser", "lexical").collect() == []


# ---------------------------------------------------------------- many questions


def test_many_questions_are_answered_as_one_by_one(spark):
    m = talk(spark, 500).persist()
    index, lengths = indexed(m).persist(), sizes(m)
    vectors = m.select("conversation_id", "seq", "content").collect()
    vectors = spark.createDataFrame([(r.conversation_id, r.seq, hash_vector(r.content.split()).tolist()) for r in vectors], "conversation_id string, seq int, embedding array<float>").repartition(3).persist()
    texts = ["the cat", "red", "Blue blue green", "", "zebra", "a of"]
    asked = spark.createDataFrame([(i, t, hash_vector(t.lower().split()).tolist()) for i, t in enumerate(texts)], "question_id int, text string, embedding array<float>")
    words = questions.keyword_hits(index, lengths, asked, 5).collect()
    near = questions.semantic_hits(vectors, asked, 5).collect()
    parts = questions.semantic_hits(vectors, asked, 5, part_bytes=4000).collect()
    both = questions.hybrid_hits(index, lengths, vectors, asked, 4).collect()
    flat = lambda rows, i: [(r.conversation_id, r.seq, round(r.score, 8)) for r in sorted((r for r in rows if r.question_id == i), key=lambda r: r["rank"])]
    one = lambda df: [(r.conversation_id, r.seq, round(r.score, 8)) for r in df.collect()]
    for i, t in enumerate(texts):
        v = hash_vector(t.lower().split()).tolist()
        assert flat(words, i) == one(search.indexed_search(index, lengths, t, 5)), t
        assert flat(near, i) == flat(parts, i) == one(search.semantic_search(vectors, v, 5)), t
        assert flat(both, i) == one(search.rrf([search.indexed_search(index, lengths, t, 20), search.semantic_search(vectors, v, 20)], 4)), t
    for df in (m, index, vectors):
        df.unpersist()


def shuffled_rows(spark) -> int:
    """Rows that all stages so far have sent to others."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_questions_of_a_word_that_all_messages_have(spark):
    m = spark.createDataFrame([(f"c{i:04d}", s, f"the w{i % 7} {'x ' * (i % 5)}u{i}") for i in range(200) for s in range(2)], "conversation_id string, seq int, content string")
    index, lengths = indexed(m).persist(), sizes(m)
    index.count()
    texts = [f"the w{i % 7}" if i % 2 else f"the u{i % 200} w{i % 200 % 7}" for i in range(300)]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")
    before = shuffled_rows(spark)
    rows = questions.keyword_hits(index, lengths, asked, 3, shard_words=500).collect()
    assert shuffled_rows(spark) - before < 40_000  # 300 questions meet 400 messages in "the" alone
    for i in (0, 1, 2, 5, 299):
        got = [(r.conversation_id, r.seq, round(r.score, 8)) for r in sorted((r for r in rows if r.question_id == i), key=lambda r: r["rank"])]
        assert got == [(r.conversation_id, r.seq, round(r.score, 8)) for r in search.indexed_search(index, lengths, texts[i], 3).collect()]
    index.unpersist()


def test_vectors_that_do_not_fit(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "question_id int, embedding array<float>")
    held = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 0.0]), ("c", 0, None)], "conversation_id string, seq int, embedding array<float>")
    assert [(r.question_id, r.conversation_id) for r in questions.semantic_hits(held, asked).collect()] == [(1, "a")]
    assert questions.semantic_hits(held.limit(0), asked).collect() == [] and questions.semantic_hits(held, asked.limit(0)).collect() == []
    with pytest.raises(Exception, match="dimensions"):
        questions.semantic_hits(spark.createDataFrame([("a", 0, [1.0])], held.schema), asked).collect()


def test_contexts_are_packed_as_on_the_driver(spark):
    from quillmere.plans import context

    m = talk(spark, 300).persist()
    c = m.select("conversation_id").distinct().withColumn("title", F.when(F.col("conversation_id") > "c050", F.concat(F.lit("tïtle "), "conversation_id"))).withColumn("tool", F.lit("x")).withColumn("started_at", F.lit(dt.datetime(2026, 1, 1)))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["the", "cat dog", "red", "zebra"])], "question_id int, text string")
    index, lengths = indexed(m).persist(), sizes(m)
    hits = questions.keyword_hits(index, lengths, asked, 4)
    for most in (130, 600):
        got = {r.question_id: r for r in questions.contexts(hits, m, c, most).collect()}
        for i, t in enumerate(["the", "cat dog", "red"]):
            block = context.context(search.indexed_search(index, lengths, t, 4), m, c, most)
            if block.sections:
                assert (got[i].text, got[i].sections, got[i].chars, got[i].tokens, got[i].truncated) == (block.text, block.sections, block.chars, block.tokens, block.truncated), (most, t)
            else:
                assert i not in got
        assert 3 not in got
    m.unpersist()
    index.unpersist()


def test_the_engine_answers_many(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for i, words in enumerate(["fix the unicode parser", "deploy the cluster", "paint the fence"]):
        write(tmp_path / "src", f"s{i}", f"/w/{i}", [words, "done"], day=i + 1)
    e = Engine(spark, str(tmp_path / "store"))
    e.index("claude-code", str(tmp_path / "src"))
    asked = spark.createDataFrame([("a", "unicode parser"), ("b", "cluster"), ("c", "")], "question_id string, text string")
    best = {r.question_id: r.conversation_id for r in e.hits_of_all(asked, 2).where("rank = 1").collect()}
    assert {q: e.conversation(c).first().content for q, c in best.items()} == {"a": "fix the unicode parser", "b": "deploy the cluster"}
    assert {r.question_id for r in e.contexts(asked).where("text LIKE '%the%' AND sections > 0").collect()} == {"a", "b"}


# ---------------------------------------------------------------- snippets


def plain_snippet(content, terms, width=12):
    import re

    words = re.sub(r"\s+", " ", content).strip().split(" ")
    of = [{x for x in re.split(r"[\W_]+", w.lower()) if x in terms} for w in words]
    last = max(1, len(words) - width + 1)
    counts = [len(set().union(*of[s : s + width])) for s in range(last)]
    at = counts.index(max(counts))
    shown = [f"[{w}]" if o else w for w, o in zip(words[at : at + width], of[at : at + width], strict=True)]
    return ("…" if at else "") + " ".join(shown) + ("…" if at + width < len(words) else "")


def test_snippets_show_the_best_window(spark):
    rng = random.Random(3)
    texts = ["cat " + "x " * 30 + "the cat, sat\non the mat " + "y " * 30, "", "nothing", "cat", "x " * 40 + "mat"]
    texts += [" ".join(rng.choice(["x", "y", "z", "w", "v", "cat", "Mat.", "the-cat"]) if rng.random() < 0.4 else "q" for _ in range(rng.randint(1, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    for query in ("cat the mat", "mat", "zebra"):
        got = {r.i: r.s for r in df.select("i", search.snippet("content", query, start="[", end="]").alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == plain_snippet(t, search.query_terms(query)), t
    assert "[the] [cat,]" in df.where("i = 0").select(search.snippet("content", "cat the mat", start="[", end="]")).first()[0]
    assert df.where("i = 0").select(search.snippet("content", "")).first()[0].startswith("cat x")


# ---------------------------------------------------------------- devices and models


def test_devices_are_asked_at_once_and_late_ones_stopped(spark):
    hits = spark.createDataFrame([("c1", 0, 2.0), ("c2", 1, 1.0)], "conversation_id string, seq int, score double")

    def hangs():
        return spark.range(1, numPartitions=1).select(F.udf(lambda x: time.sleep(60) or "c", "string")("id").alias("conversation_id"), F.lit(0).alias("seq"), F.lit(1.0).alias("score"))

    def breaks():
        raise OSError("no route")

    def slow():
        time.sleep(1)
        return hits

    hits.collect()
    began = time.monotonic()
    found, lost = search.federated_search({"a": lambda: hits, "hangs": hangs, "breaks": breaks, "slow": slow, "slower": slow, "unasked": breaks}, 5, ["a", "hangs", "breaks", "slow", "slower"], seconds=4)
    assert time.monotonic() - began < 6 and lost == ["hangs", "breaks"]  # not the sum of all
    assert [(r.conversation_id, r.device) for r in found.collect()] == [("c1", "a"), ("c2", "a")]
    tracker = spark.sparkContext.statusTracker()
    until = time.monotonic() + 10
    while tracker.getActiveJobsIds() and time.monotonic() < until:
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds() and search.federated_search({"breaks": breaks}, 5)[0] is None
    assert search.federated_search({}, 5) == (None, [])


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")
    os.mkdir(loads)
    sent = str(tmp_path / "sent")
    os.mkdir(sent)

    def load():
        import uuid

        with open(os.path.join(loads, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            pass

        def model(texts):
            with open(os.path.join(sent, uuid.uuid4().hex), "w") as f:
                f.write(str(len(texts)))
            return np.array([[float(len(t)), 1.0] for t in texts])

        return model

    e = Engine(spark, str(tmp_path / "store"), load=load, model="counting")
    talk(spark, 1200).repartition(8).write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    e.store.append("messages", m)
    e.store.append("conversations", m.select("conversation_id").distinct().select("conversation_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in e.table("conversations").schema if f.name != "conversation_id"]))
    e.embed_pending()
    e.store.append("messages", m.withColumn("seq", F.col("seq") + 1000))
    e.embed_pending()
    assert e.table("embeddings").count() == 2400 and {r.model for r in e.table("embeddings").select("model").distinct().collect()} == {"counting"}
    pids = [n.split("-")[0] for n in os.listdir(loads)]
    assert len(pids) == len(set(pids)) and pids
    counts = [int(open(os.path.join(sent, n)).read()) for n in os.listdir(sent)]
    assert sum(counts) == 2400 and max(counts) <= 128 and len(counts) < 60
    assert all(abs(r.embedding[1] - 1.0) < 1e-6 for r in e.table("embeddings").limit(5).collect())
    assert e.hits("some words", "semantic", 2).count() == 2 and len(os.listdir(loads)) == len(pids) + 1
