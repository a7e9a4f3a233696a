import datetime as dt

from pyspark.sql import functions as F

from quillmere import schema
from quillmere.store import Store
from quillmere.streaming import ingest, live

NOW = dt.datetime(2026, 1, 1, 12, 0)


def ev(path, event, minutes, message=None):
    return (path, event, message, NOW + dt.timedelta(minutes=minutes))


def states(spark, *events):
    df = spark.createDataFrame(events, schema.HOOK_EVENTS)
    return {r.path: (r.state, r.inferred) for r in live.live_states(df, F.lit(NOW)).collect()}


def test_live_states(spark):
    assert states(spark, ev("a", "UserPromptSubmit", -5), ev("a", "Notification", -4, "Needs your permission"), ev("a", "PostToolUse", -3)) == {"a": ("running", False)}
    assert states(spark, ev("a", "UserPromptSubmit", -5), ev("a", "Notification", -4, "please approve")) == {"a": ("needs_you", False)}
    assert states(spark, ev("a", "PreToolUse", -21)) == {"a": ("idle", True)} and states(spark, ev("a", "PreToolUse", -20)) == {"a": ("running", False)}
    assert states(spark, ev("a", "Stop", -719)) == {"a": ("idle", False)} and states(spark, ev("a", "Stop", -720)) == {}
    assert states(spark, ev("", "Stop", -1), ev(None, "Stop", -1), ev("b", "Notification", -1, "hello")) == {"b": ("idle", False)}
    assert states(spark, ev("a", "PreToolUse", -1500), ev("a", "Notification", -1, "x")) == {"a": ("idle", False)}  # forgotten in between


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    events = [ev("a", "UserPromptSubmit", -9), ev("a", "Notification", -8, "permission"), ev("b", "SessionStart", -7), ev("b", "PreToolUse", -6), ev("c", "Stop", -5), ev("a", "PostToolUse", -4)]
    df = spark.createDataFrame(events, schema.HOOK_EVENTS)
    for i in range(3):
        spark.createDataFrame(events[2 * i : 2 * i + 2], schema.HOOK_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema.HOOK_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.live_stream(stream).writeStream.format("memory").queryName("live_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = spark.table("live_out").groupBy("path").agg(F.max_by("state", "seen").alias("state"))
    want = {r.path: r.state for r in live.live_states(df, F.lit(NOW)).collect()}
    assert {r.path: r.state for r in last.collect()} == want == {"a": "running", "b": "running", "c": "idle"}


def test_relayed_messages_count_once(spark, tmp_path):
    rows = [("d1", 1, NOW), ("d1", 1, NOW), ("d1", 2, NOW), ("d2", 1, NOW)]
    spark.createDataFrame(rows, "device string, origin_seq long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device string, origin_seq long, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.deduplicated(stream).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("once").count() == 3


def test_batches_are_ingested_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    s = spark.createDataFrame([("1", "codex", "/a", "p", "T", "thread")], "session_id string, tool string, path string, project string, title string, kind string")
    m = spark.createDataFrame([("1", 0, "user", "token = abcdefgh9"), ("1", 1, "assistant", "ok")], "session_id string, seq int, role string, content string")
    assert ingest.ingest_batch(store, s, m) == 1 and ingest.ingest_batch(store, s, m) == 0
    assert store.read("conversations").count() == 1 and {r.content for r in store.read("messages").collect()} == {"token=[REDACTED]", "ok"}
    store.put("k", "1")
    store.put("k", "2")
    assert store.get("k") == "2" and store.get("none") is None
    before = store.read("messages")
    store.replace("messages", before.where("seq = 0"))
    assert store.read("messages").count() == 1 and before.count() == 2
