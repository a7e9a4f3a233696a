"""The test tables as the engine's own: who plays what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages; a minute a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 7200 + F.col("turn") * 60).alias("ts"), F.when(F.col("role") == "assistant", F.array(F.lit("edit"), F.lit("run"))).otherwise(F.array().cast("array<string>")).alias("tools"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session a conversation, of three tools and seven projects."""
    m = messages(spark, sf_dir)
    s = m.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return s.select("session_id", F.concat(F.lit("tool"), F.pmod("session_id", F.lit(3)).cast("string")).alias("tool"), F.concat(F.lit("p"), F.pmod("session_id", F.lit(7)).cast("string")).alias("project"), F.lit("m").alias("model"), "started_at", "ended_at")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated session rows: the type is the tool, the user the project."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("session_key"), F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("project"), F.col("ts").alias("started_at"), "value", F.lit("thread").alias("kind"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one-message conversations: the language is the tool, the source the project."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("conversation_id"), F.lit(0).alias("seq"), F.col("text").alias("content"), F.col("lang").alias("tool"), F.col("source").alias("project"))


def room_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as rooms: users are human, every fifth assistant message is a DONE."""
    c = table(spark, sf_dir, "conversations")
    done = (F.col("role") == "assistant") & (F.pmod(F.col("turn") + F.col("conv_id"), F.lit(5)) == 0)
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("room"), F.concat(F.col("role"), F.pmod("turn", F.lit(2)).cast("string")).alias("author"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "d1").otherwise("d2").alias("device"), F.col("turn").alias("origin_seq"), F.when(F.pmod("turn", F.lit(4)) == 1, "assistant1").alias("recipient"),
        F.when(done, F.concat(F.lit("done: "), "text")).otherwise(F.col("text")).alias("text"), (F.col("role") == "user").alias("human"), (F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
    )
