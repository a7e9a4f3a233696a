"""Incremental ingestion: new history files into versioned tables, exactly once by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from ..operators.ingest import deduplicate, identify, redact_messages
from ..operators.blocks import level
from ..operators.search import bucket, postings
from ..store import Store

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def ingest_batch(store: Store, sessions: DataFrame, messages: DataFrame) -> int:
    """Sessions (session_id, tool, path, …) and their messages into the store; the number of new conversations.

    Redaction comes first, then identity; what is stored or forgotten already is left out.  Messages and their index are
    written before the conversations that make them count, and only where they are not there yet, so a batch that runs
    twice, or again after a crash at any point, leaves everything once."""
    messages = redact_messages(messages)
    found = identify(sessions, messages)
    stored, gone = store.read("conversations"), store.read("forgotten")
    new = store.keep(deduplicate(found, stored, gone))
    n = new.count()
    if n:
        said = messages.join(new.select("session_id", "conversation_id"), "session_id").drop("session_id")
        for table, rows in (("messages", said), ("postings", indexed(said)), ("sizes", sizes(said))):
            there = store.read(table).select("conversation_id").join(new.select("conversation_id"), "conversation_id", "left_semi").distinct()
            store.append(table, rows.join(there, "conversation_id", "left_anti"))
        store.append("conversations", new)
    return n


def indexed(messages: DataFrame) -> DataFrame:
    """The rows of the stored inverted index."""
    return postings(messages).withColumn("level", level(F.col("tf"), F.col("length"))).withColumn("bucket", bucket(F.col("term")))


def sizes(messages: DataFrame) -> DataFrame:
    """(conversation_id, seq, length) in words."""
    return messages.select("conversation_id", "seq", F.size(tokens(F.coalesce("content", F.lit("")))).alias("length"))


def run(files: DataFrame, store: Store, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """A query that parses and ingests each micro-batch of new files."""

    def each(batch: DataFrame, _: int) -> None:
        ingest_batch(store, *parse(batch))

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
