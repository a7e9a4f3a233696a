"""From parsed sessions to stored ones: redaction, identity, deduplication, versions, tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident as I
from ..functions import text as T

RESERVED_FOLDERS = [".helper", ".assistant-helper"]


def without_helper_projects(sessions: DataFrame, reserved: list[str] | None = None) -> DataFrame:
    """Sessions whose project's last path segment is reserved for the engine's own helpers go."""
    last = F.element_at(F.split(F.rtrim(F.coalesce("project", F.lit("")), F.lit("/")), "/"), -1)
    return sessions.where(~last.isin(reserved or RESERVED_FOLDERS))


def redact_messages(messages: DataFrame, content: str = "content") -> DataFrame:
    return messages.withColumn(content, T.redact(content))


def identify(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session columns, content_hash, conversation_id, session_key, message_count) of sessions (session_id, tool, path, …)."""
    ordered = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", F.coalesce("content", F.lit("")).alias("content")))).alias("ms"))
    out = sessions.join(ordered, "session_id")
    hashed = I.conversation_hash(F.col("tool"), F.col("ms"))
    first = F.coalesce(F.get("ms", F.lit(0))["content"], F.lit(""))
    out = out.withColumn("content_hash", hashed).withColumn("message_count", F.size("ms")).withColumn("session_key", I.session_key(F.col("tool"), F.coalesce("path", F.lit("")), first))
    return out.withColumn("conversation_id", I.conversation_id(F.col("content_hash"))).drop("ms")


def deduplicate(conversations: DataFrame, stored: DataFrame | None = None, forgotten: DataFrame | None = None) -> DataFrame:
    """One conversation a content hash, none that is stored or forgotten."""
    out = conversations
    if forgotten is not None:
        out = out.join(forgotten.select("session_key"), "session_key", "left_anti")
    if stored is not None:
        out = out.join(stored.select("content_hash"), "content_hash", "left_anti")
    w = Window.partitionBy("content_hash").orderBy("session_id")
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def superseded(messages: DataFrame, versions: DataFrame) -> DataFrame:
    """(conversation_id) of versions whose messages all open a longer version of the same session.

    ``versions`` (conversation_id, session_key, message_count), ``messages`` (conversation_id, seq, role, content).  A
    version is its messages' running hash: a shorter one is a prefix of a longer one if the longer one's running hash at
    that length is the shorter one's last, so the test is one equi-join instead of a join of all messages."""
    ordered = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("ms"))
    step = lambda acc, m: F.concat(acc, F.array(F.sha2(F.concat_ws("\u0000", F.element_at(acc, -1), m["role"], F.coalesce(m["content"], F.lit(""))), 256)))
    chain = versions.join(ordered, "conversation_id").withColumn("chain", F.aggregate("ms", F.array(F.lit("")), step)).drop("ms")
    whole = chain.select("conversation_id", "session_key", "message_count", F.element_at("chain", -1).alias("link"))
    inner = chain.select(F.col("conversation_id").alias("longer"), "session_key", F.col("message_count").alias("longer_count"), F.posexplode("chain").alias("message_count", "link"))
    return whole.join(inner, ["session_key", "message_count", "link"]).where("longer_count > message_count").select("conversation_id").distinct()


def collapse_versions(messages: DataFrame, versions: DataFrame) -> DataFrame:
    return versions.join(superseded(messages, versions), "conversation_id", "left_anti")


def pending_embeddings(messages: DataFrame, embeddings: DataFrame) -> DataFrame:
    return messages.join(embeddings.select("conversation_id", "seq"), ["conversation_id", "seq"], "left_anti")


def forget(conversations: DataFrame, forgotten: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations without the sessions of ``keys`` (session_key), and tombstones with them."""
    return conversations.join(keys, "session_key", "left_anti"), forgotten.unionByName(keys.select("session_key")).distinct()


def of_kept(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages or vectors of conversations that are there: what is forgotten or collapsed leaves nothing behind."""
    return rows.join(conversations.select("conversation_id"), "conversation_id", "left_semi")


def upsert(state: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """``state`` with ``changes``; of rows with one key the largest ``order`` stays, a change before a stored one."""
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def patch(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Flags, notes and tags: fields that a change leaves null keep their value."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    cols = [F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in changes.columns and x != key else F.col(x) for x in state.columns]
    return state.join(c, key, "full").select(*cols)
