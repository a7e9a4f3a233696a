"""Registered queries of the stored index, of many questions at once, and of what a store holds on disk, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks, questions, search, threads
from ..store import Store, scratch
from ..streaming.ingest import indexed, sizes
from . import adapters as A
from .queries import _BM25, QUERY, _vectors, query, r6
from .state_queries import _FOUND, _talks

# ---- the stored index


def _store(spark, sf_dir) -> Store:
    """A new store with the index of all messages, written in two parts."""
    store = Store(spark, scratch(spark, "index"))
    m = A.messages(spark, sf_dir).withColumn("conversation_id", F.col("conversation_id").cast("string")).withColumn("seq", F.col("seq").cast("int"))
    for half in (0, 1):
        mine = m.where(F.pmod(F.xxhash64("conversation_id"), F.lit(2)) == half)
        store.append("postings", indexed(mine))
        store.append("sizes", sizes(mine))
    return store


@query(f"WITH {_BM25} SELECT conv_id AS conversation_id, turn AS seq, round(score, 6) AS score FROM kb WHERE rn = 1 ORDER BY kb.score DESC, conv_id::VARCHAR LIMIT 10")
def stored_search(spark, sf_dir):
    """The best conversations from a stored index, of which only the blocks are read that can hold them."""
    store = _store(spark, sf_dir)
    n, mean = store.read("sizes").agg(F.count("*"), F.avg("length")).first()
    found, _ = blocks.search_blocks(store.read("postings"), store.derived("blocks", blocks.directory), n, mean, QUERY, 10)
    return found.select(F.col("conversation_id").cast("long").alias("conversation_id"), F.col("seq").cast("long").alias("seq"), r6("score").alias("score"))


@query(r"""WITH m AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM conversations),
  s AS (SELECT conv_id, turn, count(*) AS length FROM m GROUP BY ALL), p AS (SELECT term, conv_id, turn, count(*) AS tf FROM m GROUP BY ALL),
  v AS (SELECT term, least(63, floor(64 / (1 + 1.2 * (0.25::DOUBLE / tf + 0.75 / 100.0::DOUBLE * length / tf))))::INT AS level, tf, length FROM p JOIN s USING (conv_id, turn))
  SELECT term, level, count(*) AS n, round(min(1 / tf::DOUBLE), 6) AS by_tf, round(min(length::DOUBLE / tf), 6) AS by_length FROM v GROUP BY term, level""")
def index_blocks(spark, sf_dir):
    """The directory of all blocks of the index."""
    found = blocks.directory(indexed(A.messages(spark, sf_dir)))
    return found.select("term", "level", "n", r6("by_tf").alias("by_tf"), r6("by_length").alias("by_length"))


# ---- many questions

_ASKED = r"""m AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM conversations),
  q AS (SELECT conv_id AS question_id, list_distinct(w[1:2]) AS words FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
  qt AS (SELECT question_id, len(words) AS wanted, unnest(words) AS term FROM q),
  p AS (SELECT term, conv_id, turn, count(*) AS tf, any_value(length) AS length FROM (SELECT conv_id, turn, len(w) AS length, unnest(w) AS term FROM m) GROUP BY term, conv_id, turn),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY term), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM m),
  sc AS (SELECT question_id, conv_id, turn, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
         FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY question_id, conv_id, turn HAVING count(*) = any_value(wanted)),
  one AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY question_id, conv_id ORDER BY score DESC, turn) = 1),
  kw AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, conv_id) AS rank FROM one QUALIFY rank <= 5)"""


def _asked(spark, sf_dir) -> DataFrame:
    """A question a conversation: the first two words that were said in it."""
    first = A.messages(spark, sf_dir).groupBy("conversation_id").agg(F.min_by("content", "seq").alias("content"))
    return first.select(F.col("conversation_id").alias("question_id"), F.array_join(F.slice(T.tokens("content"), 1, 2), " ").alias("text"))


def _answered(spark, sf_dir) -> DataFrame:
    m = A.messages(spark, sf_dir)
    return questions.keyword_hits(indexed(m), sizes(m), _asked(spark, sf_dir), 5)


@query(f"WITH {_ASKED} SELECT question_id, conv_id AS conversation_id, turn AS seq, round(score, 6) AS score, rank FROM kw")
def questions_by_words(spark, sf_dir):
    return _answered(spark, sf_dir).select("question_id", "conversation_id", "seq", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_NEAR = """q AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS q FROM embeddings WHERE label = 4),
  u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  sc AS (SELECT question_id, vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 9) AS score FROM q, u),
  sem AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM sc WHERE score >= 0.15 QUALIFY rank <= 5)"""


@query(f"WITH {_NEAR} SELECT question_id, vec_id AS conversation_id, round(score, 6) AS score, rank FROM sem")
def questions_by_vectors(spark, sf_dir):
    """Every vector of one label as a question against all."""
    v = _vectors(spark, sf_dir)
    found = questions.semantic_hits(v, v.where("label = 4").select(F.col("conversation_id").alias("question_id"), "embedding"), 5)
    return found.select("question_id", "conversation_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_ASKED},
  c AS (SELECT conv_id, turn, role, text, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + octet_length(encode(text)), 0) AS used FROM conversations),
  b AS (SELECT conv_id, '## t' || conv_id || ' (a)' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS body FROM c WHERE used <= 20000 GROUP BY conv_id),
  u AS (SELECT question_id, rank, body, sum(octet_length(encode(body))) OVER (PARTITION BY question_id ORDER BY rank) AS upto FROM kw JOIN b USING (conv_id))
  SELECT question_id, md5(string_agg(body, chr(10) ORDER BY rank) FILTER (upto <= 20000)) AS digest, count(*) FILTER (upto <= 20000)::INT AS sections, bool_or(upto > 20000) AS truncated FROM u GROUP BY question_id""")
def questions_in_context(spark, sf_dir):
    """What a model is to be shown for each question, packed in the plan."""
    m = A.messages(spark, sf_dir)
    c = m.select("conversation_id").distinct().select("conversation_id", F.concat(F.lit("t"), F.col("conversation_id").cast("string")).alias("title"), F.lit("a").alias("tool"))
    return questions.contexts(_answered(spark, sf_dir), m, c, 20_000).select("question_id", F.md5("text").alias("digest"), "sections", "truncated")


# ---- what a store holds on disk


@query("SELECT conv_id::VARCHAR AS conversation_id, count(*) AS rows_on_disk FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id")
def forgotten_on_disk(spark, sf_dir):
    """All messages in two parts of a store, every tenth conversation deleted and swept away; then what its files hold, whoever points to them."""
    store = Store(spark, scratch(spark, "forget"))
    m = A.messages(spark, sf_dir).select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("seq").cast("int").alias("seq"), "role", "content", "ts", "tools")
    for half in (0, 1):
        store.append("messages", m.where(F.pmod("seq", F.lit(2)) == half))
    store.delete("messages", m.where("conversation_id % 10 = 3").select("conversation_id"), "conversation_id")
    store.sweep(0)
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(store.root).groupBy("conversation_id").agg(F.count("*").alias("rows_on_disk"))


# ---- links that are known already

_KNOWN = """kn AS (SELECT 'e' || lpad(conv_id::VARCHAR, 8, '0') AS a, 'l' || lpad(conv_id::VARCHAR, 8, '0') AS b FROM n WHERE conv_id % 5 = 1
        UNION ALL SELECT 'l' || lpad(conv_id::VARCHAR, 8, '0'), 'e' || lpad((conv_id - 9)::VARCHAR, 8, '0') FROM n WHERE conv_id % 7 = 2 AND conv_id >= 9)"""
_UNKNOWN = _FOUND.replace("p AS (SELECT l.key AS later", f"{_KNOWN},\n  p0 AS (SELECT l.key AS later").replace(
    "\n  t AS (SELECT * FROM (SELECT conv_id, turn", "\n  p AS (SELECT * FROM p0 WHERE NOT EXISTS (SELECT 1 FROM kn WHERE least(a, b) = least(later, earlier) AND greatest(a, b) = greatest(later, earlier))),\n  t AS (SELECT * FROM (SELECT conv_id, turn"
)


def _known(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of every fifth session with its later one, and rejections between sessions of a repository, the later one first."""
    n = F.substring("session_key", 2, 8).cast("long")
    own = s.where("session_key LIKE 'e%'").select(n.alias("id"))
    key = lambda first, x: F.concat(F.lit(first), F.lpad(x.cast("string"), 8, "0"))
    links = own.where("id % 5 = 1").select(key("e", F.col("id")).alias("a"), key("l", F.col("id")).alias("b"))
    return links, own.where("id % 7 = 2 AND id >= 9").select(key("l", F.col("id")).alias("a"), key("e", F.col("id") - 9).alias("b"))


@query(f"WITH {_UNKNOWN} SELECT * FROM x")
def detect_links_known(spark, sf_dir):
    """Detection where some pairs are linked already and others have been rejected."""
    s, m = _talks(spark, sf_dir)
    return threads.detect_links(s.where("session_key LIKE 'l%'"), s, m, *_known(s)).select("later", "earlier", "confidence", "applied")


@query(f"WITH {_UNKNOWN} SELECT later, earlier, place FROM p")
def link_candidates_known(spark, sf_dir):
    s, _ = _talks(spark, sf_dir)
    return threads.link_candidates(s.where("session_key LIKE 'l%'"), s, *_known(s)).select("later", "earlier", F.col("place").cast("long").alias("place"))
