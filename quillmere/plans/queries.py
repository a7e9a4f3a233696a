"""The registered queries of the engine's own operators, and the SQL that each is held against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident as I
from ..functions import text as T
from ..functions import vector as V
from ..operators import activity, ingest, metrics, rooms, search, shared, themes, threads
from ..streaming.live import live_states
from . import adapters as A
from . import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


QUERY = "the and"
AS_OF = dt.date(2024, 1, 29)
#: Marker lists that occur in the test tables' invented words.
MARKERS = {"correction": ["no.", "no,", "undo", "ing"], "constraint": ["only", "dont", "than"], "error": ["eron"], "test": ["test"], "commit": ["nthe"]}

_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BM25 = r"""
  m AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM conversations),
  t AS (SELECT conv_id, turn, len(w)::DOUBLE AS length, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'and'))::DOUBLE AS b FROM m),
  s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, count(*) FILTER (a > 0)::DOUBLE AS da, count(*) FILTER (b > 0)::DOUBLE AS db FROM t),
  k AS (SELECT conv_id, turn, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean))
                       + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)) AS score FROM t, s WHERE a > 0 AND b > 0),
  kb AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rn FROM k)"""


@query(f"WITH {_BM25} SELECT conv_id AS conversation_id, turn AS seq, round(score, 6) AS score FROM kb WHERE rn = 1 ORDER BY kb.score DESC, conv_id LIMIT 10")
def kw_search(spark, sf_dir):
    return search.keyword_search(A.messages(spark, sf_dir), QUERY, 10).select("conversation_id", "seq", r6("score").alias("score"))


@query(f"WITH {_BM25} SELECT conv_id AS conversation_id, turn AS seq, round(score, 6) AS score FROM k")
def bm25_all(spark, sf_dir):
    return search.bm25(A.messages(spark, sf_dir), QUERY).select("conversation_id", "seq", r6("score").alias("score"))


@query(r"""WITH m AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM conversations),
  p AS (SELECT term, conv_id, turn, count(*) AS tf FROM m GROUP BY ALL)
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY term""")
def postings_df(spark, sf_dir):
    return search.postings(A.messages(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE lang = 'en' AND contains(source, '1')),
  t AS (SELECT doc_id, len(w)::DOUBLE AS length, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS a FROM d),
  s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, count(*) FILTER (a > 0)::DOUBLE AS da FROM t)
  SELECT doc_id AS conversation_id, 0 AS seq, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
  FROM t, s WHERE a > 0 ORDER BY ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) DESC, doc_id LIMIT 20""")
def kw_search_filtered(spark, sf_dir):
    docs = A.documents(spark, sf_dir)
    return search.keyword_search(docs, "the", 20, search.Filters(tool="en", project="1")).select("conversation_id", "seq", r6("score").alias("score"))


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_SEM = f"""sem AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS score FROM embeddings, {_Q})"""


def _vectors(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conversation_id"), F.lit(0).alias("seq"), "embedding", "label")


def _probe(spark, sf_dir):
    return list(_vectors(spark, sf_dir).orderBy("conversation_id").first().embedding)


@query(f"WITH {_SEM} SELECT vec_id AS conversation_id, 0 AS seq, round(score, 6) AS score FROM sem WHERE score >= 0.15 ORDER BY sem.score DESC, vec_id LIMIT 10")
def semantic_topk(spark, sf_dir):
    return search.semantic_search(_vectors(spark, sf_dir), _probe(spark, sf_dir), 10).select("conversation_id", "seq", r6("score").alias("score"))


@query(f"""WITH {_BM25}, {_SEM},
  l1 AS (SELECT conv_id AS id, turn AS seq, row_number() OVER (ORDER BY score DESC, conv_id) - 1 AS rank FROM kb WHERE rn = 1 QUALIFY rank < 50),
  l2 AS (SELECT vec_id AS id, 0 AS seq, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM sem WHERE score >= 0.15 QUALIFY rank < 50),
  u AS (SELECT id, seq, 1.0::DOUBLE / (60 + rank) AS part, 0 AS l FROM l1 UNION ALL SELECT id, seq, 1.0::DOUBLE / (60 + rank), 1 FROM l2),
  f AS (SELECT id, sum(part) AS score, arg_min(seq, l) AS seq FROM u GROUP BY id)
  SELECT id AS conversation_id, seq, round(score, 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    return search.hybrid_search(A.messages(spark, sf_dir), _vectors(spark, sf_dir), QUERY, _probe(spark, sf_dir), 10).select("conversation_id", "seq", r6("score").alias("score"))


@query(f"""WITH {_SEM}, p AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS l FROM sem),
  e AS (SELECT vec_id, l, row_number() OVER (PARTITION BY l ORDER BY score DESC, vec_id) AS rank FROM (SELECT * FROM p UNION ALL SELECT vec_id, label, score, 1 FROM p WHERE l = 0 AND vec_id % 2 = 0) WHERE score >= 0.15 QUALIFY rank <= 20),
  f AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l) AS l FROM e GROUP BY vec_id)
  SELECT vec_id AS conversation_id, 0 AS seq, CASE l WHEN 0 THEN 'a' ELSE 'b' END AS device, round(score, 6) AS score FROM f ORDER BY f.score DESC, vec_id LIMIT 10""")
def federated_rrf(spark, sf_dir):
    v, q = _vectors(spark, sf_dir), _probe(spark, sf_dir)
    a, b = v.where("conversation_id % 3 = 0"), v.where("conversation_id % 3 <> 0 OR conversation_id % 2 = 0")
    return search.federated([("a", search.semantic_search(a, q, 20)), ("b", search.semantic_search(b, q, 20))], 10).select("conversation_id", "seq", "device", r6("score").alias("score"))


@query("""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
  p AS (SELECT label, unnest(range(len(e))) AS pos, unnest(list_transform(e, lambda x: x / n)) AS x FROM u),
  m AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY label)
  SELECT m.label, n, pos, round(x / len, 6) AS x FROM m JOIN l USING (label)""")
def centroids(spark, sf_dir):
    c = themes.centroids(A.table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


_ACT = "SELECT bucket, sum(n) OVER (PARTITION BY bucket)::BIGINT AS total, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, tool)::INT AS place, tool, n FROM e"


@query(f"WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type AS tool, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL) {_ACT}")
def activity_day(spark, sf_dir):
    return activity.activity_flat(A.dated(spark, sf_dir), "day", "thread")


@query(f"WITH e AS (SELECT strftime(ts, '%Y-W%W') AS bucket, event_type AS tool, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL) {_ACT}")
def activity_week(spark, sf_dir):
    return activity.activity_flat(A.dated(spark, sf_dir), "week", "thread")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def facets(spark, sf_dir):
    return activity.facet(A.table(spark, sf_dir, "documents"), "source")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def counts_by_tool_kind(spark, sf_dir):
    return activity.counts_by(A.table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT d.lang AS tool, count(*) FILTER (l.quality = 0) AS threads, count(*) FILTER (l.quality = 1) AS skills FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY d.lang")
def status(spark, sf_dir):
    d, lab = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    rows = d.join(lab, "doc_id").select(F.col("lang").alias("tool"), F.when(F.col("quality") == 1, "skill").otherwise("thread").alias("kind"))
    return activity.status(rows)


@query("""SELECT doc_id, n_chars, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def longest_version(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("session_key"), F.col("n_chars").alias("message_count"), F.col("doc_id").alias("indexed_at"), F.col("doc_id").alias("conversation_id"), "source")
    return activity.longest_version(d).select(F.col("conversation_id").alias("doc_id"), F.col("message_count").alias("n_chars"), "source")


@query("SELECT user_id::VARCHAR AS project, max(ts) AS last FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY last DESC, project LIMIT 15")
def recent_folders(spark, sf_dir):
    return activity.recent_folders(A.dated(spark, sf_dir))


def _marked(markers: dict[str, list[str]]) -> dict[str, str]:
    return {k: "(" + " OR ".join("contains(lower({0}), '" + m.replace("'", "''") + "')" for m in v) + ")" for k, v in markers.items()}


def _per_sql(markers: dict[str, list[str]], text: str = "text") -> str:
    """The rows of :func:`metrics.session_metrics`, in SQL."""
    mark = _marked(markers)
    return f"""m AS (SELECT conv_id, turn, role, substr(coalesce({text}, ''), 1, 2000) AS c, role IN ('user', 'human') AS u FROM conversations),
  x AS (SELECT *, CASE WHEN u THEN count(*) FILTER (u) OVER (PARTITION BY conv_id ORDER BY turn) END AS rn FROM m),
  w AS (SELECT conv_id, coalesce(string_agg(c, chr(10) ORDER BY turn) FILTER (u), '') AS whole FROM m GROUP BY conv_id),
  a AS (SELECT conv_id, count(*) AS messages, count(*) FILTER (u) AS user_turns, count(*) FILTER (u AND rn > 1 AND {mark['correction'].format('c')}) AS corrections,
     coalesce(bool_or(rn = 2 AND {mark['correction'].format('c')}), false) AS first_prompt_miss, NOT arg_max(u, turn) AS resolved,
     coalesce(max(CASE WHEN rn = 1 THEN length(c) END), 0) AS first_prompt_chars, coalesce(bool_or(rn = 1 AND {mark['constraint'].format('c')}), false) AS specific,
     count(*) FILTER (role = 'assistant') * 2 AS actions, min(CASE WHEN rn = 1 THEN turn END) AS first_seq, max(turn) - min(turn) AS minutes,
     'tool' || (conv_id % 3) AS tool, 'p' || (conv_id % 7) AS project, 1700000000 + conv_id * 7200 + min(turn) * 60 AS start FROM x GROUP BY conv_id),
  f AS (SELECT a.conv_id, min(m.turn) AS reply FROM a JOIN m ON a.conv_id = m.conv_id AND m.role = 'assistant' AND m.turn > a.first_seq GROUP BY a.conv_id),
  per AS (SELECT a.*, f.reply, {mark['error'].format('whole')} AS pasted_error, {mark['test'].format('whole')} AS mentions_test, {mark['commit'].format('whole')} AS mentions_commit,
     (contains(whole, '```') OR len(string_split(whole, '    ')) - 1 > 3 OR contains(whole, ');' || chr(10))) AS pasted_code,
     user_turns + 2 * corrections AS friction, CASE WHEN (reply - first_seq) * 60 BETWEEN 0 AND 3600 THEN (reply - first_seq) * 60 END AS first_response_secs
     FROM a JOIN w USING (conv_id) LEFT JOIN f USING (conv_id))"""


_PER = _per_sql(MARKERS)



def _per(spark, sf_dir):
    return metrics.session_metrics(A.sessions(spark, sf_dir), A.messages(spark, sf_dir), MARKERS)


@query(f"""WITH {_PER} SELECT conv_id AS session_id, messages, user_turns, corrections, first_prompt_miss, resolved, first_prompt_chars, specific, pasted_code, pasted_error,
  mentions_test, mentions_commit, actions, friction, minutes::DOUBLE AS minutes, first_response_secs FROM per""")
def session_metrics(spark, sf_dir):
    cols = ["session_id", "messages", "user_turns", "corrections", "first_prompt_miss", "resolved", "first_prompt_chars", "specific", "pasted_code", "pasted_error", "mentions_test", "mentions_commit"]
    return _per(spark, sf_dir).select(*cols, F.size("actions").cast("long").alias("actions"), "friction", "minutes", "first_response_secs")


#: The lists that are used outside the tests.
_REAL = {"correction": T.CORRECTION_MARKERS, "constraint": T.CONSTRAINT_MARKERS, "error": T.ERROR_MARKERS, "test": T.TEST_MARKERS, "commit": T.COMMIT_MARKERS}
#: All of them, and phrases that nearly hold one; a message gets one by its place.
_PHRASES = [*dict.fromkeys(m for v in _REAL.values() for m in v), "notwithstanding", "onl y", "e rror", "plain"]
_PHRASED = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in _PHRASES) + f"][1 + (conv_id * 7 + turn * 11) % {len(_PHRASES)}] || ' ' || text"


@query(f"""WITH {_per_sql(_REAL, _PHRASED)} SELECT conv_id AS session_id, user_turns, corrections, first_prompt_miss, resolved, first_prompt_chars, specific, pasted_error, mentions_test, mentions_commit, friction FROM per""")
def session_metrics_marked(spark, sf_dir):
    """The real marker lists over messages that hold each of them."""
    phrases = F.array(*[F.lit(p) for p in _PHRASES])
    place = F.pmod(F.col("conversation_id") * 7 + F.col("seq") * 11, F.lit(len(_PHRASES))).cast("int")
    m = A.messages(spark, sf_dir).withColumn("content", F.concat(F.get(phrases, place), F.lit(" "), "content"))
    found = metrics.session_metrics(A.sessions(spark, sf_dir), m)
    return found.select("session_id", "user_turns", "corrections", "first_prompt_miss", "resolved", "first_prompt_chars", "specific", "pasted_error", "mentions_test", "mentions_commit", "friction")


@query(f"""WITH {_PER}, b AS (SELECT avg(n) AS busy FROM (SELECT count(DISTINCT project) AS n FROM per GROUP BY strftime(to_timestamp(start) AT TIME ZONE 'UTC', '%Y-%m-%d')))
  SELECT count(*) AS sessions, count(DISTINCT project) AS projects, sum(user_turns)::BIGINT AS user_turns, median(user_turns)::DOUBLE AS median_turns, round(avg(user_turns), 6) AS mean_turns,
   round(avg((corrections > 0)::INT), 6) AS correction_rate, round(avg(first_prompt_miss::INT), 6) AS first_prompt_miss_rate, round(avg((NOT resolved)::INT), 6) AS abandonment_rate,
   round(avg(first_prompt_chars), 6) AS avg_first_prompt_chars, round(avg(specific::INT), 6) AS specificity_rate, round(avg(pasted_code::INT), 6) AS code_paste_rate,
   round(avg(pasted_error::INT), 6) AS error_paste_rate, round(avg(mentions_test::INT), 6) AS test_mention_rate, round(avg(mentions_commit::INT), 6) AS commit_mention_rate,
   round(coalesce(count(*) FILTER (pasted_error AND resolved) / nullif(count(*) FILTER (pasted_error), 0), 0), 6) AS error_recovery_rate, round(avg(actions), 6) AS avg_tool_actions,
   count(DISTINCT tool) AS tools_used, median(minutes)::DOUBLE AS median_session_minutes, count(minutes) AS timed_sessions, coalesce(median(first_response_secs), 0)::DOUBLE AS median_time_to_first_response_secs,
   round(any_value(busy), 6) AS avg_projects_per_active_day FROM per, b""")
def work_metrics(spark, sf_dir):
    out = metrics.work_metrics(_per(spark, sf_dir))
    rounded = {"mean_turns", "avg_first_prompt_chars", "avg_tool_actions", "avg_projects_per_active_day"}
    return out.select(*[r6(c).alias(c) if c.endswith("_rate") or c in rounded else F.col(c) for c in out.columns])


@query(f"WITH {_PER} SELECT project, count(*) AS sessions, round(avg(user_turns), 6) AS avg_turns FROM per GROUP BY project HAVING count(*) >= 3 ORDER BY avg(user_turns) DESC, project LIMIT 6")
def high_friction(spark, sf_dir):
    return metrics.high_friction_projects(_per(spark, sf_dir)).withColumn("avg_turns", r6("avg_turns"))


@query(f"WITH {_PER} (SELECT 'rough' AS kind, conv_id AS session_id, friction FROM per ORDER BY friction DESC, conv_id LIMIT 3) UNION ALL (SELECT 'smooth', conv_id, friction FROM per WHERE resolved AND messages > 0 ORDER BY friction, conv_id LIMIT 3)")
def rough_smooth(spark, sf_dir):
    return metrics.rough_and_smooth(_per(spark, sf_dir))


@query(f"WITH {_PER} SELECT extract(hour FROM to_timestamp(start) AT TIME ZONE 'UTC')::INT AS hour, count(*) AS n FROM per GROUP BY 1")
def by_hour(spark, sf_dir):
    return metrics.by_hour(_per(spark, sf_dir))


_HALVES = """h AS (SELECT *, conv_id % 2 AS half FROM per), g AS (SELECT half, count(*)::DOUBLE AS sessions, avg((corrections > 0)::INT) AS correction_rate, avg(first_prompt_miss::INT) AS first_prompt_miss_rate,
   avg((NOT resolved)::INT) AS abandonment_rate, avg(specific::INT) AS specificity_rate, avg(mentions_test::INT) AS test_mention_rate, median(user_turns)::DOUBLE AS median_turns,
   avg(actions) AS avg_tool_actions, avg(pasted_error::INT) AS error_paste_rate, coalesce(count(*) FILTER (pasted_error AND resolved) / nullif(count(*) FILTER (pasted_error), 0), 0) AS error_recovery_rate FROM h GROUP BY half),
  d AS (SELECT half, avg(n) AS avg_projects_per_active_day FROM (SELECT half, strftime(to_timestamp(start) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(DISTINCT project) AS n FROM h GROUP BY ALL) GROUP BY half),
  gd AS (SELECT * FROM g JOIN d USING (half))"""


def _halves(spark, sf_dir):
    per = _per(spark, sf_dir).persist()  # one pass over the messages for both
    return metrics.work_metrics(per.where("session_id % 2 = 0")), metrics.work_metrics(per.where("session_id % 2 = 1"))


_TREND = " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT {m} FROM gd WHERE half = 0) AS c, (SELECT {m} FROM gd WHERE half = 1) AS p, {str(low).lower()} AS lower" for m, _, low, _ in reports.TREND_METRICS)


@query(f"""WITH {_PER}, {_HALVES}, t AS ({_TREND}) SELECT metric, round(c, 6) AS current, round(p, 6) AS previous, round(CASE WHEN abs(p) > 1e-9 THEN (c - p) / abs(p) ELSE 0 END, 6) AS delta,
  (CASE WHEN lower THEN c < p ELSE c > p END) AND abs(c - p) > 1e-9 AS improved FROM t""")
def trends(spark, sf_dir):
    out = reports.trends(*_halves(spark, sf_dir))
    return out.select("metric", r6("current").alias("current"), r6("previous").alias("previous"), r6("delta").alias("delta"), "improved")


def _clamp(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


@query(f"""WITH {_PER}, {_HALVES}, s AS (SELECT
   round(100 * ({_clamp('avg_tool_actions / 8')} + {_clamp('(5 - avg_projects_per_active_day) / 4')}) / 2)::INT AS delegation,
   round(100 * ({_clamp('specificity_rate / 0.5')} + {_clamp('(0.4 - first_prompt_miss_rate) / 0.4')}) / 2)::INT AS description,
   round(100 * ({_clamp('(0.6 - correction_rate) / 0.6')} + {_clamp('(0.5 - abandonment_rate) / 0.5')}) / 2)::INT AS discernment,
   round(100 * CASE WHEN error_paste_rate >= 0.05 THEN (2 * {_clamp('test_mention_rate / 0.4')} + {_clamp('error_recovery_rate')}) / 3 ELSE {_clamp('test_mention_rate / 0.4')} END)::INT AS diligence
   FROM gd WHERE half = 0) SELECT *, round((delegation + description + discernment + diligence) / 4.0)::INT AS overall FROM s""")
def fluency(spark, sf_dir):
    return reports.fluency(_halves(spark, sf_dir)[0])


@query(f"""WITH {_PER}, {_HALVES}, l AS (
   SELECT 'front_load' AS lever, 'first_prompt_miss_rate' AS metric, first_prompt_miss_rate AS weight FROM gd WHERE half = 0 AND first_prompt_miss_rate > 0.20
   UNION ALL SELECT 'close_loops', 'abandonment_rate', abandonment_rate FROM gd WHERE half = 0 AND abandonment_rate > 0.25
   UNION ALL SELECT 'review_plan', 'correction_rate', correction_rate * 0.9 FROM gd WHERE half = 0 AND correction_rate > 0.40
   UNION ALL SELECT 'ask_tests', 'test_mention_rate', 0.15 - test_mention_rate FROM gd WHERE half = 0 AND test_mention_rate < 0.15
   UNION ALL SELECT 'batch_projects', 'avg_projects_per_active_day', (avg_projects_per_active_day - 3) / 5 FROM gd WHERE half = 0 AND avg_projects_per_active_day > 3)
  SELECT lever, metric, round(weight, 6) AS weight FROM l""")
def levers(spark, sf_dir):
    return reports.levers(_halves(spark, sf_dir)[0]).select("lever", "metric", r6("weight").alias("weight"))


@query(f"""SELECT event_type AS tool, count(*) FILTER (ts::DATE = DATE '{AS_OF}') AS today, count(*) FILTER (ts::DATE BETWEEN DATE '{AS_OF}' - 7 AND DATE '{AS_OF}') AS week, count(*) AS month,
  round(count(*) / 30.0, 6) AS per_day FROM events WHERE ts::DATE BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' GROUP BY event_type""")
def glance(spark, sf_dir):
    return reports.glance(A.dated(spark, sf_dir), AS_OF).withColumn("per_day", r6("per_day"))


def _redact_sql(column: str) -> str:
    out = column
    for pattern, new in T.REDACTION_RULES:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query(f"SELECT doc_id, md5(r) AS digest, (r <> text)::BOOLEAN AS changed FROM (SELECT doc_id, text, {_redact_sql('text')} AS r FROM documents)")
def redact(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text", T.redact("text").alias("r"))
    return d.select("doc_id", F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("changed"))


@query("""SELECT sha256(encode('doc') || '\\x00'::BLOB || '\\x01'::BLOB || encode(coalesce(text, '')) || '\\x00'::BLOB) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def dedup(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", I.conversation_hash(F.lit("doc"), F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content")))).alias("content_hash"))
    n = d.groupBy("content_hash").agg(F.count("*").alias("n"))
    return ingest.deduplicate(d.withColumnRenamed("doc_id", "session_id")).join(n, "content_hash").select("content_hash", F.col("session_id").alias("doc_id"), "n")


@query("""WITH v AS (SELECT conv_id, n FROM (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id), (VALUES (0.5), (1.0)) f(share), LATERAL (SELECT greatest(1, floor(total * share))::INT AS n)),
  d AS (SELECT DISTINCT conv_id, n FROM v) SELECT conv_id || '-' || n AS conversation_id FROM d a WHERE EXISTS (SELECT 1 FROM d b WHERE b.conv_id = a.conv_id AND b.n > a.n)""")
def supersede(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    n = m.groupBy("session_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("ms"))
    v = n.select("session_id", "ms", F.explode(F.array_distinct(F.array(F.greatest(F.lit(1), F.floor(F.col("total") * 0.5)).cast("int"), F.col("total").cast("int")))).alias("message_count"))
    v = v.select(F.concat_ws("-", "session_id", "message_count").alias("conversation_id"), F.col("session_id").cast("string").alias("session_key"), "message_count", F.slice("ms", 1, F.col("message_count")).alias("ms"))
    said = v.select("conversation_id", F.inline("ms"))
    return ingest.superseded(said, v.drop("ms"))


_SESS = """e AS (SELECT event_id, user_id, ts, ts + to_microseconds(round(coalesce(value, 0) * 1000000)::BIGINT) AS te FROM events),
  b AS (SELECT *, max(te) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e),
  g AS (SELECT *, sum(CASE WHEN pe IS NULL OR ts - pe > INTERVAL 3 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM b WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  hd AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, n ORDER BY ts, event_id) AS head FROM g
        UNION ALL SELECT *, 0, event_id FROM b WHERE user_id IS NULL OR ts IS NULL)"""


def _timed(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.coalesce("value", F.lit(0.0)) * 1_000_000).cast("long"))
    return e.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), end.alias("te"))


@query(f"WITH {_SESS} SELECT event_id, head FROM hd")
def sessionise(spark, sf_dir):
    return threads.sessionise(_timed(spark, sf_dir), "user_id", None, "ts", "te", "event_id").select("event_id", "head")


@query(f"""WITH {_SESS}, s AS (SELECT hd.head, count(*) AS sessions, min(hd.ts) AS started_at, max(coalesce(te, hd.ts)) AS last_activity, count(DISTINCT event_type) AS tools, arg_min(event_type, (hd.ts, hd.event_id)) AS first_tool
   FROM hd JOIN events USING (event_id) GROUP BY head) SELECT head, sessions, epoch_us(started_at) AS started_us, epoch_us(last_activity) AS last_us, tools, first_tool FROM s""")
def thread_summary(spark, sf_dir):
    found = threads.sessionise(_timed(spark, sf_dir), "user_id", None, "ts", "te", "event_id")
    key = F.lpad(F.col("event_id").cast("string"), 12, "0")
    members = found.select(F.col("head").alias("thread_id"), F.col("ts").alias("started_at"), F.col("te").alias("last_activity"), key.alias("session_key"), F.lit(None).cast("string").alias("title"), F.col("user_id").cast("string").alias("repo_key"), F.col("event_type").alias("tool"), F.lit("").alias("branch"), F.lit(1).alias("message_count"))
    out = threads.summarise(members)
    return out.select(F.col("thread_id").alias("head"), "sessions", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_activity").alias("last_us"), F.size("tools").cast("long").alias("tools"), F.get("tools", F.lit(0)).alias("first_tool"))


@query("""WITH s AS (SELECT event_id, user_id, ts, ts + to_microseconds(round(coalesce(value, 0) * 1000000)::BIGINT) AS te, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  c AS (SELECT l.event_id AS later, e.event_id AS earlier, row_number() OVER (PARTITION BY l.event_id ORDER BY e.ts DESC, e.event_id) AS place FROM s l JOIN s e ON l.user_id = e.user_id AND l.event_id <> e.event_id
   AND e.ts <= l.ts AND floor(epoch(l.ts)) <= floor(epoch(e.te)) + 86400) SELECT later, earlier, place FROM c WHERE place <= 20""")
def link_candidates(spark, sf_dir):
    s = _timed(spark, sf_dir).select(F.col("user_id").alias("repo_key"), F.col("event_id").alias("session_key"), F.col("event_id").alias("conversation_id"), F.col("ts").alias("started_at"), F.col("te").alias("last_activity"), F.col("event_type").alias("tool"))
    return threads.link_candidates(s, s).select("later", "earlier", F.col("place").cast("long").alias("place"))


_LOG = """log AS (SELECT conv_id * 1000 + turn AS id, conv_id::VARCHAR AS room, role || (turn % 2) AS author, CASE WHEN conv_id % 2 = 0 THEN 'd1' ELSE 'd2' END AS device, turn AS origin_seq,
   CASE WHEN turn % 4 = 1 THEN 'assistant1' END AS recipient, CASE WHEN role = 'assistant' AND (turn + conv_id) % 5 = 0 THEN 'done: ' || text ELSE text END AS text, role = 'user' AS human, conv_id * 100 + turn AS ts FROM conversations),
  lb AS (SELECT *, NOT human AND upper(trim(text)) LIKE 'DONE%' AS ad, human OR upper(trim(text)) LIKE 'DONE%' AS bound FROM log)"""


@query(f"""WITH {_LOG}, x AS (SELECT *, coalesce(sum(ad::INT) OVER (PARTITION BY room ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS exchange, sum(bound::INT) OVER (PARTITION BY room ORDER BY id) AS seg FROM lb)
  SELECT id, exchange, sum((NOT bound)::INT) OVER (PARTITION BY room, seg ORDER BY id)::BIGINT AS turn FROM x""")
def exchanges(spark, sf_dir):
    return rooms.exchanges(A.room_log(spark, sf_dir)).select("id", "exchange", "turn")


@query(f"WITH {_LOG}, l AS (SELECT room, coalesce(max(CASE WHEN bound THEN id END), -1) AS last FROM lb GROUP BY room) SELECT room, count(*) FILTER (id > last AND NOT human) AS turns FROM lb JOIN l USING (room) GROUP BY room")
def room_turns(spark, sf_dir):
    return rooms.turns_now(A.room_log(spark, sf_dir))


def _agents(log):
    return log.groupBy("room").agg(F.min("id").alias("cursor"), F.max("ts").alias("seen")).withColumn("name", F.explode(F.array(F.lit("assistant1"), F.lit("user0"))))


@query(f"""WITH {_LOG}, ag AS (SELECT room, min(id) AS cursor, unnest(['assistant1', 'user0']) AS reader FROM log GROUP BY room)
  SELECT reader, id FROM log JOIN ag USING (room) WHERE id > cursor AND (author <> reader OR device <> 'd1') AND (recipient IS NULL OR recipient = reader OR recipient = reader || '@d1')""")
def unread(spark, sf_dir):
    log = A.room_log(spark, sf_dir)
    return rooms.unread(log, _agents(log), "d1").select("reader", "id")


@query(f"WITH {_LOG} SELECT room, count(*) AS messages, max(ts) AS last FROM log GROUP BY room")
def rooms_list(spark, sf_dir):
    log = A.room_log(spark, sf_dir)
    return rooms.rooms_list(log, _agents(log))


@query(f"WITH {_LOG} SELECT room, upper(trim(arg_max(text, id))) LIKE 'DONE%' AS closed FROM log WHERE NOT human GROUP BY room")
def rooms_closed(spark, sf_dir):
    return rooms.closed(A.room_log(spark, sf_dir))


@query(f"WITH {_LOG}, n AS (SELECT room, author, lead(author) OVER (PARTITION BY room ORDER BY ts, author, id) AS b FROM log) SELECT DISTINCT room, least(author, b) AS a, greatest(author, b) AS b FROM n WHERE b IS NOT NULL AND b <> author")
def conversed(spark, sf_dir):
    return rooms.conversed(A.room_log(spark, sf_dir).withColumn("exchange", F.lit(0)))


@query("""WITH c AS (SELECT 'r' AS room, 'h' || (page_id % 3) AS holder, page_id, url FROM pages), p AS (SELECT *, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM c),
  a AS (SELECT DISTINCT room, holder, CASE WHEN page_id % 2 = 0 THEN path ELSE regexp_replace(path, '/[^/]*$', '') END AS path FROM p)
  SELECT DISTINCT w.holder, w.path, c.holder AS other, c.path AS claimed FROM a w JOIN a c ON w.holder <> c.holder AND (w.path = c.path OR starts_with(w.path, c.path || '/') OR starts_with(c.path, w.path || '/'))""")
def claim_conflicts(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    path = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.lit("/"))
    path = F.when(F.col("page_id") % 2 == 0, path).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    c = p.select(F.lit("r").alias("room"), F.concat(F.lit("h"), (F.col("page_id") % 3).cast("string")).alias("holder"), path.alias("path")).distinct().withColumn("expires", F.lit(10))
    return rooms.conflicts(c, c.drop("expires"), F.lit(5)).select("holder", "path", "other", "claimed")


@query("""WITH w AS (SELECT user_id, arg_max(event_type, (epoch_us(ts) // 3600000000, event_type, event_type)) AS title, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY user_id),
  s AS (SELECT user_id, arg_max(props, (epoch_us(ts) // 60000000, event_type, props)) AS status FROM events WHERE ts IS NOT NULL GROUP BY user_id) SELECT user_id, title, status FROM w JOIN s USING (user_id)""")
def lww_merge(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("ts IS NOT NULL").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = e.select("user_id", F.col("event_type").alias("title"), F.floor(F.col("us") / 3_600_000_000).alias("title_at"), F.col("event_type").alias("title_by"), F.col("props").alias("status"), F.floor(F.col("us") / 60_000_000).alias("status_at"), F.col("event_type").alias("status_by"))
    return shared.merge_registers(rows, ["user_id"], ["title", "status"]).select("user_id", "title", "status")


_TERMS = r"unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3 AND w NOT IN ({0})))".format(", ".join(f"'{w}'" for w in T.STOPWORDS))


@query(f"""WITH w AS (SELECT source, {_TERMS} AS term FROM documents), tf AS (SELECT source, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, sum(tf) AS df FROM tf GROUP BY term),
  s AS (SELECT source, term, tf * greatest(0, ln((SELECT count(*) FROM documents) / (1 + df))) AS score FROM tf JOIN df USING (term)),
  t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS rn FROM s WHERE score > 0 QUALIFY rn <= 3)
  SELECT d.source, coalesce(string_agg(term, ' · ' ORDER BY rn), '(mixed)') AS label FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN t USING (source) GROUP BY d.source""")
def theme_labels(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("title"))
    return themes.labels(d, "source", "title")


@query()
def theme_clusters(spark, sf_dir):
    v = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("title"), F.lit("t").alias("tool"), V.unit(F.col("embedding")).alias("centroid"))
    return themes.themes(v, 8).select("cluster", "size", "label")


_EVENTS = """ev AS (SELECT 'u' || user_id AS path, event_id, ts, CASE event_type WHEN 'click' THEN 'pretooluse' WHEN 'error' THEN 'notification' WHEN 'purchase' THEN 'stop' WHEN 'signup' THEN 'sessionstart' ELSE 'roomlisten' END AS event FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


@query(f"""WITH {_EVENTS}, mx AS (SELECT max(ts) AS now FROM ev), l AS (SELECT path, event, ts, CASE event WHEN 'pretooluse' THEN 'running' WHEN 'notification' THEN 'needs_you' WHEN 'stop' THEN 'idle' WHEN 'sessionstart' THEN 'idle' ELSE 'listening' END AS state,
    row_number() OVER (PARTITION BY path ORDER BY ts DESC, event DESC) AS rn FROM ev)
  SELECT path, CASE WHEN state = 'running' AND ts + INTERVAL 20 MINUTES < now THEN 'idle' ELSE state END AS state, state = 'running' AND ts + INTERVAL 20 MINUTES < now AS inferred, epoch_us(ts) AS seen_us FROM l, mx WHERE rn = 1 AND ts + INTERVAL 12 HOURS > now""")
def live_state(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    kinds = {"click": "pretooluse", "error": "notification", "purchase": "stop", "signup": "sessionstart"}
    event = F.lit("roomlisten")
    for k, name in kinds.items():
        event = F.when(F.col("event_type") == k, name).otherwise(event)
    ev = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), event.alias("event"), F.when(F.col("event_type") == "error", "needs permission").alias("message"), F.col("ts").cast("timestamp").alias("ts"))
    now = ev.agg(F.max("ts")).first()[0]
    return live_states(ev, F.lit(now)).select("path", "state", "inferred", F.unix_micros("seen").alias("seen_us"))


@query("SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM labels WHERE toxic = 1) AS forgotten")
def corpus_counts(spark, sf_dir):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [n(A.table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conversations"), n(A.table(spark, sf_dir, "embeddings"), "embeddings"), n(A.table(spark, sf_dir, "labels").where("toxic = 1"), "forgotten")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query("""SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.conv_id AND c.turn = 0)""")
def pending_embeddings(spark, sf_dir):
    m = A.messages(spark, sf_dir).select("conversation_id", F.col("seq").cast("long").alias("seq"))
    e = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conversation_id"), F.lit(0).cast("long").alias("seq"))
    return ingest.pending_embeddings(m, e).select(F.col("conversation_id").alias("conv_id"), F.col("seq").alias("turn"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND NOT (ltrim(text) = '' OR ltrim(text) LIKE '<%' OR ltrim(text) LIKE 'Caveat:%' OR ltrim(text) LIKE '[Request interrupted%' OR ltrim(text) LIKE 'This session is being continued%')),
  p AS (SELECT conv_id, trim(regexp_replace(arg_max(text, turn) FILTER (role = 'user'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(arg_max(text, turn) FILTER (role = 'assistant'), '\\s+', ' ', 'g')) AS b FROM t WHERE back <= 12 GROUP BY conv_id)
  SELECT conv_id AS conversation_id, CASE WHEN length(a) <= 220 THEN a ELSE rtrim(substr(a, 1, 220)) || '…' END AS asked, CASE WHEN length(b) <= 200 THEN b ELSE rtrim(substr(b, 1, 200)) || '…' END AS answered FROM p""")
def standing(spark, sf_dir):
    from .context import standing as run

    return run(A.messages(spark, sf_dir).where("content IS NOT NULL"))


# The queries of other modules register themselves.
from . import retrieval_queries, source_queries, state_queries, text_queries  # noqa: E402, F401
