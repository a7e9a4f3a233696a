"""Registered queries of threads, links, rooms, shared state and the store's own rows, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident as I
from ..operators import activity, ingest, rooms, search, shared, threads
from ..streaming.live import inferred_running
from . import adapters as A
from .queries import _LOG, _SESS, _agents, _timed, query

SALT = "quillmere-work-v1"


def _sha(*parts: str) -> str:
    """The id of a piece of work, in SQL."""
    joined = " || ".join(["encode('" + SALT + "')", *(f"'\\x00'::BLOB || encode({p})" for p in parts)])
    return f"'th_w' || substr(sha256({joined}), 1, 16)"


# ---- threads

_BRANCH = "CASE event_type WHEN 'error' THEN 'feat/a' WHEN 'view' THEN 'Main' WHEN 'click' THEN 'main' ELSE '' END"
_IDS = f"""e AS (SELECT event_id, user_id, ts, coalesce(value, 0) AS value, {_BRANCH} AS branch, ts + to_microseconds(round(coalesce(value, 0) * 1000000)::BIGINT) AS te FROM events),
  b AS (SELECT *, max(te) OVER (PARTITION BY user_id, branch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  g AS (SELECT *, sum(CASE WHEN pe IS NULL OR ts - pe > INTERVAL 3 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, branch ORDER BY ts, event_id) AS n FROM b),
  h AS (SELECT event_id, user_id, branch, first_value(event_id) OVER (PARTITION BY user_id, branch, n ORDER BY ts, event_id) AS head FROM g
        UNION ALL SELECT event_id, user_id, branch, event_id FROM e WHERE user_id IS NULL OR ts IS NULL),
  ids AS (SELECT event_id, CASE WHEN user_id IS NULL THEN 'th_' || event_id WHEN branch IN ('feat/a', 'Main') THEN {_sha("'u' || user_id", "branch")}
                           ELSE {_sha("'u' || user_id", "branch", "'sk_' || head")} END AS auto_id FROM h)"""


def _work(spark, sf_dir) -> DataFrame:
    e = _timed(spark, sf_dir)
    branch = F.when(F.col("event_type") == "error", "feat/a").when(F.col("event_type") == "view", "Main").when(F.col("event_type") == "click", "main").otherwise("")
    return e.select(
        F.concat(F.lit("sk_"), F.col("event_id").cast("string")).alias("session_key"), "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_key"), branch.alias("branch"),
        F.col("ts").alias("started_at"), F.col("te").alias("last_activity"), F.col("event_type").alias("tool"), F.lit(1).alias("message_count"),
    )


@query(f"WITH {_IDS} SELECT event_id, auto_id AS thread_id FROM ids")
def thread_ids(spark, sf_dir):
    return threads.threads_of(_work(spark, sf_dir)).select("event_id", "thread_id")


@query(f"WITH {_IDS} SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'th_n' || event_id % 7 ELSE auto_id END AS thread_id FROM ids")
def thread_membership(spark, sf_dir):
    s = _work(spark, sf_dir)
    put = s.where("event_id % 50 = 0").select("session_key", F.concat(F.lit("th_n"), (F.col("event_id") % 7).cast("string")).alias("thread_id"))
    return threads.threads_of(s, put).select("event_id", "thread_id")


@query("""SELECT o_orderkey AS thread_id, o_orderdate AS last_activity FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND contains('host/c' || o_custkey % 40, 'c3')
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def thread_filters(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "active").otherwise("parked")
    rows = o.select(F.col("o_orderkey").alias("thread_id"), status.alias("status"), F.array("o_orderpriority").alias("tools"), F.concat(F.lit("host/c"), (F.col("o_custkey") % 40).cast("string")).alias("repo_key"), F.col("o_orderdate").alias("last_activity"))
    return threads.thread_list(rows, "active", ["1-URGENT", "5-LOW"], "C3", 200).select("thread_id", "last_activity")


@query("SELECT l_orderkey AS thread_id FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_returnflag = 'R' OR contains(l_linestatus || l_linenumber, 'F7'))")
def served_threads(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread_id"), F.col("l_returnflag").alias("tool"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("project"))
    return threads.served_threads(rows, ["R"], ["F7"])


_TALK = """c AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM conversations),
  n AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS k FROM c GROUP BY conv_id),
  s AS (SELECT 'e' || lpad(conv_id::VARCHAR, 8, '0') AS key, conv_id, 'r' || conv_id % 9 AS repo, 'a' AS tool, conv_id * 7200 + first * 60 AS start, conv_id * 7200 + last * 60 AS fin, false AS late FROM n
        UNION ALL SELECT 'l' || lpad(conv_id::VARCHAR, 8, '0'), conv_id, 'r' || conv_id % 9, CASE WHEN conv_id % 3 = 0 THEN 'b' ELSE 'a' END, conv_id * 7200 + last * 60 + 600, conv_id * 7200 + last * 60 + 600, true FROM n)"""
_FOUND = f"""{_TALK},
  p AS (SELECT l.key AS later, e.key AS earlier, l.conv_id AS lc, e.conv_id AS ec, e.late AS elate, l.start AS began, l.tool AS lt, e.tool AS et, e.fin, row_number() OVER (PARTITION BY l.key ORDER BY e.start DESC, e.key) AS place
        FROM s l JOIN s e ON l.repo = e.repo AND l.key <> e.key AND e.start <= l.start AND l.start <= e.fin + 86400 WHERE l.late QUALIFY place <= 20),
  t AS (SELECT * FROM (SELECT conv_id, turn, role, norm, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE turn > 0 AND role IN ('user', 'assistant')) WHERE back <= 200 AND length(norm) >= 80),
  pr AS (SELECT later, earlier, lc, substr(norm, 1, 160) AS print, role = 'assistant' AS own, row_number() OVER (PARTITION BY later, earlier ORDER BY turn DESC) AS rn
         FROM p JOIN t ON t.conv_id = p.ec AND NOT p.elate AND p.ec * 7200 + t.turn * 60 <= began + 60 QUALIFY rn <= 8),
  op AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN string_agg(norm, ' ' ORDER BY turn) ELSE 'nothing of it' END AS opening FROM c GROUP BY conv_id),
  cp AS (SELECT later, earlier, count(*) AS prints, count(*) FILTER (contains(opening, print)) AS hits, bool_or(own AND contains(opening, print)) AS mine FROM pr JOIN op ON op.conv_id = pr.lc GROUP BY ALL),
  j AS (SELECT p.*, coalesce(prints >= 3 AND hits >= 2 AND hits * 2 >= prints AND mine, false) AS copied FROM p LEFT JOIN cp USING (later, earlier)),
  f AS (SELECT later, earlier, copied, row_number() OVER (PARTITION BY later ORDER BY copied DESC, place) AS rn FROM j WHERE copied OR (et <> lt AND began <= fin + 1800)),
  x AS (SELECT later, earlier, CASE WHEN copied THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, copied AS applied FROM f WHERE rn = 1)"""


def _talks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every conversation as a session, and a later one of its repository, which in every fourth opens with all that was said."""
    m = A.messages(spark, sf_dir)
    key = lambda c, first: F.concat(F.lit(first), F.lpad(F.col(c).cast("string"), 8, "0"))
    at = lambda x: F.timestamp_seconds(x)
    n = m.groupBy("conversation_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("ms"))
    cid, repo = F.col("conversation_id"), F.concat(F.lit("r"), F.pmod("conversation_id", F.lit(9)).cast("string"))
    end = cid * 7200 + F.col("last") * 60
    both = F.explode(F.array(F.struct(F.lit("e").alias("k"), F.lit("a").alias("tool"), (cid * 7200 + F.col("first") * 60).alias("s"), end.alias("t")), F.struct(F.lit("l").alias("k"), F.when(cid % 3 == 0, "b").otherwise("a").alias("tool"), (end + 600).alias("s"), (end + 600).alias("t"))))
    s = n.select(cid, repo.alias("repo_key"), both.alias("x"))
    session = F.concat("x.k", F.lpad(cid.cast("string"), 8, "0"))
    s = s.select(session.alias("session_key"), session.alias("conversation_id"), "repo_key", F.col("x.tool").alias("tool"), at(F.col("x.s")).alias("started_at"), at(F.col("x.t")).alias("last_activity"))
    said = m.select(key("conversation_id", "e").alias("conversation_id"), "seq", "role", "content", at(cid * 7200 + F.col("seq") * 60).alias("ts"))
    whole = F.when(cid % 4 == 0, F.array_join(F.transform("ms", lambda x: x["content"]), " ")).otherwise("nothing of it")
    later = n.select(key("conversation_id", "l").alias("conversation_id"), F.lit(0).cast("long").alias("seq"), F.lit("user").alias("role"), whole.alias("content"), at(end + 600).alias("ts"))
    return s, said.unionByName(later)


@query(f"WITH {_FOUND} SELECT * FROM x")
def detect_links(spark, sf_dir):
    s, m = _talks(spark, sf_dir)
    return threads.detect_links(s.where("session_key LIKE 'l%'"), s, m).select("later", "earlier", "confidence", "applied")


_LINKS = "k AS (SELECT 'k' || l_partkey % 60 AS a, 'k' || l_suppkey % 60 AS b, l_returnflag = 'A' AS applied, l_orderkey AS ref, l_linenumber AS line FROM lineitem WHERE l_partkey % 60 <> l_suppkey % 60)"


def _links(spark, sf_dir) -> DataFrame:
    x = A.table(spark, sf_dir, "lineitem")
    k = lambda c: F.concat(F.lit("k"), (F.col(c) % 60).cast("string"))
    return x.where("l_partkey % 60 <> l_suppkey % 60").select(k("l_partkey").alias("a"), k("l_suppkey").alias("b"), (F.col("l_returnflag") == "A").alias("applied"), F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("line"))


def _members(spark) -> DataFrame:
    n = spark.range(60)
    return n.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("session_key"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("thread_id"))


@query(f"""WITH {_LINKS}, e AS (SELECT least(a, b) || '-' || greatest(a, b) AS p, unnest([a, b]) AS s FROM k WHERE NOT applied)
  SELECT 't' || substr(s, 2)::INT % 7 AS thread_id, count(DISTINCT p) AS pending FROM e GROUP BY 1""")
def pending_suggestions(spark, sf_dir):
    return threads.pending_suggestions(_links(spark, sf_dir), _members(spark))


@query(f"WITH {_LINKS} SELECT ref, line, substr(a, 2)::INT % 7 = 3 AND substr(b, 2)::INT % 7 = 3 AS inside FROM k WHERE substr(a, 2)::INT % 7 = 3 OR substr(b, 2)::INT % 7 = 3")
def links_of_thread(spark, sf_dir):
    return threads.links_of_thread(_links(spark, sf_dir), _members(spark).where("thread_id = 't3'").select("session_key")).select("ref", "line", "inside")


@query("""WITH x AS (SELECT c_custkey AS id, 'r' || c_nationkey AS repo, CASE c_mktsegment WHEN 'MACHINERY' THEN 'main' ELSE c_mktsegment END AS branch, c_custkey % 5 AS dev, round(c_acctbal)::BIGINT * 60 AS at, c_custkey % 4 = 1 AS done FROM customer),
  l AS (SELECT * FROM x WHERE branch <> 'main' AND NOT done),
  p AS (SELECT a.id AS thread_id, b.id AS other, abs(a.at - b.at) AS apart, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.at - b.at), b.id) AS rn FROM l a JOIN l b ON a.repo = b.repo AND a.branch = b.branch AND a.dev <> b.dev AND abs(a.at - b.at) <= 172800)
  SELECT thread_id, other, apart FROM p WHERE rn <= 3""")
def related_threads(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    rows = c.select(
        F.col("c_custkey").alias("thread_id"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo_key"), F.when(F.col("c_mktsegment") == "MACHINERY", "main").otherwise(F.col("c_mktsegment")).alias("branch"),
        F.array((F.col("c_custkey") % 5).cast("string")).alias("devices"), F.timestamp_seconds(F.round("c_acctbal").cast("long") * 60).alias("last_activity"), F.when(F.col("c_custkey") % 4 == 1, "done").otherwise("active").alias("status"),
    )
    return threads.related(rows)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'own' WHEN o_custkey % 3 = 0 THEN 'key' || o_custkey % 10 END AS repo_key FROM orders")
def fill_repo_keys(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.concat(F.lit("p"), (F.col("o_custkey") % 30).cast("string")).alias("project"), F.when(F.col("o_orderstatus") == "P", "own").alias("repo_key"))
    known = spark.range(0, 30, 3).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project"), F.concat(F.lit("key"), (F.col("id") % 10).cast("string")).alias("repo_key"))
    return threads.fill_repo_keys(rows, known).select("o_orderkey", "repo_key")


def _grouped(spark, sf_dir) -> tuple[threads.State, DataFrame]:
    """Customers as sessions, those of a nation a thread that they have been put in; suppliers are sessions by themselves."""
    c = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("sk_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("session_key"), F.concat(F.lit("th_n"), F.col("c_nationkey").cast("string")).alias("thread_id"), F.timestamp_seconds(F.col("c_custkey")).alias("started_at"))
    s = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("sk_s"), F.col("s_suppkey").cast("string")).alias("session_key"), F.concat(F.lit("th_s"), F.col("s_suppkey").cast("string")).alias("thread_id"), F.timestamp_seconds(1_000_000 + F.col("s_suppkey")).alias("started_at"))
    put = c.select("session_key", "thread_id")
    rows = put.select("thread_id").distinct().select("thread_id", F.when(F.col("thread_id") != "th_n4", F.concat(F.lit("T"), "thread_id")).alias("title"), F.lit(None).cast("string").alias("goal"), F.lit(None).cast("string").alias("folder"), F.lit("active").alias("status"))
    links = spark.createDataFrame([], "a string, b string, kind string, origin string, confidence double, applied boolean")
    return threads.State(rows, put, links, spark.createDataFrame([], "a string, b string")), c.unionByName(s)


_PUT = "m AS (SELECT 'sk_' || lpad(c_custkey::VARCHAR, 9, '0') AS session_key, 'th_n' || c_nationkey AS thread_id FROM customer)"
_NATION = "(SELECT 'th_n' || c_nationkey FROM customer WHERE c_custkey = {0})"


def _first(of: int) -> str:
    return "sk_" + f"{of:09d}"


@query(f"WITH {_PUT} SELECT session_key, CASE WHEN thread_id = {_NATION.format(7)} THEN {_NATION.format(2)} ELSE thread_id END AS thread_id FROM m UNION ALL SELECT 'sk_s3', {_NATION.format(2)}")
def link_sessions(spark, sf_dir):
    """The threads of customers 2 and 7 become one, then supplier 3 joins it: by links on purpose, whatever their order."""
    state, members = _grouped(spark, sf_dir)
    state = threads.link_sessions(state, members, _first(7), _first(2))
    return threads.link_sessions(state, members, "sk_s3", _first(2), "continued").membership


@query(f"""WITH {_PUT} SELECT DISTINCT thread_id, CASE WHEN thread_id = 'th_n4' THEN 'Tth_n9' WHEN thread_id <> 'th_n4' THEN 'T' || thread_id END AS title FROM m WHERE thread_id <> 'th_n9'""")
def merge_threads(spark, sf_dir):
    """A thread without a title takes in one that has one."""
    state, members = _grouped(spark, sf_dir)
    return threads.merge_threads(state, members, "th_n9", "th_n4").threads.select("thread_id", "title")


@query(f"WITH {_PUT} SELECT session_key, CASE session_key WHEN '{_first(5)}' THEN 'th_000000005' ELSE thread_id END AS thread_id FROM m")
def unlink_session(spark, sf_dir):
    state, members = _grouped(spark, sf_dir)
    return threads.unlink_session(state, members, _first(5)).membership


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, kind, applied FROM (VALUES ('sk_s1', 'sk_s2', 'related', true), ('sk_s1', 'sk_s4', 'reviewed', true)) v(a, b, kind, applied)""")
def put_and_reject_links(spark, sf_dir):
    """A suggestion that is replaced, one that is rejected, a rejection that a link on purpose lifts."""
    s, m = _grouped(spark, sf_dir)
    s = threads.put_link(s, m, "sk_s1", "sk_s2", "continued", "detected", 0.5, False)
    s = threads.put_link(s, m, "sk_s3", "sk_s2", "continued", "detected", 0.5, False)
    s = threads.reject_link(threads.reject_link(s, "sk_s2", "sk_s3"), "sk_s1", "sk_s4")
    s = threads.link_sessions(threads.link_sessions(s, m, "sk_s2", "sk_s1"), m, "sk_s4", "sk_s1", "reviewed")
    return s.links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "applied")


@query(f"""WITH RECURSIVE {_FOUND},
  ed AS (SELECT later AS a, earlier AS b FROM x WHERE applied UNION SELECT earlier, later FROM x WHERE applied), reach AS (SELECT a AS k, a AS up FROM ed UNION SELECT reach.k, ed.b FROM reach JOIN ed ON ed.a = reach.up),
  o AS (SELECT reach.k, reach.up, s.start FROM reach JOIN s ON s.key = reach.up) SELECT k AS session_key, 'th_' || arg_min(up, (start, 'th_' || up)) AS thread_id FROM o GROUP BY k""")
def apply_links(spark, sf_dir):
    """Sessions that detected links bring together, all in the thread of the earliest."""
    s, m = _talks(spark, sf_dir)
    found = threads.detect_links(s.where("session_key LIKE 'l%'"), s, m)
    members = s.select("session_key", F.concat(F.lit("th_"), "session_key").alias("thread_id"), "started_at")
    none = _grouped(spark, sf_dir)[0]
    empty = threads.State(none.threads.limit(0), none.membership.limit(0), none.links, none.rejections)
    return threads.apply_links(empty, members, found).membership


# ---- rooms

@query(f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY id DESC) AS rn FROM log WHERE room = '3') SELECT id, author, text FROM r WHERE rn <= 5")
def room_history(spark, sf_dir):
    return rooms.history(A.room_log(spark, sf_dir), "3", 5).select("id", "author", "text")


@query(f"WITH {_LOG} SELECT id, author FROM log WHERE room = '3' AND id > 3001 ORDER BY id LIMIT 2")
def room_page(spark, sf_dir):
    return rooms.page_after(A.room_log(spark, sf_dir), "3", 3001, 2).select("id", "author")


@query(f"""WITH {_LOG}, ag AS (SELECT room, min(id) AS cursor, unnest(['assistant1', 'user0']) AS reader FROM log GROUP BY room),
  u AS (SELECT reader, id, row_number() OVER (PARTITION BY room, reader ORDER BY id DESC) AS rn, greatest(count(*) OVER (PARTITION BY room, reader) - 3, 0) AS skipped
        FROM log JOIN ag USING (room) WHERE id > cursor AND (author <> reader OR device <> 'd1') AND (recipient IS NULL OR recipient = reader OR recipient = reader || '@d1'))
  SELECT reader, id, skipped FROM u WHERE rn <= 3""")
def last_unread(spark, sf_dir):
    log = A.room_log(spark, sf_dir)
    return rooms.last_unread(rooms.unread(log, _agents(log), "d1"), 3).select("reader", "id", "skipped")


@query(f"WITH {_LOG} SELECT room, name, CASE WHEN room = '3' AND name = 'user0' THEN max(id) ELSE min(id) END AS cursor FROM log, (VALUES ('assistant1'), ('user0')) n(name) GROUP BY room, name")
def mark_read(spark, sf_dir):
    log = A.room_log(spark, sf_dir)
    return rooms.mark_read(_agents(log), log, "3", "user0").select("room", "name", "cursor")


@query(f"WITH {_LOG}, d AS (SELECT max(id) AS done FROM lb WHERE room = '5' AND ad), p AS (SELECT coalesce(max(id), -1) AS before FROM lb, d WHERE room = '5' AND ad AND id < done) SELECT id, author FROM lb, d, p WHERE room = '5' AND id <= done AND id > before")
def exchange_of(spark, sf_dir):
    log = A.room_log(spark, sf_dir)
    last = log.where("room = '5' AND NOT human AND upper(trim(text)) LIKE 'DONE%'").agg(F.max("id")).first()[0]
    return rooms.exchange_of(log, "5", -1 if last is None else last).select("id", "author")


@query(f"WITH {_LOG}, s AS (SELECT room, author AS name, max(ts) AS spoke FROM log WHERE NOT human GROUP BY ALL), a AS (SELECT room, max(ts) - 40 * (room::BIGINT % 90) AS seen, unnest(['assistant1', 'user0']) AS name, max(ts) + 60 AS now FROM log GROUP BY room), x AS (SELECT room, name, now - greatest(seen, coalesce(spoke, seen)) AS seconds FROM a LEFT JOIN s USING (room, name)) SELECT room, name, seconds, CASE WHEN seconds < 60 THEN 'active' ELSE 'spoke' END AS state FROM x WHERE seconds <= 1800")
def presence(spark, sf_dir):
    log = A.room_log(spark, sf_dir)
    now = log.groupBy("room").agg((F.max("ts") + 60).alias("now"))
    agents = _agents(log).join(now, "room").withColumn("seen", F.col("seen") - 40 * F.pmod(F.col("room").cast("long"), F.lit(90)))
    return rooms.presence(log, agents, F.col("now")).select("room", "name", "seconds", "state")


@query(f"WITH {_LOG} SELECT author, device, max(ts) AS ts FROM log WHERE ts >= 1000 GROUP BY author, device")
def remote_agents(spark, sf_dir):
    return rooms.remote_agents(A.room_log(spark, sf_dir), 1000)


@query(f"WITH {_LOG} SELECT device, max(origin_seq) AS origin_seq FROM log GROUP BY device")
def high_water(spark, sf_dir):
    return rooms.high_water(A.room_log(spark, sf_dir))


@query("SELECT event_id % 2 AS device, event_id // 4 AS origin_seq, count(DISTINCT 1)::BIGINT AS n FROM events GROUP BY ALL")
def receive(spark, sf_dir):
    """Messages that arrive twice, some of which are there already, are there once."""
    e = A.table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("device"), F.expr("event_id div 4").alias("origin_seq"))
    log = e.where("origin_seq % 3 = 0").distinct()
    return rooms.receive(log, e).groupBy("device", "origin_seq").agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE page_id % 20 >= 5")
def live_claims(spark, sf_dir):
    c = A.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("expires"))
    return rooms.live_claims(c, F.lit(5)).select("page_id")


@query("SELECT page_id FROM pages WHERE NOT (page_id % 3 = 1 AND page_id % 4 = 2)")
def release_in_room(spark, sf_dir):
    c = A.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).cast("string").alias("room"), (F.col("page_id") % 4).cast("string").alias("holder"), F.col("url").alias("path"))
    return rooms.release(c, "1", "2").select("page_id")


_EX = f"""{_LOG}, x AS (SELECT *, coalesce(sum(ad::INT) OVER (PARTITION BY room ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS exchange FROM lb),
  z AS (SELECT *, author || '@' || device AS who FROM x WHERE (room, exchange) IN (SELECT (room, exchange) FROM x WHERE ad)),
  a AS (SELECT room, exchange, who || CASE WHEN recipient IS NULL THEN '' ELSE ' → ' || recipient END || ': ' || text AS line, human, ts, who, id, text FROM z)"""


@query(f"""WITH {_EX} SELECT room, exchange, room || ': ' || substr(arg_min(text, id), 1, 70) AS title, 'room://' || room || '#' || min(id) AS path, count(*)::INT AS message_count,
  sha256(encode('rooms') || '\\x00'::BLOB || encode('')) <> '' AS hashed, md5(string_agg(CASE WHEN human THEN 'u' ELSE 'a' END || line, chr(10) ORDER BY ts, who, id)) AS digest FROM a GROUP BY room, exchange""")
def archive_exchange(spark, sf_dir):
    out = rooms.archive_exchange(rooms.exchanges(A.room_log(spark, sf_dir)), "d9")
    lines = F.array_join(F.transform("messages", lambda m: F.concat(F.when(m["role"] == "user", "u").otherwise("a"), m["content"])), "\n")
    return out.select("room", "exchange", "title", "path", "message_count", (F.length("content_hash") == 64).alias("hashed"), F.md5(lines).alias("digest"))


_TASK = "k AS (SELECT 'r' || l_partkey % 50 AS room, l_suppkey % 40 AS id, CASE l_linenumber % 5 WHEN 0 THEN 'todo' WHEN 1 THEN 'doing' WHEN 2 THEN 'done' WHEN 3 THEN 'blocked' ELSE 'nonsense' END AS status, l_orderkey AS updated, l_linenumber AS who FROM lineitem)"


def _tasks(spark, sf_dir) -> DataFrame:
    x = A.table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(s) for s in ("todo", "doing", "done", "blocked", "nonsense")])
    return x.select(F.concat(F.lit("r"), (F.col("l_partkey") % 50).cast("string")).alias("room"), (F.col("l_suppkey") % 40).alias("id"), F.get(names, F.col("l_linenumber") % 5).alias("status"), F.col("l_orderkey").alias("updated"), F.col("l_linenumber").alias("updated_by"))


@query(f"WITH {_TASK} SELECT room, id, max(updated) AS updated, arg_max(status, (updated, who, status)) AS status FROM k WHERE status <> 'nonsense' GROUP BY room, id")
def merge_tasks(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    # of one task's versions of one time and writer the last by status counts, in both
    one = t.groupBy("room", "id", "updated", "updated_by").agg(F.max(F.when(F.col("status") != "nonsense", F.col("status"))).alias("status")).where("status IS NOT NULL")
    return rooms.merge_tasks(one.limit(0), one).select("room", "id", "updated", "status")


@query(f"WITH {_TASK} SELECT room, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM k GROUP BY room")
def board_progress(spark, sf_dir):
    return activity.board_progress(_tasks(spark, sf_dir))


@query("SELECT 'r' || s_nationkey AS room, count(*) FILTER (s_suppkey % 3 = 0) = 0 AS finished, count(*) FILTER (s_suppkey % 3 = 0)::INT AS waiting FROM supplier GROUP BY 1")
def gather(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    t = s.select(F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("room"), F.col("s_name").alias("id"), F.lit("").alias("owner"), F.when(F.col("s_suppkey") % 3 == 0, "doing").when(F.col("s_suppkey") % 3 == 1, "done").otherwise("blocked").alias("status"))
    return rooms.gather(t).select("room", "finished", F.size("waiting").alias("waiting"))


@query("SELECT 'r' || s_nationkey AS room, 'o' || s_suppkey % 5 AS recipient, 'Task ' || s_name || ' for you: ' || s_nationkey AS opening FROM supplier WHERE s_suppkey % 5 > 0")
def plan_messages(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    owner = F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("o"), (F.col("s_suppkey") % 5).cast("string"))).otherwise("")
    t = s.select(F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("room"), F.col("s_name").alias("id"), F.col("s_nationkey").cast("string").alias("title"), owner.alias("owner"), F.array(F.lit("/f")).alias("files"))
    return rooms.plan_messages(t, "lead").select("room", "recipient", F.substring_index("text", "\n", 1).alias("opening"))


@query(f"WITH {_LOG} SELECT room, count(*) AS messages, 2 AS agents, (room::BIGINT % 2 = 0)::INT AS claims FROM log GROUP BY room")
def room_view(spark, sf_dir):
    log = A.room_log(spark, sf_dir)
    claims = log.where("CAST(room AS BIGINT) % 2 = 0").select("room").distinct().select("room", F.lit("/p").alias("path"), F.lit("h").alias("holder"))
    tasks = log.limit(0).select("room", F.lit(0).alias("created"), F.lit("").alias("id"), F.lit("").alias("title"), F.lit("").alias("status"))
    return rooms.room_view(log, _agents(log), claims, tasks).select("room", "messages", F.size("agents").alias("agents"), F.when(F.col("claims").isNull(), 0).otherwise(F.size("claims")).alias("claims"))


# ---- shared between devices

_PARTS = "p AS (SELECT c_custkey AS part, 'd' || c_nationkey % 3 AS device, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN c_custkey - c_custkey % 100 ELSE c_custkey END AS root, c_acctbal, c_mktsegment FROM customer)"


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = A.table(spark, sf_dir, "customer").withColumn("device", F.concat(F.lit("d"), (F.col("c_nationkey") % 3).cast("string")))
    joined = c.where("c_custkey % 4 = 0").select("device", F.col("c_custkey").alias("part"), (F.col("c_custkey") - F.col("c_custkey") % 100).alias("root"), (F.col("c_custkey") % 8 == 0).alias("gone"))
    state = F.when(F.col("c_mktsegment") == "BUILDING", "needs_you").when(F.col("c_mktsegment") == "MACHINERY", "running").otherwise("idle")
    rows = c.select("device", F.col("c_custkey").alias("part"), F.lit(1).alias("messages"), F.lit(2).alias("sessions"), F.timestamp_seconds(F.col("c_custkey")).alias("started_at"), F.timestamp_seconds(F.round("c_acctbal").cast("long")).alias("last_activity"), F.array("c_mktsegment").alias("tools"), state.alias("state"))
    return rows, joined


@query(f"WITH {_PARTS} SELECT part, root FROM p")
def resolve_roots(spark, sf_dir):
    return shared.resolve_roots(*_parts(spark, sf_dir)).select("part", "root")


@query(f"""WITH {_PARTS} SELECT root, count(*) AS messages, 2 * count(*) AS sessions, min(part) AS first, max(round(c_acctbal)::BIGINT) AS last, count(DISTINCT c_mktsegment)::INT AS tools, count(DISTINCT device)::INT AS devices,
  CASE max(CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 ELSE 1 END) WHEN 3 THEN 'needs_you' WHEN 2 THEN 'running' ELSE 'idle' END AS state FROM p GROUP BY root""")
def fold(spark, sf_dir):
    out = shared.fold(shared.resolve_roots(*_parts(spark, sf_dir)))
    return out.select("root", "messages", "sessions", F.unix_timestamp("started_at").alias("first"), F.unix_timestamp("last_activity").alias("last"), F.size("tools").alias("tools"), F.size("devices").alias("devices"), "state")


@query(f"WITH {_PARTS} SELECT root, count(*) AS messages, count(*) FILTER (part % 5 = 0)::INT AS notes FROM p GROUP BY root")
def whole_thread(spark, sf_dir):
    rows, parts = _parts(spark, sf_dir)
    notes = rows.where("part % 5 = 0").select(F.concat(F.lit("n"), F.col("part").cast("string")).alias("note_id"), F.col("part").alias("thread_id"), F.lit("note").alias("kind"), F.lit("x").alias("text"), F.col("part").alias("created"))
    out = shared.whole_thread(rows, parts, notes)
    return out.select("root", "messages", F.when(F.col("notes").isNull(), 0).otherwise(F.size("notes")).alias("notes"))


@query("SELECT c_custkey AS root, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'S' ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'done' ELSE 'active' END AS status FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0)")
def overlay(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    reg = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("thread_id"), F.when(F.col("c_custkey") % 2 == 1, "S").otherwise("").alias("title"), F.lit("done").alias("status"), (F.col("c_custkey") % 5 == 0).alias("deleted"))
    return shared.overlay(c.select(F.col("c_custkey").alias("root"), F.col("c_name").alias("title")), reg)


@query("WITH p AS (SELECT event_id, epoch_us(ts) // 1000000 AS updated FROM events WHERE epoch_us(ts) // 1000000 > 1704200000 ORDER BY 2, 1 LIMIT 200) SELECT event_id, updated, (SELECT CASE WHEN count(*) = 200 THEN max(updated) - 1 ELSE max(updated) END FROM p) AS upto FROM p")
def changes_since(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("updated"))
    pages, upto = shared.changes_since({"events": e}, 1_704_200_000, 200)
    return pages["events"].withColumn("upto", F.lit(upto).cast("long"))


@query("SELECT event_id % 500 AS note_id, max(epoch_us(ts) // 1000000) AS updated, arg_max(event_id, (epoch_us(ts) // 1000000, event_id)) AS writer FROM events WHERE ts IS NOT NULL AND event_type <> 'view' GROUP BY 1")
def merge_notes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "unknown").otherwise("note")
    e = A.table(spark, sf_dir, "events").where("ts IS NOT NULL").select((F.col("event_id") % 500).alias("note_id"), kind.alias("kind"), F.lit("t").alias("text"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("updated"), F.col("event_id").alias("updated_by"))
    return shared.merge_notes(e.where("kind = 'note' AND updated_by % 2 = 0"), e).select("note_id", "updated", F.col("updated_by").alias("writer"))


@query("SELECT conv_id AS conversation_id, turn AS seq, 'th_' || lpad(conv_id::VARCHAR, 6, '0') AS token FROM conversations WHERE role = 'user' AND turn % 2 = 0")
def handoff_tokens(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    mark = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" handoff: th_"), F.lpad(F.col("conversation_id").cast("string"), 6, "0"), F.lit(" ."))).otherwise(" handoff: !")
    return shared.handoff_tokens(m.withColumn("content", F.concat("content", mark)))


@query("""SELECT 'sk_' || conv_id AS a, 'th_here' || conv_id % 4 AS b, 'attach' AS what FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 0
  UNION ALL SELECT DISTINCT 'th_own' || conv_id, 'th_here' || conv_id % 4, 'join' FROM conversations WHERE conv_id % 3 <> 0""")
def handoff_joins(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    text = lambda x: F.concat(F.lit(x), F.col("conv_id").cast("string"))
    tokens = c.select(F.col("conv_id").alias("conversation_id"), F.concat(F.lit("th_here"), (F.col("conv_id") % 4).cast("string")).alias("token"), F.when(F.col("conv_id") % 3 == 0, "me").otherwise("far").alias("from_device"))
    attach, join = shared.handoff_joins(tokens, c.select(F.col("conv_id").alias("conversation_id"), text("sk_").alias("session_key"), text("th_own").alias("thread_id")), "me")
    return attach.select(F.col("session_key").alias("a"), F.col("thread_id").alias("b"), F.lit("attach").alias("what")).union(join.select("part", "root", F.lit("join")))


@query("WITH p AS (SELECT conv_id * 1000 + turn AS id, role, turn FROM conversations WHERE conv_id * 1000 + turn > 5000 ORDER BY 1 LIMIT 100) SELECT id, (SELECT max(id) FROM p) AS watermark FROM p WHERE role = 'user'")
def markers_since(spark, sf_dir):
    m = A.messages(spark, sf_dir).select((F.col("conversation_id") * 1000 + F.col("seq")).alias("id"), "conversation_id", "seq", "role", F.lit("handoff: th_0000").alias("content"))
    found, upto = shared.markers_since(m, 5000, 100)
    return found.select((F.col("conversation_id") * 1000 + F.col("seq")).alias("id"), F.lit(upto).cast("long").alias("watermark"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END AS urgency FROM customer")
def urgency(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    state = F.when(F.col("c_mktsegment") == "BUILDING", "needs_you").when(F.col("c_mktsegment") == "MACHINERY", "running").when(F.col("c_mktsegment") == "HOUSEHOLD", "listening").otherwise("ended")
    return c.select("c_custkey", shared.urgency(state).alias("urgency"))


@query("""WITH mx AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, max(ts) AS last FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)
  SELECT 'p' || user_id AS path FROM s, mx WHERE user_id % 2 = 0 AND last + INTERVAL 24 HOURS >= now AND user_id % 90 <= 45 AND user_id % 5 <> 0""")
def inferred_running_sessions(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    path = F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path")
    s = e.groupBy("user_id").agg(F.max("ts").alias("last_activity"))
    files = s.select(path, (now - F.make_interval(secs=F.col("user_id") % 90)).alias("modificationTime"))
    live = s.where("user_id % 5 = 0").select(path)
    sessions = s.select(path, F.when(F.col("user_id") % 2 == 0, "codex").otherwise("cursor").alias("tool"), "last_activity")
    return inferred_running(sessions, files, live, now).select("path")


# ---- rows of the store

@query("SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 0")
def forget(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("sk"), (F.col("doc_id") % 7).cast("string")).alias("session_key"), F.col("doc_id").alias("conversation_id"), "lang")
    keys = spark.createDataFrame([("sk0",)], "session_key string")
    kept, _ = ingest.forget(d, keys.limit(0), keys)
    return ingest.of_kept(d.select("conversation_id", "lang"), kept).select(F.col("conversation_id").alias("doc_id"), "lang")


@query("SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 OR l.toxic = 1")
def saved(spark, sf_dir):
    lab = A.table(spark, sf_dir, "labels")
    state = lab.select(F.col("doc_id").alias("session_key"), (F.col("quality") == 1).alias("bookmarked"), (F.col("toxic") == 1).alias("pinned"), F.lit(None).cast("string").alias("note"), F.array().cast("array<string>").alias("tags"))
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_key"), F.col("doc_id").alias("conversation_id"), F.col("doc_id").alias("indexed_at"), F.lit(None).cast("timestamp").alias("started_at"), "n_chars")
    return activity.saved(state, d).select(F.col("session_key").alias("doc_id"), "n_chars")


@query("SELECT DISTINCT t AS tag FROM (SELECT unnest([lower(c_mktsegment), 'n' || c_nationkey]) AS t FROM customer)")
def tag_facet(spark, sf_dir):
    from ..functions import text as T

    c = A.table(spark, sf_dir, "customer")
    return activity.tag_facet(c.select(T.tags(F.concat(F.lit(" "), "c_mktsegment", F.lit(", N"), F.col("c_nationkey").cast("string"), F.lit(",,"))).alias("tags")))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'new' WHEN quality = 1 THEN 'old' END AS note, quality = 1 AS pinned FROM labels")
def patch_flags(spark, sf_dir):
    lab = A.table(spark, sf_dir, "labels")
    state = lab.select("doc_id", F.when(F.col("quality") == 1, "old").alias("note"), (F.col("quality") == 1).alias("pinned"))
    changes = lab.where("toxic = 1").select("doc_id", F.lit("new").alias("note"), F.lit(None).cast("boolean").alias("pinned"))
    return ingest.patch(state, changes, "doc_id")


@query("SELECT user_id, max(epoch_us(ts)) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id")
def upsert_rows(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ingest.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "us").select("user_id", "us")


@query("""SELECT page_id, 'sk_' || substr(sha256(encode('web') || '\\x00'::BLOB || encode(url) || '\\x00'::BLOB || encode(html)), 1, 16) AS session_key FROM pages""")
def session_keys(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    return p.select("page_id", I.session_key(F.lit("web"), F.col("url"), F.col("html")).alias("session_key"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 <> 0")
def helper_projects(spark, sf_dir):
    last = F.when(F.col("s_nationkey") % 5 == 0, ".helper/").otherwise(".helper/x")
    return ingest.without_helper_projects(A.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("/w/"), "s_name", F.lit("/"), last).alias("project"))).select("s_suppkey")


@query("SELECT doc_id FROM documents WHERE (lang IS NULL OR lang <> 'de') AND (source IS NULL OR NOT contains(source, '2'))")
def serve_scope(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tool"), F.col("source").alias("project"))
    return search.served(d, ["de"], ["2"]).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 7 AND o_orderstatus = 'F' OR (o_custkey % 50 = 7 AND o_orderstatus = 'O') ORDER BY o_orderdate DESC, length(CASE o_orderstatus WHEN 'F' THEN '/c/7/F' ELSE '/c/7' END) DESC, lpad(o_orderkey::VARCHAR, 9, '0') LIMIT 1")
def latest_in_folder(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    folder = F.concat(F.lit("/c/"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderstatus") == "F", "/F").otherwise(""))
    c = o.select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("conversation_id"), folder.alias("project"), F.col("o_orderdate").alias("last_activity"))
    return activity.latest_in_folder(c, "/c/7/F/src/").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY n_chars DESC, doc_id LIMIT 1")
def of_source_path(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conversation_id"), F.col("source").alias("path"), F.col("n_chars").alias("message_count"))
    first = d.agg(F.min("path")).first()[0]
    return activity.of_source_path(d, first).select(F.col("conversation_id").alias("doc_id"))


@query("SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 50")
def recent_records(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("conversation_id"), F.col("ts").alias("started_at"))
    return activity.recent(e, 50).select(F.col("conversation_id").alias("event_id"))


@query("""SELECT message, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'bad line <n>' WHEN 'error' THEN 'no session <id>' ELSE event_type END AS message FROM events) GROUP BY message ORDER BY n DESC, message LIMIT 4""")
def parse_error_histogram(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("bad line "), F.col("event_id").cast("string"))).when(F.col("event_type") == "error", F.concat(F.lit("no session "), F.lpad(F.hex("event_id"), 12, "a"))).otherwise(F.col("event_type"))
    return activity.parse_error_histogram(e.select(text.alias("message")))


@query(f"WITH {_SESS} SELECT head, count(*) AS n FROM hd GROUP BY head HAVING count(*) > 1")
def threads_of_several(spark, sf_dir):
    found = threads.sessionise(_timed(spark, sf_dir), "user_id", None, "ts", "te", "event_id")
    return found.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
