"""Registered queries of text and vector functions, hits and their snippets, metrics by name, and budgets of context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import metrics, search, themes
from ..streaming.ingest import indexed, sizes
from . import adapters as A
from . import context, reports
from .queries import _BM25, _HALVES, _PER, _Q, _SEM, QUERY, _halves, _per, _probe, query, r6

# ---- hits

@query(f"WITH {_BM25} SELECT kb.conv_id AS conversation_id, kb.turn AS seq, md5(c.text) AS digest, c.role FROM kb JOIN conversations c USING (conv_id, turn) WHERE rn = 1 ORDER BY kb.score DESC, kb.conv_id LIMIT 10")
def hydrate(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    return search.hydrate(search.keyword_search(m, QUERY, 10), m).select("conversation_id", "seq", F.md5("content").alias("digest"), "role")


@query(f"WITH {_BM25} SELECT conv_id AS conversation_id, turn AS seq, round(score, 6) AS score FROM kb WHERE rn = 1 AND conv_id % 2 = 0 ORDER BY kb.score DESC, conv_id LIMIT 10".replace("FROM conversations)", "FROM conversations WHERE conv_id % 2 = 0)", 1))
def indexed_search(spark, sf_dir):
    """The search over a stored index, restricted to some conversations before anything is ranked."""
    m = A.messages(spark, sf_dir)
    wanted = m.where("conversation_id % 2 = 0").select("conversation_id").distinct()
    found = search.indexed_search(indexed(m), sizes(m), QUERY, 10, wanted)
    return found.select("conversation_id", "seq", r6("score").alias("score"))


@query(f"WITH {_SEM} SELECT vec_id AS conversation_id, round(score, 6) AS score FROM sem WHERE score >= 0.15 AND label = 3 ORDER BY sem.score DESC, vec_id LIMIT 10")
def semantic_filtered(spark, sf_dir):
    v = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conversation_id"), F.lit(0).alias("seq"), "embedding", F.col("label").cast("string").alias("tool"))
    return search.semantic_search(v, _probe(spark, sf_dir), 10, filters=search.Filters(tool="3")).select("conversation_id", r6("score").alias("score"))


@query(f"""WITH {_BM25.replace("FROM conversations)", "FROM conversations WHERE conv_id % 3 = 1)", 1)}, {_SEM},
  l1 AS (SELECT conv_id AS id, row_number() OVER (ORDER BY score DESC, conv_id) - 1 AS rank FROM kb WHERE rn = 1 QUALIFY rank < 50),
  l2 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM sem WHERE score >= 0.15 AND vec_id % 3 = 1 QUALIFY rank < 50),
  f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY id) SELECT id AS conversation_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 10""")
def hybrid_filtered(spark, sf_dir):
    tool = lambda df: df.withColumn("tool", F.pmod("conversation_id", F.lit(3)).cast("string"))
    v = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conversation_id"), F.lit(0).alias("seq"), "embedding")
    found = search.hybrid_search(tool(A.messages(spark, sf_dir)), tool(v), QUERY, _probe(spark, sf_dir), 10, search.Filters(tool="1"))
    return found.select("conversation_id", r6("score").alias("score"))


@query(r"""WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations),
  p AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM w),
  f AS (SELECT *, list_contains(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), 'de') AS a, list_contains(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), 'the') AS b,
        list_contains(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), 'and') AS c FROM p),
  n AS (SELECT *, coalesce(bool_or(a) OVER e, false)::INT + coalesce(bool_or(b) OVER e, false)::INT + coalesce(bool_or(c) OVER e, false)::INT AS n, count(*) OVER (PARTITION BY conv_id, turn) AS size
        FROM f WINDOW e AS (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
  s AS (SELECT conv_id, turn, arg_min(pos, -n * 100000000 + pos) AS first FROM n GROUP BY ALL)
  SELECT conv_id AS conversation_id, turn AS seq, CASE WHEN first > 1 THEN '…' ELSE '' END || string_agg(CASE WHEN a OR b OR c THEN '[' || x || ']' ELSE x END, ' ' ORDER BY pos)
         || CASE WHEN first + 12 <= any_value(size) THEN '…' ELSE '' END AS snippet
  FROM n JOIN s USING (conv_id, turn) WHERE pos >= first AND pos < first + 12 GROUP BY conv_id, turn, first""")
def snippets(spark, sf_dir):
    """The best windows for three words: in many messages not the window of the first hit."""
    return A.messages(spark, sf_dir).select("conversation_id", "seq", search.snippet("content", "De the AND", start="[", end="]").alias("snippet"))


@query(r"SELECT conv_id, turn, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(substr(t, 1, 160)) || '…' END AS snippet, substr(trim(text), 1, 40) AS plain FROM (SELECT conv_id, turn, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)")
def plain_snippets(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.plain_snippet("text").alias("snippet"), T.clip_plain("text", 40).alias("plain"))


@query("""WITH p AS (SELECT conv_id, turn, text, len(list_filter(range(1, 61), lambda i: i <= length(text) AND octet_length(encode(text[1:i])) <= 60)) AS k FROM conversations)
  SELECT conv_id, turn, CASE WHEN octet_length(encode(text)) <= 60 THEN text ELSE rtrim(text[1:k]) || ' …' END AS clipped FROM p""")
def byte_clips(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clip_bytes("text", 60).alias("clipped"))


# ---- text and vectors

@query(r"""WITH b AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, '0x' || substr(md5(url), 1, 6) AS x, page_id % 4 AS k FROM pages), r AS (SELECT *, host || '/own' || k || '/repo' || page_id AS want FROM b)
  SELECT page_id, want AS remote, 'own' || k || '/repo' || page_id AS label FROM r""")
def remotes(spark, sf_dir):
    """The forms of a git remote lead to one key, and that to one label."""
    p = A.table(spark, sf_dir, "pages")
    host, k = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), (F.col("page_id") % 4).cast("string")
    path = F.concat(F.lit("Own"), k, F.lit("/Repo"), F.col("page_id").cast("string"))
    form = F.when(k == "0", F.concat(F.lit("https://me:pw@"), host, F.lit("/"), path, F.lit(".git"))).when(k == "1", F.concat(F.lit("git@"), host, F.lit(":"), path, F.lit(".git")))
    form = form.when(k == "2", F.concat(F.lit("ssh://git@"), host, F.lit(":22/"), path, F.lit("/"))).otherwise(F.concat(F.lit("http://"), host, F.lit("/"), path))
    key = T.normalize_remote(form)
    return p.select("page_id", key.alias("remote"), T.repo_label(key).alias("label"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS folder, 'repo ' || substr(md5(url), 1, 8) AS root FROM pages WHERE NOT contains(url, chr(92))")
def repo_labels(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").where(~F.contains("url", F.lit("\\")))
    return p.select("page_id", T.repo_label(F.concat(F.lit("path:"), "url")).alias("folder"), T.repo_label(F.concat(F.lit("root:"), F.md5("url"))).alias("root"))


_ESCAPED = "replace(replace(replace(text, ' ', '%20'), 'e', '%65'), 'th', '%54%48') || '+%C3%a9%E2%82%AC%F0%9F%98%80'"


@query(f"SELECT conv_id, turn, url_decode({_ESCAPED}) AS decoded FROM conversations WHERE NOT contains(text, '%')")
def percent_decoded(spark, sf_dir):
    """Escapes of one to four bytes in either case, and a plus, which is none."""
    c = A.table(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("%")))
    return c.select("conv_id", "turn", T.percent_decode(F.expr(_ESCAPED)).alias("decoded"))


@query("""WITH s AS (SELECT event_id, floor(epoch(TIMESTAMP '2024-02-10 00:00:00') - floor(epoch(ts)))::BIGINT AS s FROM events WHERE ts IS NOT NULL)
  SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS ago FROM s WHERE s >= 0""")
def relative_times(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").where("ts <= TIMESTAMP_NTZ '2024-02-10 00:00:00'").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", T.relative_time("ts", F.lit("2024-02-10 00:00:00").cast("timestamp")).alias("ago"))


@query("SELECT c_custkey, list_sort(list_distinct([lower(c_mktsegment), 'x', lower(c_name)])) AS tags FROM customer")
def tag_lists(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select("c_custkey", T.tags(F.concat(F.lit(" X ,"), "c_mktsegment", F.lit(",, x,"), "c_name", F.lit(", "))).alias("tags"))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, octet_length(encode(w))), lambda i: (strpos('0123456789abcdef', lower(hex(encode(w))[2 * i + 1])) * 16 - 16 + strpos('0123456789abcdef', lower(hex(encode(w))[2 * i + 2])) - 1)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(rf"""WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS w FROM conversations), u AS (SELECT w, {_FNV} AS h FROM (SELECT DISTINCT w FROM t)),
  p AS (SELECT conv_id, turn, (h % 384)::INT AS pos, sum(CASE WHEN (h // 8589934592::HUGEINT) % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS x FROM t JOIN u USING (w) GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS n FROM p GROUP BY ALL)
  SELECT conv_id AS conversation_id, turn AS seq, pos, round(x / n, 3) AS x FROM p JOIN n USING (conv_id, turn) WHERE x <> 0""")
def hash_embeddings(spark, sf_dir):
    out = V.embed(A.messages(spark, sf_dir).select("conversation_id", "seq", "content"))
    return out.select("conversation_id", "seq", F.posexplode("embedding").alias("pos", "x")).where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 3))


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS far, round(list_dot_product(embedding::DOUBLE[], q), 6) AS dot FROM embeddings, {_Q}")
def distances(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _probe(spark, sf_dir)])
    return A.table(spark, sf_dir, "embeddings").select("vec_id", r6(F.sqrt(V.squared_distance(F.col("embedding"), q))).alias("far"), r6(V.dot(F.col("embedding"), q)).alias("dot"))


# ---- metrics by name, reports

@query(f"WITH {_PER} SELECT 'tool' AS what, tool AS value, count(*) AS n FROM per GROUP BY tool UNION ALL SELECT 'model', 'm', count(*) FROM per UNION ALL SELECT 'action', a, (sum(actions) // 2)::BIGINT FROM per, (VALUES ('edit'), ('run')) v(a) GROUP BY a HAVING sum(actions) > 0")
def metrics_by_name(spark, sf_dir):
    per = _per(spark, sf_dir).persist()
    parts = [metrics.top(per, c, n).select(F.lit(w).alias("what"), "value", "n") for w, c, n in (("tool", "tool", None), ("model", "model", 6), ("action", "actions", 8))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT 'l' || conv_id % 5 AS value, count(DISTINCT conv_id) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def top_languages(spark, sf_dir):
    """Languages of fenced blocks that users open, once a session."""
    m = A.messages(spark, sf_dir)
    lang = F.concat(F.lit("l"), F.pmod("conversation_id", F.lit(5)).cast("string"))
    m = m.withColumn("content", F.concat(F.lit("see ```"), F.upper(lang), F.lit(" x\ncode\n``` "), "content"))
    return metrics.top(metrics.session_metrics(A.sessions(spark, sf_dir), m), "languages", 8)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN CASE WHEN l_returnflag = 'A' THEN l_tax < l_discount * 0.9 ELSE l_tax > l_discount * 1.1 OR (l_discount < 1e-9 AND l_tax > 0) END THEN 'improved'
  WHEN CASE WHEN l_returnflag = 'A' THEN l_tax > l_discount * 1.1 ELSE l_tax < l_discount * 0.9 END THEN 'regressed' ELSE 'no clear change' END AS verdict FROM lineitem""")
def verdicts(spark, sf_dir):
    x = A.table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", reports.verdict(F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag") == "A").alias("verdict"))


@query(f"""WITH {_PER}, {_HALVES} SELECT CASE WHEN avg_tool_actions >= 4.0 AND test_mention_rate < 0.15 THEN 'diligence' WHEN avg_projects_per_active_day > 3.0 THEN 'delegation' WHEN correction_rate > 0.40 THEN 'discernment' WHEN first_prompt_miss_rate > 0.20 THEN 'description' END AS dimension,
  round(abandonment_rate * sessions)::BIGINT AS unresolved FROM gd WHERE half = 0""")
def reflection(spark, sf_dir):
    half = _halves(spark, sf_dir)[0]
    return reports.reflection(half).crossJoin(reports.unresolved(half))  # one row each


@query(f"""WITH {_PER}, {_HALVES}, l AS (SELECT 1 AS place, 'front_load' AS lever, first_prompt_miss_rate AS weight FROM gd WHERE half = 0 AND first_prompt_miss_rate > 0.20 UNION ALL SELECT 2, 'close_loops', abandonment_rate FROM gd WHERE half = 0 AND abandonment_rate > 0.25
   UNION ALL SELECT 3, 'review_plan', correction_rate * 0.9 FROM gd WHERE half = 0 AND correction_rate > 0.40 UNION ALL SELECT 4, 'ask_tests', 0.15 - test_mention_rate FROM gd WHERE half = 0 AND test_mention_rate < 0.15
   UNION ALL SELECT 5, 'batch_projects', (avg_projects_per_active_day - 3) / 5 FROM gd WHERE half = 0 AND avg_projects_per_active_day > 3) SELECT lever, round(weight, 6) AS weight FROM l ORDER BY l.weight DESC, place DESC LIMIT 1""")
def top_lever(spark, sf_dir):
    return reports.top_lever(_halves(spark, sf_dir)[0]).select("lever", r6("weight").alias("weight"))


@query("SELECT 8 AS clusters, count(*) AS items, true AS tight, true AS labelled FROM embeddings")
def theme_quality(spark, sf_dir):
    """Clusters hold every item once, and lie closer about their centres than all items about theirs."""
    v = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.unit(F.col("embedding")).alias("centroid"), F.lit("some title").alias("title"), F.lit("t").alias("tool"))
    placed = themes.cluster(v, 8)
    sums = lambda by: placed.select(*by, F.posexplode("centroid").alias("pos", "x")).groupBy(*by, "pos").agg((F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count("*")).alias("v")).agg(F.sum("v").alias("v"))
    within_, whole = sums(["cluster"]).first().v, sums([]).first().v
    out = placed.agg(F.count_distinct("cluster").cast("int").alias("clusters"), F.count("*").alias("items"))
    named = themes.labels(placed, "cluster", "title").where("label IS NULL").count() == 0
    return out.withColumn("tight", F.lit(bool(within_ < whole))).withColumn("labelled", F.lit(named))


# ---- budgets

@query("SELECT conv_id AS conversation_id, turn AS seq FROM (SELECT *, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + octet_length(encode(text)), 0) AS used FROM conversations) WHERE used <= 1500")
def context_budget(spark, sf_dir):
    return context.within(A.messages(spark, sf_dir), 1500).select("conversation_id", "seq")


@query(f"""WITH {_BM25}, b AS (SELECT conv_id, score, row_number() OVER (ORDER BY score DESC, conv_id) AS place FROM kb WHERE rn = 1 QUALIFY place <= 4),
  u AS (SELECT c.conv_id, c.turn, c.role, c.text, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + octet_length(encode(text)), 0) AS used FROM conversations c JOIN b USING (conv_id)),
  sec AS (SELECT b.place, '## t' || conv_id || ' (a)' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS body FROM u JOIN b USING (conv_id) WHERE used <= 20000 GROUP BY b.place, conv_id),
  r AS (SELECT *, sum(octet_length(encode(body))) OVER (ORDER BY place) AS upto FROM sec) SELECT coalesce(string_agg(body, chr(10) ORDER BY place), '') AS text, count(*) AS sections FROM r WHERE upto <= 20000""")
def context_block(spark, sf_dir):
    """The best conversations for two words, whole, while they fit."""
    m = A.messages(spark, sf_dir)
    c = m.groupBy("conversation_id").agg(F.concat(F.lit("t"), F.first("conversation_id").cast("string")).alias("title"), F.lit("a").alias("tool"), F.min("ts").alias("started_at"))
    block = context.context(search.keyword_search(m, QUERY, 4), m, c, 20_000)
    return spark.createDataFrame([(block.text, block.sections)], "text string, sections long")


@query(r"""WITH n AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) SELECT conv_id AS conversation_id, md5(string_agg(t, chr(10) ORDER BY turn)) AS digest FROM n WHERE rn <= 60 GROUP BY conv_id""")
def texts_opening(spark, sf_dir):
    from ..operators.threads import opening_text

    return opening_text(A.messages(spark, sf_dir)).select("conversation_id", F.md5("opening").alias("digest"))


@query(f"WITH {_PER} SELECT conv_id AS session_id FROM per WHERE NOT resolved AND messages > 0 ORDER BY start DESC, conv_id LIMIT 20")
def loops_open(spark, sf_dir):
    return context.open_loops(_per(spark, sf_dir), A.messages(spark, sf_dir)).select("session_id")
