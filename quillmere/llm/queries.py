"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "row")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import plan_records, read_archives, write_archives

    return read_archives(write_archives(plan_records(table(spark, sf_dir, "pages"))))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), shingle=4, k=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_ids import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8, k=5)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "row")
    return collocations(docs, least=100, longest=5, top=2000)


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    return jaccard_components(docs, k=3, percent=90)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_lm_score": op5_lm_score,
    "op6_nearest": op6_nearest,
    "op7_token_ids": op7_token_ids,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_licenses": op10_licenses,
    "op11_collocations": op11_collocations,
    "op12_jaccard": op12_jaccard,
    "op13_ranked": op13_ranked,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op11_collocations": rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
        grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM worded, range(1, 6) AS ks(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
        cand AS (SELECT * FROM f WHERE k >= 2 AND a >= 100),
        inner_ AS (
            SELECT DISTINCT lang, g[i:i + len(g) - 2] AS g, a FROM cand, range(1, 3) AS r(i) WHERE k >= 3),
        kept AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.g = c.g AND i.a >= c.a)),
        cuts AS (SELECT lang, g, a, c, g[1:c] AS x, g[c + 1:] AS y FROM kept, range(1, 5) AS r(c) WHERE c < k),
        scored AS (
            SELECT u.lang, u.g, u.a, u.c, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * u.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM cuts u JOIN totals t USING (lang) JOIN f x ON x.lang = u.lang AND x.g = u.x JOIN f y ON y.lang = u.lang AND y.g = u.y),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
        placed AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM placed WHERE rank <= 2000""",
    "op12_jaccard": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
        reach AS (SELECT DISTINCT x AS a, x AS b FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
        least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ c USING (doc_id)""",
    "op13_ranked": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        total AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM d),
        p AS (SELECT doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
        df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
        w AS (SELECT b.item_id, b.t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM b JOIN df USING (t), total),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
            FROM w JOIN p USING (t), total GROUP BY item_id, doc_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10""",
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op9_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
        ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, sizes),
        bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM b JOIN sizes ON k = least(len(w), 5)),
        n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles,
               count(*)::DOUBLE / any_value(item_shingles) AS containment
        FROM ds JOIN bs USING (k, s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles)""",
}
