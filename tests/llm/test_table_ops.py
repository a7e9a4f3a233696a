"""Mixing, WARC, token ids, language, language model, nearest neighbours: against plain computations."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.conftest import words
from quillmere.llm import ann, common, langid, lm_score, mixing, warc
from quillmere.llm.common import apply_decisions, numbered, write_decisions
from quillmere.llm.mph import PerfectHash
from quillmere.llm.queries import tokenizer
from quillmere.llm.token_ids import Encoder, encode, lookup, read_shards, width, write_shards


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, out, left = float(sum(sizes.values())), {}, set(order)
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mix_meets_its_targets(docs, rows, empty):
    counted = numbered(docs, "no").select(F.col("no").alias("row"), "doc_id", "source", "text")
    out = mixing.mix(counted).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want = plain_targets(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    largest = {}
    for r in out:
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(largest[s] if largest[s] > 5000 else 60, 0.02 * t), (s, taken[s], t)
    again = mixing.mix(counted.repartition(7).cache())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.copies) for r in again.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.size, r.copies) for r in out)
    assert mixing.mix(numbered(empty, "no").select(F.col("no").alias("row"), "doc_id", "source", "text")).collect() == []


def test_mix_of_small_buckets_and_several_flights(spark, monkeypatch):
    """Sources that leave more undecided than one flight takes, and an id that overfills its bucket."""
    monkeypatch.setattr(mixing, "BUCKET", 40)
    monkeypatch.setattr(mixing, "LAST_FLIGHT", 30)
    rng = random.Random(8)
    rows = [(i, i if i % 4 else 7, f"s{i % 3}", words(rng, rng.randint(1, 60))) for i in range(1500)]
    df = spark.createDataFrame(rows, "row long, doc_id long, source string, text string").repartition(3)
    out, again = (sorted(map(tuple, mixing.mix(d).collect())) for d in (df, df.repartition(5)))
    assert out == again and len(out) == 1500
    for s in ("s0", "s1", "s2"):
        mine = [r for r in out if r[2] == s]
        assert abs(sum(r[3] * r[6] for r in mine) - mine[0][5]) <= 0.02 * mine[0][5] and all(0 <= r[6] <= 3 for r in mine)


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{i:03d}": int(x) for i, x in enumerate(rng.integers(0, 1000, 80) ** 2)} | {None: 7}
    got = mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long")).collect()
    want = plain_targets(sizes)
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) for r in got) and len(got) == 81


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(0, 500, 400).astype(float), np.full(400, 0.37)
    out = mixing.fly(size, p, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert math.isclose(out.sum(), p.sum(), rel_tol=1e-9) and math.isclose(out @ size, p @ size, rel_tol=1e-9)


def test_flight_is_fair():
    rng, n = np.random.default_rng(1), 1500
    mean = sum((lambda q: mixing.land(np.arange(12.0), q))(mixing.fly(np.arange(12.0), np.full(12, 0.5), rng.random(12))) for _ in range(n)) / n
    assert np.abs(mean - 0.5).max() < 0.12


def test_mixed_repeats_rows(docs, empty):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {(r.doc_id, r.size): r["count"] for r in out.groupBy("doc_id", F.length("text").alias("size")).count().collect()}
    counted = numbered(docs, "no").select(F.col("no").alias("row"), "doc_id", "source", "text")
    want = {}
    for r in mixing.mix(counted).join(counted.select("row", F.length("text").alias("chars")), "row").collect():
        want[r.doc_id, r.chars] = want.get((r.doc_id, r.chars), 0) + r.copies
    assert counts == {k: v for k, v in want.items() if v}
    assert mixing.mixed(empty).collect() == []


def test_decisions_reach_their_rows(docs):
    counted = numbered(docs, "no")
    made = counted.select(F.col("no").alias("row"), "doc_id", F.pmod(F.col("no"), F.lit(3)).alias("n")).where("n <> 1")
    out = apply_decisions(counted, "no", write_decisions(made), default=1)
    want = sum({0: 0, 1: 1, 2: 2}[r.no % 3] for r in counted.select("no").collect())
    assert out.count() == want and out.columns == docs.columns
    with pytest.raises(Exception, match="not the one"):
        apply_decisions(counted, "no", write_decisions(made.withColumn("doc_id", F.lit(-5))), default=1).collect()


def test_skew_join_is_a_join(spark, monkeypatch):
    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(500)] + [(None, 1)], "k int, v int")
    right = left.groupBy("k").count().where("k <> 5").withColumn("x", F.col("k") * 10)
    monkeypatch.setattr(common, "HEAVY_ROWS", 100)
    got = common.skew_join(left, right, "k", "count", 501)
    want = left.join(right.drop("count"), "k")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def get(self, *_):
            return None

    class Context:
        master, getCheckpointDir, getConf = "local-cluster[2,1,1024]", lambda self: None, lambda self: Nothing()

    class Session:
        conf, sparkContext = Nothing(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


HTML = "page_id long, url string, html string, digest int, payload string"


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "x" * 200, "tiny"
    pages = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (3, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", big), (None, None, None), (10, "u", "ä" * 3_000_000), (11, "u", "ä" * 3_000_000)]
    spark.createDataFrame([(*p, 1, "x") for p in pages], HTML).repartition(3).write.parquet(f"{tmp_path}/pages")
    df = spark.read.parquet(f"{tmp_path}/pages")
    written = warc.write_archives(warc.plan_records(df), archive_bytes=400)
    out = warc.read_archives(written, payloads=True).collect()
    assert len(out) == len(pages) and written.agg(F.sum("records")).first()[0] == len(pages) and written.count() > 3
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for i, _, html in pages:
        assert any(r.payload_bytes == len((html or "").encode()) and r.payload_digest == digest(html) for r in by[i])
    assert [(by[i][0].record_type, by[i][0].refers_to) for i in (5, 2, 9, 3, 4, 10, 11)] == [("revisit", 2), ("response", None), ("revisit", 2), ("response", None), ("response", None), ("response", None), ("revisit", 10)]
    assert {r.record_type for r in by[8]} == {"response"} and {(r.record_type, r.refers_to) for r in by[None]} == {("revisit", 2), ("response", None)}
    assert by[2][0].payload == big.encode() and by[5][0].payload == b""
    none = spark.createDataFrame([], HTML)
    assert warc.read_archives(warc.write_archives(warc.plan_records(none))).collect() == []


def test_warc_reader_refuses_damage():
    digest = hashlib.sha256(b"abc").hexdigest()
    good = warc.record(1, "u", b"abc", digest, None)
    assert [r[:5] for r in warc.read_records(io.BytesIO(good + good))] == [(1, 3, digest, "response", None)] * 2
    plain = zlib.decompress(good, 31)
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (good[:-10], pack(plain.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")), pack(plain.replace(b"WARC/1.1", b"WORC/1.1")), pack(plain[:-1]), b"junk"):
        with pytest.raises((warc.BadRecord, KeyError)):
            list(warc.read_records(io.BytesIO(bad)))


def test_perfect_hash_is_minimal_and_loads():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        keys = np.unique(keys)
        made = PerfectHash.of(keys)
        mph, used = PerfectHash.load(made.dump() + b"more", len(made.sizes))
        assert used == len(made.dump())
        for key in keys[:20]:
            where = PerfectHash.slot_in_file(lambda n, at: made.dump()[at : at + n], len(made.sizes), np.array([key]))
            assert where == (mph.slots(np.array([key]))[0], used)
        assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="twice"):
        PerfectHash.of(np.array([1, 1], np.uint64))


def _encoded(coder, texts):
    ids, at = coder.encode(pa.array([t.encode() for t in texts], pa.binary()), 1)
    assert (ids[at[1:] - 1] == 1).all()
    return [ids[a : b - 1].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), Encoder(path, np.uint16)
    texts = ["", "It's  a. test, the TEST...", "a\x00b \x00", "<|endoftext|> x<|startoftext|>y", "x <|ENDOFTEXT|> y", "<|EndOfText|>", "T\u0308 J\u030c t\u0308", "é é  　x ", "don't. can,t 1.5,", "x" * 3000]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert _encoded(fast, texts) == want and [_encoded(fast, [t])[0] for t in texts] == want
    other = tokenizer("byte_bpe_50k.json")
    assert Encoder(other).mark is None and _encoded(Encoder(other), [" a  b"]) == [Tokenizer.from_file(other).encode(" a  b", add_special_tokens=False).ids]
    assert _encoded(fast, []) == [] and _encoded(fast, [" \t"]) == [[]]


PIECES = ["a", "The", "WORD", "É", "ß", "ÿ", "÷", "###", "$'", "'S", "]", "\\", "`", "~", "Ĳ", "ŉ", "e\u0301", "T\u0308", "ẞ", "ς", "İ", ".", ",", "'s", "'LL", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startOfText|>", " ", "  ", "\n", "\t", "\x00", "\x1c", "\u00a0", "\u2028", "1", "23", "中", "🙂", "_", "-", "\ufffd"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=5))
def test_encoder_matches_the_library_on_any_text(texts):
    from tokenizers import Tokenizer

    if "fuzz" not in _KEPT:
        _KEPT["fuzz"] = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), Encoder(tokenizer("word_bpe_49k.json"), np.uint16)
    plain, fast = _KEPT["fuzz"]
    assert _encoded(fast, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


_KEPT: dict = {}


def test_token_shards_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    shards = write_shards(docs, path, range_rows=15)
    out = sorted(read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted([r[0] for r in rows], key=lambda d: (d is None, d or 0)) and shards.count() > 2
    texts, start = {}, 0
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in out:
        ids = [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts[r.doc_id]]
        assert r.start == start and (r.n_tokens, r.ids_crc32) in [(len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())) for i in ids]
        start += r.n_tokens
    got = lookup(spark, shards, [3, 107, 106, 55555, -9])
    assert set(got) == {3, 107, 106} and got[3].tolist() == plain.encode(texts[3][0], add_special_tokens=False).ids + [1]
    assert width(path) == 2 and read_shards(write_shards(empty, path)).collect() == [] and lookup(spark, write_shards(empty, path), [1]) == {}
    assert encode(docs.limit(0), path).collect() == []


def test_a_frequent_id_and_null_ids_have_several_ranges(spark):
    path, rng = tokenizer("word_bpe_49k.json"), random.Random(3)
    rows = [(i, words(rng, 5)) for i in range(60)] + [(7, words(rng, 5)) for _ in range(70)] + [(None, words(rng, 5)) for _ in range(80)]
    shards = write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, range_rows=10)
    listed = shards.collect()
    assert max(r.docs for r in listed) < 60 and sum(r.docs for r in listed) == len(rows)
    assert sum(r.first_id is None for r in listed) > 1 and sum(r.first_id == r.last_id == 7 for r in listed) > 1
    out = sorted(read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted([r[0] for r in rows], key=lambda d: (d is None, d or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))


def test_language_is_learned_and_held_out(spark, docs, rows, empty):
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 60}
    held = [r for r in out if r.held_out and r.doc_id in lang]
    assert held and all(r.lang_pred == lang[r.doc_id] and 0.5 < r.score <= 1 for r in held)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (102, 103, 104, 105):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    blind = docs.withColumn("lang", F.when(~langid.held_out(), F.col("lang")))
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(blind).collect()} == {(r.doc_id, r.lang_pred) for r in out}
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(empty).collect() == []
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4


def test_decoding_is_the_plain_one():
    rng = np.random.default_rng(4)
    for k in (1, 2, 4, 7):
        x, names = rng.random((60, 12)).astype(np.float32), [f"l{i % k}" for i in range(60)]
        x[:, -1] = 1
        x[np.arange(60), np.arange(60) % k] += 2
        model = langid.Model.fit(x, names)
        best, share, lead = model.decode(x[:, :-1])
        for i in range(60):
            bits = [sum(float(a) * float(b) for a, b in zip(x[i], model.weights[:, j], strict=True)) for j in range(model.code.shape[1])]
            loss = [sum(t * math.log1p(math.exp(-b * c)) for t, b, c in zip(model.trust, bits, word, strict=True)) for word in model.code]
            odds = [math.exp(-v * len(bits)) for v in loss]
            order = sorted(range(k), key=lambda j: (loss[j], j))
            assert best[i] == order[0] and math.isclose(share[i], odds[order[0]] / sum(odds), rel_tol=1e-3)
            assert math.isclose(lead[i], (odds[order[0]] - (odds[order[1]] if k > 1 else 0)) / sum(odds), rel_tol=1e-2, abs_tol=1e-3)


def test_the_language_model_does_not_hang_on_the_order_of_rows(spark, docs):
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" once more"))))
    a, b = (langid.fit(d) for d in (twice.repartition(2), twice.repartition(7)))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 6, 12, 40):
        code = langid.codewords(k)
        far = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert code.shape[0] == k and min(far) >= (1 if k == 2 else code.shape[1] / 4)


def plain_scores(texts, lexicon, network):
    """Pseudo-likelihoods by a loop over tokens, and log p of every word in the first place of the first text."""
    words = [[w for w in re.split(b"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] for t in texts]
    counts = Counter(w for ws in words for w in ws)
    group = {w: (w[-1] * 31 + (w[-2] if len(w) > 1 else 0)) % lm_score.GROUPS for w in counts}
    code = {w: int(lm_score.tokens_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in counts}
    k = int(np.ceil(len(counts) ** 0.5))
    top = sorted(counts, key=lambda w: (-counts[w], code[w]))[:k]
    assert lexicon.frequent.tolist() == [code[w] for w in top] and lexicon.counts.tolist() == [counts[w] for w in top]
    place = {w: i for i, w in enumerate(top)}
    whole = Counter()
    for w in counts.keys() - place.keys():
        whole[group[w]] += counts[w]
    cls = lambda w: place.get(w, k + group[w])
    n, size = lexicon.clusters, lexicon.size

    def log_p(around, word):
        x = [v for p, c in enumerate(around) for v in network.embed[p][c].tolist()]
        h = [math.tanh(sum(a * b for a, b in zip(x, network.hidden[:, j].tolist(), strict=True)) + float(network.hidden_bias[j])) for j in range(lm_score.HIDDEN)]
        at = lambda m, bias, j: sum(a * b for a, b in zip(h, m[:, j].tolist(), strict=True)) + float(bias[j])
        share = lambda z, j: z[j] - max(z) - math.log(sum(math.exp(v - max(z)) for v in z))
        z = [at(network.out, network.out_bias, j) for j in range(n + lm_score.GROUPS)]
        c = cls(word)
        if c >= k:
            return share(z, n + c - k) + math.log(counts[word] / whole[c - k])
        return share(z, c // size) + share([at(network.inner[c // size], network.inner_bias[c // size], j) for j in range(size)], c % size)

    out = []
    for ws in words:
        around = [[cls(ws[j]) if 0 <= (j := i + d) < len(ws) else lexicon.outside for d in (-2, -1, 1, 2)] for i in range(len(ws))]
        out.append(sum(log_p(a, w) for a, w in zip(around, ws, strict=True)))
    return out, [log_p([0, 1, lexicon.outside, k], w) for w in counts]


def test_scores_match_a_loop_over_tokens_and_are_a_distribution(spark, docs):
    small = docs.where("doc_id < 12 or doc_id between 102 and 106 or doc_id is null").select("doc_id", "text").repartition(2).cache()
    numbered_ = small.select(F.lit(0).alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    lexicon, network, seqs = lm_score.fit(numbered_, part_tokens=300)
    texts = [r.text for r in small.collect()]
    plain, every = plain_scores(texts, lexicon, network)
    got = sorted(r.pll for r in lm_score.score(small, part_tokens=300).collect())
    assert np.allclose(got, sorted(plain), rtol=1e-4) and math.isclose(sum(map(math.exp, every)), 1, rel_tol=1e-4)


def test_scores_do_not_hang_on_the_layout(spark, docs, rows, empty):
    out = {}
    for parts in (2, 8):
        out[parts] = lm_score.score(docs.repartition(parts), part_tokens=4000).collect()
        assert len(out[parts]) == len(rows)
        for r in out[parts]:
            assert r.pll <= 0 and (r.mean_pll is None) == (r.n_tokens == 0)
    order = lambda rs: sorted((r.doc_id or -1, r.n_tokens, round(r.pll, 6)) for r in rs)
    assert np.allclose(order(out[2]), order(out[8]), rtol=1e-5)
    same = [r.pll for r in out[2] if r.doc_id in (1, 100)]
    assert math.isclose(*same, rel_tol=1e-5)
    assert lm_score.score(empty).collect() == [] and [r.pll for r in lm_score.score(docs.where("doc_id = 102")).collect()] == [0]


def test_the_network_learns_from_the_sides(spark):
    lexicon = lm_score.Lexicon(np.arange(36), np.full(36, 10), np.full(lm_score.GROUPS, 10))
    net, rng = lm_score.Network.start(lexicon), np.random.default_rng(0)
    pairs = rng.integers(0, 36 + lm_score.GROUPS, 1 << 14)  # the word is the one before
    around = np.stack([np.full(len(pairs), lexicon.outside), pairs, pairs, np.full(len(pairs), lexicon.outside)], axis=1)
    before = net.log_p(around, pairs).mean()
    for r in range(30):
        net.learn(around, pairs, r)
    assert net.log_p(around, pairs).mean() > before + 1


def test_a_changed_table_is_refused(spark):
    lexicon = lm_score.Lexicon(np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(lm_score.GROUPS, 10))
    rows = spark.createDataFrame([(0, 1, bytearray(b"a b"))], "row long, doc_id long, text binary")
    words = lm_score.words_of_parts(rows).where("false")
    with pytest.raises(Exception, match="other words"):
        lm_score.sequences(rows, lexicon, lm_score.write_counts(words, words, 1)).collect()


def test_contexts_stay_in_their_document():
    got = lm_score.contexts(np.array([1, 2, 3, 4]), np.array([0, 2, 4]), 9)
    assert got.tolist() == [[9, 9, 2, 9], [9, 1, 9, 9], [9, 9, 4, 9], [9, 3, 9, 9]]
    assert lm_score.contexts(np.arange(5), np.array([0, 0, 5, 5]), 9).tolist() == [[9, 9, 1, 2], [9, 0, 2, 3], [0, 1, 3, 4], [1, 2, 4, 9], [2, 3, 9, 9]]


VEC = "vec_id long, embedding array<float>, label int, entry string, v int"


def test_neighbours_exactly_and_by_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[200:500] = x[7]  # a crowd of copies
    rows = [(i, v.tolist(), 1, "e", 2) for i, v in enumerate(x)] + [(2000, None, 1, "e", 2), (2100, [0.0] * 16, 1, "e", 2), (2200, [float("nan")] * 16, 1, "e", 2), (2300, [None] * 16, 1, "e", 2), (None, x[3].tolist(), 1, "e", 2), (2400, [1.0], 1, "e", 2)]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    out = ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    recall = []
    wide = x.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10].tolist()
        recall.append(len({i for i, _ in found} & set(best)) / 10)
        assert len(found) == 10 and q not in {i for i, _ in found} and all(math.isclose(s, d[i], rel_tol=1e-12, abs_tol=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda t: (t[1], t[0]))
    assert np.mean(recall) >= 0.9
    assert [i for i, _ in got[200]] == [7, *range(201, 210)]


def test_recall_on_the_test_tables(spark):
    """64 dimensions, every query against brute force."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.select("vec_id", F.col("embedding").cast("array<double>")).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = {}
    for r in ann.nearest_neighbours(v, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        recall.append(len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert len(recall) == len(got) >= 20 and np.mean(recall) >= 0.9 and min(recall) >= 0.5
    assert all(ann.parallel_weight(d) > 1 for d in (2, 16, 25, 64, 768))


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    out = sorted(ann.nearest_neighbours(few, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r.query_id, r.rank))
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out if r.query_id == 0] == [(0, 1, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 1, 1.0)]
    assert [(r.rank, r.vec_id) for r in out if r.query_id == 100] == [(1, 0), (2, 1)]
    assert ann.nearest_neighbours(few.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_anisotropic_codes_err_less_along_the_vector():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    model = ann.Model.fit(x, 16)
    cell = ann.nearest(x, model.centres)
    rest = x - model.centres[cell]
    along = {}
    for weight in (1.0, model.weight):
        m = ann.Model(model.centres, model.books, weight)
        codes = m.codes(x, rest)
        error = rest - m.books[np.arange(16)[None], codes].reshape(len(x), -1)
        along[weight] = np.abs((error * x).sum(axis=1) / np.linalg.norm(x, axis=1)).mean()
    assert model.weight > 1 and along[model.weight] < along[1.0]
