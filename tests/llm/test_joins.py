"""Collocations, the n-gram Jaccard join and ranked search: against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.llm.collocations import collocations, dictionary, fragments, own_phrases, phrases, unique_rows, word_counts
from quillmere.llm.common import U64, numbered
from quillmere.llm.jaccard import Trie, jaccard_components, joined, needed, ordered_sets, prefix, similar_links
from quillmere.llm.ranked import Shard, doc_weights, ranked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * counts[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def spoken(rng, n, words="the of a in It cat dog sat on mat ä ö the,the of. of! a\tb c\nd".split(" ")):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def spoken_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice(["en", "de", None, "und"]), spoken(rng, rng.randint(0, 60))) for i in range(150)]
    rows += [(200, "en", None), (201, None, ""), (202, "fr", " .,\n"), (203, "en", spoken(rng, 30_000)), (204, "de", "x y z " * 50), (204, "de", "x y z " * 50), (None, "en", "The cat sat")]
    return rows


def stored(spark, tmp_path_factory, rows, schema, name):
    path = str(tmp_path_factory.mktemp(name) / "t.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("least", "top"), [(2, 10_000), (5, 7), (60, 100)])
def test_collocations_are_the_plain_ones(spark, spoken_rows, tmp_path_factory, least, top):
    docs = stored(spark, tmp_path_factory, [(*r, "w", 1) for r in spoken_rows], "doc_id long, lang string, text string, w string, id int", "spoken")
    found = collocations(numbered(docs, "row"), least, 5, top)
    assert sorted(map(tuple, found.collect())) == plain_collocations([r[1:] for r in spoken_rows], least, 5, top)


def test_phrases_of_pivots_dealt_over_several_buckets(spark, spoken_rows, tmp_path_factory):
    docs = numbered(stored(spark, tmp_path_factory, spoken_rows, "doc_id long, lang string, text string", "dealt"), "row")
    counts = word_counts(docs).persist()
    words = dictionary(counts, 3).persist()
    one, many, parts = ({(tuple(r.w), r.a) for r in phrases(docs, words, counts, 3, 5, split=s, most_whole=m).collect()} for s, m in ((10**9, 1 << 20), (100, 1 << 20), (100, 0)))
    assert one == many == parts and len(one) > 500  # the dictionary whole, and by part
    ids = sorted((r.id, -r.f) for r in words.collect())
    assert [i for i, _ in ids] == list(range(len(ids))) and [f for _, f in ids] == sorted(f for _, f in ids)
    counts.unpersist()
    words.unpersist()


def test_every_occurrence_of_a_phrase_is_in_one_fragment():
    rng = np.random.default_rng(1)
    ids, piece = rng.integers(-1, 6, 4000), np.sort(rng.integers(0, 300, 4000))
    plain = Counter()
    for i in range(len(ids)):
        for k in range(2, 6):
            w = ids[i : i + k]
            if len(w) == k and (w >= 0).all() and piece[i] == piece[i + k - 1]:
                plain[tuple(w.tolist())] += 1
    rows, n = unique_rows(fragments(ids, piece, 4), np.ones(len(fragments(ids, piece, 4)), np.int64))
    found = Counter()
    for k in range(2, 6):
        for w, c in zip(*own_phrases(rows, n, k), strict=True):
            found[tuple(w.tolist())] += int(c)
    assert found == plain


def test_rows_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr("quillmere.llm.collocations.mix64", lambda x: x & U64(1))
    rows = np.array([[1, 2], [3, 4], [1, 2], [5, 6], [3, 4]])
    found, n = unique_rows(rows, np.array([1, 2, 3, 4, 5]))
    assert {(tuple(r), c) for r, c in zip(found.tolist(), n.tolist(), strict=True)} == {((1, 2), 4), ((3, 4), 7), ((5, 6), 4)}


def test_a_table_that_changes_is_an_error(spark, spoken_rows, tmp_path_factory):
    docs = numbered(stored(spark, tmp_path_factory, spoken_rows, "doc_id long, lang string, text string", "before"), "row")
    other = numbered(stored(spark, tmp_path_factory, [(i, g, (t or "") + " the") for i, g, t in spoken_rows], "doc_id long, lang string, text string", "after"), "row")
    counts = word_counts(docs)
    with pytest.raises(Exception, match="not those that were counted"):
        phrases(other, dictionary(counts, 2), counts, 2, 5, most_whole=0).collect()


def test_collocations_of_nothing(empty):
    assert collocations(numbered(empty.drop("row"), "row")).collect() == []


def test_scores_beyond_64_bits(spark):
    from quillmere.llm.collocations import _score

    row = spark.createDataFrame([(10**13, 10**15, 10**13 + 3, 10**13 + 7)], "a long, n long, l long, r long").select(_score().alias("s")).first()
    assert row.s == 1000 * 10**13 * 10**15 // ((10**13 + 3) * (10**13 + 7))


# ---------------------------------------------------------------- Jaccard join


def gram_set(text, k=3):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def plain_components(sets, percent):
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j], percent):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(sets))]


def plain_jaccard(rows, percent):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [gram_set(r[1]) for r in rows]
    roots = plain_components(sets, percent)
    return Counter((r[0], len(s), rows[root][0]) for r, s, root in zip(rows, sets, roots, strict=True))


@pytest.fixture(scope="module")
def near_rows(rows):
    """The common fixture, chains of near copies, a group of copies and of near copies, and texts that share a passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [(r[0], r[1]) for r in rows]
    base = [word() for _ in range(120)]
    for i in range(40):  # each one word further
        base[rng.randrange(120)] = word()
        out.append((1000 + i, " ".join(base)))
    passage = [word() for _ in range(60)]
    for i in range(30):
        out.append((2000 + i, " ".join(passage + [word() for _ in range(rng.choice([0, 1, 2, 5, 7, 30]))])))
    for i in range(20):
        out.append((3000 + i, "Aa bb cc " * (i // 5) + "dd ee"))
    return out


@pytest.mark.parametrize("percent", [90, 60, 100])
def test_jaccard_components_match_brute_force(spark, near_rows, tmp_path_factory, percent):
    docs = stored(spark, tmp_path_factory, [(*r, "n", 1) for r in near_rows], "doc_id long, text string, copy string, id int", "near")
    found = Counter(tuple(r) for r in jaccard_components(numbered(docs, "row"), 3, percent).collect())
    assert found == plain_jaccard(near_rows, percent)
    assert len({c for _, _, c in found}) < len(found)


def test_crowded_groups_are_joined_in_blocks(spark):
    """All share their first n-gram; some are similar; groups of five at most are joined at a time."""
    rng = np.random.default_rng(4)
    sets = []
    for i in range(60):
        own = rng.integers(100, 2**40, 20)
        if i % 3 == 2:
            own = np.concatenate([sets[-1][1:-1], own[:1]])
        sets.append(np.unique(np.append(own, 7)))
    rows = [(i, len(s), bytearray(s.astype("<u8").tobytes()), [7]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, n long, grams binary, prefix array<long>").repartition(3)
    found = {r.u: r.root for r in similar_links(df, 80, most=5).collect()}
    roots = plain_components([set(s.tolist()) for s in sets], 80)
    assert [found.get(i, i) for i in range(60)] == roots and len(set(roots)) < 60


def test_ngrams_of_the_same_documents_are_one_group(spark, monkeypatch):
    """Twenty n-grams that the same three documents share are one group; one that two of them share is another."""
    import quillmere.llm.jaccard as J

    rows = [(i, 60, bytearray(np.arange(20 + 40 * i, dtype="<u8")[-60:].tobytes()), [*range(20), *([99] if i < 3 else [])]) for i in range(1, 4)]
    seen, join = [], J._links
    monkeypatch.setattr(J, "_links", lambda rows, *a: seen.append(rows.select("gram").distinct().count()) or join(rows, *a))
    df = spark.createDataFrame(rows, "id long, n long, grams binary, prefix array<long>")
    assert similar_links(df, 90).collect() == [] and seen == [1]  # a family, joined as a whole
    seen.clear()
    assert similar_links(df, 90, most=2).collect() == [] and seen == [0, 1, 2, 2]  # none is small enough, then group by group


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=14), st.sampled_from([50, 80, 90, 100]))
def test_the_trie_finds_what_is_similar(sets, percent):
    lists = [np.array(sorted(s)) for s in sets]
    trie, marks = Trie(lists, percent), np.zeros(41, bool)
    for q, s in zip(lists, sets, strict=True):
        assert sorted(trie.similar(q, marks).tolist()) == [i for i, other in enumerate(sets) if alike(s, other, percent)]
        assert not marks.any()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=14), st.data())
def test_joined_connects_what_chains_connect(sets, data):
    known = np.array(data.draw(st.lists(st.integers(0, len(sets)), min_size=len(sets), max_size=len(sets))))
    links = joined([np.array(sorted(s), np.uint64) for s in sets], known, 70)
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if known[i] == known[j]:
                up[find(i)] = find(j)
    want = up[:]
    for u, v in links.tolist():
        assert alike(sets[u], sets[v], 70)
        up[find(u)] = find(v)
    mine = [find(i) for i in range(len(sets))]
    up = want
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j], 70):
                up[find(i)] = find(j)
    best = [find(i) for i in range(len(sets))]
    assert all((mine[i] == mine[j]) == (best[i] == best[j]) for i in range(len(sets)) for j in range(i))


def test_a_dense_group_takes_few_looks(monkeypatch):
    """Two thousand near copies that all differ: the trie is asked a few times, not once each."""
    rng = np.random.default_rng(2)
    base = np.arange(10_000, 10_400)
    lists = [np.sort(np.append(np.delete(base, rng.integers(0, 400, 3)), rng.integers(0, 9000, 3))).astype(np.uint64) for _ in range(2000)]
    asked, similar = [], Trie.similar
    monkeypatch.setattr(Trie, "similar", lambda self, *a: asked.append(1) or similar(self, *a))
    assert len(joined(lists, np.arange(2000), 90)) == 1999 and len(asked) < 20


def test_bounds_of_similar_sets():
    for n in range(1, 60):
        for m in range(1, 60):
            o = needed(n, m, 90)
            assert 100 * o >= 90 * (n + m - o) and 100 * (o - 1) < 90 * (n + m - o + 1)
        assert prefix(n, 90) == n - math.ceil(0.9 * n - 1e-9) + 1


def test_documents_that_share_nothing_rare_send_nothing(spark, tmp_path_factory):
    """Only what has one of its first n-grams in common with others is sent on."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(10**6)) for _ in range(50)) + " one two three four") for i in range(40)]
    docs = numbered(stored(spark, tmp_path_factory, rows, "doc_id long, text string", "apart"), "row")
    from quillmere.llm.common import write_decisions
    from quillmere.llm.jaccard import rarity

    chosen = write_decisions(docs.selectExpr("row", "doc_id", "1 AS n"))
    assert ordered_sets(docs, chosen, rarity(docs, chosen, 3, 5), 3, 5, 90).count() == 0


def test_jaccard_of_nothing(empty):
    assert jaccard_components(numbered(empty.drop("row"), "row")).collect() == []


# ---------------------------------------------------------------- ranked search


def plain_ranked(rows, items, k=10):
    docs = [(i, Counter(TERM.findall(lower(t)))) for i, t in rows]
    n_docs, n_words = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in docs:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // n_words
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
                if score > 0:
                    scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard", [1 << 20, 300, 1])
@pytest.mark.parametrize("part", [8 << 20, 200])
def test_ranked_matches_brute_force(spark, docs, rows, shard, part):
    items = [(1, rows[0][1][:200]), (2, rows[3][1]), (2, "one"), (3, None), (4, ""), (5, "zzzz nothing like it"), (None, "One TWO three! 123"), (6, rows[7][1] + " " + rows[8][1]), (7, "ab")]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found = ranked(docs, table, 10, shard_postings=shard, part_bytes=part).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in found) == plain_ranked([(r[0], r[1]) for r in rows], items)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.randoms(use_true_random=False))
def test_a_shard_finds_the_best(docs, k, rng):
    held = [(d, t, rng.randint(1, 4)) for d in range(docs) for t in range(6) if rng.random() < 0.5]
    m = np.array([rng.randint(10, 300) for _ in range(docs)])
    doc, term, tf = (np.array([h[i] for h in held], np.int64) for i in range(3))
    shard = Shard(docs, doc, term.astype(U64), tf, m)
    weights = np.array([0, 1, 7, 7, 500, 1000])
    score = Counter()
    for d, t, n in held:
        score[d] += int(weights[t]) * (10**9 * n // (1000 * n + 8 * int(m[d])))
    best = sorted(((s, d) for d, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    assert shard.best(np.arange(6).astype(U64), weights, k) == best
    if best:
        assert shard.best(np.arange(6).astype(U64), weights, k, best[-1][0]) == best
        assert shard.best(np.arange(6).astype(U64), weights, k, best[0][0] + 1) == []


def test_a_shard_leaves_subtrees_unopened():
    """One document holds a rare term; bounds exclude nearly all others."""
    docs = 4096
    doc = np.concatenate([np.arange(docs), [1234]])
    term = np.concatenate([np.zeros(docs), [1]]).astype(U64)
    shard = Shard(docs, doc, term, np.ones(docs + 1, np.int64), np.full(docs, 100))
    assert shard.best(np.array([0, 1]).astype(U64), np.array([1, 1000]), 1)[0][1] == 1234
    assert shard.opened < 1024  # of 8191


def test_weights_of_very_long_documents_stay_exact():
    n = np.array([10, 10**9])
    assert doc_weights(n, 10**10, 10**18).tolist() == [10 + 90 * 10 * 10**10 // 10**18, 10 + 90 * 10**9 * 10**10 // 10**18]
    assert doc_weights(n[:0], 0, 0).tolist() == []


def test_ranked_of_nothing(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked(empty, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == [] and ranked(docs, none).collect() == []
