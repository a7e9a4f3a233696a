"""Language-model scores: masked pseudo-likelihood under a bidirectional window network.

A token is a word, A-Z in lower case.  The network sees the classes of the two tokens before and the two after a position and
predicts the token in it.  The most frequent words, about as many as the square root of the number of different words, are
classes of their own and are predicted themselves, in two steps: their cluster, then the word in it.  All other words are
predicted as one of 32 classes by their last two bytes, and in its class a word has its share of the corpus, from exact counts
of every word there is.  So

    log p(token | both sides) = log p(cluster) + log p(word | cluster),  or  log p(class) + log (count of the word / of the class)

is a distribution over all words of the corpus, and a document's score is the sum over all its tokens.

Everything is gathered from all documents and grows with them.  Words are counted in a distributed table; each part of the
scan gets the counts of its own words as a file in the shared folder.  Documents become sequences of classes, two bytes a
token, which are dealt by a hash into parts that hang on the number of tokens alone.  Every position of every document trains:
in each part a network descends over the part's documents in a fixed order, all starting from the network that the first part
gave, and the networks meet in their mean, weighted by tokens.  The scores are thus the same however the table is laid out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_binary, as_bytes, filesystem, fresh_dir, numbered, pieces, stash, tidy, word_hashes, word_spans

#: Classes of the words that are not frequent, and the most words that are (classes have 16 bits).
GROUPS, MOST_FREQUENT = 32, 60_000
SIDE, WIDTH, HIDDEN = 2, 8, 20
#: Positions in a step, and in a block, which is shuffled and whose words within clusters are learned at once; the rate of descent.
STEP, BLOCK, RATE = 1024, 16_384, 0.7
#: Tokens of a part, about, and the most parts, beyond which parts grow; different words that a task holds before it passes them on.
PART_TOKENS, MOST_PARTS, HELD = 2_000_000, 20_000, 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash and the group of every word, and n + 1 positions of each document's first among them."""
    low = _LOWER[data]
    starts, ends, firsts = word_spans(low, offsets, SPACE)
    last = low[ends - 1].astype(np.int64)
    second = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return word_hashes(low, starts, ends).view(np.int64), ((last * 31 + second) % GROUPS).astype(np.int8), firsts


@dataclass
class Lexicon:
    """The frequent words by their hashes, in the order of their classes, and the token counts of these and of the groups."""

    frequent: np.ndarray
    counts: np.ndarray
    groups: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.frequent, kind="stable")
        self.sorted = self.frequent[self.order]
        self.k = len(self.frequent)
        self.outside = self.k + GROUPS
        self.clusters = int(np.ceil(self.k**0.5))
        self.size = -(-self.k // self.clusters) if self.k else 1

    def classes(self, hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        out = self.k + groups.astype(np.int64)
        if self.k:
            at = np.minimum(np.searchsorted(self.sorted, hashes), self.k - 1)
            out = np.where(self.sorted[at] == hashes, self.order[at], out)
        return out


@dataclass
class Network:
    embed: np.ndarray  # 2 SIDE x classes x WIDTH: a table for each place
    hidden: np.ndarray  # 2 SIDE WIDTH x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN x (clusters + GROUPS)
    out_bias: np.ndarray
    inner: np.ndarray  # clusters x HIDDEN x words of a cluster
    inner_bias: np.ndarray

    @classmethod
    def start(cls, lexicon: Lexicon, seed: int = 11) -> Network:
        """What has not been seen has a bias so low that its probability is 0."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        words = np.zeros(lexicon.clusters * lexicon.size)
        words[: lexicon.k] = lexicon.counts
        words = words.reshape(lexicon.clusters, lexicon.size)
        with np.errstate(divide="ignore"):
            first, inner = (np.maximum(np.log(x), -1e4).astype(np.float32) for x in (np.concatenate([words.sum(axis=1), lexicon.groups]), words))
        first -= first.max(initial=-1e4)
        return cls(
            draw(2 * SIDE, lexicon.outside + 1, WIDTH, scale=0.3), draw(2 * SIDE * WIDTH, HIDDEN, scale=0.15), np.zeros(HIDDEN, np.float32), draw(HIDDEN, len(first), scale=0.05), first,
            np.zeros((lexicon.clusters, HIDDEN, lexicon.size), np.float32), inner,
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.hidden_bias, self.out, self.out_bias, self.inner, self.inner_bias]

    def dump(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.parts())

    def load(self, data: bytes) -> Network:
        """A network of this one's shape."""
        flat, at, out = np.frombuffer(data, "<f4"), 0, []
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inputs, the hidden layer, and the logarithms of all clusters and groups."""
        x = np.concatenate([self.embed[p][around[:, p]] for p in range(2 * SIDE)], axis=1)
        h = np.tanh(x @ self.hidden + self.hidden_bias)
        return x, h, _normalised(h @ self.out + self.out_bias)

    def first(self, target: np.ndarray) -> np.ndarray:
        """The cluster, or group, of each class."""
        clusters, size = self.inner_bias.shape
        k = self.embed.shape[1] - 1 - GROUPS
        return np.where(target < k, target // size, target - k + clusters)

    def clustered(self, target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cluster, positions) of all targets that are in one."""
        first = self.first(target)
        order = np.argsort(first, kind="stable")
        cut = np.searchsorted(first[order], np.arange(len(self.inner) + 1))
        for c in np.flatnonzero(np.diff(cut)).tolist():
            yield c, order[cut[c] : cut[c + 1]]

    def log_p(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The logarithm of the probability of each position's word, if that is frequent, else of its group."""
        _, h, z = self.forward(around)
        out = z[np.arange(len(z)), self.first(target)].astype(np.float64)
        for c, at in self.clustered(target):
            out[at] += _normalised(h[at] @ self.inner[c] + self.inner_bias[c])[np.arange(len(at)), target[at] % self.inner.shape[2]]
        return out

    def step(self, around: np.ndarray, target: np.ndarray, rate: float) -> np.ndarray:
        """One step of descent on the mean loss of clusters and groups; the hidden layer before it."""
        x, h, z = self.forward(around)
        p = np.exp(z)
        p[np.arange(len(p)), self.first(target)] -= 1
        p *= rate / len(p)
        back = (p @ self.out.T) * (1 - h * h)
        into = (back @ self.hidden.T).reshape(len(x), 2 * SIDE, WIDTH)
        self.out -= h.T @ p
        self.out_bias -= p.sum(axis=0)
        self.hidden -= x.T @ back
        self.hidden_bias -= back.sum(axis=0)
        place = around * WIDTH + np.arange(2 * SIDE) * (self.embed.shape[1] * WIDTH)
        np.subtract.at(self.embed.reshape(-1), (place[:, :, None] + np.arange(WIDTH)).ravel(), into.ravel())
        return h

    def learn(self, around: np.ndarray, target: np.ndarray, seed: int) -> None:
        """A block: steps over its positions in a shuffled order, then one step of each cluster's words on the hidden layers
        that these had, on the mean loss of the cluster."""
        order = np.random.default_rng([seed, len(target)]).permutation(len(target))
        around, target = around[order], target[order]
        hidden = np.concatenate([self.step(around[a : a + STEP], target[a : a + STEP], RATE * len(target[a : a + STEP]) / STEP) for a in range(0, len(target), STEP)])
        for c, at in self.clustered(target):
            h = hidden[at]
            p = np.exp(_normalised(h @ self.inner[c] + self.inner_bias[c]))
            p[np.arange(len(p)), target[at] % self.inner.shape[2]] -= 1
            p *= RATE / max(len(p), 64)
            self.inner[c] -= h.T @ p
            self.inner_bias[c] -= p.sum(axis=0)


def _normalised(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def contexts(classes: np.ndarray, firsts: np.ndarray, outside: int) -> np.ndarray:
    """The classes around every position, ``SIDE`` before and after, within the position's document."""
    n = len(classes)
    padded = np.concatenate([np.full(SIDE, outside), classes, np.full(SIDE, outside)])
    out = np.stack([padded[SIDE + step : SIDE + step + n] for step in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)
    lengths = np.diff(firsts)
    place = np.arange(n) - np.repeat(firsts[:-1], lengths)
    left = np.repeat(lengths, lengths) - 1 - place
    for i, step in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        out[(place < -step) if step < 0 else (left < step), i] = outside
    return out


def _unique(h: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, first = np.unique(h[order], return_index=True)
    return h, g[order][first], np.add.reduceat(n[order], first) if len(h) else n[:0]


def words_of_parts(rows: DataFrame) -> DataFrame:
    """(part, h, g, n): the different words of each partition of ``rows`` (row, doc_id, text binary) and how often they occur."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0

        def full() -> pa.RecordBatch:
            h, g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            h, g, n = _unique(h, g, n)
            held[:] = [(h, g, n)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), part, np.int32)), pa.array(h), pa.array(g), pa.array(n)], ["part", "h", "g", "n"])

        for b in batches:
            data, offsets = as_bytes(b.column(2))
            for lo, hi in pieces(offsets, 4 << 20):
                h, g, _ = tokens_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                held.append(_unique(h, g, np.ones(len(h), np.int64)))
                size += len(held[-1][0])
                if size > 2 * HELD:
                    made = full()
                    size = len(held[0][0])
                    if size > HELD:
                        yield made
                        held, size = [], 0
        if held:
            yield full()

    return rows.mapInArrow(tidy(each), "part int, h long, g byte, n long")


def write_counts(words: DataFrame, counts: DataFrame, least: int) -> str:
    """A folder with a file for each part: the hashes of its words that occur less than ``least`` times in all, sorted, and these
    numbers."""
    folder = fresh_dir(words.sparkSession, "counts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, held = None, []

        def close() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            temp = f"{base}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temp, compression=None) as out:
                out.write(h.astype("<i8").tobytes())
                out.write(n.astype("<i8").tobytes())
            fs.move(temp, f"{base}/{part}.words")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(h)])], ["part", "words"])

        for b in batches:
            parts, h, n = (c.to_numpy() for c in b.columns)
            for p in np.unique(parts).tolist():
                if part is not None and p != part:
                    yield close()
                    held = []
                part = p
                held.append((h[parts == p], n[parts == p]))
        if held:
            yield close()

    rare = counts.where(F.col("n") < least).select("h", "n")
    found = words.select("part", "h").join(rare, "h").select("part", "h", "n").repartition("part").sortWithinPartitions("part", "h")
    stash(found.mapInArrow(tidy(each), "part int, words long"), "written")
    return folder


def sequences(rows: DataFrame, lexicon: Lexicon, folder: str) -> DataFrame:
    """(doc_id, n, rest, seq): the classes of each row's words, 16 bits each, and the sum of the log shares that words which are
    not frequent have in their groups."""
    with np.errstate(divide="ignore"):
        whole = np.log(lexicon.groups.astype(float))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        path = f"{base}/{TaskContext.get().partitionId()}.words"
        h = n = np.zeros(0, np.int64)
        if fs.get_file_info(path).type == pafs.FileType.File:
            with fs.open_input_stream(path, compression=None) as f:
                h, n = np.frombuffer(f.read(), "<i8").reshape(2, -1)
        for b in batches:
            data, offsets = as_bytes(b.column(2))
            for lo, hi in pieces(offsets, 4 << 20):
                hashes, groups, firsts = tokens_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                mine, back = np.unique(hashes, return_inverse=True)
                group = np.zeros(len(mine), np.int64)
                group[back] = groups
                cls, rest = lexicon.classes(mine, group), np.zeros(len(mine))
                rare = cls >= lexicon.k
                at = np.minimum(np.searchsorted(h, mine[rare]), max(len(h) - 1, 0))
                if rare.any() and (not len(h) or (h[at] != mine[rare]).any()):
                    raise ValueError("a part has other words than when they were counted: the table or its split has changed")
                if rare.any():
                    rest[rare] = np.log(n[at]) - whole[group[rare]]
                total = np.concatenate([[0], np.cumsum(rest[back])])
                seq = cls[back].astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(lo, hi - lo), pa.array(np.diff(firsts)), pa.array(total[firsts[1:]] - total[firsts[:-1]]), pa.array([seq[x:y].tobytes() for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)], pa.binary())],
                    ["doc_id", "n", "rest", "seq"],
                )

    return rows.mapInArrow(tidy(each), "doc_id long, n long, rest double, seq binary")


def _batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = as_bytes(column)
    return np.frombuffer(data.tobytes(), "<u2").astype(np.int64), offsets // 2


def train(dealt: DataFrame, lexicon: Lexicon, network: Network) -> Network:
    """The mean of the networks that descend from ``network`` over each part of ``dealt`` (part, seq), whose partitions are
    sorted."""
    schema = "part int, seen long, network binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mine, held, size, seen = None, network, [], 0, 0

        def learn(n: int) -> None:
            nonlocal held, size, seen
            around, target = (np.concatenate(x) for x in zip(*held, strict=True))
            for a in range(0, n, BLOCK):
                mine.learn(around[a : min(a + BLOCK, n)], target[a : min(a + BLOCK, n)], seen)
                seen += min(BLOCK, n - a)
            held, size = [(around[n:], target[n:])], len(target) - n

        def close() -> pa.RecordBatch:
            if size:
                learn(size)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen]), pa.array([mine.dump()], pa.binary())], ["part", "seen", "network"])

        for b in batches:
            parts = b.column(0).to_numpy()
            for p in np.unique(parts).tolist():
                if p != part:
                    if part is not None:
                        yield close()
                    part, mine, held, size, seen = p, network.load(network.dump()), [], 0, 0
                rows = np.flatnonzero(parts == p)
                seq, firsts = _batch(b.column(1).slice(int(rows[0]), len(rows)))
                held.append((contexts(seq, firsts, lexicon.outside), seq))
                size += len(seq)
                if size >= BLOCK:
                    learn(size // BLOCK * BLOCK)
        if part is not None:
            yield close()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, part = 0.0, 0, 0
        for b in batches:
            for part, n, w in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007
                total = total + np.frombuffer(w, "<f4") * float(n)
                seen += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen]), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], ["part", "seen", "network"])

    # means of sixty-four runs of parts first, as a stream, in a fixed order: no task holds more than one network and one sum
    made = dealt.select("part", "seq").mapInArrow(tidy(each), schema)
    runs = made.repartition(64, F.pmod("part", F.lit(64))).sortWithinPartitions("part").mapInArrow(mean, schema)
    found = runs.repartition(1).sortWithinPartitions("part").mapInArrow(mean, schema).collect()
    return network.load(bytes(found[0].network)) if found else network


def fit(rows: DataFrame, part_tokens: int = PART_TOKENS) -> tuple[Lexicon, Network, DataFrame]:
    """The lexicon, the network and the sequences of ``rows`` (row, doc_id, text binary), whose scan is :func:`numbered`."""
    words = stash(words_of_parts(rows), "words")
    counts = stash(words.groupBy("h").agg(F.min("g").alias("g"), F.sum("n").alias("n")), "lexicon")
    total = counts.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    k = min(MOST_FREQUENT, int(np.ceil(total.words**0.5)))
    top = counts.orderBy(F.desc("n"), "h").limit(k).collect()  # bounded: 60,000 numbers
    # words as frequent as the last of these stay below or above it by their hash; their counts are written with the others
    groups = np.zeros(GROUPS, np.int64)
    for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect():
        groups[r.g] = r.n
    for r in top:
        groups[r.g] -= r.n
    lexicon = Lexicon(np.array([r.h for r in top], np.int64), np.array([r.n for r in top], np.int64), groups)
    seqs = stash(sequences(rows, lexicon, write_counts(words, counts, (top[-1].n if top else 0) + 1)), "sequences")
    network = Network.start(lexicon)
    parts = max(1, min(MOST_PARTS, -(-(total.tokens or 0) // part_tokens)))
    part = F.pmod(F.xxhash64("doc_id", "seq"), F.lit(parts)).cast("int")
    dealt = seqs.where("n > 0").select(part.alias("part"), "doc_id", "seq")
    order = ["part", F.col("doc_id").asc_nulls_first(), F.xxhash64("seq")]
    if parts > 1:  # all parts start from what the first gives
        network = train(dealt.where("part = 0").repartition(1).sortWithinPartitions(*order), lexicon, network)
    return lexicon, train(dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(*order), lexicon, network), seqs


def score(docs: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, pll, mean_pll) of every row of ``docs`` (doc_id, text; other columns are not looked at).

    pll is the sum of the log probabilities of all tokens given both sides, mean_pll by token.  Null and empty texts
    have no tokens: pll 0, mean_pll null.  Repeated rows repeat and count as often; a null doc_id stays null; words of equal
    count are in the order of their hashes; texts of any length train and are scored whole; an empty table gives an empty
    one.  ``docs`` must be a stored table or one that comes out the same each time."""
    row = f"row_{uuid.uuid4().hex}"
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_binary("text")), row).select(row, "doc_id", "text")
    lexicon, network, seqs = fit(rows, part_tokens)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, firsts = _batch(b.column(3))
            around = contexts(seq, firsts, lexicon.outside)
            logs = np.zeros(len(seq) + 1)
            for a in range(0, len(seq), BLOCK):
                logs[a + 1 : a + 1 + BLOCK] = network.log_p(around[a : a + BLOCK], seq[a : a + BLOCK])
            total = np.cumsum(logs)
            n = b.column(1).to_numpy()
            pll = total[firsts[1:]] - total[firsts[:-1]] + b.column(2).to_numpy()
            mean = np.divide(pll, n, out=np.zeros(len(n)), where=n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pll), pa.array(mean, mask=n == 0)], ["doc_id", "n_tokens", "pll", "mean_pll"])

    return seqs.mapInArrow(tidy(each), "doc_id long, n_tokens long, pll double, mean_pll double")
