"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of it a logistic classifier over hashed byte n-grams of the whole text
says how surely the bit is one.  Decoding takes, for each language, the logistic loss of its codeword under all bit
scores, each bit weighted by how reliable its classifier was in training, and chooses the least (Dietterich and
Bakiri, 1995; Allwein, Schapire and Singer, 2000).  A text whose two best codewords are nearly as close is flagged
ambiguous.  Up to five languages get the exhaustive code, in which all pairs differ in more than half of the bits;
more get the best of seeded random codes.

The classifiers are fitted on a bounded sample of the labelled rows: those whose ids hash lowest, the same number of
each language, ``SAMPLE`` in all at most (so at most as many languages, the most frequent).  Only text and language of rows outside the held-out fold are read for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, pieces, release, tidy

#: Labelled rows to fit on, at most, and per language.
SAMPLE, PER_LANGUAGE = 3000, 600
HASHED = 4096
UNDETERMINED = "und"
#: Letters a to z, what is no letter (0), and every byte beyond ASCII.
_CLASS = np.zeros(256, np.int32)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x41:0x5B] = np.arange(1, 27)
_CLASS[0x80:] = np.arange(27, 155)
SIZE = 155 + HASHED


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """The features of all 1-, 2- and 3-grams that begin at each byte."""
    c = _CLASS[data]
    two = c[:-1] * 155 + c[1:]
    three = two[:-1] * 155 + c[2:]
    spread = lambda x: 155 + ((x.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int32)  # noqa: E731  12 bits
    return [c, spread(two), spread(three + 155 * 155)]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row a document: square roots of the shares of its n-grams, so of length 1 (0 for a text of no bytes)."""
    out = np.zeros((len(offsets) - 1, SIZE), np.float32)
    grams = _grams(data)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for n, g in enumerate(grams):
            if b - n > a:
                out[i] += np.bincount(g[a : b - n], minlength=SIZE)
    out[:, 0] = 0  # spaces by themselves tell nothing
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """``k`` codewords as rows of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:  # all ways to split the languages in two
        bits = [[1 if (m >> i) & 1 else -1 for i in range(k)] for m in range(1, 1 << k, 2) if m != (1 << k) - 1]
        return np.array(bits).T.astype(float)
    rng, size = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(k))))
    tries = (np.where(rng.random((k, size)) < 0.5, -1.0, 1.0) for _ in range(200))
    fine = (c for c in tries if (np.abs(c.sum(axis=0)) < k).all())
    return max(fine, key=lambda c: size - int((c @ c.T - 2 * size * np.eye(k)).max()))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features + 1 x bits
    trust: np.ndarray  # by bit

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], rounds: int = 150, ridge: float = 1e-4, rate: float = 8.0) -> Model:
        """Logistic regressions for all bits at once, by accelerated gradient descent; the last column of ``x`` is 1."""
        languages = sorted(set(labels))
        code = codewords(len(languages))
        at = {name: i for i, name in enumerate(languages)}
        y = code[[at[name] for name in labels]] if labels else np.zeros((0, code.shape[1]))
        w = np.zeros((x.shape[1], code.shape[1]), np.float32)
        if len(languages) > 1:
            y = y.astype(np.float32)
            share = np.array([labels.count(name) for name in languages], np.float32)
            each = (1 / share)[[at[name] for name in labels]][:, None] / len(languages)
            look, before = w, w
            for t in range(rounds):
                slope = -x.T @ (each * y / (1 + np.exp(np.clip(y * (x @ look), -30, 30)))) + ridge * look
                w = look - rate * slope
                look, before = w + t / (t + 3) * (w - before), w
        wrong = ((x @ w) * y <= 0).mean(axis=0) if len(languages) > 1 else np.zeros(code.shape[1])
        rate_wrong = np.clip(wrong, 1e-3, 0.499)
        trust = np.log((1 - rate_wrong) / rate_wrong)
        return cls(languages, code, w, trust / trust.sum() if len(trust) else trust)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the nearest language, its share of 1 among all (softmax of the weighted losses), and the
        lead over the second."""
        f = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([np.logaddexp(0, -f * c) @ self.trust for c in self.code], axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(share, axis=1)
        return best, share[np.arange(len(x)), best], top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from; a null id is in neither fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """The model of the labelled rows of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("lang", "doc_id", F.col("text").cast("binary").alias("text"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()
    most = max(1, min(PER_LANGUAGE, SAMPLE // max(len(counts), 1)))
    # of each language about half more rows than are wanted, by a bound on the hash of their ids; then just as many
    least = {r.lang: min(1 << 60, int((1.5 * most + 50) / r["count"] * (1 << 60))) for r in counts}
    bounds = F.broadcast(docs.sparkSession.createDataFrame(list(least.items()), "lang string, bound long"))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 60)), "doc_id")
    low = labelled.select("lang", "doc_id").join(bounds, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 60)) < F.col("bound")).select("lang", "doc_id").distinct()
    # the ids are ranked first, so that texts are read for the chosen rows alone
    chosen = low.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("lang", "doc_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            for lo, hi in pieces(offsets):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    # of rows of one id and language that with the smallest hash of its text
    one = labelled.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    rows = one.select("lang", F.col("least.text").alias("text")).mapInArrow(tidy(each), "lang string, x binary").toArrow()
    labels, packed = rows.column("lang").to_pylist(), rows.column("x").to_pylist()
    order_ = sorted(range(len(labels)), key=lambda i: (labels[i], packed[i]))  # the same model, however the rows arrive
    x = np.ones((len(labels), SIZE + 1), np.float32)
    for i, at in enumerate(order_):
        x[i, :SIZE] = np.frombuffer(packed[at], np.float16)
    del rows, packed
    model = Model.fit(x, [labels[i] for i in order_])
    release()
    return model


def _letters(text: bytes | None) -> bool:
    if not text:
        return False
    return any(0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in text[:64]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, lead) of each text of a binary column; without letters: undetermined, 0, 0."""
    data, offsets = as_bytes(texts)
    n = len(texts)
    score, lead, names = np.zeros(n), np.zeros(n), [UNDETERMINED] * n
    if model.languages:
        for lo, hi in pieces(offsets, 1 << 19):
            best, s, gap = model.decode(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            for i in range(lo, hi):
                if _letters(data[offsets[i] : offsets[i + 1]].tobytes()):
                    names[i], score[i], lead[i] = model.languages[best[i - lo]], s[i - lo], gap[i - lo]
    return names, score, lead


def identify(docs: DataFrame, ambiguous: float = 0.5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row of ``docs`` (doc_id, text, lang).

    Learns from the labelled rows outside the held-out fold.  ``und``: null and letterless texts, score 0, and every
    text where no row is labelled.  ``ambiguous``: the two best languages' shares lie less than that apart.  Repeated
    rows repeat; a null doc_id stays null, held_out false; texts of any length are read whole; of equal losses the language
    first by name wins; an empty table gives an empty one; other columns, whatever their names, are not looked at."""
    model = fit(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, lead = predict(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(lead < ambiguous)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(each), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told; null and letterless texts go.  Where nothing is labelled,
    no language can be told, and all go."""
    model, schema, at = fit(docs), docs.schema, docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _, _ = predict(b.column(at).cast(pa.binary()), model)
            yield b.filter(pa.array([n != UNDETERMINED for n in names], pa.bool_()))

    return docs.mapInArrow(tidy(each), schema)
