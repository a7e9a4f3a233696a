"""Vector expressions over arrays of numbers, in double precision, and the hash embedder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def hash_vector(words: list[str], dim: int = 384) -> np.ndarray:
    """Signed hashing of a bag of words: FNV-1a picks the place and, by bit 33, the sign; then length 1."""
    out = np.zeros(dim, np.float64)
    for w in words:
        h = _fnv1a(w.encode())
        out[h % dim] += -1.0 if (h >> 33) & 1 else 1.0
    n = np.linalg.norm(out)
    return (out / n if n else out).astype(np.float32)


#: Messages whose vectors are made at a time.
ROWS = 256


def _hash_vectors(words: pa.ListArray, dim: int) -> np.ndarray:
    """As :func:`hash_vector`, a row a list; a word of several lists is hashed once."""
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    hashes = np.fromiter((_fnv1a(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    at, sign = (hashes % np.uint64(dim)).astype(np.int64), np.where((hashes >> np.uint64(33)) & np.uint64(1), -1.0, 1.0)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    out = np.bincount(np.repeat(np.arange(len(words)), lengths) * dim + at[codes], sign[codes], len(words) * dim).astype(np.float64).reshape(-1, dim)  # whole numbers, if there are no words
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0).astype(np.float32)


def embed(texts: DataFrame, text: str = "content", out: str = "embedding", dim: int = 384) -> DataFrame:
    """``texts`` with a hash embedding; 64-bit wrapping products need Arrow batches instead of SQL.

    Words stay in Arrow's arrays, and the vectors of few messages are made at a time."""
    from .text import tokens

    @F.arrow_udf("array<float>")
    def run(words: pa.Array) -> pa.Array:
        made = [_hash_vectors(words.slice(i, ROWS), dim) for i in range(0, len(words), ROWS)]
        flat = np.concatenate(made).ravel() if made else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim), pa.array(flat, pa.float32()))

    return texts.withColumn(out, run(tokens(text)))
