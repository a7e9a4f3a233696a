"""Winnowed rolling hashes of texts: fingerprints that every copy of a long enough passage has too.

Of each run of ``WINDOW`` consecutive hashes of ``GRAM`` characters the smallest is kept, the leftmost of equals.  Which one that is
depends on the run alone, so two texts that share ``LEAST`` characters keep the same one there (Schleimer, Wilkerson, Aiken:
"Winnowing", 2003): a copied passage is found by an equality of hashes, and what meets is then compared itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a hash, hashes of a run, and so the characters of a passage that is surely found.
GRAM, WINDOW = 40, 41
LEAST = GRAM + WINDOW - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RUNS = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def rolling(text: str, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram`` consecutive characters: a difference of two sums of powers, shifted back."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(signs) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, back = _powers(_BASE, len(signs)), _powers(_INVERSE, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((signs + np.uint64(1)) * power)])
        return _mixed((sums[gram:] - sums[:-gram]) * back)


def winnowed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text's fingerprints, by place; a text of fewer than ``GRAM`` characters has none."""
    hashes = rolling(text or "")
    if not len(hashes):
        return hashes.view(np.int64), np.zeros(0, np.int64)
    width = min(WINDOW, len(hashes))
    runs = sliding_window_view(hashes, width)
    least = np.concatenate([runs[a : a + _RUNS].argmin(axis=1) + np.arange(a, min(a + _RUNS, len(runs))) for a in range(0, len(runs), _RUNS)])
    at = np.unique(least)
    return hashes[at].view(np.int64), at


def _each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"h": h, "at": a} for h, a in zip(*(x.tolist() for x in winnowed(t)), strict=True)])


def fingerprints(text: Column | str) -> Column:
    """The fingerprints of a text as an array of (h, at); 64-bit wrapping arithmetic over characters needs Arrow batches instead of SQL."""
    return F.pandas_udf(_each, "array<struct<h: long, at: int>>")(text)
