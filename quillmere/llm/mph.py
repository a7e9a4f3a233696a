"""A minimal perfect hash by levels of collision-free bits, vectorised.

Each level hashes the keys that are left to a bit array of ``GAMMA`` bits a key and sets the bits that exactly
one key hits; the others go on (Limasset et al., "Fast and scalable minimal perfect hashing for massive key
sets", 2017).  A key's value is the number of set bits before its own in all levels, so n keys get 0..n-1.  A
stored fingerprint of each slot tells foreign keys apart, but for one in 2^32.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import U64, mix64

GAMMA = 2.0


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix64(keys + U64(level + 1) * U64(0x9E3779B97F4A7C15))
    return (h % U64(bits)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ U64(0xA5A5A5A55A5A5A5A)) >> U64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], sizes: list[int]) -> None:
        """levels: the bits of each level, packed, whole words of 64; sizes: their numbers of bits."""
        self.levels, self.sizes = levels, sizes
        self.words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64) if levels else np.zeros(1, np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: unsigned 64-bit, all different."""
        if len(np.unique(keys)) != len(keys):
            raise ValueError("a key is there twice")
        levels, sizes = [], []
        left = keys
        while len(left):
            bits = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
            at = _places(left, len(levels), bits)
            hits = np.bincount(at, minlength=bits)
            levels.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            sizes.append(bits)
            left = left[hits[at] != 1]
        return cls(levels, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it (a foreign key may get another's slot)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _places(keys[left], level, bits)
            word, bit = self.base[level] + (at >> 6), (at & 63).astype(U64)
            now = self.words[word]
            hit = (now >> bit) & U64(1) == 1
            below = np.bitwise_count(now & ((U64(1) << bit) - U64(1))).astype(np.int64)
            out[left[hit]] = (self.before[word] + below)[hit]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        """The bits of each level, then every word of bits with the number of set bits before it."""
        pairs = np.stack([self.words.astype("<u8"), self.before[:-1].astype("<u8")], axis=1)
        return np.asarray(self.sizes, "<u8").tobytes() + pairs.tobytes()

    @classmethod
    def load(cls, data: bytes, levels: int) -> tuple[PerfectHash, int]:
        """The hash at the start of ``data``, and where what follows it begins."""
        sizes = np.frombuffer(data, "<u8", levels).astype(np.int64)
        counts = sizes // 64
        words = np.frombuffer(data, "<u8", 2 * int(counts.sum()), 8 * levels)[0::2].astype(np.uint64)
        return cls(np.split(words, np.cumsum(counts)[:-1]) if levels else [], sizes.tolist()), 8 * levels + 16 * len(words)

    @staticmethod
    def slot_in_file(read: Callable[[int, int], bytes], levels: int, key: np.ndarray) -> tuple[int, int]:
        """The slot of one key, and the length of the dump, by ``read(bytes, from)``: one small read a level until it is found."""
        sizes = np.frombuffer(read(8 * levels, 0), "<u8").astype(np.int64).tolist()
        first, slot = 0, -1
        for level, bits in enumerate(sizes):
            at = int(_places(key, level, bits)[0])
            word, before = (int(x) for x in np.frombuffer(read(16, 8 * levels + 16 * (first + (at >> 6))), "<u8"))
            if word >> (at & 63) & 1:
                slot = before + (word & ((1 << (at & 63)) - 1)).bit_count()
                break
            first += bits // 64
        return slot, 8 * levels + sum(sizes) // 4
