"""Sets of word shingles of texts, circulant MinHash signatures of them, and exact comparison of sets."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import xxhash

from .common import mix

WORDS = 5
_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_BLOCK = 4096
_HELD = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z made a-z."""
    return text.lower().split()


class Hashes(dict):
    """64-bit hashes of words met before; the table is emptied when it holds many bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held > _HELD:
            self.clear()
            self.held = 0
        self.held += len(word) + 100
        h = self[word] = xxhash.xxh3_64_intdigest(word, 0x5EED)
        return h


_HASHES = Hashes()


def shingle_sets(docs: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the 5-word shingles of each list of words; one of fewer words, but not
    none, has one for all its words."""
    sizes = np.array([len(w) for w in docs], np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(docs)), np.uint64, int(sizes.sum()))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    rolled = np.zeros(max(len(h) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        rolled += h[j : j + len(rolled)] * _FACTORS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Numbered:
    """Shingles as numbers that stand for their words themselves: equal numbers are equal words, without hashing.

    Words, pairs of words, pairs of pairs, and these with a fifth word are numbered as they are met. A set stays
    comparable with the others of the same object.
    """

    def __init__(self) -> None:
        self.words: dict[object, int] = {}
        self.tables: list[dict[int, int]] = [{}, {}, {}]

    def __len__(self) -> int:
        return len(self.words) + sum(map(len, self.tables))

    def _number(self, level: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        table = self.tables[level]
        keys, back = np.unique((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), return_inverse=True)
        got = np.fromiter((table.setdefault(k, len(table)) for k in keys.tolist()), np.int64, len(keys))
        return got[back]

    def set_of(self, words: list[bytes]) -> np.ndarray:
        """The sorted distinct numbers of the shingles of a list of words."""
        if not words:
            return np.zeros(0, np.int64)
        if len(words) < WORDS:  # below zero, so that it meets no whole shingle
            key = (len(words), *words)
            return np.array([-1 - self.words.setdefault(key, len(self.words))], np.int64)
        w = np.fromiter((self.words.setdefault(x, len(self.words)) for x in words), np.int64, len(words))
        two = self._number(0, w[:-1], w[1:])
        four = self._number(1, two[:-2], two[2:])
        return np.unique(self._number(2, four[:-1], w[4:]))


class Circulant:
    """Signatures of k coordinates from two permutations.

    The first permutation sends a shingle to a place of 0..2**bits - 1; coordinate i is the least value of the second one,
    moved i places around, over a set's places. The values that a shingle gives to all coordinates thus stand side by
    side in one table.
    """

    def __init__(self, k: int, bits: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.mask = k, np.uint64((1 << bits) - 1)
        self.salt = rng.integers(1 << 63, dtype=np.uint64)
        order = rng.permutation(1 << bits).astype(np.uint32)
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((order, order[:k])), k)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (mix(shingles ^ self.salt) & self.mask).astype(np.int64)
        out = np.full(self.k, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(places), _BLOCK):
            np.minimum(out, self.rows[places[i : i + _BLOCK]].min(axis=0), out=out)
        return out


@lru_cache(maxsize=4)
def circulant(k: int) -> Circulant:
    return Circulant(k)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of rows coordinates; keys of different bands differ."""
    s = signature[: len(signature) // rows * rows].astype(np.uint64).reshape(-1, rows)
    key = np.arange(1, len(s) + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
    return key.view(np.int64)


def copy_digest(words: list[bytes]) -> bytes:
    """16 bytes of a cryptographic hash of a list of words: equal ones are taken for equal lists."""
    return blake2b(b" ".join(words), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    met = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * met >= percent * (len(a) + len(b) - met)
