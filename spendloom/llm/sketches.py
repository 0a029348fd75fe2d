"""Word shingles of a text and their fast similarity sketch."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

from .common import WORD

SHINGLE_WORDS = 5
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
#: Word hashes kept per worker; only affects speed.
KEPT_WORDS = 150_000
_known: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Unrelated odd factors of the words of a shingle by place.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)


def word_hashes(words: list[str]) -> np.ndarray:
    new = set(words).difference(_known)
    if len(_known) + len(new) > KEPT_WORDS:
        _known.clear()
        new = set(words)
    for w in new:
        _known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, lower-casing A-Z.

    A text with fewer words is one shingle; a text without words has none.
    """
    words = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * _FACTORS[i]
    return np.unique(mix(total + np.uint64(size)))


def set_digest(values: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()


def fast_sketch(values: np.ndarray, coordinates: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes: one 64-bit value a coordinate.

    In each of the first ``coordinates`` rounds every element falls into one random bin with the
    round and a random number as its value; a bin keeps the smallest value it gets, so earlier
    rounds win. In round ``coordinates + b`` every element falls into bin b, which therefore fills
    at the latest then. Rounds end once every bin is filled; several are thrown at a time. Two
    sets agree in a coordinate with the probability of their similarity, concentrated as if
    coordinates were independent.
    """
    t, unset = coordinates, np.iinfo(np.uint64).max
    found = np.full(t, unset, np.uint64)
    at_once = max(1, 6 * t // len(values))
    for first in range(0, t, at_once):
        rounds = np.arange(first, min(first + at_once, t), dtype=np.uint64)
        value, mixed = _throw(values, rounds)
        bins = ((mixed >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(found, bins, value)
        if found.max() != unset:
            return found
    left = np.flatnonzero(found == unset)
    value, _ = _throw(values, (left + t).astype(np.uint64))
    found[left] = value.reshape(len(left), -1).min(axis=1)
    return found


def _throw(values: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and random number of every element in each round, round by round."""
    mixed = mix((values[None, :] + ((rounds + np.uint64(1)) * np.uint64(_STEP))[:, None]).ravel())
    return np.repeat(rounds << np.uint64(48), len(values)) | (mixed & np.uint64(0xFFFFFFFFFFFF)), mixed


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` coordinates, different by band."""
    bands = sketch.reshape(-1, rows)
    total = mix(np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(_STEP))
    for i in range(rows):
        total = mix(total ^ bands[:, i]) * np.uint64(_STEP) + np.uint64(i)
    return mix(total)
