"""Anchors of byte strings, and maximal repeats from an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .sketches import mix

#: Positions handled at once; bounds memory for very long texts.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64."""
    out = np.ones(n, np.uint64)
    done, factor = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(factor)
        done, factor = done + take, factor * factor % 2**64
    return out


_SPAN = CHUNK + 4096
_UP, _DOWN = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 2**64), _SPAN)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes; ``data`` is no longer than a chunk and its overlap."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _DOWN[: len(sums) - size])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every window, the first of equals."""
    least, place, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        have += step
    return place


def anchored(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of the starts of strings of ``length`` bytes: first start, anchor and anchor's hash of each.

    A string's anchor is the run of ``gram`` bytes within it that has the smallest hash. It depends on
    the string alone, so equal strings have equal anchors at equal places.
    """
    starts = len(data) - length + 1
    for first in range(0, max(starts, 0), CHUNK):
        part = data[first : min(first + CHUNK + length - 1, len(data))]
        hashes = gram_hashes(part, gram)
        place = window_minima(hashes, length - gram + 1)
        yield first, place.astype(np.int64) + first, hashes[place].view(np.int64)


@dataclass(frozen=True)
class Repeat:
    """A string of ``length`` bytes that no common character extends, and all its occurrences."""

    length: int
    occurrences: list[int]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    if len(keys) == 2:
        return np.unique((keys[0].astype(np.uint64) << np.uint64(32)) | keys[1].astype(np.uint64), return_inverse=True)[1].astype(np.uint32)
    return np.unique(keys[0], return_inverse=True)[1].astype(np.uint32)


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([ranks[by:], np.zeros(min(by, len(ranks)), ranks.dtype)])


def _prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all positions by their first ``length`` bytes, by doubling; past the end counts as zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(data)]
    by_size = {8: _ranks(words)}
    while max(by_size) * 2 <= length:
        size = max(by_size)
        by_size[2 * size] = _ranks(by_size[size], _shifted(by_size[size], size))
    size = max(by_size)
    # two overlapping runs cover the length exactly and sort as it does, as the first decides before the overlap
    return by_size[size] if size == length else _ranks(by_size[size], _shifted(by_size[size], length - size))


def maximal_repeats(segments: list[bytes], length: int) -> tuple[list[Repeat], np.ndarray, np.ndarray]:
    """Maximal repeats of at least ``length`` bytes within ``segments``, and the segments' starts and ends
    in the joined string in which occurrences are counted.

    Suffixes are sorted by their first ``length`` bytes. Runs that share them and whose occurrences
    all follow one and the same byte are left out, for they are part of a longer repeat. The others are
    sorted to the segments' ends; a scan of their common prefixes with a stack visits every interval of
    the prefix tree, and those with diverse left bytes are the repeats. What stands before or behind a
    segment counts as different everywhere.
    """
    joined = b"".join(segments)
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(joined, np.uint8)
    starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)] or [np.empty(0, int)])
    if len(starts) < 2:
        return [], begins, ends
    rank = _prefix_ranks(data, length)[starts]
    order = np.argsort(rank, kind="stable")
    rank, places = rank[order], starts[order]
    edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1], [True]]))
    at_begin = np.isin(places, begins)
    left = np.where(at_begin, -1 - np.arange(len(places)), data[places - 1].astype(np.int64))
    differs = np.concatenate([[False], left[1:] != left[:-1]])
    differs[edge[:-1]] = False
    several = np.diff(edge) > 1
    diverse = np.add.reduceat(differs, edge[:-1]) > 0
    found: list[Repeat] = []
    for a, b in zip(edge[:-1][several & diverse].tolist(), edge[1:][several & diverse].tolist(), strict=True):
        stops = ends[np.searchsorted(ends, places[a:b], side="right")]
        members = sorted((joined[p:e], p, before) for p, e, before in zip(places[a:b].tolist(), stops.tolist(), left[a:b].tolist(), strict=True))
        found += _interval_repeats(members, length)
    return found, begins, ends


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = known, n
    while low < high:  # x[:low] equal, x[:high + 1] differs
        middle = (low + high + 1) // 2
        if x[known:middle] == y[known:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _interval_repeats(members: list[tuple[bytes, int, int]], length: int) -> list[Repeat]:
    """Left-diverse intervals of sorted suffixes (text, place, left byte) that share ``length`` bytes."""
    found: list[Repeat] = []
    # open intervals: common length, first member, left byte if it is the same everywhere, else None
    stack: list[list] = []
    for i in range(1, len(members) + 1):
        common = _common(members[i - 1][0], members[i][0], length) if i < len(members) else -1
        first, before = i - 1, members[i - 1][2]
        while stack and stack[-1][0] > common:
            size, first, lefts = stack.pop()
            lefts = lefts if lefts == before else None
            if lefts is None and i - first > 1:
                found.append(Repeat(size, [m[1] for m in members[first:i]]))
            before = lefts
        if common < 0:
            break
        if not stack or stack[-1][0] < common:
            stack.append([common, first, before])
        elif stack[-1][2] != before:
            stack[-1][2] = None
    return found
