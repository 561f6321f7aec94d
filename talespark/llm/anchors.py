"""Anchors: places that any two equal strings of a given length choose alike, found by hashes of their surroundings."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are looked at together, or one longer text. A worker keeps tables for as many.
PART = 1 << 18


@lru_cache(4)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (base, inverse))
    return up, down


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """64-bit hashes of any substrings of one byte array, in constant time each."""

    def __init__(self, data: np.ndarray, seed: int):
        # Mostly one size, so one pair of tables for each seed; those of a longer text go with it.
        kept = len(data) < PART
        self.up, down = (_powers if kept else _powers.__wrapped__)(0x5851F42D4C957F2D + 2 * seed, PART if kept else len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.add.accumulate(_table(seed)[data] * down[: len(data)])]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _scramble((self.sums[end] - self.sums[start]) * self.up[start])


    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all strings of ``width`` bytes, not scrambled."""
        with np.errstate(over="ignore"):
            out = self.sums[width:] - self.sums[:-width]
            out *= self.up[: len(out)]
        return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` neighbours from each place on; one shorter by width - 1."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places of the anchors of texts laid end to end in ``data``, and their hashes; ``ends``: where each text ends.

    A window of ``span`` bytes within a text has as anchors the places of its least ``gram``-byte hashes (by their upper 32
    bits), ties included. So equal windows have equal anchors, and every window has one. On ordinary text about 2 in
    span - gram places are anchors.
    """
    width, n = span - gram + 1, len(data)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = Hashes(data, 1).rolling(gram)
    keys = (whole >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(keys, width, np.minimum)  # one for each window start
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= span
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - span + 1, -1)
    least[np.cumsum(inside[: len(least)]) == 0] = 0
    none = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero(_sliding(np.concatenate((none, least, none)), width, np.maximum) == keys)
    return at, _scramble(whole[at])
