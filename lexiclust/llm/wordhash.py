"""Words of many texts at once: boundaries and 64-bit hashes as numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64."""
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """``data``: the texts' bytes, each closed by a space. Word ``i`` is
    ``data[begin[i]:end[i]]``; text ``d`` owns words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return self.end - self.begin

    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of all word bytes, each one's place in its word, and
        where each word begins in these arrays."""
        sizes = self.lengths
        at = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
        return place + np.repeat(self.begin, sizes), place, at

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.begin):
            return np.empty(0, dtype=np.uint64)
        where, place, at = self.letters()
        weight = powers(int(self.lengths.max()))
        return mix(np.add.reduceat((self.data[where].astype(np.uint64) + np.uint64(1))
                                   * weight[place], at))


def segment(texts: list[bytes], separators: np.ndarray = SPACES) -> Words:
    """Words of all texts: runs of bytes that are no separators. The space
    must be one, as it closes every text."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = np.concatenate([[False], ~separators[data]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin = edge[0::2]
    end = edge[1::2] if len(edge) % 2 == 0 else np.append(edge[1::2], len(data))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return Words(data, begin, end, np.searchsorted(begin, bounds))


def shingle_hashes(words: Words, size: int) -> list[np.ndarray]:
    """For each text the hashes of its ``size``-word shingles in order; with
    fewer words the whole sequence is one; without words none."""
    h = words.hashes()
    weight = powers(size + 1)
    rolled = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        rolled += h[j:j + len(rolled)] * weight[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(rolled[a:b - size + 1])
        elif b > a:  # shorter: the length keeps it apart from full shingles
            short = (h[a:b] * weight[:b - a]).sum(dtype=np.uint64)
            out.append(mix(weight[size:] * np.uint64(b - a) ^ short))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
