"""Vectorised words and word n-grams of whole batches of texts."""

from __future__ import annotations

import numpy as np

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_UNBASE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for reuse."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[int(base)] = have
    return have[:n]


class Words:
    """The words of texts (bytes): places, hashes and the text each belongs to."""

    def __init__(self, texts: list[bytes]) -> None:
        # a separator after each text ends its last word
        joined = b"\n".join(texts) + b"\n"
        self.joined = joined
        data = np.frombuffer(joined, np.uint8)
        lens = np.array([len(x) for x in texts], dtype=np.int64) + 1
        text_end = np.cumsum(lens)
        sep = _SEP[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.concatenate(([0], text_end)))  # word offsets of the texts
        self.count = np.diff(self.first)
        pieces = np.empty(len(self.start), dtype=np.uint64)
        # polynomial hashes from running sums, a block of words at a time
        for a in range(0, len(pieces), 1 << 16):
            s, e = self.start[a : a + (1 << 16)], self.end[a : a + (1 << 16)]
            lo, hi = int(s[0]), int(e[-1])
            run = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[lo:hi]] * _powers(_BASE, hi - lo), out=run[1:])
            pieces[a : a + (1 << 16)] = (run[e - lo] - run[s - lo]) * _powers(_UNBASE, hi - lo + 1)[s - lo]
        self.hash = mix(pieces + (self.end - self.start).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; meaningless within n of a text's end."""
        k = len(self.hash)
        out = np.zeros(k, dtype=np.uint64)
        step = 1 << 18
        for a in range(0, max(0, k - n + 1), step):
            h = self.hash[a : min(k, a + step + n - 1)]
            run = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * _powers(_BASE2, len(h)), out=run[1:])
            m = len(h) - n + 1
            out[a : a + m] = (run[n:] - run[:-n]) * _powers(_UNBASE2, m)
        return mix(out)

    def whole(self, n: int) -> np.ndarray:
        """True where n words of the same text begin."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))
        return left >= n
