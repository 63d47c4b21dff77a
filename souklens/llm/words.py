"""Words of byte buffers and their hashes, in numpy: a word is a run of digits, letters and bytes of non-ASCII characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # index of each row's first word, and one more entry

    def text(self, i: int) -> str:
        return self.data[self.start[i]: self.end[i]].tobytes().decode()

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word: a polynomial by prefix sums modulo 2**64, mixed."""
        power, back = np.full((2, len(self.data) + 1), _BASE)
        back[:] = _INVERSE
        power[0] = back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(back, out=back)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        return mixed((total[self.end] - total[self.start]) * back[self.start])

    def shingles(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each word on; 0 where the row ends sooner."""
        out = np.zeros(len(hashes), np.uint64)
        if len(hashes) >= n:
            h = hashes[: len(hashes) - n + 1].copy()
            for i in range(1, n):
                h = mixed(h * _BASE + hashes[i: len(hashes) - n + 1 + i])
            out[: len(h)] = np.where(self.doc[: len(h)] == self.doc[n - 1:], h, np.uint64(0))
        return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows whose bytes lie between consecutive offsets; no word crosses rows."""
    data = _LOWER[data]
    inside = _IS_WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = np.unique(offsets[1:-1])
    joined = inside & before[:-1]
    joined[edge[edge < len(data)]] = False
    start = np.flatnonzero(inside & ~joined)
    follows = np.append(joined[1:], False)
    end = np.flatnonzero(inside & ~follows) + 1
    doc = np.searchsorted(offsets[1:], start, side="right")
    return Words(data, start, end, doc, np.searchsorted(start, offsets, side="left"))
