"""Texts of a batch as one numpy array of code points, with words and hashes computed without a loop over texts.

Folding: a code point's entry in the fold table is its lower-case letter or digit, or 0 for anything to skip. A word is
a maximal run of entries other than 0 within one text. Null texts count as empty.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U64 = np.uint64
#: Odd multipliers of the polynomial and mixing hashes.
BASE_1, BASE_2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
TABLE_END, LETTERS_END = 0x20000, 0x32400


@cache
def fold_table() -> np.ndarray:
    """Made by rule from Python's Unicode tables; ideographs beyond the table fold to themselves."""
    out = np.zeros(TABLE_END, np.uint32)
    for c in range(TABLE_END):
        ch = chr(c)
        if ch.isalnum():
            out[c] = next((ord(x) for x in ch.lower() if x.isalnum()), 0)
    return out


def fold(codes: np.ndarray) -> np.ndarray:
    table = fold_table()
    if codes.size and codes.max() >= TABLE_END:
        high = codes >= TABLE_END
        out = table[np.where(high, 0, codes)]
        return np.where(high & (codes < LETTERS_END), codes, out)
    return table[codes]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


def powers(base: U64, n: int) -> np.ndarray:
    return _powers(int(base), 1 << max(n, 1).bit_length())


class Codes:
    """codes of all texts in a row; text i is codes[start[i]:start[i + 1]]."""

    def __init__(self, texts: list):
        texts = [t or "" for t in texts]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate(([0], np.cumsum(n)))
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(texts)

    def of(self) -> np.ndarray:
        """For each code point the number of its text."""
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.start))


class Words:
    """Words of a batch: hash, and first and last code point of each; word j of text i lies in first[i] <= j < first[i+1]."""

    def __init__(self, c: Codes):
        kept = fold(c.codes)
        on = kept != 0
        if not on.any():
            self.hash = np.empty(0, U64)
            self.begin = self.end = np.empty(0, np.int64)
            self.first = np.zeros(c.n + 1, np.int64)
            return
        starts = on.copy()
        starts[1:] &= ~on[:-1]
        heads = c.start[:-1][c.start[:-1] < len(on)]
        starts[heads] = on[heads]
        self.begin = np.flatnonzero(starts)
        at = np.flatnonzero(on)
        word = np.flatnonzero(starts[at])  # where each word begins among the kept code points
        size = np.diff(np.append(word, len(at)))
        self.end = at[word + size - 1] + 1
        place = np.arange(len(at)) - np.repeat(word, size)
        term = kept[at].astype(U64) * powers(BASE_1, int(size.max()) + 1)[place]
        self.hash = mix(np.add.reduceat(term, word) + size.astype(U64) * BASE_2)
        self.first = np.searchsorted(self.begin, c.start)

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of its first word) of each run of n words within one text."""
        k = len(self.hash) - n + 1
        if k <= 0:
            return np.empty(0, U64), np.empty(0, np.int64)
        # a rolling polynomial by doubling: runs of 1, 2, 4, ... words, put together to n
        total = np.zeros(k, U64)
        block, width, done = self.hash, 1, 0
        base = powers(BASE_2, n + 1)
        while width <= n:
            if n & width:
                total += block[done : done + k] * base[done]
                done += width
            if width * 2 <= n:
                block = block[:-width] + block[width:] * base[width]
            width *= 2
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.flatnonzero(text[:k] == text[n - 1 :])
        return mix(total[at] + U64(seed)), at
