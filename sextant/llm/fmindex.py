"""A compressed FM-index over word numbers: a wavelet matrix of the Burrows-Wheeler
transform, and one of the documents in suffix order.

The text and its suffix order are dropped once the index is built: what stays is
bits, packed into words, with running counts.  Searches run backward and for many
patterns at once: one step extends every pattern that is still open by one word,
as two ranks per pattern.  The earliest document among a pattern's occurrences is
the least symbol of the document matrix in the pattern's interval.
"""

from __future__ import annotations

import numpy as np

#: Words by which suffixes are ordered.  Intervals of patterns of fewer words are right.
DEPTH = 64


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Start of each suffix in ascending order of its first ``depth`` or more words,
    by prefix doubling; suffixes that agree in these stand in order of place."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < min(depth, n):
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        held = key[order]
        new = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class _Bits:
    """A bit vector packed into 64-bit words, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in the first ``at`` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """A sequence of symbols 0 .. sigma - 1 as a bit vector per binary digit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (values >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(bits), int(len(bits) - bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places lead, following the symbol's digits."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least symbol in each interval [low, high) of one place or more."""
        value = np.zeros(len(low), np.int64)
        for shift, bits, zeros in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            down = (high - b) > (low - a)  # some place in the interval has digit zero
            value |= np.where(down, 0, 1 << shift)
            low, high = np.where(down, low - a, zeros + a), np.where(down, high - b, zeros + b)
        return value

    def nbytes(self) -> int:
        return sum(b.words.nbytes + b.before.nbytes for _, b, _ in self.levels)


class FMIndex:
    """Index of a text of word numbers from 1; 0 separates parts and ends the text.
    document: the number of the document that each word of the text is of, the
    earliest first.  depth: patterns must have fewer words."""

    def __init__(self, text: np.ndarray, document: np.ndarray | None = None, depth: int = DEPTH):
        self.size = n = len(text)
        order = suffix_order(text, depth)
        self.sigma = sigma = int(text.max()) + 1 if n else 1
        counts = np.bincount(text, minlength=sigma)
        first = np.cumsum(counts) - counts
        self.words = WaveletMatrix(text[order - 1], sigma)  # the word before each suffix
        #: Added to a walk, gives the place among the suffixes that start with the symbol.
        self.shift = first - self.words.walk(np.arange(sigma), np.zeros(sigma, np.int64))
        self.documents = None if document is None else WaveletMatrix(document[order], int(document.max()) + 1 if n else 1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a word put before each."""
        both = self.words.walk(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.concatenate([self.shift[symbol], self.shift[symbol]])
        return both[: len(symbol)], both[len(symbol) :]

    def matching(self, pattern: np.ndarray, starts: np.ndarray, length: int, alone: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the windows of ``length`` words that start at these
        places of a streamed pattern: how many of a window's last words occur in more
        than ``alone`` places of the index, and the interval of their occurrences.

        A window leaves the search as soon as the part read so far doesn't.  Words
        that the index does not know have numbers of sigma or more."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        matched = np.zeros(len(starts), np.int64)
        open_ = np.arange(len(starts))
        for k in range(length - 1, -1, -1):
            symbol = pattern[starts[open_] + k]
            known = symbol < self.sigma
            high[open_[~known]] = low[open_[~known]]
            open_, symbol = open_[known], symbol[known]
            low[open_], high[open_] = self.extend(symbol, low[open_], high[open_])
            open_ = open_[high[open_] - low[open_] > alone]
            if not len(open_):
                break
            matched[open_] = length - k
        return matched, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The earliest document among the occurrences of each interval."""
        return self.documents.least(low, high)
