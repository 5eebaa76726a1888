"""Periodic runs of words, found on a harmonic grid.

A run of period p and length 4 p or more covers several multiples of p.  So for
each period p the places 0, p, 2 p, ... of a text are compared with the places p
further on: how far the words agree onward and backward from there (longest
common extensions) gives the stretch around them that repeats with period p.
These are n/1 + n/2 + n/3 + ... questions, each answered in constant time from a
suffix array of the words, one of the reversed words, and range minima over the
common prefixes of neighbouring suffixes.

Many texts share one array: every word is numbered within its text, so no suffix
of one text is compared with one of another.  Spark deals the texts; a task holds
some GROUP_WORDS words at a time, and more only where one text has more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import slices

#: A run has at least this many words, and this many times its period.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of the texts that share one suffix array; questions asked at a time.
GROUP_WORDS, QUESTIONS = 1 << 16, 1 << 19


class Extensions:
    """Longest common extensions of suffixes: suffix array by prefix doubling, common
    prefixes of neighbours, and a table of range minima over them.

    order: the suffixes by their first symbol; new: which places of the order begin
    another symbol.  The last symbol, and one between any two texts, must be unique.
    longest: the greatest distance of two suffixes of one text in the order.
    """

    def __init__(self, order: np.ndarray, new: np.ndarray, longest: int):
        n, order, new = len(order), order.copy(), new.copy()
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        ranks, parted = [rank], np.zeros(n, np.int8)
        open_ = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        while len(open_):  # only suffixes that still agree with another are sorted further
            at = order[open_]
            key = rank[at].astype(np.int64) << 32 | rank[at + (1 << len(ranks) - 1)]
            by_key = np.argsort(key)
            key, at = key[by_key], at[by_key]
            fresh = np.append(True, key[1:] != key[:-1])
            parted[open_[fresh & ~new[open_]]] = len(ranks)
            order[open_], new[open_] = at, fresh
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
            ranks.append(rank)
            open_ = open_[~(fresh & np.append(fresh[1:], True))]
        self.rank = rank
        common = np.zeros(n, np.int32)
        for turn in range(1, len(ranks)):  # neighbours that parted in this turn agree in 2^(turn-1) words or more, not in twice as many
            place = np.flatnonzero(parted == turn)
            a, b = order[place - 1] + (1 << turn - 1), order[place] + (1 << turn - 1)
            for level in range(turn - 2, -1, -1):
                more = (ranks[level][a] == ranks[level][b]).astype(np.int32) << level
                a, b = a + more, b + more
            common[place] = a - order[place - 1]
        self.minima, width = [common], 1
        while 2 * width <= longest:
            last = self.minima[-1]
            self.minima.append(np.append(np.minimum(last[:-width], last[width:]), last[n - width :]))
            width *= 2
        self.minima = np.concatenate(self.minima)
        self.size = n

    def ask(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in which the suffixes at a and b agree; a and b differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        row = level.astype(np.int64) * self.size
        return np.minimum(self.minima[row + low], self.minima[row + high + 1 - (1 << level)])


def _stretches(first: np.ndarray, forward: Extensions, backward: Extensions, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end, period): the stretches that repeat with a period on its grid,
    long enough for a run, each with its smallest period."""
    top = np.where(lengths >= MIN_WORDS, lengths // MIN_PERIODS, 0)
    which = np.repeat(np.arange(len(lengths)), top)
    period = np.arange(len(which)) - np.repeat(np.cumsum(top) - top, top) + 1
    asked = (lengths[which] - 1) // period
    upto = np.append(0, np.cumsum(asked))
    found = [np.zeros((0, 3), np.int64)]
    at = 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + QUESTIONS, "right")) - 1)
        p, c, base = period[at:to], asked[at:to], starts[which[at:to]]
        step = np.repeat(p, c).astype(np.int32)
        place = step.copy()
        place[upto[at:to] - upto[at]] = np.append(base[0], base[1:] - (base[:-1] + (c[:-1] - 1) * p[:-1]))
        place = np.cumsum(place, dtype=np.int32)
        agree = np.flatnonzero(first[place] == first[place + step])  # the extension of all others is zero
        a, p = place[agree], step[agree]
        end = a + p + forward.ask(a, a + p)
        begin = a - backward.ask(forward.size - a, forward.size - a - p)
        long = end - begin >= np.maximum(MIN_WORDS, MIN_PERIODS * p)
        found.append(_smallest(np.stack([begin[long], end[long], p[long]], 1).astype(np.int64)))
        at = to
    return _smallest(np.concatenate(found))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows with equal start and end the one of smallest period.  A stretch of four
    periods or more has no smaller period but divisors, and those have the same ends."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of some texts, each a list of words: rows (text, start, length, period) by
    text, start and period; which words stay, of all texts one after another; and the
    place of each text's first word among these."""
    lengths = np.array([len(t) for t in texts], np.int64)
    numbers = {w: k for k, w in enumerate(set().union(*texts), 1)}
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths + 1) - lengths  # a mark before each text, one after the last
    n = int(lengths.sum()) + len(texts) + 1
    symbols = np.zeros(n, np.int64)
    owner = np.repeat(np.arange(len(texts) + 1), np.append(lengths + 1, 1))
    marks = np.zeros(n, bool)
    marks[np.append(starts - 1, n - 1)] = True
    symbols[~marks] = words
    symbols += owner * (len(numbers) + 1)
    order = np.argsort(symbols).astype(np.int32)
    held = symbols[order]
    new = np.append(True, held[1:] != held[:-1])
    first = np.empty(n, np.int32)
    first[order] = np.cumsum(new)
    longest = int(lengths.max(initial=0)) + 1
    rows = np.zeros((0, 3), np.int64)
    if (lengths >= MIN_WORDS).any():
        rows = _stretches(first, Extensions(order, new, longest), Extensions(n - 1 - order, new, longest), starts, lengths)
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
    np.add.at(drop, rows[:, 1], -1)
    text = np.searchsorted(starts, rows[:, 0], "right") - 1
    runs = np.stack([text, rows[:, 0] - starts[text], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return runs, (np.cumsum(drop[:-1]) == 0)[~marks], np.append(0, np.cumsum(lengths))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with their words, some GROUP_WORDS words at a time."""
    for batch in slices(batches):
        texts: list[list[bytes]] = []
        at = size = 0
        for k, text in enumerate(batch.column(1).cast(pa.binary())):
            texts.append((text.as_py() or b"").split())
            size += len(texts[-1])
            if size >= GROUP_WORDS or k == batch.num_rows - 1:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = k + 1, 0, []


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row.

    Words are separated by space and U+0009 .. U+000D and compared as they are.
    runs: array of (start, length, period) of every stretch of MIN_WORDS words and
    MIN_PERIODS periods or more with its smallest period, that no neighbouring word
    extends; in order of start, then period.  collapsed: the text without the words
    that some run has after its first period, joined by one space.

    A null or empty text has no word and no run; its collapsed text is empty.  Rows
    stay as they are repeated; other columns of the input are not read.  An empty
    table gives an empty result.  A text is worked on by one task, in memory of
    about 100 to 300 bytes a word.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches):
            runs, kept, at = runs_of(texts)
            whole = np.add.reduceat(np.append(~kept, False), at[:-1]) == 0 if len(texts) else []
            left = [b" ".join(t if w or not t else compress(t, kept[a : a + len(t)].tolist())) for t, w, a in zip(texts, whole, at, strict=False)]
            bounds = pa.array(np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32))
            parts = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(run_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(bounds, parts), pa.array(left, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
