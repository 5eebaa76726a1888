"""Token counts of a piece vocabulary, by rank-synchronous merging of arrays.

Byte-pair merging never joins two pieces across a space, so a text falls into
pre-tokens that merge independently.  A batch's pre-tokens are held as one
ragged array of symbols; in each round every pre-token applies its one
lowest-ranked, leftmost pair, all pre-tokens at once, until none has a pair
left.  The symbols that survive are counted: one token each, or one per byte
for a character outside the vocabulary.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import slices

MARK = "▁"
#: Symbols of the pre-tokens that one call of the merge loop works on.
CHUNK_SYMBOLS = 200_000
#: Pre-tokens longer than this merge alone, all occurrences of a pair at a time.
LONG = 2_000
#: Counts held per process: two generations of at most this many pre-tokens.
CACHED = 200_000
_NONE = np.int64(2**62)
_PRE_TOKENS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Vocabulary:
    """Pieces, their ranks, and the pairs of pieces that merge into a piece.

    A symbol below ``size`` is a piece; ``size + n`` is a character of n UTF-8
    bytes outside the vocabulary.  Pairs are kept in an open-addressed table.
    """

    def __init__(self, pieces: dict[str, float]):
        self.ids = {p: k for k, p in enumerate(pieces)}
        self.size = len(self.ids)
        order = sorted(pieces, key=lambda p: -pieces[p])
        rank = np.empty(max(1, self.size), np.int64)
        rank[[self.ids[p] for p in order]] = np.arange(len(order))
        if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p) for p in pieces):
            raise ValueError("a piece joins words or lines: pre-tokens of this vocabulary are not independent")
        keys, new = [], []
        self.bigrams = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        for p in pieces:
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.stride + b)
                    new.append(self.ids[p])
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_new = np.zeros(self.mask + 1, np.int64)
        for key, n in zip(keys, new, strict=True):
            at = self._home(np.int64(key))
            while self.slot_key[at] >= 0:
                at = (at + 1) & self.mask
            self.slot_key[at], self.slot_new[at] = key, n
        self.rank = rank

    @property
    def stride(self) -> int:
        return self.size + 8

    def _home(self, key):
        with np.errstate(over="ignore"):
            return ((key * np.int64(-7046029254386353131)) >> np.int64(20)) & self.mask

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged piece of each pair of symbols."""
        key = a * self.stride + b
        at = self._home(key)
        held = self.slot_key[at]
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held[open_] = self.slot_key[at[open_]]
            open_ = open_[(held[open_] != key[open_]) & (held[open_] >= 0)]
        new = self.slot_new[at]
        return np.where(held == key, self.rank[new], _NONE), new

    def symbols(self, text: str) -> list[int]:
        get, size = self.ids.get, self.size
        return [get(c) if c in self.ids else size + len(c.encode("utf-8", "replace")) for c in text]

    def tokens(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each surviving symbol stands for."""
        return np.where(symbols < self.size, 1, symbols - self.size)

    def cut(self, word: str) -> list[str]:
        """Parts of a word that never merge: two characters that stand side by
        side in no piece are never inside one symbol."""
        ends = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.bigrams]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True)]


def merge_counts(vocabulary: Vocabulary, words: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    out = np.zeros(len(words), np.int64)
    short: list[tuple[int, list[int]]] = []
    for k, word in enumerate(words):
        if len(word) <= LONG:
            short.append((k, vocabulary.symbols(word)))
        else:
            for part in vocabulary.cut(word):
                if len(part) <= LONG:
                    short.append((k, vocabulary.symbols(part)))
                else:
                    out[k] += _merge_one(vocabulary, np.array(vocabulary.symbols(part), np.int64))
    short.sort(key=lambda x: len(x[1]))  # equal lengths end together
    at = 0
    while at < len(short):
        end, total = at, 0
        while end < len(short) and (end == at or total + len(short[end][1]) <= CHUNK_SYMBOLS):
            total += len(short[end][1])
            end += 1
        owners = np.array([k for k, _ in short[at:end]], np.int64)
        np.add.at(out, owners, _merge_ragged(vocabulary, [s for _, s in short[at:end]]))
        at = end
    return out.tolist()


def _merge_ragged(v: Vocabulary, sequences: list[list[int]]) -> np.ndarray:
    """Rounds over many sequences: each applies its lowest-ranked leftmost pair.

    key[i] holds rank and position of the pair that starts at symbol i, so the
    minimum over a sequence is its next merge.  A merged symbol stays at its
    left position; the right one's key is closed and the links step over it.
    """
    lengths = np.array([len(s) for s in sequences], np.int64)
    counts = np.zeros(len(sequences), np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return counts
    starts = (np.cumsum(lengths) - lengths)[full]
    symbol = np.fromiter((x for s in sequences for x in s), np.int64, int(lengths.sum()))
    n = len(symbol)
    owner = np.repeat(np.arange(len(full)), lengths[full])
    place = np.arange(n, dtype=np.int64)
    after, before = place + 1, place - 1
    last = np.ones(n, bool)
    last[:-1] = owner[1:] != owner[:-1]
    after[last], before[starts] = n, n  # n: no neighbour
    rank, new = v.pairs(symbol, symbol[np.minimum(after, n - 1)])
    rank[last] = _NONE
    key = np.where(rank < _NONE, (rank << np.int64(32)) | place, _NONE)
    alive = np.ones(n, bool)
    while True:
        low = np.minimum.reduceat(key, starts)
        left = low[low < _NONE] & np.int64(0xFFFFFFFF)
        if not len(left):
            break
        right = after[left]
        symbol[left] = new[left]
        alive[right] = False
        key[right] = _NONE
        beyond = after[right]
        after[left] = beyond
        inner = beyond < n
        before[beyond[inner]] = left[inner]
        prior = before[left]
        start = np.concatenate([left[inner], prior[prior < n]])
        end = np.concatenate([beyond[inner], left[prior < n]])
        key[left] = _NONE
        r, new[start] = v.pairs(symbol[start], symbol[end])
        key[start] = np.where(r < _NONE, (r << np.int64(32)) | start, _NONE)
    counts[full] = np.add.reduceat(np.where(alive, v.tokens(symbol), 0), starts)
    return counts


def _merge_one(v: Vocabulary, symbol: np.ndarray) -> int:
    """One long sequence: all occurrences of the lowest-ranked pair at a time,
    up to the first whose result forms a pair of lower rank, which goes first."""
    while len(symbol) > 1:
        rank, new = v.pairs(symbol[:-1], symbol[1:])
        low = rank.min()
        if low >= _NONE:
            break
        at = np.flatnonzero(rank == low)
        run = np.cumsum(np.concatenate([[True], np.diff(at) != 1]))
        first = np.concatenate([[True], run[1:] != run[:-1]])
        at = at[((at - np.repeat(at[first], np.bincount(run)[1:])) % 2) == 0]  # of overlapping ones every other
        merged = new[at[0]]
        left = np.where(at > 0, symbol[np.maximum(at - 1, 0)], -1)
        left[1:][at[1:] - at[:-1] == 2] = merged
        right = np.where(at + 2 < len(symbol), symbol[np.minimum(at + 2, len(symbol) - 1)], -1)
        same = np.full(len(at), merged)
        before = np.where(left >= 0, v.pairs(np.maximum(left, 0), same)[0], _NONE)
        behind = np.where(right >= 0, v.pairs(same, np.maximum(right, 0))[0], _NONE)
        sooner = np.flatnonzero(np.minimum(before, behind) < low)
        if len(sooner):
            at = at[: sooner[0] + 1]
        symbol = symbol.copy()
        symbol[at] = merged
        symbol = np.delete(symbol, at + 1)
    return int(v.tokens(symbol).sum())


class Counter:
    """Counts tokens of texts, remembering pre-tokens seen lately."""

    def __init__(self, vocabulary: Vocabulary, cached: int = CACHED):
        self.vocabulary, self.cached = vocabulary, cached
        self.now: dict[str, int] = {"": 0}
        self.before: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return _PRE_TOKENS.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def count(self, texts: list[str | None]) -> list[int]:
        parts = [self.pre_tokens(t or "") for t in texts]
        unknown = set().union(*parts) - self.now.keys()
        if len(self.now) + len(unknown) > self.cached:
            self.before, self.now = self.now, {"": 0}
            unknown = set().union(*parts)
        fresh = []
        for w in unknown:
            if (n := self.before.get(w)) is None:
                fresh.append(w)
            else:
                self.now[w] = n
        self.now.update(zip(fresh, merge_counts(self.vocabulary, fresh), strict=True))
        return [sum(map(self.now.__getitem__, p)) for p in parts]


@functools.lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """The counter of one process for one vocabulary file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    normal = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return Counter(Vocabulary({sp.id_to_piece(i): sp.get_score(i) for i in normal}))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null text counts as empty: no bytes, no tokens.  Repeated rows stay
    repeated; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = counter(model_path).count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("c_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("c_bytes"), F.col(text_col).alias("c_text"))
    kind = rows.schema["c_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
