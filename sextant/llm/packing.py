"""Packing documents into sequences of a fixed length by fitted patterns.

Pieces are packed by length alone, so the problem is their histogram, which has
at most ``max_tokens`` rows however large the corpus is:

1. enumerate all patterns of one, two and three pieces that fill a sequence exactly;
2. fit a repeat count to each by non-negative least squares on the histogram;
3. round: whole counts first, then a fit of what is left, whose counts are rounded
   up in the order of their size as long as the pieces last;
4. pack the residual, which holds the short pieces, by best fit on its histogram.

A few shares of the rounded counts are tried, largest first, and the plan of
fewest sequences is taken.  The plan is a list of runs (pattern, repeats).  Each
piece finds its place from its rank among the pieces of its length: no sequence
is ever put together in one task, and no ids move.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import ENCODED_ROWS, materialise, slices
from sextant.llm.encoding import CACHED, encoder

MAX_TOKENS = 2048
#: Pieces under this part of a sequence are left to the residual, which they fill up.
SHORT = 16
#: Gradient steps of a fit, and fits of what the rounding leaves.
ROUNDS, FITS = 150, 5
#: Shares of the rounded counts that are tried.
SHARES = (1.0, 0.98, 0.95, 0.9, 0.8, 0.6)
#: Pieces that one ranking task should see of one length.
RANK_ROWS = 2_000

Run = tuple[tuple[int, ...], int]


def patterns(histogram: dict[int, int], size: int, least: int = 1) -> np.ndarray:
    """All patterns of two and three lengths from ``least`` on that fill a sequence,
    a row each, longest first; zero stands for no third piece."""
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0 and least <= x < size), np.int64)
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    long = lengths[2 * lengths >= size]
    long = long[have[size - long]]
    found = [np.stack([long, size - long, np.zeros_like(long)], 1)]
    for a in lengths.tolist():
        b = lengths[(lengths <= a) & (2 * lengths >= size - a) & (lengths < size - a)]
        b = b[have[size - a - b]]
        found.append(np.stack([np.full_like(b, a), b, size - a - b], 1))
    return np.concatenate(found)


def fit(histogram: dict[int, int], table: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of the histogram on the patterns, by accelerated
    projected gradient steps."""
    if not len(table):
        return np.zeros(0)
    target = np.zeros(size + 1)
    target[list(histogram)] = list(histogram.values())
    scale = max(target.max(), 1.0)
    target /= scale

    def forward(x: np.ndarray) -> np.ndarray:
        used = sum(np.bincount(column, x, size + 1) for column in table.T)
        used[0] = 0
        return used

    def backward(r: np.ndarray) -> np.ndarray:
        return r[table].sum(axis=1)

    probe = np.ones(len(table))
    for _ in range(8):  # the largest eigenvalue bounds the step
        probe = backward(forward(probe))
        top = np.linalg.norm(probe)
        probe /= top
    step = 1 / (1.05 * top)
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        rest = forward(y) - target
        rest[0] = 0
        new = np.maximum(0, y - step * backward(rest))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def rounded(left: dict[int, int], table: np.ndarray, counts: np.ndarray, up: bool) -> list[Run]:
    """Runs of the patterns by descending count, rounded down or up, as far as the
    histogram has the pieces; these are taken from it."""
    runs: list[Run] = []
    for k in np.argsort(-counts, kind="stable").tolist():
        wanted = int(np.ceil(counts[k] - 1e-9) if up else counts[k])
        if wanted < 1:
            break
        pattern = tuple(x for x in table[k].tolist() if x)
        need = Counter(pattern)
        repeats = min(wanted, *(left[x] // n for x, n in need.items()))
        if repeats > 0:
            runs.append((pattern, repeats))
            for x, n in need.items():
                left[x] -= n * repeats
    return runs


def best_fit(histogram: dict[int, int], size: int) -> list[Run]:
    """Best fit on a histogram: open a sequence with the longest piece, add the
    longest that fits until none does, and repeat the pattern while its lengths last."""
    left = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(left)
    runs: list[Run] = []
    while order:
        used: Counter[int] = Counter()
        space = size
        at = len(order)
        while at > 0:
            at = min(at, bisect.bisect_right(order, space))
            while at > 0 and left[order[at - 1]] <= used[order[at - 1]]:
                at -= 1
            if at == 0:
                break
            x = order[at - 1]
            used[x] += 1
            space -= x
        repeats = min(left[x] // n for x, n in used.items())
        runs.append((tuple(sorted(used.elements(), reverse=True)), repeats))
        for x, n in used.items():
            left[x] -= n * repeats
            if not left[x]:
                order.remove(x)
    return runs


def fitted(histogram: dict[int, int], size: int) -> list[Run]:
    """Runs of the fitted and rounded patterns."""
    left = dict(histogram)
    runs: list[Run] = [((size,), left.pop(size))] if left.get(size) else []
    table = patterns(left, size, max(1, size // SHORT))
    for k in range(FITS):
        some = np.zeros(size + 1, bool)
        some[[0, *(x for x, n in left.items() if n)]] = True
        table = table[some[table].all(axis=1)]
        taken = rounded(left, table, fit(left, table, size), up=k > 0)
        runs += taken
        if k and not taken:
            break
    return runs


def plan(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[Run]:
    """Runs that use every piece of the histogram exactly once: fitted patterns, and
    best fit for the residual.  Where all rounded counts leave the residual too few
    short pieces, the least of them are given back."""
    runs = fitted(histogram, size)
    several = sum(n * len(p) for p, n in runs if len(p) > 1)
    tokens = sum(x * n for x, n in histogram.items())
    best: list[Run] | None = None
    for share in SHARES:
        kept: list[Run] = []
        left, room = Counter(histogram), int(share * several)
        for pattern, repeats in runs:
            n = repeats if len(pattern) == 1 else min(repeats, room // len(pattern))
            if n:
                kept.append((pattern, n))
                room -= n * len(pattern) if len(pattern) > 1 else 0
                left.subtract({x: n * k for x, k in Counter(pattern).items()})
        found = kept + best_fit(left, size)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= -(-tokens // size):
            break
    return best


@dataclass(frozen=True)
class Places:
    """For each length: where the k-th piece of that length goes.  A slot covers
    ranks from ``first[i]`` on: sequence ``sequence[i] + rank - first[i]``."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @staticmethod
    def of(runs: list[Run]) -> Places:
        first: dict[int, list[int]] = {}
        sequence: dict[int, list[int]] = {}
        offset: dict[int, list[int]] = {}
        ranks: Counter[int] = Counter()
        at = 0
        for pattern, repeats in runs:
            place = 0
            for x in pattern:
                first.setdefault(x, []).append(ranks[x])
                sequence.setdefault(x, []).append(at)
                offset.setdefault(x, []).append(place)
                ranks[x] += repeats
                place += x
            at += repeats
        pack = lambda d: {k: np.array(v, np.int64) for k, v in d.items()}
        return Places(pack(first), pack(sequence), pack(offset))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            rows = np.flatnonzero(length == x)
            slot = np.searchsorted(self.first[x], rank[rows], side="right") - 1
            sequence[rows] = self.sequence[x][slot] + rank[rows] - self.first[x][slot]
            offset[rows] = self.offset[x][slot]
        return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED, rows: int = ENCODED_ROWS) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit).

    A document is its ids and the end id; one longer than max_tokens is cut into
    pieces of max_tokens, of which the first may be shorter.  A null text is
    empty: its only piece is the end id.  Repeated rows give repeated pieces.
    cached, rows: words remembered by a worker, and texts it encodes at a time.
    """
    texts = docs.select(F.col(id_col).alias("p_id"), F.col(text_col).alias("p_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            ids, bounds = encoder(tokenizer_path, cached).encode(batch.column(1))
            n = np.diff(bounds) + 1
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            count = (n + max_tokens - 1) // max_tokens
            owner = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            first = (n - 1) % max_tokens + 1
            length = np.where(piece == 0, first[owner], max_tokens)
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * max_tokens)
            ends = np.cumsum(length) * 4  # pieces lie one after another
            value = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), value.cast(pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    kind = texts.schema["p_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def assign(rows: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``; other columns stay.

    rows needs a column ``length`` of 1 .. max_tokens.  Pieces of a length are
    ranked within salted groups, as many as the length needs, whose bases are summed
    from the counts of groups: a length that many pieces share is ranked by many tasks.
    """
    held = materialise(rows, "pieces", ENCODED_ROWS)
    histogram = {r[0]: r[1] for r in held.groupBy("length").count().collect()}  # at most max_tokens rows
    places = Places.of(plan(histogram, max_tokens))
    many = {x: 1 + n // RANK_ROWS for x, n in histogram.items() if n > RANK_ROWS}
    groups = F.lit(1)
    if many:
        groups = F.coalesce(F.create_map(*[F.lit(v) for pair in many.items() for v in pair])[F.col("length")], F.lit(1))
    names = [c for c in held.columns if c != "length"]
    order = [f"c{k}" for k in range(len(names))]
    salted = held.select("length", *[F.col(c).alias(a) for c, a in zip(names, order, strict=True)])
    salted = salted.withColumn("s_salt", F.pmod(F.xxhash64(*order), groups).cast("int"))
    bases = salted.groupBy("length", "s_salt").agg(F.count(F.lit(1)).alias("s_count"))
    base = F.coalesce(F.sum("s_count").over(Window.partitionBy("length").orderBy("s_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = bases.select("length", "s_salt", base.alias("s_base"))
    rank = F.row_number().over(Window.partitionBy("length", "s_salt").orderBy(*order))
    ranked = salted.withColumn("s_rank", rank).join(bases, ["length", "s_salt"]).withColumn("s_rank", F.col("s_rank") - 1 + F.col("s_base")).drop("s_salt", "s_base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "s_rank"))
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c != "s_rank"], pa.array(sequence), pa.array(offset)],
                names=[*[c for c in batch.schema.names if c != "s_rank"], "sequence_id", "offset"],
            )

    kept = [f for f in ranked.schema.fields if f.name != "s_rank"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    out = ranked.mapInArrow(run, f"{ddl}, sequence_id bigint, offset bigint")
    return out.select(*[F.col(a).alias(c) for c, a in zip(names, order, strict=True)], "length", "sequence_id", "offset")
