"""Near-duplicates by SimHash fingerprints and an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits agree in at
least ``8 - max_bits`` of their eight bytes.  Each distinct fingerprint is listed
under its bytes at every pair of positions; where lists of pairs would be long,
under every three or four positions, as the number of fingerprints asks.  Pairs
that share a list are tallied: the number of bytes that they share, position by
position.  Pairs that reach the guaranteed number are kept and verified on all 64
bits.  A pair that reaches it shares a list, so none is missed.

Lists that a sample expects to be very long are split by one more position each,
down to the guaranteed number of positions.  Within a list, fingerprints that
link are joined to a forest, so a group of copies gives as many rows as it has
members, not as many as it has pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import NARROW_ROWS, materialise, release, slices
from sextant.llm.components import components

SEED = 42
MAX_BITS = 4
NGRAM = 4
#: Fingerprints that a list should have on average; more ask for one more position.
LIST = 16
#: Fingerprints beyond which a list is split by further positions, and the most
#: fingerprints of the sample that tells.
HOT, SAMPLED = 100_000, 100_000
#: Fingerprints of one list that are compared directly; more are indexed again by their varying bits.
DIRECT = 8_192
#: Lists up to this length are compared all at once, by distance within the list.
SHORT = 32


def shingle_hashes(text: bytes | None, ngram: int) -> np.ndarray:
    """XXH64 of every ngram-word shingle, repeats included; a text of fewer words
    is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= ngram:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = end - length
    spans = zip(start[: n - ngram + 1].tolist(), end[ngram - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n - ngram + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is one if over half the values have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, ngram: int = NGRAM) -> int:
    """SimHash of the ngram-word shingles of a text, A-Z in lower case; a text
    without words has fingerprint zero."""
    return majority(shingle_hashes(text, ngram))


def fingerprints(docs: DataFrame, ngram: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed 64-bit integer) of every row."""
    rows = docs.select(F.col(id_col).alias("f_id"), F.col(text_col).cast("binary").alias("f_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, ngram) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['f_id'].dataType.simpleString()}, fp bigint")


def forest(found: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the distinct fingerprints which link, directly or by others.

    Up to DIRECT fingerprints are searched breadth first: each is compared with
    those not reached yet.  More are indexed by eight groups of the bits in which
    they vary, as in the outer index; each such key fixes about half of them.
    """
    if len(found) < 2:
        return found[:0], found[:0]
    varying = np.bitwise_or.reduce(found ^ found[0])
    bits = [k for k in range(64) if int(varying) >> k & 1]
    if len(found) > DIRECT and len(bits) > 8:
        groups = [sum(1 << k for k in bits[g::8]) for g in range(8)]
        parts = []
        for chosen in combinations(groups, 8 - max_bits):
            key = found & np.uint64(sum(chosen))
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            parts += [forest(found[order[a:b]], max_bits) for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True) if b - a > 1]
        left, right = (np.concatenate([p[k] for p in parts]) if parts else found[:0] for k in (0, 1))
        return left, right
    left, right = _index_forest(found, max_bits)
    return found[left], found[right]


def _index_forest(found: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of sketches that link, joined breadth first."""
    left, right = [], []
    rest = np.arange(len(found))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            near = links_of(found[rest] ^ found[one], max_bits)
            if near.any():
                reached = rest[near]
                left.append(np.full(len(reached), one))
                right.append(reached)
                frontier.extend(reached)
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally of pairs: bytes that both have at the same position, from their difference x."""
    some = x | x >> np.uint64(4)
    some |= some >> np.uint64(2)
    some |= some >> np.uint64(1)
    return 8 - np.bitwise_count(some & np.uint64(0x0101010101010101))


def links_of(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the differences x are of pairs that link: those that reach the least
    number of shared bytes are verified on all bits."""
    kept = shared_bytes(x) >= 8 - max_bits
    kept[kept] = np.bitwise_count(x[kept]) <= max_bits
    return kept


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by the first, cut so that no run of it is divided."""
    open_: list[list[np.ndarray]] = []
    for batch in slices(batches, NARROW_ROWS):
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if open_ and open_[0][0][0] == now[0][-1]:  # one run so far
            open_.append(now)
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        yield [np.concatenate([*(o[c] for o in open_), x[:cut]]) for c, x in enumerate(now)]
        open_ = [[x[cut:] for x in now]]
    if open_:
        yield [np.concatenate([o[c] for o in open_]) for c in range(len(open_[0]))]


def bounds(k: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k)) if len(k) else np.zeros(1, np.int64)


def within(cuts: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within the runs of 2 .. longest rows, a distance at a time."""
    size = np.diff(cuts)
    for step in range(1, longest):
        chosen = np.flatnonzero((size > step) & (size <= longest))
        if not len(chosen):
            return
        n = size[chosen] - step
        at = np.repeat(cuts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield at, at + step


def positions_for(n: int) -> int:
    """Positions that a list fixes, from the number of distinct fingerprints."""
    return next((p for p in (2, 3) if n <= LIST << 8 * p), 4)


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _places(mask: int) -> list[int]:
    return [p for p in range(8) if mask >> 8 * p & 0xFF]


def hot_lists(sample: np.ndarray, n: int, positions: int, deepest: int) -> dict[int, np.ndarray]:
    """Keys of the lists that are split, by mask: those of which the sample expects
    over HOT among n fingerprints, and their parts as far as they are as long."""
    least = max(8, -(-HOT * len(sample) // max(n, 1)))
    found: dict[int, np.ndarray] = {}
    now = {_mask(c): np.ones(len(sample), bool) for c in combinations(range(8), positions)}
    for _ in range(positions, deepest):
        further: dict[int, np.ndarray] = {}
        for mask, rows in now.items():
            keys, count = np.unique(sample[rows] & np.uint64(mask), return_counts=True)
            if (keys := keys[count >= least]).size:
                found[mask] = keys
                split = rows & np.isin(sample & np.uint64(mask), keys)
                for p in set(range(8)) - set(_places(mask)):
                    more = mask | 0xFF << 8 * p
                    further[more] = further.get(more, False) | split
        now = further
    return found


def listed(fp: np.ndarray, positions: int, hot: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the lists, and the fingerprints to enter there."""
    now = {_mask(c): np.ones(len(fp), bool) for c in combinations(range(8), positions)}
    while now:
        further: dict[int, np.ndarray] = {}
        for mask, rows in now.items():
            key = fp & np.uint64(mask)
            if mask in hot and (split := rows & np.isin(key, hot[mask])).any():
                rows = rows & ~split
                for p in set(range(8)) - set(_places(mask)):
                    more = mask | 0xFF << 8 * p
                    further[more] = further.get(more, False) | split
            # lists of two masks may share a name: that only adds pairs to tally
            name = (key ^ np.uint64(mask * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            yield (name ^ name >> np.uint64(32))[rows], fp[rows]
        now = further


def _edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a, b`` that connect the fingerprints (column fp, distinct) which
    differ in at most max_bits bits, directly or by a chain."""
    n = distinct.count()
    positions = min(positions_for(n), 8 - max_bits)
    sample = distinct if n <= SAMPLED else distinct.sample(SAMPLED / n, SEED)
    hot = hot_lists(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64), n, positions, 8 - max_bits)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, NARROW_ROWS):
            for name, fp in listed(batch.column(0).to_numpy().view(np.uint64), positions, hot):
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(fp.view(np.int64))], names=["list", "fp"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, fp in runs(batches):
            fp, cuts = fp.view(np.uint64), bounds(name)
            for i, j in within(cuts, SHORT):
                near = links_of(fp[i] ^ fp[j], max_bits)
                yield from _edges(fp[i[near]], fp[j[near]])
            for k in np.flatnonzero(np.diff(cuts) > SHORT):
                yield from _edges(*forest(np.unique(fp[cuts[k] : cuts[k + 1]]), max_bits))

    index = distinct.select("fp").mapInArrow(enter, "list bigint, fp bigint")
    return index.repartition("list").sortWithinPartitions("list").mapInArrow(tally, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id of its group.

    Rows group if their fingerprints differ in at most max_bits bits, directly
    or by a chain.  Null, empty and wordless texts have fingerprint zero and
    group like any other.  Null ids are never a group's smallest, unless it has
    no other.  Rows that repeat an id stay rows of their own.
    """
    rows = materialise(fingerprints(docs, ngram, id_col, text_col), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialise(placed.join(groups, "root").select("fp", "component_id"), "groups")
    release(distinct, roots)
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")
