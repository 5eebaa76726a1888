"""Exact top-k inner products by vector-approximation files.

Two files are written: the exact vectors, a row each, and the approximations, in
blocks: BITS bits per component that name a cell of the block's grid.  Cells are
equi-depth: each holds about as many of the block's values, and is known by the
least and greatest of them.  A scan of the approximations alone gives a lower and an
upper bound of every score at the price of two products.  What no longer can be among a query's k best goes at once;
of the rest, exact vectors are read in order of their bounds, first as many as
usually suffice, then all whose bound reaches the k-th score found, until that
is certain.

A task holds one slice of the approximations and streams all query blocks past
it, so nothing is joined as a product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import NARROW_ROWS, materialise, release, slices

SCALE = 256
#: Bits of a component's cell.
BITS = 6
CELLS = 1 << BITS
BLOCK = 4_096
QUERIES = 1_024
#: Approximation blocks that one task holds.
SLICE_BLOCKS = 64
#: Queries whose bounds are computed at a time.
BOUNDED = 256
#: Exact vectors that each query reads first, in multiples of k.
FIRST = 2
#: Whole numbers up to here are exact as doubles; the range of a 64-bit score.
EXACT, LONG = 2.0**53, (1 << 63) - 1
#: Stands for a null id: after all others.
LAST = LONG


def integers(embedding: Column) -> Column:
    """floor(256 x) of every component: a whole number, as double."""
    return F.transform(embedding, lambda x: F.when(F.abs(x.cast("double")) < 2.0**52, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))


def usable(embedding: Column) -> Column:
    """Not null, and without components that are null or not finite (as 256 x)."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite, F.lit(False))


@dataclass
class Approximation:
    """One block of the approximation file: ids, each component's cell, and the least
    and greatest value of every cell (cell, component)."""

    uid: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cells: np.ndarray

    @staticmethod
    def of(uid: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> Approximation:
        n, dim = exact.shape
        ordered = np.sort(exact, axis=0)
        low, high, cells = np.zeros((CELLS, dim)), np.zeros((CELLS, dim)), np.zeros((n, dim), np.uint8)
        for j in range(dim):
            first = np.unique(ordered[np.arange(CELLS) * n // CELLS, j])
            cells[:, j] = np.searchsorted(first, exact[:, j], "right") - 1
            low[: len(first), j] = first
            high[: len(first), j] = ordered[np.append(np.searchsorted(ordered[:, j], first[1:]), n) - 1, j]
        return Approximation(uid, ids, low, high, cells)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every query's score with every vector: a component
        lies as far from the middle of its cell as the cell's ends at most.  Where doubles
        are not exact, sums count as far off as they may be."""
        low, high = (np.take_along_axis(x, self.cells.astype(np.intp), axis=0) / 2 for x in (self.low, self.high))
        most = np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=0, initial=0)
        with np.errstate(over="ignore", invalid="ignore"):
            middle, around = q @ (low + high).T, np.abs(q) @ (high - low).T
            total = np.abs(q) @ most
            off = np.where(total < EXACT / 4, 0.0, total * (len(most) + 4) * 2.0**-50)[:, None]
            lower, upper = middle - around - off, middle + around + off
        return np.where(np.isfinite(lower), lower, -np.inf), np.where(np.isfinite(upper), upper, np.inf)

    def packed(self) -> bytes:
        """The cells, BITS bits each."""
        return np.packbits(np.unpackbits(self.cells[..., None], axis=2)[..., 8 - BITS :]).tobytes()

    @staticmethod
    def unpacked(packed: bytes, n: int, dim: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * dim * BITS).reshape(n, dim, BITS)
        return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def scan(blocks: list[Approximation], q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """What may be among the k best of each query: query places, uids, ids, lower and
    upper bounds.  own: uids that are the queries themselves; floor: scores that k
    candidates are known to reach."""
    best = np.full((len(q), k), -np.inf)
    found: list[tuple[np.ndarray, ...]] = []
    for b in blocks:
        lower, upper = b.bounds(q)
        order = np.argsort(b.uid, kind="stable")
        at = np.minimum(np.searchsorted(b.uid, own, sorter=order), len(b.uid) - 1)
        mine = np.flatnonzero(b.uid[order[at]] == own)
        lower[mine, order[at[mine]]] = upper[mine, order[at[mine]]] = -np.inf
        top = -np.partition(-lower, k - 1, axis=1)[:, :k] if lower.shape[1] > k else lower
        best = -np.sort(-np.concatenate([best, top], axis=1), axis=1)[:, :k]
        floor = np.maximum(floor, best[:, k - 1])
        i, n = np.nonzero((upper >= floor[:, None]) & (upper > -np.inf))
        found.append((i, b.uid[n], b.ids[n], lower[i, n], upper[i, n]))
    i, uid, ids, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
    # k candidates of higher bound, or of this bound and smaller id, leave the others no place
    order = np.lexsort((ids, -lower, i))
    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
    last = np.full(len(q), LAST)
    kth = np.full(len(q), -np.inf)
    at = order[place == k - 1]
    kth[i[at]], last[i[at]] = lower[at], ids[at]
    keep = (upper >= floor[i]) & ((upper > kth[i]) | ((upper == kth[i]) & (ids <= last[i])))
    return tuple(x[keep] for x in (i, uid, ids, lower, upper))


def exact_scores(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner products of rows: as 64-bit scores (at their limits beyond), as doubles not
    above them, and as keys that order what lies beyond the limits."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = (np.abs(q) * np.abs(v)).sum(axis=1)
        score = np.where(total < EXACT, (q * v).sum(axis=1), 0).astype(np.int64)
    near, key = score.astype(np.float64), np.full(len(score), "1", object)
    for k in np.flatnonzero(total >= EXACT).tolist():
        whole = sum(int(a) * int(b) for a, b in zip(q[k].tolist(), v[k].tolist(), strict=True))
        score[k] = max(-LONG - 1, min(LONG, whole))
        near[k] = np.nextafter(float(whole) if abs(whole) < 10**308 else np.inf if whole > 0 else -np.inf, -np.inf)
        if score[k] != whole:
            key[k] = f"{'2' if whole > 0 else '0'}{whole + 10**700:0701d}"
    return score, near, key


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


_FILE = "dim int, block bigint, uid binary, ids binary, low binary, high binary, cells binary"


def _approximated(rows: DataFrame) -> DataFrame:
    """The approximation file: blocks of the rows of each partition, of one dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, uid, ids, exact in _blocks(batches, BLOCK):
            a = Approximation.of(uid, ids, exact)
            values = [dim, int(uid[0]), _bytes(uid, "<i8"), _bytes(ids, "<i8"), _bytes(a.low, "<f8"), _bytes(a.high, "<f8"), a.packed()]
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _FILE.split(", ")])

    return rows.select("uid", "ids", "v").mapInArrow(run, _FILE)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in slices(batches, size):
        dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            uid, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            yield dim, uid, ids, part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(uid), dim)


def _query_blocks(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, uid, _, exact in _blocks(batches, QUERIES):
            values = [dim, int(uid[0]), _bytes(uid, "<i8"), _bytes(exact, "<f8")]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "block", "uid", "exact"])

    return rows.select("uid", "ids", "v").mapInArrow(run, "dim int, block bigint, uid binary, exact binary")


def _bounded(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``q, uid, ids, lower, upper`` of what may be among the k best of query q.  Every
    task holds a slice of the approximations; query blocks are dealt to all slices."""
    spark = blocks.sparkSession
    n = blocks.count()
    parts = max(1, -(-n // SLICE_BLOCKS), min(n, spark.sparkContext.defaultParallelism))
    none = F.lit(None).cast("binary")
    scanned = blocks.select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("s"), F.lit(0).alias("kind"), "dim", "block", "uid", "ids", "low", "high", "cells", none.alias("exact"))
    streamed = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("s"), F.lit(1).alias("kind"), "dim", "block", "uid", *[none.alias(c) for c in ("ids", "low", "high", "cells")], "exact")
    seed = [_loaded(r) for r in blocks.orderBy("block").limit(1).collect()]  # one block: a first floor for every query
    dim = seed[0].low.shape[1] if seed else -1
    rows = scanned.unionByName(streamed).repartition(parts, "s").sortWithinPartitions("s", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["s"] != at:
                    at, held = row["s"], {}
                if row["kind"] == 0:
                    held.setdefault(row["dim"], []).append(_loaded(row))
                elif row["dim"] in held:
                    uid = np.frombuffer(row["uid"], "<i8")
                    exact = np.frombuffer(row["exact"], "<f8").reshape(len(uid), row["dim"])
                    for a in range(0, len(uid), BOUNDED):
                        q, own = exact[a : a + BOUNDED], uid[a : a + BOUNDED]
                        floor = np.full(len(q), -np.inf)
                        if row["dim"] == dim:
                            i, _, _, lower, _ = scan(seed, q, own, floor, k)
                            reached = np.bincount(i, minlength=len(q)) >= k
                            order = np.lexsort((-lower, i))
                            first = np.searchsorted(i[order], np.flatnonzero(reached))
                            floor[reached] = lower[order][first + k - 1]
                        i, found, ids, lower, upper = scan(held[row["dim"]], q, own, floor, k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own[i], found, ids, lower, upper)], names=["q", "uid", "ids", "lower", "upper"])

    return rows.mapInArrow(run, "q bigint, uid bigint, ids bigint, lower double, upper double")


def _loaded(row) -> Approximation:
    uid, ids = (np.frombuffer(row[c], "<i8") for c in ("uid", "ids"))
    low, high = (np.frombuffer(row[c], "<f8").reshape(CELLS, row["dim"]) for c in ("low", "high"))
    return Approximation(uid, ids, low, high, Approximation.unpacked(row["cells"], len(uid), row["dim"]))


def _read(pairs: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """Exact scores of the pairs (q, uid): ``q, uid, ids, score, near, key``."""
    rows = pairs.select("q", "uid", "ids").join(vectors.select("uid", "v"), "uid").join(asked.select(F.col("uid").alias("q"), F.col("v").alias("q_v")), "q").select("q", "uid", "ids", "v", "q_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            dims = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v, q = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim) for c in (3, 4))
                score, near, key = exact_scores(q, v)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(score), pa.array(near), pa.array(key, pa.string())], names=["q", "uid", "ids", "score", "near", "key"])

    return rows.mapInArrow(run, "q bigint, uid bigint, ids bigint, score bigint, near double, key string")


def top_k(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", report: dict[str, int] | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every query.

    Queries are the rows for which query (a condition on the input) is true;
    candidates are all rows but the query's own.  Score: inner product of the
    whole numbers floor(256 x); ties go to the smaller id, null ids last.  Only
    vectors of one dimension are compared, empty ones among themselves; vectors
    that are null or hold null or non-finite components take no part.  Rows that
    repeat an id are different rows.  Ranks are exact for components of any size;
    a score beyond 64 bits shows as the limit.  Fewer than k candidates are all
    returned; an empty table gives no rows.  report: gets ``pairs`` of a query and a
    vector, and how many of them were ``read`` exactly.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("v_id"), F.col(vector_col).alias("v_vector"), F.coalesce(query, F.lit(False)).alias("v_query"))
    rows = rows.filter(usable(F.col("v_vector")))
    held = materialise(rows.select(F.monotonically_increasing_id().alias("uid"), "v_id", F.coalesce("v_id", F.lit(LAST)).alias("ids"), integers(F.col("v_vector")).alias("v"), "v_query"), "exact-vectors")
    # of equal vectors only the first k + 1 can be among anyone's k best
    copies = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("ids", "uid"))
    listed = held.select("uid", "ids", "v").withColumn("copy", copies).filter(F.col("copy") <= k + 1)
    blocks = materialise(_approximated(listed), "approximations", BLOCK)
    asked = held.filter("v_query")
    query_blocks = materialise(_query_blocks(asked), "query-blocks", QUERIES)
    bounds = materialise(_bounded(blocks, query_blocks, k), "bounds", 8)
    release(blocks, query_blocks)
    by = Window.partitionBy("q").orderBy(F.desc("lower"), "ids", "uid")
    whole = Window.partitionBy("q")
    kth = bounds.withColumn("place", F.row_number().over(by)).withColumn("kth", F.max(F.when(F.col("place") == k, F.struct("lower", (-F.col("ids")).alias("ids")))).over(whole))
    open_ = F.col("kth").isNull() | (F.col("upper") > F.col("kth.lower")) | ((F.col("upper") == F.col("kth.lower")) & (F.col("ids") <= -F.col("kth.ids")))
    order = Window.partitionBy("q").orderBy(F.desc("upper"), F.desc("lower"), "ids", "uid")
    left = materialise(kth.filter(open_).select("q", "uid", "ids", "upper", F.row_number().over(order).alias("place")), "candidates")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("key"), "ids", "uid")
    first = materialise(_read(left.filter(F.col("place") <= FIRST * k), held, asked), "first-scores", NARROW_ROWS)
    reached = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("q", "near")
    rest = left.filter(F.col("place") > FIRST * k).join(reached, "q", "left").filter(F.col("near").isNull() | (F.col("upper") >= F.col("near")))
    scores = materialise(first.unionByName(_read(rest, held, asked)), "scores", NARROW_ROWS)
    release(bounds, left, first)
    if report is not None:
        report |= {"pairs": asked.count() * held.count(), "read": scores.count()}
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = held.select("uid", "v_id")
    out = ranked.join(names.withColumnRenamed("v_id", "vec_id"), "uid").join(names.select(F.col("uid").alias("q"), F.col("v_id").alias("query_id")), "q")
    return out.select("query_id", "rank", "vec_id", "score")
