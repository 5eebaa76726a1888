"""Prefix trie of conversations.

Every distinct sequence of a conversation's first d turns is a node.  Turns are
reduced to 128-bit digests of role and text before anything is shuffled; a path's
key is a digest chained over them.  Three kinds of nodes are told apart by how
many different conversations pass through them:

* one: the rest of that conversation is a tail without a branch, and what its
  nodes hold follows from the bytes that are left;
* up to ``heavy``: the node belongs to the shard of its topmost such ancestor.
  Shards come to tasks whole; there they become level-order tries (LOUDS: a bit
  vector and arrays by level), rolled up from the last level to the first;
* more: an upper level.  Shards hand their totals to the upper levels above them,
  which are merged by one aggregation, so no task holds a prefix that many share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import NARROW_ROWS, materialise, release, slices

#: Different conversations beyond which a prefix is an upper level.
HEAVY = 2_000
#: Nodes of the shards that become one trie, unless one shard has more.
SHARD_NODES = 100_000
ROOT = bytes(16)


class Louds:
    """A trie in level order: per node, a one for each child, then a zero.  Node 0 is
    the top; the k-th one (from 0) is the edge to node k + 1."""

    def __init__(self, parents: np.ndarray, levels: np.ndarray):
        """parents: of the nodes 1, 2, ... in level order, so ascending; levels: where
        each level begins, and the end."""
        n = len(parents) + 1
        counts = np.bincount(parents, minlength=n)
        bits = np.ones(len(parents) + n, bool)
        bits[np.cumsum(counts) + np.arange(n)] = False
        self.n, self.levels, self.size = n, levels, len(bits)
        self.words = np.packbits(bits, bitorder="little")

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words, count=self.size, bitorder="little").astype(bool)

    def parents(self) -> np.ndarray:
        """Of nodes 1, 2, ...: the zeros before the edge to a node are the nodes that ended."""
        ones = np.flatnonzero(self.bits())
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        return np.diff(np.append(-1, np.flatnonzero(~self.bits()))) - 1

    def rolled_up(self, *values: np.ndarray) -> None:
        """Adds to every node what its subtree holds, from the last level up."""
        parents = self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            for v in values:
                np.add.at(v, parents[a - 1 : b - 1], v[a:b])


def level_order(level: np.ndarray, keys: list[bytes], parents: list[bytes]) -> tuple[Louds, np.ndarray]:
    """The trie of some shards under one top, and which row each of its nodes 1, 2, ...
    is.  level: 1 for the topmost nodes of a shard, which hang from the top; nodes of
    a level stand in order of their parents."""
    row_of = dict(zip(keys, range(len(keys)), strict=True))
    up_row = np.fromiter((row_of.get(p, -1) for p in parents), np.int64, len(parents))
    up_row[level == 1] = -1
    place = np.zeros(len(keys) + 1, np.int64)  # at -1 the top's
    rows = np.argsort(level, kind="stable")
    levels = np.append([0, 1], np.cumsum(np.bincount(level)[1:]) + 1)
    up = np.zeros(len(rows), np.int64)
    for a, b in zip(levels[1:-1] - 1, levels[2:] - 1, strict=True):
        above = place[up_row[rows[a:b]]]
        order = np.argsort(above, kind="stable")
        rows[a:b], up[a:b] = rows[a:b][order], above[order]
        place[rows[a:b]] = np.arange(a, b) + 1
    return Louds(up, levels), rows


_NODE = "key binary, depth int, parent binary, conv_id {0}, parent_conv_id {0}, has_parent boolean, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"


def _roll_up_shards(nodes: DataFrame, kind: str) -> DataFrame:
    """Light nodes with what their subtrees hold.  nodes: shard, top_depth, key, parent,
    depth, conv_id, n_convs, n_bytes, and for the head of a tail n_children, n_leaves
    and saved of the tail."""
    rows = nodes.select("shard", "top_depth", "key", "parent", "depth", "conv_id", "n_convs", "n_bytes", "n_children", "n_leaves", "saved")
    rows = rows.repartition("shard").sortWithinPartitions("shard")

    def finish(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        number = {c: t[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("top_depth", "depth", "n_convs", "n_bytes", "n_children", "n_leaves", "saved")}
        trie, row = level_order(number["depth"] - number["top_depth"] + 1, t["key"].to_pylist(), t["parent"].to_pylist())
        of = {c: np.append(0, v[row]) for c, v in number.items()}
        head = of["n_leaves"] > 0
        leaves, saved = of["n_leaves"], np.where(head, of["saved"], (of["n_convs"] - 1) * of["n_bytes"])
        trie.rolled_up(leaves, saved)
        children = np.where(head, of["n_children"], trie.degrees())
        t, up = t.take(row), trie.parents()
        conv = t["conv_id"].combine_chunks()
        columns = [t["key"], pa.array(of["depth"][1:].astype(np.int32)), t["parent"], conv, conv.take(pa.array(up - 1, mask=up == 0)), pa.array(up > 0)]
        columns += [pa.array(x[1:]) for x in (of["n_convs"], children, leaves, saved)]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[c.split()[0] for c in _NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards, until they have SHARD_NODES nodes."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, NARROW_ROWS):
            shard = batch.column(0).to_pylist()
            cuts = [k for k in range(len(shard)) if k and shard[k] != shard[k - 1]]
            if held and held[-1].column(0)[-1].as_py() != shard[0]:
                cuts.insert(0, 0)
            at = 0
            for cut in cuts:
                if size + cut - at >= SHARD_NODES:
                    yield finish([*held, batch.slice(at, cut - at)])
                    held, size, at = [], 0, cut
            held.append(batch.slice(at))
            size += len(shard) - at
        if held:
            yield finish(held)

    return rows.mapInArrow(run, _NODE.format(kind))


def _paths(turns: DataFrame, kind: str) -> DataFrame:
    """A row per turn, streamed in order: ``conv_id, depth, key, parent, n_bytes, upto,
    total, last``.  upto: bytes of the path's texts so far; last: the path's last turn.
    A path without turns has one row of depth 0.  turns: conv_id, place, label, n_bytes;
    one row of each conversation has place 0 and no label."""
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = f"conv_id {kind}, depth int, key binary, parent binary, n_bytes bigint, upto bigint, last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        out: list[list] = []
        now = None  # the row whose successor decides whether it is the last
        for batch in slices(batches, NARROW_ROWS):
            id_type = batch.schema.field(0).type
            types = [id_type, pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            for conv, place, label, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if now:
                        now[6] = True
                        out.append(now)
                    now = [conv, 0, ROOT, None, 0, 0, False]
                    continue
                if now[1]:
                    out.append(now)
                key = hashlib.blake2b(now[2] + label, digest_size=16).digest()
                now = [conv, now[1] + 1, key, now[2], size, now[5] + size, False]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if now:
            now[6] = True
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now, types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def _ends(last: DataFrame, kind: str) -> DataFrame:
    """``key, n_ends, conv_id, total, n_turns, ends_sha256`` of every node at which
    conversations end; members stream past in order, so any number of copies does."""
    rows = last.select("key", "conv_id", "upto", "depth").repartition("key").sortWithinPartitions("key", "conv_id")
    schema = f"key binary, n_ends bigint, conv_id {kind}, total bigint, n_turns int, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        out: list[list] = []
        now = digest = None
        for batch in slices(batches, NARROW_ROWS):
            types = [pa.binary(), pa.int64(), batch.schema.field(1).type, pa.int64(), pa.int32(), pa.string()]
            for key, conv, total, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != key:
                    if now:
                        out.append([*now, digest.hexdigest()])
                    now, digest = [key, 0, None, total, depth], hashlib.sha256()
                now[1] += 1
                if conv is not None:
                    digest.update((f"{conv}" if now[2] is None else f",{conv}").encode())
                    now[2] = conv if now[2] is None else now[2]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip([*now, digest.hexdigest()], types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, label, n_bytes``: turns in order from 1, reduced to a digest of
    role and text.  A null turn comes first; rows that repeat a turn follow each other
    by their digests.  Null roles and texts are empty."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), label.alias("label"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "label"))
    return rows.select("conv_id", place.alias("place"), "label", "n_bytes")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, heavy: int = HEAVY) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    turns: as ``numbered`` gives them, places of a conversation ascending from 1.
    conversations (conv_id): further ids, whose conversations may have no turn.
    conv_id is the smallest member; the root (depth 0) has no text and holds all.
    saved_tokens sums (n_convs - 1) times the bytes of the last text over a node's
    subtree: what storing each prefix once saves.  ends_sha256 digests the members that
    end at a node (ascending, joined by commas; none: of nothing).

    All rows of the null id are one conversation; it is no smallest member beside
    others and adds nothing to digests.  Repeated rows are turns of their own.  Without
    conversations there is no node.  Roles and texts of equal 128-bit digest are equal.
    heavy: different conversations beyond which a prefix is an upper level; a shard's
    task holds the turns that at most so many share, not those of one alone.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    ids = turns.select("conv_id").union(conversations.select("conv_id")) if conversations is not None else turns.select("conv_id")
    marks = ids.distinct().select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("bigint").alias("n_bytes"))
    paths = materialise(_paths(turns.select("conv_id", F.col("place").cast("int").alias("place"), "label", "n_bytes").unionByName(marks), kind), "paths")
    ends = materialise(_ends(paths.filter("last"), kind), "ends")

    # One conversation stands for all that are equal.
    first = ends.select(F.col("conv_id").alias("rep"), F.col("n_ends").alias("weight"), "total", "n_turns")
    same = paths["conv_id"].eqNullSafe(first["rep"])
    told = paths.filter("depth > 0").join(first, same).select("rep", "weight", "total", "n_turns", "depth", "key", "parent", "n_bytes", "upto")
    counts = told.groupBy("key").agg(F.sum("weight").alias("n_convs"), F.count(F.lit(1)).alias("n_seqs"), F.min("rep").alias("conv_id"))
    counts = materialise(counts, "counts")
    along = Window.partitionBy("rep").orderBy("depth")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_heavy = F.col("n_seqs") > max(1, heavy)
    light = lambda c: F.first(F.when(~is_heavy, F.col(c)), ignorenulls=True).over(so_far)
    placed = told.join(counts, "key").select("*", light("key").alias("shard"), light("depth").alias("top_depth"), (F.lag("n_seqs").over(along) == 1).alias("in_tail"), is_heavy.alias("is_heavy"))
    placed = materialise(placed, "placed")
    release(counts)

    alone = F.col("n_seqs") == 1
    nodes = placed.filter(F.col("rep").eqNullSafe(F.col("conv_id")))  # one row a node
    rest = ((F.col("weight") - 1) * (F.col("total") - F.col("upto") + F.col("n_bytes"))).alias("saved")
    goes_on = (F.col("depth") < F.col("n_turns")).cast("bigint")
    tails = nodes.filter(F.coalesce("in_tail", F.lit(False))).select(
        "key", "depth", "parent", "conv_id", F.col("conv_id").alias("parent_conv_id"), F.lit(True).alias("has_parent"), "n_convs", goes_on.alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), rest
    )
    of_head = lambda c, name: F.when(alone, c).otherwise(0).alias(name)
    of_shards = nodes.filter(~F.col("is_heavy") & ~F.coalesce("in_tail", F.lit(False)))
    of_shards = of_shards.select("shard", "top_depth", "key", "parent", "depth", "conv_id", "n_convs", "n_bytes", of_head(goes_on, "n_children"), of_head(F.lit(1), "n_leaves"), F.when(alone, rest).otherwise(0).alias("saved"))
    shards = materialise(_roll_up_shards(of_shards, kind), "shards")

    # Upper levels: every shard, and every upper node itself, adds to all prefixes above.
    upper = nodes.filter("is_heavy").select("key", "parent", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"))
    given = shards.filter(~F.col("has_parent")).select(F.col("conv_id").alias("from"), (F.col("depth") - 1).alias("low"), "n_leaves", "saved")
    given = given.unionByName(upper.select(F.col("conv_id").alias("from"), F.col("depth").alias("low"), F.lit(0).cast("bigint").alias("n_leaves"), F.col("own").alias("saved")))
    above = placed.filter("is_heavy").select("rep", F.col("depth").alias("at"), F.col("key").alias("up"))
    sums = above.join(given, above["rep"].eqNullSafe(given["from"]) & (above["at"] <= given["low"])).groupBy("up").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    beneath = nodes.filter(F.col("is_heavy") | (F.col("key") == F.col("shard"))).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    merged = upper.join(sums, F.col("key") == F.col("up")).join(beneath.withColumnRenamed("parent", "of"), F.col("key") == F.col("of"))
    whole = given.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    members = ends.agg(F.sum("n_ends").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs is not null")
    tops = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    root = members.join(F.broadcast(whole)).join(F.broadcast(tops))  # three tables of one row
    none, zero = F.lit(None), F.lit(0).cast("bigint")
    root = root.select(
        F.lit(ROOT).alias("key"), F.lit(0).alias("depth"), none.cast("binary").alias("parent"), "conv_id", none.cast(kind).alias("parent_conv_id"),
        F.lit(True).alias("has_parent"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved"),
    )
    merged = merged.select("key", "depth", "parent", "conv_id", none.cast(kind).alias("parent_conv_id"), F.lit(False).alias("has_parent"), "n_convs", "n_children", "n_leaves", "saved")

    # Nodes right under an upper level learn its smallest member.
    of_above = upper.select(F.col("key").alias("of"), F.col("conv_id").alias("of_conv")).unionByName(root.select(F.col("key").alias("of"), F.col("conv_id").alias("of_conv")))
    under = shards.filter(~F.col("has_parent")).unionByName(merged)
    under = under.join(of_above, F.col("parent") == F.col("of")).withColumn("parent_conv_id", F.col("of_conv")).drop("of", "of_conv")
    every = tails.unionByName(shards.filter("has_parent")).unionByName(under).unionByName(root)
    said = ends.select(F.col("key").alias("end"), "ends_sha256")
    return every.join(said, F.col("key") == F.col("end"), "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
