"""Groups of texts whose sets of word shingles are similar, without a lost link.

The pipeline's near-duplicate stage asks for five-word shingles and a Jaccard
similarity of 0.8.  Its first step is SimHash: fingerprints of the sets are listed
under their bytes, pairs are tallied and verified on 64 bits (``simhash.links``), and
those that link are decided by the shingles of both.

A similarity of 0.8 is some ten bits of a fingerprint, more than four shared bytes can
promise, so pairs that the fingerprints leave in different groups are met exactly: with
all shingles in one order, two texts so similar share one of their first
``n - ceil(0.8 n) + 1``.  Pairs that share a list are dropped where sizes, places
or parity bitmaps rule them out (in long lists one of 2,048 bits, then one of two
bits a shingle), and decided by the shingles of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import BATCH_ROWS, materialise, release, slices
from sextant.llm.components import components
from sextant.llm.simhash import MAX_BITS, SEED, bounds, links, majority, runs, shingle_hashes, within

#: Lanes of 64 bits of the parity bitmap that goes with a text into long lists.
LANES = 32
#: Share and least number of rows that are sampled to tell which shingles are common.
SAMPLE, SAMPLED = 0.02, 20_000
#: Shingles that are held as common; they come last in the order of all texts.
COMMON = 200_000
#: Shingles that a sampling task counts at a time.
COUNTED = 2_000_000
#: Lists up to this length give all their pairs at once; longer ones a forest first.
SHORT = 16
#: Rows of an Arrow batch that carry such a bitmap.
LISTED_ROWS = 5_000
#: Keys of texts that are broadcast to find their texts; more meet in a shuffle.
BROADCAST_KEYS = 1_000_000


def needed(size: int, similarity: Fraction) -> int:
    """Shingles that a text of this many shares with any text so similar."""
    return -(-size * similarity.numerator // similarity.denominator)


def prefix(tokens: np.ndarray, common: np.ndarray, weight: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The first ``n - needed + 1`` of n distinct shingles, rare ones first: texts
    so similar have one of these in common.

    common is sorted, with the weight of each; others have weight zero.  Any
    weights give a right prefix, as long as all texts are ordered by the same.
    """
    if not len(tokens):
        return np.zeros(0, np.int64)
    weights = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        weights = np.where(common[at] == tokens, weight[at], 0)
    return tokens[np.lexsort((tokens, weights))][: len(tokens) - needed(len(tokens), similarity) + 1]


def parities(tokens: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Parity of the number of shingles in each of 64 x lanes classes (lanes: a power
    of two).  Two texts' bitmaps differ in no more bits than there are shingles that
    only one of them has.  The halves of a bitmap, differing bits set, are the bitmap
    of half as many classes."""
    odd = np.bincount((tokens & (64 * lanes - 1)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def lanes_for(size: int) -> int:
    """Lanes of a text's large bitmap: two bits a shingle or more."""
    return 1 << max(0, (2 * size - 1) // 64).bit_length()


def _may(pairs: DataFrame, distinct: DataFrame, rules: _Rules) -> DataFrame:
    """Those of the pairs ``a, b`` that the large bitmaps do not rule out.  Texts of
    sizes so near have bitmaps of one length, or of one length and its double."""
    a, b = (distinct.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("bits").alias(f"{n}_bits")) for n in ("a", "b"))
    n = F.least(F.size("a_bits"), F.size("b_bits"))

    def folded(x: str) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > n, halves).otherwise(F.col(x))

    differing = F.zip_with(folded("a_bits"), folded("b_bits"), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("bigint"))
    total = F.aggregate(differing, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").filter(rules.bits(F.col("a_size"), F.col("b_size"), total)).select("a", "b")


def _tokens(text: bytes | None, ngram: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, ngram).view(np.int64))


def _node(tokens: np.ndarray) -> int:
    """A set's name: texts of the same shingles are one node, those without words node zero."""
    from xxhash import xxh3_64_intdigest

    value = xxh3_64_intdigest(tokens.astype("<i8").tobytes()) if len(tokens) else 0
    return value - (1 << 64) if value >> 63 else value


class _Rules:
    """What every pair of the given similarity fulfils, in whole numbers."""

    def __init__(self, similarity: Fraction):
        self.p, self.q = similarity.numerator, similarity.denominator

    def sizes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a, b) * self.q >= np.maximum(a, b) * self.p

    def places(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray) -> np.ndarray:
        """The sizes allow it, and so does the place of the first shingle in common:
        all others stand behind it in both orders."""
        return self.sizes(a, b) & self.shared(a, b, np.minimum(a - at, b - bt))

    def shared(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Texts of a and b shingles, n of them in common, are similar enough."""
        return n * (self.p + self.q) >= (a + b) * self.p

    def bits(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The bitmaps may differ in n bits."""
        return n * (self.p + self.q) <= (a + b) * (self.q - self.p)


def _meet(rules: _Rules, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within the short lists of (k, node, size, pos) that sizes and places
    allow, with place -1, and the rows of longer lists as (k, node, pos)."""
    k, node, size, pos = columns
    again = np.concatenate([[True], (k[1:] != k[:-1]) | (node[1:] != node[:-1])])[: len(k)]
    k, node, size, pos = (x[again] for x in columns)  # copies met in several tasks
    cuts = bounds(k)
    length = np.diff(cuts)
    left, right = [], []
    for i, j in within(cuts, SHORT):
        near = rules.places(size[i], size[j], pos[i], pos[j])
        left.append(np.minimum(node[i], node[j])[near])
        right.append(np.maximum(node[i], node[j])[near])
    place = np.full(sum(map(len, left)), -1)
    crowded = np.repeat(length > SHORT, length)
    return np.concatenate([*left, k[crowded]]), np.concatenate([*right, node[crowded]]), np.concatenate([place, pos[crowded]])


@dataclass
class _List:
    """The texts of one long list: sizes, places of the shared shingle, bitmaps, roots."""

    size: np.ndarray
    pos: np.ndarray
    bits: np.ndarray
    root: np.ndarray

    def near(self, rules: _Rules, one: int, rest: np.ndarray) -> np.ndarray:
        """Which of rest may be similar to one."""
        near = rules.places(self.size[rest], self.size[one], self.pos[rest], self.pos[one])
        at = rest[near]
        near[near] = rules.bits(self.size[at], self.size[one], np.bitwise_count(self.bits[at] ^ self.bits[one]).sum(axis=1, dtype=np.int64))
        return near


def _first_links(rules: _Rules, texts: _List) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the texts that may be similar, breadth first.  It only settles early
    which are; the pairs it leaves out are met by _other_links."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.arange(len(texts.size))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            near = texts.near(rules, one, rest)
            if near.any():
                left.append(np.full(near.sum(), one))
                right.append(rest[near])
                frontier.extend(rest[near])
                rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def _other_links(rules: _Rules, texts: _List) -> tuple[np.ndarray, np.ndarray]:
    """Every pair that may be similar and is of two groups so far."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if (texts.root != texts.root[0]).any():
        for one in range(len(texts.size) - 1):
            rest = one + 1 + np.flatnonzero(texts.root[one + 1 :] != texts.root[one])
            rest = rest[texts.near(rules, one, rest)]
            left.append(np.full(len(rest), one))
            right.append(rest)
    return np.concatenate(left), np.concatenate(right)


def _edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _described(rows: DataFrame, ngram: int, similarity: Fraction) -> DataFrame:
    """``doc_id, t, node, size, first, bits, small, fp`` of every row; first is null where
    the task has described the same set before.  bits, small: the two bitmaps; fp: the
    SimHash of the set."""
    common, weight = _common(rows, ngram)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies are listed once a task
        for batch in slices(batches):
            node, size, first, bits, small, fp = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                tokens = _tokens(text, ngram)
                node.append(_node(tokens))
                size.append(len(tokens))
                first.append(None if node[-1] in seen else prefix(tokens, common, weight, similarity))
                bits.append(parities(tokens, lanes_for(len(tokens))))
                small.append(parities(tokens).tobytes())
                fp.append(majority(tokens.view(np.uint64)))
                seen.add(node[-1])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (first, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), *lists, pa.array(small, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "t", "node", "size", "first", "bits", "small", "fp"])

    kind = rows.schema["f_id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"doc_id {kind}, t bigint, node bigint, size bigint, first array<bigint>, bits array<bigint>, small binary, fp bigint")


def _distinct(described: DataFrame) -> DataFrame:
    """``node, t, size, bits, small, fp`` of every different set."""
    first = [F.first(c).alias(c) for c in ("bits", "small", "fp")]
    return described.groupBy("node").agg(F.min("t").alias("t"), F.max("size").alias("size"), *first)


def by_fingerprint(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a, b`` of sets (node, fp) that connect those whose fingerprints differ in at
    most max_bits bits: a forest of the fingerprints, and of each its other sets."""
    named = materialise(distinct.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    a, b = (named.select(F.col("fp").alias(n), F.col("least").alias(f"{n}_node")) for n in ("a", "b"))
    near = links(named.select("fp"), max_bits).join(a, "a").join(b, "b").select("a_node", "b_node")
    same = distinct.join(named, "fp").filter("node <> least").select("least", "node")
    x, y = (F.col(c) for c in ("a_node", "b_node"))
    out = materialise(near.unionAll(same).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "near-fingerprints")
    release(named)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of two groups; roots: node, root of the nodes that have a smaller one."""
    a, b = (roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in ("a", "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def similar_documents(docs: DataFrame, similarity: float = 0.8, ngram: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, component_id, component_key`` of every row: groups of texts
    whose sets of word shingles have the given Jaccard similarity or more, directly
    or by a chain, and the smallest row of each (ids first, null ids last; of equal
    ids the smaller key, an XXH64 of the text).

    Sets whose fingerprints are near are decided first; then come all other pairs that
    share a list of shingles and lie in different groups.  No link is lost, and shingles
    are 64-bit hashes.  Lists of many texts are first joined to a forest; where that
    leaves several groups, all their pairs across groups are decided too.  Texts without words, null ones among them, form one
    group; repeated rows give repeated rows; an empty table gives none.
    """
    exact = Fraction(str(similarity))
    rules = _Rules(exact)
    rows = docs.select(F.col(id_col).alias("f_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("t"), F.col(text_col).cast("binary").alias("f_text"))
    described = materialise(_described(rows, ngram, exact), "described", BATCH_ROWS)
    distinct = materialise(_distinct(described), "distinct-sets")
    held = materialise(described.select("doc_id", "t", "node"), "nodes")
    index = described.select("node", "size", F.posexplode("first").alias("pos", "k")).select("k", "node", "size", F.col("pos").cast("bigint").alias("pos"))
    index = index.repartition("k").sortWithinPartitions("k", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches):
            a, b, pos = _meet(rules, columns)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(pos)], names=["a", "b", "pos"])

    met = materialise(index.mapInArrow(meet, "a bigint, b bigint, pos bigint"), "met")
    release(described)

    candidates = by_fingerprint(distinct.select("node", "fp"))
    near = _decided(candidates, rows, distinct, rules, ngram)
    known = components(near)
    release(candidates)

    def links_of(crowds: DataFrame, choose: Callable[[_Rules, _List], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, node, size, pos, root, small in runs(batches):
                bits, cuts = np.frombuffer(b"".join(small), "<u8").reshape(len(k), LANES), bounds(k)
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    a, b = choose(rules, _List(size[lo:hi], pos[lo:hi], bits[lo:hi], root[lo:hi]))
                    yield from _edges(*(f(node[lo:hi][a], node[lo:hi][b]) for f in (np.minimum, np.maximum)))

        sorted_ = crowds.select("k", "node", "size", "pos", "root", "small").repartition("k").sortWithinPartitions("k", "node")
        return sorted_.mapInArrow(run, "a bigint, b bigint").distinct()

    crowds = met.filter("pos >= 0").select(F.col("a").alias("k"), F.col("b").alias("node"), "pos")
    crowds = crowds.join(distinct.select("node", "size", "small"), "node")
    pairs = met.filter("pos < 0").select("a", "b").unionAll(links_of(crowds.withColumn("root", F.lit(0).cast("bigint")), _first_links))
    tried = materialise(_may(_apart(pairs.distinct(), known), distinct, rules), "tried", LISTED_ROWS)
    release(known)
    rest = _decided(tried, rows, distinct, rules, ngram)
    linked = near.unionAll(rest)
    roots = components(linked)
    if not crowds.isEmpty():
        grouped = crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        others = materialise(_may(links_of(grouped, _other_links).join(tried, ["a", "b"], "left_anti"), distinct, rules), "others", LISTED_ROWS)
        if not others.isEmpty():
            more = _decided(others, rows, distinct, rules, ngram)
            release(roots)
            roots = components(linked.unionAll(more))
            release(more)
        release(others)
    placed = distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t"))
    leasts = held.groupBy("node").agg(F.min(rank).alias("least")).join(placed, "node")
    groups = leasts.groupBy("root").agg(F.min("least").alias("least"))
    found = placed.join(groups, "root").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.t").alias("component_key"))
    out = materialise(held.join(found, "node").select("doc_id", F.col("t").alias("text_key"), "component_id", "component_key"), "similar")
    release(held, distinct, met, tried, near, rest, roots)
    return out


def _decided(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, rules: _Rules, ngram: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets of shingles are similar."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    keys = materialise(distinct.join(ends, "node", "left_semi").select("t"), "keys")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            names, sets = [], []
            for text in batch.column(0).to_pylist():
                tokens = _tokens(text, ngram)
                if (name := _node(tokens)) not in seen:
                    names.append(name)
                    sets.append(tokens)
                    seen.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])

    few = keys.count() <= BROADCAST_KEYS
    texts = rows.select("t", "f_text").join(F.broadcast(keys) if few else keys, "t", "left_semi").select("f_text")
    sets = materialise(texts.mapInArrow(read, "node bigint, tokens array<bigint>"), "sets", BATCH_ROWS)
    once = sets.groupBy("node").agg(F.first("tokens").alias("tokens"))  # a set may come from several tasks
    a, b = (once.select(F.col("node").alias(n), F.col("tokens").alias(f"{n}_tokens")) for n in ("a", "b"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    similar = pairs.join(a, "a").join(b, "b").filter(rules.shared(F.size("a_tokens"), F.size("b_tokens"), shared)).select("a", "b")
    out = materialise(similar, "linked")
    release(keys, sets)
    return out


def _common(rows: DataFrame, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the rows, sorted, and their numbers.
    A task counts its own rows first and leaves out what it has seen once."""
    n = rows.select("t").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            k, count = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k[count > 1]), pa.array(count[count > 1])], names=["k", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.append(_tokens(text, ngram))
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        yield counted()

    sample = rows.select("f_text").sample(min(1.0, max(SAMPLE, SAMPLED / max(n, 1))), SEED)
    counts = sample.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(COMMON).toArrow()
    k, count = (counts.column(c).to_numpy() for c in (0, 1))
    order = np.argsort(k)
    return k[order], count[order]
