"""Substring dedup: word windows that an earlier document also has.

Documents are indexed in shards by content, so that a passage is searched in
the one shard that can hold its copies.  Every window of ``window`` words has an
anchor: its word k-gram of least hash.  Successive windows with one anchor form
a fragment; equal windows have equal anchors.

1. Each document gives its fragments as (anchor, document, place).  Of fragments
   that a batch of documents holds several times, word for word, only the
   earliest document's goes on, so a hot passage moves one row per batch.
2. Rows meet by anchor.  An anchor that only one document has is of no passage.
3. The fragments of the other anchors are streamed, as text, to the shards of
   their anchors.  A shard's FM-index holds each different fragment; backward
   search over its wavelet matrix gives every window's occurrences, and the
   document matrix the earliest of them.  A window is repeated if that is earlier
   than the fragment's own document.
4. The windows found are put together by document.

An anchor that very many fragments share is split by window instead, so no shard
grows without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import NARROW_ROWS, materialise, release, slices
from sextant.llm.fmindex import FMIndex

WINDOW = 13
GRAM = 5
#: Words of one FM-index; groups of an anchor are not split.
SHARD_WORDS = 200_000
#: Fragments of an anchor beyond which it is split by window.
HOT_FRAGMENTS = 10_000
#: Windows of a fragment: a bit each of a signed 64-bit integer.
MOST_WINDOWS = 62
#: Rows of an Arrow batch where both texts and narrow rows go to Python.
SENT_ROWS = 2_000
#: Stands for a null id: later than every document.
LAST = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ROWS = (("anchor", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("code", pa.int64()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


class Words:
    """The words of a batch of texts, one after another, numbered and hashed."""

    def __init__(self, texts: list[bytes | None]):
        from xxhash import xxh64_intdigest

        parts = [(t or b"").split() for t in texts]
        self.count = np.fromiter(map(len, parts), np.int64, len(parts))
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        number: dict[bytes, int] = {}
        of = number.setdefault
        self.number = np.fromiter((of(w, len(number)) for p in parts for w in p), np.int64, int(self.count.sum()))
        known = np.fromiter((xxh64_intdigest(w, 7) for w in number), np.uint64, len(number))
        self.hash = known[self.number] if len(self.number) else np.zeros(0, np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(_ODD, len(self.hash)))])
        self.inverse = _powers(_INVERSE, len(self.hash) + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words in each span, the same wherever they stand."""
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of these lengths from a and from b have the same words."""
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        same = self.number[np.repeat(a, length) + step] == self.number[np.repeat(b, length) + step]
        return np.logical_and.reduceat(same, np.cumsum(length) - length) if len(length) else same


def fragments(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, start (among the batch's words), windows and anchor of every fragment."""
    n = len(words.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64)
    last = np.repeat(words.end, words.count) - window  # last window start of each word's document
    grams = words.span(np.arange(n - gram + 1), np.arange(gram, n + 1))
    wide = window - gram + 1  # k-grams of a window
    m = len(grams) - wide + 1
    least = grams[:m].copy()
    for k in range(1, wide):
        np.minimum(least, grams[k : k + m], out=least)
    anchor = np.zeros(m, np.int64)
    for k in range(wide - 1, -1, -1):
        np.copyto(anchor, np.arange(k, k + m), where=grams[k : k + m] == least)
    at = np.flatnonzero(np.arange(m) <= last[:m])
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    owner = np.repeat(np.arange(len(words.count)), words.count)[at]
    new = np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    start = at[first]
    return owner[first], start, size, least[start]


def _again(words: Words, start: np.ndarray, length: np.ndarray, anchor: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which fragments an earlier document of the batch has word for word."""
    content = words.span(start, start + length)
    order = np.lexsort((d, content, anchor))
    k, c = anchor[order], content[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(order) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = np.flatnonzero(d[order] > d[first])
    a, b = order[later], first[later]
    same = length[a] == length[b]
    a, b = a[same], b[same]
    out = np.zeros(len(order), bool)
    out[a[words.equal(start[a], start[b], length[a])]] = True
    return out


def _fragment_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``anchor, d, h, code`` of every fragment; code: place, windows, and whether
    all its windows are repeated already.  docs: d, h, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            d, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            words = Words(batch.column(2).to_pylist())
            owner, start, size, anchor = fragments(words, window, gram)
            if not len(owner):
                continue
            done = _again(words, start, size + window - 1, anchor, d[owner])
            place = start - words.start[owner]
            anchor = np.where(done, _mixed(anchor + place.astype(np.uint64) + h[owner].view(np.uint64)), anchor)  # only passes through
            columns = (anchor.view(np.int64), d[owner], h[owner], place << 7 | size << 1 | done)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, _ROWS, strict=True)], names=[n for n, _ in _ROWS])

    return docs.mapInArrow(run, "anchor bigint, d bigint, h bigint, code bigint")


class _Anchors:
    """Reads rows sorted by (anchor, d) and picks those of anchors that documents share.

    Only the group at a batch's end stays open; of it, no more than HOT_FRAGMENTS
    rows are held back.  A group of more is split by window (hot)."""

    def __init__(self):
        self.anchor, self.held, self.seen = None, [], 0

    def feed(self, columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
        """Yields rows, whether they are to be searched, and whether they are hot."""
        done = (columns[3] & 1) == 1
        if done.any():
            yield [c[done] for c in columns], False, False
            columns = [c[~done] for c in columns]
        anchor, d = columns[:2]
        if not len(anchor):
            return
        new = np.concatenate([[anchor[0] != self.anchor], anchor[1:] != anchor[:-1]])
        cuts = np.flatnonzero(new)
        head = int(cuts[0]) if len(cuts) else len(anchor)
        if head:
            yield from self._add([c[:head] for c in columns])
        if not len(cuts):
            return
        yield from self.close()
        tail = int(cuts[-1])
        if tail > head:
            ends = np.append(cuts[1:], len(anchor))[:-1]
            size = ends - cuts[:-1]
            shared, hot = d[cuts[:-1]] != d[ends - 1], size > HOT_FRAGMENTS
            for flag in (False, True):
                if len(at := np.flatnonzero(np.repeat((shared & ~hot) if not flag else hot, size)) + head):
                    yield [c[at] for c in columns], True, flag
        self.anchor = anchor[tail]
        yield from self._add([c[tail:] for c in columns])

    def _add(self, columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
        self.seen += len(columns[0])
        self.held.append(columns)
        if self.seen > HOT_FRAGMENTS:
            for rows in self.held:
                yield rows, True, True
            self.held = []

    def close(self) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
        if self.held and self.seen <= HOT_FRAGMENTS and self.held[0][1][0] != self.held[-1][1][-1]:
            for rows in self.held:
                yield rows, True, False
        self.held, self.seen = [], 0


def _shared_rows(rows: DataFrame) -> DataFrame:
    """Fragments whose windows are all repeated, and fragments to search (probe)."""
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "d")
    names = ["anchor", "d", "h", "place", "size", "probe", "hot"]

    def batch_of(found: tuple[list[np.ndarray], bool, bool]) -> pa.RecordBatch:
        (anchor, d, h, code), probe, hot = found
        n = len(d)
        columns = (anchor, d, h, code >> 7, (code >> 1 & 63).astype(np.int32), np.full(n, probe), np.full(n, hot))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Anchors()
        for batch in slices(batches, NARROW_ROWS):
            for found in groups.feed([c.to_numpy(zero_copy_only=False) for c in batch.columns]):
                yield batch_of(found)
        for found in groups.close():
            yield batch_of(found)

    return rows.mapInArrow(run, "anchor bigint, d bigint, h bigint, place bigint, size int, probe boolean, hot boolean")


_TEXT_ROW = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("place", pa.int64()), ("size", pa.int32()), ("text", pa.binary())])


def _fragment_texts(wanted: DataFrame, window: int) -> DataFrame:
    """The words of the fragments to search, by shard key; a row without text is
    repeated in full: an earlier document of the batch has the same hot window.

    wanted: d, h, text, and the fragments of the document as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            d, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            asked = batch.column(3)
            flat = asked.flatten()
            anchor, place, size, hot = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("anchor", "place", "size", "hot"))
            count = np.diff(asked.offsets.to_numpy())
            owner = np.repeat(np.arange(len(count)), count)
            parts = np.where(hot, size, 1)  # a hot fragment gives each window by itself
            at = np.repeat(np.arange(len(owner)), parts)
            place = place[at] + np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.where(hot[at], 1, size[at])
            owner, anchor, hot = owner[at], anchor[at], hot[at]
            text: list[bytes | None] = []
            ends = np.cumsum(np.bincount(owner, minlength=len(count))).tolist()
            starts, stops, k = place.tolist(), (place + size + window - 1).tolist(), 0
            for words, end in zip((t.split() for t in batch.column(2).to_pylist()), ends, strict=True):
                text += [b" ".join(words[a:b]) for a, b in zip(starts[k:end], stops[k:end], strict=True)]
                k = end
            key, of = anchor.copy(), d[owner]
            earliest: dict[bytes, int] = {}
            for k in np.flatnonzero(hot).tolist():
                key[k] = xxh64_intdigest(text[k], 11) - (1 << 63)
                earliest[text[k]] = min(earliest.get(text[k], LAST), int(of[k]))
            for k in np.flatnonzero(hot).tolist():
                if earliest[text[k]] < of[k]:
                    key[k] = xxh64_intdigest(text[k], int(k)) - (1 << 63)  # only passes through
                    text[k] = None
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.array(h[owner]), pa.array(place), pa.array(size.astype(np.int32)), pa.array(text, pa.binary())], schema=_TEXT_ROW)

    return wanted.mapInArrow(run, "key bigint, d bigint, h bigint, place bigint, size int, text binary")


def search_shard(texts: pa.Array, sizes: np.ndarray, d: np.ndarray, window: int) -> np.ndarray:
    """Bit k of a row's number: the fragment's k-th window occurs in an earlier document.

    Each different fragment is in the index once, under its earliest document, and
    streams through it once; every row compares its own document with the result."""
    coded = texts.dictionary_encode()
    index = coded.indices.to_numpy()
    unique = [t.split() for t in coded.dictionary.to_pylist()]
    earliest = np.full(len(unique), LAST, np.int64)
    np.minimum.at(earliest, index, d)
    documents, rank = np.unique(earliest, return_inverse=True)
    number: dict[bytes, int] = {}
    text = np.fromiter((s for t in unique for s in (*(number.setdefault(w, len(number) + 1) for w in t), 0)), np.int64)
    length = np.fromiter(map(len, unique), np.int64, len(unique))
    owner = np.repeat(np.arange(len(unique)), length + 1)
    fm = FMIndex(text, rank[owner], window + 1)
    begin = np.cumsum(length + 1) - (length + 1)
    windows = np.maximum(length - window + 1, 0)
    fragment = np.repeat(np.arange(len(unique)), windows)
    before = np.cumsum(windows) - windows
    matched, low, high = fm.matching(text, begin[fragment] + np.arange(windows.sum()) - np.repeat(before, windows), window, alone=1)
    first = earliest[fragment]  # of a window that occurs only here
    found = np.flatnonzero(matched == window)
    first[found] = documents[fm.earliest(low[found], high[found])]
    row = np.repeat(np.arange(len(index)), sizes)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = first[before[index[row]] + bit] < d[row]
    return np.add.reduceat(hit.astype(np.int64) << bit, np.cumsum(sizes) - sizes)


def _searched(rows: DataFrame, window: int) -> DataFrame:
    """Windows found repeated: d, h, place and a bit for each window from there on."""
    rows = rows.repartition("key").sortWithinPartitions("key", "d")

    def result(table: pa.Table, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(hit := np.flatnonzero(mask)):
            yield pa.RecordBatch.from_arrays([pa.array(table[c].to_numpy()[hit]) for c in ("d", "h", "place")] + [pa.array(mask[hit])], names=["d", "h", "place", "mask"])

    full = lambda table: (1 << table["size"].to_numpy().astype(np.int64)) - 1
    words_in = lambda x: int(x["size"].to_numpy().sum()) + (window - 1) * x.num_rows

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            size, d = table["size"].to_numpy().astype(np.int64), table["d"].to_numpy()
            yield from result(table, search_shard(table["text"].combine_chunks(), size, d, window))

    def thinned(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        """Rows of one key, by document: each different text's first, and the later ones."""
        coded = table["text"].combine_chunks().dictionary_encode().indices.to_numpy()
        d = table["d"].to_numpy()
        earliest = np.full(int(coded.max()) + 1, LAST, np.int64)
        np.minimum.at(earliest, coded, d)
        later = d > earliest[coded]
        return table.filter(pa.array(~later)), table.filter(pa.array(later))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        words = 0
        for batch in slices(batches, NARROW_ROWS):
            settled = batch.column("text").is_null()
            if (done := pa.Table.from_batches([batch.filter(settled)])).num_rows:
                yield from result(done, full(done))
            new = pa.Table.from_batches([batch.filter(pc.invert(settled))])
            held = new if held is None else pa.concat_tables([held, new])
            words += words_in(new)
            if words >= SHARD_WORDS:
                held = held.combine_chunks()
                key = held["key"].to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
                yield from search(held.slice(0, whole))
                held = held.slice(whole)
                if words_in(held) >= SHARD_WORDS:  # one hot window: later rows are repeated
                    held, later = thinned(held)
                    yield from result(later, full(later))
                words = words_in(held)
        if held is not None:
            yield from search(held)

    return rows.mapInArrow(run, "d bigint, h bigint, place bigint, mask bigint")


def kept_words(text: bytes, places: np.ndarray, masks: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the others joined by single spaces."""
    words = text.split()
    n = len(words)
    if not len(places):
        return n, 0, b" ".join(words)
    cover = np.zeros(n + 1, np.int64)
    for k in range(int(masks.max()).bit_length()):
        hit = places[(masks >> k & 1) == 1] + k
        if len(hit):
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
    keep = np.cumsum(cover)[:n] == 0
    return n, int(n - keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` and the columns named in carry.

    A word is removed if a window of ``window`` words that covers it also starts
    in a document of smaller id; kept is the rest, joined by single spaces (with
    untouched, a text that loses nothing stays as it is).  Windows are judged on
    the input.  A null text has no words.  A null id counts as larger than all
    others; rows that repeat an id do not count as earlier than each other and
    stay rows of their own, with equal results where their texts are equal.
    """
    gram = max(min(gram, window), window - MOST_WINDOWS + 1)
    text = F.col(text_col).cast("binary")
    named = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("d"),
        F.xxhash64(text).alias("h"),  # tells apart the texts of one id
        text.alias("text"),
        F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("rest"),
    )
    texts = named.select("d", "h", F.coalesce("text", F.lit(b"")).alias("text"))
    shared = materialise(_shared_rows(_fragment_rows(texts, window, gram)), "fragments", SENT_ROWS)
    asked = shared.filter("probe").groupBy("d", "h").agg(F.collect_set(F.struct("place", "size", "anchor", "hot")).alias("asked"))
    found = _searched(_fragment_texts(texts.join(asked, ["d", "h"]), window), window)
    full = shared.filter("not probe").select("d", "h", "place", (F.expr("shiftleft(1L, size)") - 1).alias("mask"))
    marks = materialise(found.unionAll(full), "marks", SENT_ROWS)
    release(shared)
    marks = marks.groupBy("d", "h").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    joined = named.join(marks, ["d", "h"], "left").select("text", "marks", "rest")
    rest = joined.schema["rest"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = batch.column(1).flatten()
            place, mask = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("place", "mask"))
            count = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(count)
            out = [kept_words(t or b"", place[b - n : b], mask[b - n : b], window) for t, n, b in zip(batch.column(0).to_pylist(), count.tolist(), ends.tolist(), strict=True)]
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["rest", "n_words", "n_removed", "kept"])

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for out in run(iter([batch])):
                kept = pc.if_else(pc.equal(out.column(2), 0), batch.column(0), out.column(3))
                yield pa.RecordBatch.from_arrays([*out.columns[:3], kept], names=out.schema.names)

    done = joined.mapInArrow(run_whole if untouched else run, f"rest {rest.simpleString()}, n_words bigint, n_removed bigint, kept binary")
    return done.select(
        F.col("rest.id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), *[F.col(f"rest.c{k}").alias(c) for k, c in enumerate(carry)]
    )
