"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order.  Layout:

    data blocks | block index | Bloom filter | footer

A data block is a zstandard frame over entries ``shared, unshared, size`` (three
varints), the key's last ``unshared`` bytes and the value; ``shared`` bytes of
the key are those of the entry before it.  The block index has one entry per
block (first key, offset, stored size), so a lookup is a Bloom test, a binary
search of the index and one block.  The footer is of fixed size and ends in MAGIC.

Values are ids of 2 or 4 bytes, little-endian, as the vocabulary needs.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sextant.llm.common import ENCODED_ROWS, materialise, scratch_path, slices

MAGIC = b"SXTSST01"
#: index offset, index size, Bloom offset, Bloom size, entries, width of an id, hashes, magic.
FOOTER = struct.Struct("<QQQQQBB8s")
BLOCK_BYTES = 64 * 1024
BITS_PER_KEY = 10
HASHES = 7


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, on the driver or on an executor."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


def integer_key(x: int | None) -> bytes:
    """Eight bytes that sort as the integers do; null sorts first, as no bytes."""
    return b"" if x is None else struct.pack(">Q", (x + (1 << 63)) & ((1 << 64) - 1))


def key_integer(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(out: bytearray, x: int) -> None:
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _digest(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key, seed=0)
    return h & 0xFFFFFFFF, h >> 32 | 1


class Writer:
    """Writes one shard; keys must come in ascending order, equal keys may repeat."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.compressor = zstandard.ZstdCompressor(level=1)
        self.block, self.first, self.last = bytearray(), None, b""
        self.index = bytearray()
        self.digests: list[tuple[int, int]] = []
        self.at = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            if key < self.last:
                raise ValueError("keys must ascend")
            shared = next((k for k, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        for x in (shared, len(key) - shared, len(ids)):
            _varint(self.block, x)
        self.block += key[shared:]
        self.block += ids
        self.last = key
        self.digests.append(_digest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        stored = self.compressor.compress(bytes(self.block))
        self.out.write(stored)
        _varint(self.index, len(self.first))
        self.index += self.first
        _varint(self.index, self.at)
        _varint(self.index, len(stored))
        self.at += len(stored)
        self.block, self.first, self.last = bytearray(), None, b""

    def close(self) -> None:
        self._flush()
        n = len(self.digests)
        size = max(8, (n * BITS_PER_KEY + 7) // 8 * 8)
        bits = np.zeros(size, bool)
        if n:
            a, b = (np.array([d[k] for d in self.digests], np.uint64) for k in (0, 1))
            for k in range(HASHES):
                bits[((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64)] = True
        bloom = np.packbits(bits, bitorder="little").tobytes()
        self.out.write(bytes(self.index))
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(bloom), n, self.width, HASHES, MAGIC))
        self.out.close()


class Reader:
    """Looks keys up in a shard, or scans it in key order, a block at a time."""

    def __init__(self, uri: str):
        import zstandard

        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.entries, self.width, self.hashes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        self.decompressor = zstandard.ZstdDecompressor()
        self.file.seek(index_at)
        index = self.file.read(index_size)
        self.file.seek(bloom_at)
        self.bloom = np.unpackbits(np.frombuffer(self.file.read(bloom_size), np.uint8), bitorder="little")
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        at = 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.first.append(bytes(index[at : at + n]))
            offset, at = _read_varint(index, at + n)
            stored, at = _read_varint(index, at)
            self.blocks.append((offset, stored))

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, stored = self.blocks[k]
        self.file.seek(offset)
        data = self.decompressor.decompress(self.file.read(stored))
        at, key, kind = 0, b"", f"<u{self.width}"
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, kind, size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key; none if it isn't there."""
        if not self.entries:
            return []
        a, b = _digest(key)
        if not all(self.bloom[(a + k * b) % len(self.bloom)] for k in range(self.hashes)):
            return []
        k = max(0, bisect.bisect_left(self.first, key) - 1)
        found = []
        while k < len(self.first) and self.first[k] <= key:
            found += [ids for x, ids in self._block(k) if x == key]
            k += 1
        return found

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Shards:
    """A written table: its folder, and a manifest with a row per shard (shard,
    path, n_docs, n_tokens).  Files that a failed task left are in no manifest."""

    folder: str
    manifest: DataFrame


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Encode every text and write the ids as shards in ascending key order.

    One range shuffle by the integer id; equal ids are ordered by text, null ids
    and null texts first.  A null text is empty: it has the end id only.  Each
    task streams its sorted rows into one shard of its own name.
    """
    from sextant.llm.encoding import encoder

    folder = folder or scratch_path(docs.sparkSession, "sst")
    rows = docs.select(F.col(id_col).cast("bigint").alias("k_id"), F.col(text_col).alias("k_text"))
    rows = rows.repartitionByRange("k_id").sortWithinPartitions("k_id", "k_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, path, tokens = TaskContext.get().partitionId(), None, "", 0
        coder = encoder(tokenizer_path)
        width = 2 if max(coder.vocabulary_size(), end_id + 1) <= 1 << 16 else 4
        for batch in slices(batches, ENCODED_ROWS):
            ids, bounds = coder.encode(batch.column(1))
            for k, key in enumerate(batch.column(0).to_pylist()):
                if writer is None:
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    store, where = open_store(path)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    writer = Writer(store.open_output_stream(where), width)
                value = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype(f"<u{width}")
                writer.add(integer_key(key), value.tobytes())
                tokens += len(value)
        if writer is not None:
            n = len(writer.digests)
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": n, "n_tokens": tokens}], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = rows.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_tokens bigint")
    return Shards(folder, materialise(manifest, "sst-manifest", ENCODED_ROWS))


def read_shards(shards: Shards) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    start counts the ids of all documents before it.  The window that adds up
    the shards sees one row per shard.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = max(1, shards.manifest.count())
    rows = shards.manifest.select("shard", "path", before.alias("base")).repartition(n, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, at, out = Reader(row["path"]), row["base"], []
                for key, ids in reader.scan():
                    out.append((key_integer(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                reader.close()
                if out:
                    yield _rows(out)

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
