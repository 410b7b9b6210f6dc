"""Token ids in sorted-string-table shards.

A shard holds documents in the order of their keys: data blocks with
prefix-compressed keys, a sparse index with one entry per block, a Bloom filter
over the keys, and a footer of fixed size.  All numbers are little-endian.

    block    zlib of: entries, then u32 positions of restarts, then u32 their number
    entry    varint shared, varint unshared, varint value size, rest of key, value
    index    per block: u32 key size, last key, u64 offset, u32 size
    bloom    u32 hashes, then the bits
    footer   u64 index offset, u64 bloom offset, u64 documents, u64 tokens, u32 width of an id, u32 crc32 of index and bloom, 8 bytes magic

A key is one byte (0: no id, 1: id) and eight bytes of the id that sort as the
number does; eight of the text's hash and eight of a row number follow, by
which rows of one id have keys of their own, in whichever shards they come to
lie.  The Bloom filter holds the first nine bytes.  A value is the document's
ids, 2 or 4 bytes each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, materialize
from .tokens import Encoder, slices

MAGIC = b"OSSTAB01"
FOOTER = struct.Struct("<QQQQII8s")
BLOCK = 1 << 16
RESTART = 16
SHARD = 32 << 20
#: Documents to a shard at most, so that keys of tiny ones stay few in memory.
SHARD_DOCS = 1 << 18
#: Shards that one task reads, where there are many.
READ = 8
ID = 9
BLOOM_BITS = 10


def key_of(doc_id: int | None, order: int = 0, row: int = 0) -> bytes:
    """The key of a row; its first ``ID`` bytes are those of the identifier."""
    sort = lambda n: (n + (1 << 63)) & ((1 << 64) - 1)
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">QQ", sort(order), row)
    return b"\1" + struct.pack(">QQQ", sort(doc_id), sort(order), row)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(hashed: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Places in the filter of keys hashed to 64 bits, a row of ``hashes`` places a key."""
    a, b = hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _hashed(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key[:ID])


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, width: int = 2):
        self.width, self.out, self.hashed, self.index = width, [], [], []
        self.size = self.docs = self.tokens = 0
        self.block, self.restarts, self.fill, self.n, self.first, self.last = [], [], 0, 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.docs and key <= self.last:
            raise ValueError("keys must ascend")
        self.first = self.first or key
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(self.fill)
        else:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self.block.append(entry)
        self.fill += len(entry)
        self.n += 1
        if not self.docs or key[:ID] != self.last[:ID]:
            self.hashed.append(_hashed(key))
        self.last = key
        self.docs += 1
        self.tokens += len(value) // self.width
        if self.fill >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.n:
            raw = b"".join((*self.block, struct.pack(f"<{len(self.restarts)}I", *self.restarts), struct.pack("<I", len(self.restarts))))
            packed = zlib.compress(raw, 1)
            self.index.append((self.last, self.size, len(packed)))
            self.out.append(packed)
            self.size += len(packed)
            self.block, self.restarts, self.fill, self.n = [], [], 0, 0

    def close(self) -> bytes:
        self.flush()
        index = b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits, hashes = max(64, BLOOM_BITS * len(self.hashed)), 7
        filled = np.zeros(-(-bits // 8) * 8, bool)
        filled[_probes(np.array(self.hashed, np.uint64), bits, hashes).ravel().astype(np.int64)] = True
        filled = np.packbits(filled, bitorder="little")
        bloom = struct.pack("<IQ", hashes, bits) + filled.tobytes()
        tail = FOOTER.pack(self.size, self.size + len(index), self.docs, self.tokens, self.width, zlib.crc32(index + bloom), MAGIC)
        return b"".join((*self.out, index, bloom, tail))


class Shard:
    """Reads a shard: ``get`` by Bloom filter and binary search, ``scan`` in order."""

    def __init__(self, path: str):
        system, where = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(where)
        end = self.file.size()
        if end < FOOTER.size:
            raise ValueError(f"{path} is not a shard")
        index, bloom, self.docs, self.tokens, self.width, crc, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        tail = self._at(index, end - FOOTER.size - index)
        if zlib.crc32(tail) != crc:
            raise ValueError(f"{path} is damaged")
        self.last, self.blocks, at = [], [], 0
        while at < bloom - index:
            (n,) = struct.unpack_from("<I", tail, at)
            self.last.append(tail[at + 4 : at + 4 + n])
            self.blocks.append(struct.unpack_from("<QI", tail, at + 4 + n))
            at += 16 + n
        self.hashes, self.bits = struct.unpack_from("<IQ", tail, at)
        self.bloom = tail[at + 12 :]

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...], int]:
        raw = zlib.decompress(self._at(*self.blocks[k]))
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * n
        return raw, struct.unpack_from(f"<{n}I", raw, end), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _number(raw, at)
            rest, at = _number(raw, at)
            size, at = _number(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest + size
            yield key, raw[at - size : at]

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def may_hold(self, key: bytes) -> bool:
        """Whether the filter may hold the key's identifier."""
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(np.array([_hashed(key)], np.uint64), self.bits, self.hashes)[0].tolist())

    def find(self, doc_id: int | None) -> Iterator[np.ndarray]:
        """The documents of an identifier in this shard, in order."""
        wanted = key_of(doc_id)[:ID]
        if not self.may_hold(wanted):
            return
        for k in range(bisect_left(self.last, wanted), len(self.blocks)):
            raw, restarts, end = self._block(k)
            lo, hi = 0, len(restarts)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if next(self._entries(raw, restarts[mid], end))[0] < wanted:
                    lo = mid
                else:
                    hi = mid
            for found, value in self._entries(raw, restarts[lo], end):
                if found[:ID] > wanted:
                    return
                if found[:ID] == wanted:
                    yield self.ids(value)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The first document of an identifier in this shard."""
        return next(self.find(doc_id), None)

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            raw, _, end = self._block(k)
            for key, value in self._entries(raw, 0, end):
                yield key, self.ids(value)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, shard_bytes: int = SHARD, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes shards in ascending
    order of doc_id.  Returns the manifest: path, part, nth (the shards' order),
    n_docs, n_tokens, first_key, last_key, start (tokens of all shards before).

    A null text counts as empty and has the end id alone; a null id comes
    first; rows of one id are all kept, in the order of their texts' hashes,
    and copies after them as they lie in the table, each under a key of its
    own; very many of them are dealt to several tasks.  Other columns aren't
    read.  Files have names that no other attempt at a task uses, and only
    those in the manifest count, so a task may be run again.  An empty table
    gives an empty manifest.
    """
    folder = folder or fresh_path(docs.sparkSession, "sstable")

    def run(batches):
        encoder = Encoder.of(tokenizer, "spaced")
        part, nth, writer = TaskContext.get().partitionId(), 0, Writer()
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)

        def end():
            name = f"part-{part:06d}-{nth:04d}-{uuid.uuid4().hex}.sst"
            with system.open_output_stream(f"{where}/{name}") as f:
                f.write(writer.close())
            row = (f"{folder}/{name}", part, nth, writer.docs, writer.tokens, writer.first, writer.last)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["path", "part", "nth", "n_docs", "n_tokens", "first_key", "last_key"])

        for batch in batches:
            for b in slices(batch):
                ids, at = encoder.encode(b.column(3))
                for i, of in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                    writer.add(key_of(*of), np.append(ids[at[i] : at[i + 1]], np.uint16(end_id)).astype("<u2").tobytes())
                    if writer.size + writer.fill >= shard_bytes or writer.docs >= shard_docs:
                        yield end()
                        nth, writer = nth + 1, Writer()
        if writer.docs:
            yield end()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"), "text")
    # Where one id has very many rows, the hash splits them, and copies their numbers.
    rows = rows.repartitionByRange("doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h", "_row")
    schema = "path string, part int, nth int, n_docs long, n_tokens long, first_key binary, last_key binary"
    manifest = materialize(arrow_map(rows, run, schema), "manifest")
    # One row per shard, hundreds of thousands of documents each: a single ordered sum is small.
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: doc_id, start (ids before it), n_tokens, ids (unsigned 32-bit, little-endian)."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                docs, starts, sizes, blobs, held = [], [], [], [], 0
                for key, ids in shard.scan():
                    docs.append(id_of(key))
                    starts.append(base)
                    sizes.append(len(ids))
                    blobs.append(ids.tobytes())
                    base += len(ids)
                    held += len(ids)
                    if held > 1 << 21:
                        yield out(docs, starts, sizes, blobs)
                        docs, starts, sizes, blobs, held = [], [], [], [], 0
                shard.close()
                if docs:
                    yield out(docs, starts, sizes, blobs)

    def out(docs, starts, sizes, blobs):
        return pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    shards = manifest.count()
    # A task for each shard as long as that only keeps all cores busy, then one for several.
    n = max(1, min(shards, max(-(-shards // READ), 2 * manifest.sparkSession.sparkContext.defaultParallelism)))
    rows = manifest.select("path", "start").repartition(n)
    return arrow_map(rows, run, "doc_id long, start long, n_tokens long, ids binary")
