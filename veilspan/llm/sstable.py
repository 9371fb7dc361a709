"""Token-ID output as sorted-string-table shards.

A shard is one file:

* data blocks: entries in key order, each ``varint shared, varint unshared, varint value length, key
  suffix, value`` (keys prefix-compressed within the block), the block compressed by Zstandard;
* an index block with the last key, offset and length of every data block (sparse: one key a block);
* a Bloom filter over the document ids;
* a footer of fixed length with the place of both, counts, the id width and a magic number.

A key is ``0x00`` for a null id, else ``0x01`` and the id as big-endian offset binary, then the
text's hash and a counter, so repeated ids stay apart and bytewise order is id order.  A value is the
document's token ids as little-endian unsigned 16- or 32-bit integers.

Shards are written by Spark's text writer, which puts one byte, a line feed, after every row; the
format counts it as the terminator of each section.  The writer starts a new file after a fixed
number of rows, and a task a new shard after as many sections, so shards are of bounded size whatever
the partitions are.  That keeps Spark's commit protocol (a task that
is run again leaves no second file) and works on any file system that Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.chunked_encoding import encoder
from veilspan.llm.common import scratch_path, staged

MAGIC = b"VSSTIDS1"
_FOOTER = struct.Struct("<QIQIIQQB7x8s")
BLOCK_BYTES = 64 << 10
#: Data blocks of a shard, so 128 MB before compression (a document longer than a block is one block);
#: with index, filter and footer that is the number of rows that Spark's writer puts into a file.
SHARD_BLOCKS = 2048
_OTHER_SECTIONS = 3
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None, text_hash: int = 0, nth: int = 0) -> bytes:
    if doc_id is None:
        return b"\0" + struct.pack(">QI", text_hash & (1 << 64) - 1, nth)
    return b"\1" + struct.pack(">QQI", doc_id + (1 << 63), text_hash & (1 << 64) - 1, nth)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack_from(">Q", key, 1)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(doc_id: int | None, bits: int) -> Iterator[int]:
    h = 0x9E3779B97F4A7C15 if doc_id is None else doc_id & (1 << 64) - 1
    for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = ((h ^ h >> 30) * c) & (1 << 64) - 1
    h ^= h >> 31
    step = h >> 32 | 1
    return ((h + i * step) % bits for i in range(BLOOM_HASHES))


class ShardWriter:
    """Takes entries in key order and gives the file's sections, each without its terminator."""

    def __init__(self, width: int, closed_before: bool = False):
        self.width, self.offset = width, 0
        self.closed_before = closed_before  # a shard of the same task, so an empty one more is left out
        self.entries, self.size, self.last = [], 0, b""
        self.index: list[bytes] = []
        self.ids: list[int | None] = []
        self.n_tokens = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared = 0
        if self.entries:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        self.entries += (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value)
        self.size += len(value) + len(key)
        self.last = key
        self.ids.append(id_of(key))
        self.n_tokens += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            yield self._block()

    def _section(self, data: bytes) -> tuple[int, bytes]:
        at, self.offset = self.offset, self.offset + len(data) + 1
        return at, data

    def _block(self) -> bytes:
        at, data = self._section(self.packer.compress(b"".join(self.entries)))
        self.index.append(_varint(len(self.last)) + self.last + _varint(at) + _varint(len(data)))
        self.entries, self.size = [], 0
        return data

    def finish(self) -> Iterator[bytes]:
        if self.entries:
            yield self._block()
        index_at, index = self._section(b"".join(self.index))
        yield index
        bits = max(64, -(-len(self.ids) * BLOOM_BITS_PER_KEY // 8) * 8)
        bloom = bytearray(bits // 8)
        for i in self.ids:
            for p in _bloom_places(i, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at, data = self._section(bytes(bloom))
        yield data
        yield _FOOTER.pack(index_at, len(index), bloom_at, len(data), len(self.index), len(self.ids), self.n_tokens, self.width, MAGIC)


class ShardReader:
    """A shard by random access: ``read(offset, length)`` gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        foot = read(size - _FOOTER.size - 1, _FOOTER.size + 1)
        index_at, index_n, bloom_at, bloom_n, blocks, self.n_docs, self.n_tokens, self.width, magic = _FOOTER.unpack(foot[:-1])
        if magic != MAGIC or foot[-1:] != b"\n":
            raise ValueError("not a token shard, or cut short")
        self.bloom = read(bloom_at, bloom_n)
        index, at = read(index_at, index_n), 0
        self.last_keys, self.places = [], []
        for _ in range(blocks):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            offset, at = _read_varint(index, at + n)
            n, at = _read_varint(index, at)
            self.places.append((offset, n))
        self.unpacker = zstandard.ZstdDecompressor()

    @classmethod
    def of(cls, data: bytes) -> ShardReader:
        return cls(lambda at, n: data[at : at + n], len(data))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, n = self.places[k]
        data = self.unpacker.decompressobj().decompress(self.read(offset, n))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            fresh, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + fresh]
            at += fresh
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def may_hold(self, doc_id: int | None) -> bool:
        bits = len(self.bloom) * 8
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(doc_id, bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that id: Bloom filter, binary search of the index, block scan."""
        out: list[np.ndarray] = []
        if self.may_hold(doc_id):
            for k in range(bisect_left(self.last_keys, key_of(doc_id)[: 9 if doc_id is not None else 1]), len(self.places)):
                for key, value in self.block(k):
                    if id_of(key) == doc_id:
                        out.append(self.ids(value))
                    elif out or key > key_of(doc_id, -1, (1 << 32) - 1):
                        return out
        return out


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_blocks: int = SHARD_BLOCKS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes shards of up to ``shard_blocks`` blocks
    under ``path``.

    Shards hold ranges of ascending ids in the order of their files' partition and file numbers.  Null text counts as empty (the end id
    alone), null ids come first, repeated ids are all kept in an order fixed by the text's hash.
    Other columns are ignored.  An empty table gives no shard, or one without entries.
    """
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("id", "h")
        .sortWithinPartitions("id", "h")
    )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), struct.pack("<I", end_id)
        narrow = max(end_id, enc.tokenizer.get_vocab_size(with_added_tokens=True)) < 1 << 16
        out = ShardWriter(2 if narrow else 4)
        last, nth = None, 0
        for b in batches:
            for i, text, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                value = enc.encode(text.as_py()) + end
                if narrow:
                    value = np.frombuffer(value, "<u4").astype("<u2").tobytes()
                nth = nth + 1 if (i, h) == last else 0
                last = (i, h)
                for x in out.add(key_of(i, h, nth), value):
                    yield pa.record_batch({"section": [x]})
                if len(out.index) == shard_blocks:
                    for x in out.finish():
                        yield pa.record_batch({"section": pa.array([x], pa.binary())})
                    out = ShardWriter(out.width, closed_before=True)
        if out.ids or not out.closed_before:
            for x in out.finish():
                yield pa.record_batch({"section": pa.array([x], pa.binary())})

    sections = rows.mapInArrow(shard, "section binary").select(F.col("section").cast("string"))
    sections.write.option("maxRecordsPerFile", shard_blocks + _OTHER_SECTIONS).text(path)


def _shards(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_token_shards(spark, path: str) -> DataFrame:
    """One row per document, from the shards alone: shard, position there, doc_id, ids (binary,
    little-endian unsigned 32-bit)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = ShardReader.of(content.as_py()) if len(content.as_py()) else ()
                rows: list[tuple] = []
                size = 0
                for k, (key, value) in enumerate(shard):
                    rows.append((name, k, id_of(key), shard.ids(value).astype("<u4").tobytes()))
                    size += len(rows[-1][3])
                    if size > 8 << 20:
                        yield _entries(rows)
                        rows, size = [], 0
                yield _entries(rows)

    return _shards(spark, path).mapInArrow(entries, "shard string, position long, doc_id long, ids binary")


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    s, p, d, i = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.record_batch([pa.array(s, pa.string()), pa.array(p, pa.int64()), pa.array(d, pa.int64()), pa.array(i, pa.binary())], ["shard", "position", "doc_id", "ids"])


def token_index(docs: DataFrame, tokenizer: str, end_id: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Writes the shards, reads them back and returns doc_id, start, n_tokens, ids_crc32, shard.

    ``start`` needs the sizes of all earlier shards: one row per shard is summed in key order; the
    documents' own sums stay within their shard.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_token_shards(docs, path, tokenizer, end_id, shard_blocks=shard_blocks)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content, at = content.as_py(), 0
                docs, starts, sizes, crcs = [], [], [], []
                shard = ShardReader.of(content) if content else ()
                for key, value in shard:
                    ids = shard.ids(value).astype("<u4")
                    docs.append(id_of(key))
                    starts.append(at)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids))
                    at += len(ids)
                yield pa.record_batch([pa.array([name] * len(docs), pa.string()), *[pa.array(c, pa.int64()) for c in (docs, starts, sizes, crcs)]], ["shard", "doc_id", "own_start", "n_tokens", "ids_crc32"])

    found = staged(_shards(spark, path).mapInArrow(digest, "shard string, doc_id long, own_start long, n_tokens long, ids_crc32 long"), "token-index")
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # part-<partition>-<name>-c<file>
    place = [F.regexp_extract("shard", p, 1).cast("long").alias(c) for p, c in ((r"/part-(\d+)-[^/]*$", "part"), (r"-c(\d+)\.[^/]*$", "file"))]
    base = sizes.select("shard", "n", *place).selectExpr("shard", "sum(n) OVER (ORDER BY part, file ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS base")
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("own_start")).cast("long").alias("start"), "n_tokens", "ids_crc32", "shard")
