"""Token ids in sorted-string-table shards, keyed by document identifier.

A shard is one file in the shared folder::

    magic
    block*        zstd; entries (shared, rest, length varints, rest of key, value);
                  keys are prefix-compressed against the entry before
    index         of every block: first key, offset, length      (sparse: one key a block)
    bloom         bits over all keys
    footer        offsets and lengths of index and bloom, entries, ids, id width, crc, magic

Shards hold disjoint ascending ranges of keys, so a lookup is: manifest -> shard,
Bloom filter, binary search in the index, one block.

Ids are dealt by range over (id, hash of the ids), so one repeated id doesn't land in
one task; rows with equal id lie next to each other, ordered by that hash. A null id
sorts first. A null or empty text has the end id only. Other columns aren't read.
An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, open_fs, pack, pack_ints, scale_parts, small_batches, unpack, unpack_ints, write_atomically
from .wordbpe import default_vocabulary, encoder

MAGIC = b"PGSST\x01"
FOOTER = struct.Struct("<QQQQQQBI")
#: Uncompressed bytes of a block, bits of Bloom filter a key.
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 10, 7


def key_bytes(value) -> bytes:
    """Bytes that sort as the values do: null, then numbers, then strings."""
    if value is None:
        return b"\x00"
    if isinstance(value, int):
        return b"\x01" + (value + (1 << 63)).to_bytes(8, "big")
    return b"\x02" + str(value).encode()


def key_value(key: bytes):
    if key[0] == 0:
        return None
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] == 1 else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_at(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), "<u8").reshape(-1, 2)
    return (h[:, :1] + np.arange(BLOOM_HASHES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(bits)


class ShardWriter:
    """Streams one shard: blocks are written as they fill; index and Bloom filter follow."""

    def __init__(self, width: int):
        self.width = width
        self.block, self.first, self.last = bytearray(), None, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.at, self.entries, self.ids = len(MAGIC), 0, 0

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        if not self.entries:
            yield MAGIC
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        for a, b in zip(key, self.last, strict=False):
            if a != b:
                break
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(key)
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            yield from self._flush()

    def _flush(self) -> Iterator[bytes]:
        if self.block:
            data = pack(bytes(self.block))
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block, self.first = bytearray(), None
            yield data

    def finish(self) -> Iterator[bytes]:
        yield from self._flush()
        index = pack(b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index))
        bits = max(64, (self.entries * BLOOM_BITS + 7) // 8 * 8)
        bloom = np.zeros(bits, bool)
        for lo in range(0, len(self.hashes), 65536):
            bloom[_bloom_at(self.hashes[lo : lo + 65536], bits)] = True
        packed = np.packbits(bloom).tobytes()
        yield index + packed
        body = FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.entries, self.ids, self.width, zlib.crc32(index + packed))
        yield body + MAGIC


class Shard:
    """A written shard: lookups by key and a scan in key order."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._read(size - FOOTER.size - len(MAGIC), FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} isn't a complete shard")
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, self.width, crc = FOOTER.unpack(tail[: FOOTER.size])
        raw, packed = self._read(index_at, index_n), self._read(bloom_at, bloom_n)
        if zlib.crc32(raw + packed) != crc:
            raise ValueError(f"{uri}: index or Bloom filter is damaged")
        self.bits = np.frombuffer(packed, np.uint8)
        self.keys, self.blocks, at = [], [], 0
        data = unpack(raw)
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.blocks.append(struct.unpack_from("<QQ", data, at + n))
            at += n + 16

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = unpack(self._read(*self.blocks[block])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.blocks)):
            yield from self._entries(b)

    def may_hold(self, key: bytes) -> bool:
        at = _bloom_at([key], len(self.bits) * 8)[0]
        return bool(np.all(self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1))

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key, usually one: Bloom filter, binary search, then the blocks that can hold it."""
        if not self.keys or not self.may_hold(key):
            return []
        b, out = max(0, bisect.bisect_left(self.keys, key) - 1), []
        while b < len(self.keys) and self.keys[b] <= key:
            out += [v for k, v in self._entries(b) if k == key]
            b += 1
        return out


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 2, shards: int | None = None) -> DataFrame:
    """Encode whole texts and write shards; the manifest has a row for each shard.

    Manifest: shard, uri, entries, ids (long), first, last (id), width (bytes of an id).
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType
    enc_schema = T.StructType([T.StructField("id", kind), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in enc_schema])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            ties = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(ties, pa.int64()), pa.array([pack_ints(np.frombuffer(x, enc.dtype)) for x in ids], pa.binary())], schema=arrow)

    man_schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("uri", T.StringType()), T.StructField("entries", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("width", T.IntegerType())])
    man_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in man_schema])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dtype = encoder(path).dtype
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}.sst"
        out, ends = ShardWriter(dtype.itemsize), []

        def chunks() -> Iterator[bytes]:
            for batch in batches:
                for value, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    ends[1:] = [value]
                    if len(ends) == 1:
                        ends.append(value)
                    yield from out.add(key_bytes(value), unpack_ints(data).astype(dtype).tobytes())
            yield from out.finish()

        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        rest = batches

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from rest

        batches = again()
        ends.append(first.column(0)[0].as_py())
        write_atomically(uri, chunks())
        row = [shard, uri, out.entries, out.ids, ends[0], ends[-1], dtype.itemsize]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, man_arrow, strict=True)], schema=man_arrow)

    ws = Workspace(spark, "sst")
    ids = ws.table(docs.select(id_col, text_col).mapInArrow(encode, enc_schema), "ids")
    dealt = ids.repartitionByRange(shards or scale_parts(spark), "id", "tie").sortWithinPartitions("id", "tie")
    return ws.table(dealt.mapInArrow(write, man_schema), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, ids)`` of every entry, read from the files; start counts all ids before.

    The manifest has a row for each shard, so its running sum is taken on the driver.
    """
    parts, start = [], 0
    for r in manifest.orderBy("shard").collect():
        parts.append((r.uri, start))
        start += r.ids
    out = T.StructType([T.StructField(id_col, manifest.schema["first"].dataType), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                dtype, cols, held = f"<u{shard.width}", ([], [], []), 0
                for key, value in shard.scan():
                    ids = np.frombuffer(value, dtype).astype("<u4").tobytes()
                    for c, x in zip(cols, (key_value(key), at, ids), strict=True):
                        c.append(x)
                    at += len(ids) // 4
                    held += len(ids)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
                        cols, held = ([], [], []), 0
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    files = spark.createDataFrame(parts, "uri string, start long")
    return files.repartition(max(1, len(parts))).mapInArrow(read, out) if parts else spark.createDataFrame([], out)


def lookup(manifest: DataFrame, value) -> list[np.ndarray]:
    """Ids of one document: the manifest names the shards whose range holds it."""
    found = []
    for r in manifest.orderBy("shard").collect():
        if key_bytes(r.first) <= key_bytes(value) <= key_bytes(r.last):
            found += [np.frombuffer(v, f"<u{r.width}") for v in Shard(r.uri).get(key_bytes(value))]
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: write all documents' ids as shards, then describe each document from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, Workspace(spark, "shards").root)
    return read_shards(spark, manifest).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
