"""Dropping repeated lines by a sharded minimal perfect hash.

1. Lines' keys are hashed to 128 bits; Spark counts the documents of each hash and its
   largest document id (partial sums before the shuffle, so a hot line is no hot task).
2. Hashes found in enough documents are dealt to shards. A shard is a minimal perfect
   hash over its hashes with arrays at the hash's slot: fingerprint (the other 64 bits),
   count, keeper. It is one file in the shared folder.
3. Documents probe the arrays; no row per line is joined. An index of up to CACHE_BYTES
   is held by each worker as it reads the documents again. Beyond that the lines' hashes
   are dealt to the shards, packed, a row for each (page, shard), and the answers come
   back to the page by position; a page is a run of documents of one task, which waits
   in a file. So a shard is read by the tasks that answer for it, not by all.

A shard has at most about SHARD_KEYS keys of 20 bytes.

Edge cases: a null or empty text is one empty line. Each row is a document of its own,
also where ids repeat: then every row with the largest id keeps its line. A null id is
never the largest; if all holders' ids are null, nothing is dropped. Ties and repeated
lines within a document share their fate. A very long text is held whole by one worker,
and so is the batch of documents that it comes with (bounded in bytes by
``small_batches``). Columns named in ``extra`` are carried as they are, also such as are
named like the operator's own; others aren't read. An empty table gives an empty result.
The input must give the same rows in the same order when a task is run again, as a
stored table does.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, mix64, pack_sorted, read_bytes, scale_parts, small_batches, unpack_sorted, write_atomically

SHARD_KEYS, CACHE_BYTES = 500_000, 128 << 20
#: Bytes of a page; bytes of the index for a line, with the hash's bits.
PAGE_BYTES, LINE_BYTES = 16 << 20, 24
#: Tasks that answer for a shard.
SALTS = 8
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """ASCII white space stripped, A-Z lower-cased."""
    s = line.strip(SPACE)
    return s.lower() if s.isascii() else s.encode().lower().decode()


def _hashes(keys: list[str]) -> np.ndarray:
    """128 bits a key, as two signed 64-bit columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), "<i8").reshape(-1, 2)


class PerfectHash:
    """A minimal perfect hash over 64-bit keys: at each level the keys that are alone in
    their cell get its bit; the others go on. The slot is the rank of the bit. Keys that
    can't be told apart (equal 64 bits) are left over and listed.
    """

    LEVELS, ROOM = 24, 2

    def __init__(self, bits: list[np.ndarray], sizes: list[int], rest: np.ndarray):
        self.sizes, self.rest = sizes, rest
        self.bits = bits
        self.ranks, at = [], 0
        for b in bits:
            counts = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(at + np.cumsum(counts) - counts)
            at += int(counts.sum())
        self.size = at + len(rest)

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, sizes = [], []
        while len(keys) and len(bits) < cls.LEVELS:
            size = max(64, cls.ROOM * len(keys))
            cell = cls._cell(keys, len(bits), size)
            alone = np.bincount(cell.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view("<u8"))
            keys = keys[~alone[cell.astype(np.int64)]]
        return cls(bits, sizes, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key; keys that weren't built in get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(left):
                return out
            cell = self._cell(keys[left], level, size)
            word, bit = (cell >> np.uint64(6)).astype(np.int64), cell & np.uint64(63)
            hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            out[left[hit]] = ranks[w] + np.bitwise_count(bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.searchsorted(self.rest, keys[left])
            same = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[left])
            out[left[same]] = self.size - len(self.rest) + at[same]
        return out


class LineIndex:
    """One shard: the perfect hash and its arrays."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray, keeps: np.ndarray):
        self.hash, self.prints, self.counts, self.keeps = hash_, prints, counts, keeps
        self.nbytes = prints.nbytes + counts.nbytes + keeps.nbytes + sum(b.nbytes * 2 for b in hash_.bits)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keeps: np.ndarray) -> LineIndex:
        ph = PerfectHash.build(h1.view(np.uint64))
        slot = ph.slots(h1.view(np.uint64))
        if ph.size > len(ph.rest):  # equal 64 bits twice: left-over keys follow their sorted order
            for k in np.unique(ph.rest):
                at = np.flatnonzero(h1.view(np.uint64) == k)
                slot[at] = slot[at] + np.arange(len(at))
        out = [np.zeros(ph.size, a.dtype) for a in (h2, counts, keeps)]
        for to, a in zip(out, (h2, counts, keeps), strict=True):
            to[slot] = a
        return cls(ph, *out)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not held) and keeper of each hash."""
        if not self.hash.size:
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        slot = self.hash.slots(h1.view(np.uint64))
        rest = self.hash.size - len(self.hash.rest)
        for i in np.flatnonzero(slot >= rest):  # walk over the few equal 64 bits
            s = slot[i]
            while s < self.hash.size - 1 and self.prints[s] != h2[i] and self.hash.rest[s + 1 - rest] == self.hash.rest[s - rest]:
                s += 1
            slot[i] = s
        ok = (slot >= 0) & (self.prints[np.maximum(slot, 0)] == h2)
        at = np.where(ok, slot, 0)
        return np.where(ok, self.counts[at], 0).astype(np.int64), self.keeps[at]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, counts=self.counts, keeps=self.keeps, rest=self.hash.rest, sizes=np.array(self.hash.sizes, np.int64), **{f"b{i}": b for i, b in enumerate(self.hash.bits)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LineIndex:
        z = np.load(io.BytesIO(data))
        sizes = z["sizes"].tolist()
        return cls(PerfectHash([z[f"b{i}"] for i in range(len(sizes))], sizes, z["rest"]), z["prints"], z["counts"], z["keeps"])


class _Shards(dict):
    """Loads shards as they are met."""

    def __init__(self, folder: str):
        self.folder = folder

    def __missing__(self, shard: int) -> LineIndex:
        self[shard] = index = LineIndex.load(read_bytes(f"{self.folder}/{shard:06d}.mph"))
        return index


def _line_hashes(min_chars: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for k in map(line_key, set(text.split("\n"))) if len(k) >= min_chars} if text else ()
                keys += own
                docs += [doc] * len(own)
            h = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64())], schema=schema)

    return run


def build_index(docs: DataFrame, folder: str, id_col: str, text_col: str, min_docs: int, min_chars: int) -> tuple[int, int]:
    """Write the shards of all frequent lines; returns how many shards and lines."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, doc long")
    found = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keep")).filter((F.col("n") >= min_docs) & F.col("keep").isNotNull())
    ws = Workspace(spark, "lines")
    found = ws.table(found, "frequent")
    lines = found.count()
    shards = max(1, -(-lines // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        shard = int(table.column("shard")[0].as_py())
        cols = [table.column(c).to_numpy() for c in ("h1", "h2", "n", "keep")]
        write_atomically(f"{folder}/{shard:06d}.mph", [LineIndex.build(cols[0].astype(np.int64), cols[1].astype(np.int64), cols[2].astype(np.uint32), cols[3].astype(np.int64)).dump()])
        return pa.table({"shard": pa.array([shard], pa.int64())})

    dealt = found.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long"))
    done = {r.shard for r in dealt.groupBy("shard").applyInArrow(build, "shard long").collect()}
    empty = np.zeros(0, np.int64)
    for shard in range(shards):
        if shard not in done:
            write_atomically(f"{folder}/{shard:06d}.mph", [LineIndex.build(empty, empty, empty.astype(np.uint32), empty).dump()])
    return shards, lines


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, extra: Sequence[str] = ()) -> DataFrame:
    """``(id_col, *extra, n_lines, n_dropped, kept)``: kept is the text without repeated lines.

    A line goes if its key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents, except in the document with the largest id. ``extra``
    columns come as one struct named ``row``, so their names can't clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = Workspace(spark, "line-index").root
    shards, frequent = build_index(docs, folder, id_col, text_col, min_docs, min_chars)
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *([F.struct(*extra).alias("row")] if extra else []))
    out = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()), *([source.schema["row"]] if extra else [])])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def without(batch: pa.RecordBatch, lines: list[list[str]], drop: list[set[int]]) -> pa.RecordBatch:
        kept = ["\n".join([x for j, x in enumerate(own) if j not in gone]) if gone else "\n".join(own) for own, gone in zip(lines, drop, strict=True)]
        cols = [batch.column(0), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in drop], pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(cols + ([batch.column(2).cast(arrow.field(4).type)] if extra else []), schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Shards(folder)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lines = _lines(batch)
            h, doc, line = _long_lines(lines, min_chars)
            shard = h[:, 0] % shards
            drop: list[set[int]] = [set() for _ in lines]
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                counts, keeps = index[s].find(np.ascontiguousarray(h[own, 0]), np.ascontiguousarray(h[own, 1]))
                for x in np.flatnonzero(counts > 0).tolist():
                    if ids[doc[own[x]]] != int(keeps[x]):
                        drop[doc[own[x]]].add(line[own[x]])
            yield without(batch, lines, drop)

    if frequent * LINE_BYTES <= CACHE_BYTES:
        return source.mapInArrow(run, out)
    parts = scale_parts(spark)
    asked = source.mapInArrow(_asked(folder, shards, min_chars), _PROBES_DDL)
    asked = asked.repartition(parts, "shard", F.pmod("page", F.lit(SALTS))).sortWithinPartitions("shard")
    answers = asked.mapInArrow(_answered(folder), _PROBES_DDL).repartition(parts, "page").sortWithinPartitions("page")
    return answers.mapInArrow(_pages_without(folder, without, min_chars), out)


_PROBES = pa.schema([("page", pa.int64()), ("shard", pa.int64()), ("at", pa.binary()), ("h", pa.binary())])
_PROBES_DDL = "page long, shard long, at binary, h binary"


def _lines(batch: pa.RecordBatch) -> list[list[str]]:
    return [(t or "").split("\n") for t in batch.column(1).to_pylist()]


def _long_lines(lines: list[list[str]], min_chars: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Hashes of the lines whose keys are long enough, with their documents and places."""
    keys, doc, line = [], [], []
    for i, own in enumerate(lines):
        for j, x in enumerate(own):
            if len(x) >= min_chars and len(k := line_key(x)) >= min_chars:
                keys.append(k)
                doc.append(i)
                line.append(j)
    return _hashes(keys), doc, line


def _page_uri(folder: str, page: int) -> str:
    return f"{folder}/page-{page >> 24:06d}-{page & 0xFFFFFF:06d}.arrow"


def _asked(folder: str, shards: int, min_chars: int):
    """Documents to their page's file, and its lines' hashes by shard; ``at`` counts the page's long lines."""

    def close(page: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for batch in held:
                stream.write_batch(batch)
        write_atomically(_page_uri(folder, page), [out.getvalue()])
        h = np.concatenate([_long_lines(_lines(batch), min_chars)[0] for batch in held])
        shard = h[:, 0] % shards
        order = np.argsort(shard, kind="stable")
        rows = [(page, -1, None, None)]
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(own):
                rows.append((page, int(shard[own[0]]), pack_sorted(own), np.ascontiguousarray(h[own]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _PROBES, strict=True)], schema=_PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        page, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PAGE_BYTES:
                yield from close(page, held)
                page, held, size = page + 1, [], 0
        if held:
            yield from close(page, held)

    return run


def _answered(folder: str):
    """Probes sorted by shard: places of the frequent lines, and the documents that keep them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Shards(folder)
        for batch in batches:
            rows = []
            for page, shard, at, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard < 0:
                    rows.append((page, shard, None, None))
                    continue
                if shard not in index:
                    index.clear()
                h = np.frombuffer(h, "<i8").reshape(-1, 2)
                counts, keeps = index[shard].find(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]))
                hit = counts > 0
                if hit.any():
                    rows.append((page, shard, pack_sorted(unpack_sorted(at)[hit]), keeps[hit].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PROBES)], schema=_PROBES)

    return run


def _pages_without(folder: str, without, min_chars: int):
    """Answers sorted by page to the page's documents without their repeated lines."""

    def close(page: int, found: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keeper: dict[int, int] = {}
        for at, keeps in found:
            keeper.update(zip(unpack_sorted(at).tolist(), np.frombuffer(keeps, "<i8").tolist(), strict=True))
        first = 0
        with pa.ipc.open_stream(read_bytes(_page_uri(folder, page))) as stream:
            for batch in stream:
                ids, lines = batch.column(0).to_pylist(), _lines(batch)
                _, doc, line = _long_lines(lines, min_chars)
                drop: list[set[int]] = [set() for _ in lines]
                for x, (i, j) in enumerate(zip(doc, line, strict=True), first):
                    if x in keeper and ids[i] != keeper[x]:
                        drop[i].add(j)
                first += len(doc)
                yield without(batch, lines, drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        for batch in batches:
            for page, shard, places, keeps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != at:
                    if at is not None:
                        yield from close(at, found)
                    at, found = page, []
                if shard >= 0:
                    found.append((places, keeps))
        if at is not None:
            yield from close(at, found)

    return run


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, (often.k IS NOT NULL AND keeper <> doc_id) AS gone
  FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: lines found in three documents or more are dropped but in the last of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
