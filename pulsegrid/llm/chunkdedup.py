"""Substring dedup by content-defined chunks with a gear rolling hash.

A place is a cut where the gear hash of the last 32 bytes has MASK_BITS zero bits, so
cuts depend on nearby bytes only: an insertion moves the cuts it touches and no others.
Where no such place is found for MAX_GAP bytes (text of few distinct hashes), the places
are cuts whose hash is the smallest within REACH bytes to both sides, ties included.
From every cut a variable chunk reaches to the first cut at least ``min_bytes`` further
on; a shorter text is one chunk. Chunks are compared by 128-bit digest; a chunk that a
document with a smaller id also holds is a repeat. The union of a document's repeated
chunks is its repeated text, at most a cut's distance short of the shared passage at
either end.

Digests travel as packed arrays by (page, fragment of the digest range), a page being
a run of documents of one task, and the answers go back to the page by position. A
fragment's row names only the documents whose digests it has, so many fragments don't
repeat the page's ids. A chunk that a third of all documents hold is one run in one
fragment's arrays, once for each page: a page sends its smallest document's.

Edge cases: null or empty text has no bytes and no chunk. Repeats within one document,
and between rows of equal id, are no repeats; of several holders the smallest id keeps
its chunk. A null id counts as larger than every id. Cuts inside a multi-byte character
move to its first byte, so what is left is valid text. Long texts are cut whole, a page
holds their cuts. Other columns aren't read, whatever they are called. An empty table
gives an empty result. The input must give the same rows in the same order when a task
is run again, as a stored table does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fragment_count, pack_ints, pack_sorted, scale_parts, small_batches, unpack_ints, unpack_sorted

#: A cut every 2**MASK_BITS bytes on average, at least MIN_STEP apart.
MASK_BITS, MIN_STEP = 4, 8
#: Bytes without a cut from which on smallest hashes are cuts, within so many bytes to both sides.
MAX_GAP, REACH = 128, 24
#: Bytes of a chunk, at least: about two dozen words.
MIN_BYTES = 128
PAGE_CHUNKS = 1_000_000
#: A null id, in packed ids.
LAST = (1 << 63) - 1
_GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last 32 bytes of gear[byte] << age, modulo 2**32, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def smallest_places(h: np.ndarray) -> np.ndarray:
    """Places whose hash is no larger than any within REACH to both sides."""
    near = np.lib.stride_tricks.sliding_window_view(np.pad(h, REACH, constant_values=np.iinfo(h.dtype).max), 2 * REACH + 1)
    return np.flatnonzero(h == near.min(axis=1))


def cut_places(data: np.ndarray) -> np.ndarray:
    """Cuts of a text, with its start and end."""
    if not len(data):
        return np.zeros(1, np.int64)
    h = gear_hash(data)
    found = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    edges = np.concatenate(([0], found, [len(data)]))
    gaps = np.flatnonzero(np.diff(edges) > MAX_GAP)
    if len(gaps):
        found = np.sort(np.concatenate([found, *(edges[g] + 1 + smallest_places(h[edges[g] : edges[g + 1]]) for g in gaps.tolist())]))
    found = found[found < len(data)]
    for _ in range(3):
        found = found - ((data[found] & 0xC0) == 0x80)
    out, last = [0], 0
    for c in found.tolist():
        if c - last >= MIN_STEP:
            out.append(c)
            last = c
    out.append(len(data))
    return np.array(out, np.int64)


def chunk_ranges(data: np.ndarray, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's chunks."""
    if 0 < len(data) < min_bytes:
        return np.zeros(1, np.int64), np.array([len(data)])
    places = cut_places(data)
    end = np.searchsorted(places, places + min_bytes)
    ok = end < len(places)
    return places[ok], places[end[ok]]


_ROWS = pa.schema([("page", pa.int64()), ("frag", pa.int32()), ("head", pa.binary()), ("h", pa.binary()), ("g", pa.binary()), ("u", pa.binary())])
_DDL = "page long, frag int, head binary, h binary, g binary, u binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(_ROWS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)


def _head(ids: list[int], counts: list[int]) -> bytes:
    return np.array(ids, "<i8").tobytes() + np.array(counts, "<i8").tobytes()


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _pages(fragments: int, min_bytes: int):
    """Documents to their pages' chunk digests by fragment. Fragment 0 also has every chunk's range."""
    width = np.uint64(-(-(1 << 64) // fragments))

    def close(page: int, ids, sizes, counts, starts, ends, digests) -> Iterator[pa.RecordBatch]:
        d = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        doc = np.repeat(np.array(ids, np.int64), counts)
        order = np.lexsort((doc, d[:, 1], d[:, 0]))
        h, g, doc = d[order, 0], d[order, 1], doc[order]
        # Of equal digests the page's smallest document's goes on; the others follow its answer or are repeats.
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, bool)
        of = np.cumsum(new) - 1
        least = doc[new][of] if len(h) else doc
        known, same = order[doc > least], ~new & (doc == least)
        follow = pack_ints(order[same]), pack_ints(order[new][of[same]])
        h, g, order, doc = h[new], g[new], order[new], doc[new]
        at = np.append(np.searchsorted(h, np.arange(fragments, dtype=np.uint64) * width), len(h))
        spans = pack_ints(np.array(sizes)), pack_ints(np.concatenate(starts)), pack_ints(np.concatenate(ends) - np.concatenate(starts))
        yield _batch([(page, -1, _joined(_head(ids, counts), pack_ints(known), *follow), *spans)])
        for f in range(fragments):
            lo, hi = at[f], at[f + 1]
            if hi > lo:
                names, number = np.unique(doc[lo:hi], return_inverse=True)
                head = _joined(names.astype("<i8").tobytes(), pack_ints(number))
                yield _batch([(page, f, head, pack_sorted(h[lo:hi] - np.uint64(f) * width), g[lo:hi].astype("<u8").tobytes(), pack_ints(order[lo:hi]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        page = TaskContext.get().partitionId() << 24
        held: tuple[list, ...] = ([], [], [], [], [], [])
        n = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                a, b = chunk_ranges(np.frombuffer(raw, np.uint8), min_bytes)
                held[5].extend([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                for to, x in zip(held, (LAST if doc is None else doc, len(raw), len(a), a, b), strict=False):
                    to.append(x)
                n += len(a)
                if n >= PAGE_CHUNKS:
                    yield from close(page, *held)
                    page, held, n = page + 1, ([], [], [], [], [], []), 0
        if held[0]:
            yield from close(page, *held)

    return run


def _mark(table: pa.Table) -> pa.Table:
    """A fragment's digests from all pages: which have an equal one in a smaller document."""
    frag = int(table.column("frag")[0].as_py())
    pages = table.column("page").to_pylist()
    if frag < 0:  # ranges go through
        return table
    units = [unpack_ints(b) for b in table.column("u").to_pylist()]
    h = np.concatenate([unpack_sorted(b) for b in table.column("h").to_pylist()])
    g = np.concatenate([np.frombuffer(b, "<u8") for b in table.column("g").to_pylist()])
    doc = np.concatenate([np.frombuffer(names, "<i8")[unpack_ints(n).astype(np.int64)] for names, n in map(_parted, table.column("head").to_pylist())])
    order = np.lexsort((g, h))
    hs, gs, ds = h[order], g[order], doc[order]
    starts = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1]))))
    least = np.minimum.reduceat(ds, starts)
    hit = np.empty(len(h), bool)
    hit[order] = ds > np.repeat(least, np.diff(np.append(starts, len(hs))))
    rows, at = [], 0
    for page, u in zip(pages, units, strict=True):
        own = hit[at : at + len(u)]
        at += len(u)
        if own.any():
            rows.append((page, frag, None, None, None, pack_ints(u[own])))
    return pa.Table.from_batches([_batch(rows)])


_OUT = "{id} long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>"


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges that are sorted by start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's answers, ranges first, to a row for each of its documents."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def close(head: bytes, sizes, starts, lengths, hits) -> Iterator[pa.RecordBatch]:
        named, *rest = _parted(head)
        ids, counts = np.frombuffer(named, "<i8").reshape(2, -1)
        known, follow, lead = (unpack_ints(x).astype(np.int64) for x in rest)
        hit = np.zeros(len(starts), bool)
        for u in (known, *hits):
            hit[u.astype(np.int64)] = True
        hit[follow] = hit[lead]
        at, rows = 0, []
        for doc, size, n in zip(ids.tolist(), sizes.tolist(), counts.tolist(), strict=True):
            own = hit[at : at + n]
            a, b = merged(starts[at : at + n][own].astype(np.int64), (starts[at : at + n] + lengths[at : at + n])[own].astype(np.int64))
            at += n
            rows.append((None if doc == LAST else doc, size, int((b - a).sum()), len(a), [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
        for lo in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows[lo : lo + 5000], strict=True), schema, strict=True)], schema=schema)

    page, head, held, hits = None, b"", (), []
    for batch in batches:
        for number, frag, head_, h, g, u in zip(*(batch.column(c).to_pylist() for c in _ROWS.names), strict=True):
            if number != page:
                if page is not None:
                    yield from close(head, *held, hits)
                page, hits = number, []
            if frag < 0:
                head, held = head_, (unpack_ints(h), unpack_ints(g), unpack_ints(u))
            else:
                hits.append(unpack_ints(u))
    if page is not None:
        yield from close(head, *held, hits)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, spans)``: byte ranges of UTF-8 text that repeat a smaller document's."""
    spark = docs.sparkSession
    small_batches(spark)
    fragments, parts = fragment_count(docs.select(text_col), spark), scale_parts(spark)
    pages = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pages(fragments, min_bytes), _DDL)
    # Ranges (fragment -1) are dealt by page; they only pass through.
    marked = pages.groupBy("frag", F.when(F.col("frag") < 0, F.col("page")).alias("own")).applyInArrow(_mark, _DDL)
    dealt = marked.repartition(parts, "page").sortWithinPartitions("page", "frag")
    return dealt.mapInArrow(_assemble, _OUT.format(id=id_col))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans' bytes taken out of the text; ids must be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, kept = (text or "").encode("utf-8", "surrogatepass"), 0, []
                for s in own or ():
                    kept.append(raw[at : s["start"]])
                    at = s["stop"]
                out.append(None if text is None else b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["__id", "__kept"])

    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(spans.filter("n_spans > 0").select(F.col(id_col).alias("__id"), "spans"), "__id")
    kept = own.mapInArrow(run, "__id long, __kept string")
    out = docs.join(kept, docs[id_col] == kept["__id"], "left")
    return out.withColumn(text_col, F.coalesce("__kept", text_col)).drop("__id", "__kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the repeated spans of every document."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
