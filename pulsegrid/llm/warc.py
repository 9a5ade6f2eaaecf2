"""WARC archives and their Merkle fixity audit.

Archives are written by the tasks that read the pages, one gzip member a record, to
any number of replica folders. The manifest has each record's archive and offset range.

An archive's tree has its records in offset order as leaves: a leaf hashes range and
stored bytes; an inner node hashes the range it spans and up to FANOUT children. The
audit compares two replicas' roots and reads tree nodes below mismatching ones only,
down to the records that differ. Bytes are read by the manifest's ranges, so damage
(also a cut or missing file) can't shift a neighbour's range.

Edge cases: null url or html is empty; control characters of a url (a line break would
end its header) are percent-encoded, as a URI needs; a null id has no id header;
repeated rows are records of their own, and so have leaves of their own. A page is one
record however long it is: a task holds it whole, and an archive of up to ARCHIVE_BYTES.
Other columns, also such as are named like the manifest's, aren't read. An empty table
has no archives, and its audit is empty. The input must give the same rows in the same
order when a task is run again, as a stored table does.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, open_fs, scale_parts, small_batches, write_atomically

FANOUT = 16
#: Stored bytes after which an archive is closed.
ARCHIVE_BYTES = 256 << 20
_MANIFEST = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("record", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
_NODES = pa.schema([("archive", pa.string()), ("level", pa.int32()), ("node", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("hash", pa.binary()), ("root", pa.bool_())])
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_NODES_DDL = "archive string, level int, node long, lo long, hi long, hash binary, root boolean"


def record_bytes(page_id: int | None, url: str | None, html: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; the same input always gives the same bytes."""
    body = (html or "").encode()
    digest = hashlib.sha256(body).hexdigest()
    name = uuid.UUID(bytes=hashlib.sha256(f"{page_id}\0{url}\0{digest}".encode()).digest()[:16], version=5)
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_CONTROL.sub(lambda c: f'%{ord(c[0]):02X}', url or '')}", "Content-Type: text/html", f"WARC-Block-Digest: sha256:{digest}", *([f"X-Page-Id: {page_id}"] if page_id is not None else []), f"Content-Length: {len(body)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one stored record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_archives(pages: DataFrame, folders: Sequence[str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to every folder; the manifest has a row for each record."""
    spark = pages.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        rows: list[tuple] = []
        at = 0

        def close() -> pa.RecordBatch:
            for folder in folders:
                write_atomically(f"{folder}/{rows[0][1]}", held)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MANIFEST, strict=True)], schema=_MANIFEST)

        for batch in batches:
            for page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = record_bytes(*page)
                rows.append((page[0], f"part-{part:06d}-{number:04d}.warc.gz", len(rows), at, len(data)))
                held.append(data)
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    held, rows, at, number = [], [], 0, number + 1
        if rows:
            yield close()

    source = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col))
    ws = Workspace(spark, "warc")
    return ws.table(source.mapInArrow(run, "page_id long, archive string, record long, start long, length long"), "manifest")


def _leaf(lo: int, hi: int, data: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + struct.pack("<QQ", lo, hi) + data).digest()


def tree(ranges: list[tuple[int, int]], leaves: list[bytes]) -> list[tuple[int, int, int, int, bytes, bool]]:
    """Nodes (level, number, lo, hi, hash, is root) of the tree over leaves in offset order."""
    out, level = [], 0
    rows = [(*r, h) for r, h in zip(ranges, leaves, strict=True)]
    while rows:
        out += [(level, i, lo, hi, h, len(rows) == 1) for i, (lo, hi, h) in enumerate(rows)]
        if len(rows) == 1:
            break
        groups = [rows[i : i + FANOUT] for i in range(0, len(rows), FANOUT)]
        rows = [(g[0][0], g[-1][1], hashlib.sha256(b"\x01" + struct.pack("<QQ", g[0][0], g[-1][1]) + b"".join(x[2] for x in g)).digest()) for g in groups]
        level += 1
    return out


def hash_trees(manifest: DataFrame, folder: str) -> DataFrame:
    """The trees of a replica's archives: archive, level, node, lo, hi, hash, root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("record")
        name = table.column("archive")[0].as_py()
        ranges = [(a, a + n) for a, n in zip(table.column("start").to_pylist(), table.column("length").to_pylist(), strict=True)]
        fs, path = open_fs(f"{folder}/{name}")
        try:
            with fs.open_input_stream(path, compression=None) as file:  # by default a name in .gz is decompressed
                leaves = [_leaf(lo, hi, file.read(hi - lo)) for lo, hi in ranges]
        except FileNotFoundError:
            leaves = [_leaf(lo, hi, b"") for lo, hi in ranges]
        nodes = tree(ranges, leaves)
        cols = list(zip(*nodes, strict=True))
        return pa.Table.from_arrays([pa.array([name] * len(nodes)), *(pa.array(c, f.type) for c, f in zip(cols, list(_NODES)[1:], strict=True))], schema=_NODES)

    return manifest.select("archive", "record", "start", "length").groupBy("archive").applyInArrow(run, _NODES_DDL)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves that differ between two replicas' trees: archive, record, lo, hi.

    Roots are compared first; below, only children of mismatching nodes are. Trees are
    expected as stored tables. Every level costs one join of the nodes still in doubt.
    """
    keys = ["archive", "level", "node"]
    other = b.select(*keys, F.col("hash").alias("__hash"))
    # Both trees are over the same ranges, so they have the same nodes.
    roots = a.filter("root").join(other, keys, "left").filter(~F.col("hash").eqNullSafe(F.col("__hash"))).select(*keys, "lo", "hi")
    height = roots.agg(F.max("level")).first()[0]  # one number, whatever the number of archives
    doubt = roots
    for level in range(height or 0, 0, -1):
        parents = doubt.filter(F.col("level") == level).select("archive", F.col("node").alias("__parent"))
        below = a.filter((F.col("level") == level - 1) & ~F.col("root")).withColumn("__parent", F.floor(F.col("node") / FANOUT).cast("long"))
        children = below.join(parents, ["archive", "__parent"], "left_semi").join(other, keys, "left").filter(~F.col("hash").eqNullSafe(F.col("__hash"))).select(*keys, "lo", "hi")
        doubt = doubt.filter(F.col("level") < level).unionByName(children)
    out = doubt.filter("level = 0")
    return out.select("archive", F.col("node").alias("record"), "lo", "hi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: write two replicas of all pages, hash both, and report every record's fixity."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ws = Workspace(spark, "replicas")
    folders = [ws.path("a"), ws.path("b")]
    for folder in folders:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
    manifest = write_archives(pages, folders)
    trees = [ws.table(hash_trees(manifest, f), f"tree-{i}") for i, f in enumerate(folders)]
    bad = audit(*trees).select("archive", "record", F.lit(True).alias("bad"))
    leaves = trees[0].filter("level = 0").select("archive", F.col("node").alias("record"), F.hex("hash").alias("leaf_hash"))
    return (
        manifest.join(leaves, ["archive", "record"])
        .join(bad, ["archive", "record"], "left")
        .select("page_id", "archive", "record", "start", "length", F.lower("leaf_hash").alias("leaf_hash"), F.col("bad").isNull().alias("intact"))
    )
