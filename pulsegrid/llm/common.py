"""Shared plumbing of the corpus operators: shared-folder tables, checked broadcasts, packing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import reachable

#: Most rows of a side that is broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 200_000
#: Stored (compressed) bytes of input for which there is a fragment.
FRAGMENT_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests) a local folder is set where none is named; on a cluster
    that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root if ":" in root else "file://" + root


class Workspace:
    """A run's own sub-folder of the shared folder; deleted when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = reachable(spark)
        self.root = f"{shared_root(spark).rstrip('/')}/pulsegrid/{name}-{uuid.uuid4().hex[:12]}"
        path, fs = self._hadoop(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _hadoop(self, uri: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts lineage, survives lost executors."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path, fs = self._hadoop(self.path(name))
        fs.delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared-folder URI, on the driver or an executor."""
    return pafs.FileSystem.from_uri(uri)


def write_atomically(uri: str, chunks) -> int:
    """Write bytes under a temporary name, then rename: a retried task never leaves half a file."""
    fs, path = open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    size = 0
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    try:
        fs.move(part, path)
    except OSError:  # another attempt's file is there, with the same bytes
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(part)
    return size


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        if offset:
            f.seek(offset)
        return f.read(length) if length is not None else f.read()


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unchanged.

    The count stops at ``limit + 1`` rows. Unchanged means an ordinary shuffle join.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def scale_parts(spark: SparkSession, least: int = 8) -> int:
    """Shuffle partitions of the session: how wide a keyed stage is dealt."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fragment_count(df: DataFrame, spark: SparkSession, each: int = FRAGMENT_BYTES) -> int:
    """Into how many fragments keys are cut whose groups a worker holds whole.

    As many as shuffle partitions, and more where the input is large: ``each`` bytes of
    stored input a fragment, so a group's size doesn't grow with the input. Where the
    plan doesn't know its size, the number of shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(scale_parts(spark), -(-size // each) if size < 1 << 60 else 0)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits in a worker.

    A text that is longer is a batch of its own. These are settings of the session: they
    hold for all that is run afterwards, in smaller batches, with the same results.
    """
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trim() -> None:
    """Give freed memory back: a worker lives on, and its executor's limit is shared."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give free heap back.

    A JVM keeps the heap that an earlier stage made it take, and direct buffers whose
    owners are dead, until a full collection; Python workers share the executor's limit.
    There are as many tasks as cores, so each idle executor gets one; one that is busy
    or comes later may not be reached, and keeps its memory.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


_Z = zstandard.ZstdCompressor(level=3)
_D = zstandard.ZstdDecompressor()


def pack(data: bytes) -> bytes:
    return _Z.compress(data)


def unpack(data: bytes) -> bytes:
    return _D.decompress(data)


def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: planes that hold only zeros cost nothing."""
    a = np.ascontiguousarray(a, dtype="<u8")
    planes = a.view(np.uint8).reshape(-1, 8)
    width = 8
    while width > 1 and not planes[:, width - 1].any():
        width -= 1
    return bytes([width]) + _Z.compress(np.ascontiguousarray(planes[:, :width].T).tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    width = b[0]
    raw = np.frombuffer(_D.decompress(b[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers as packed differences."""
    a = a.astype("<u8", copy=False)
    return pack_ints(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(b), dtype="<u8")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
