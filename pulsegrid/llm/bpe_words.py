"""BPE encoding and decoding over a table of distinct words.

1. Texts are split into words. A *page* is a run of documents of one task; it numbers
   its distinct words and keeps each document as a sequence of those numbers.
2. The pages' words are dealt by word hash. Each bucket merges them, encodes every
   distinct word once and answers each page in the page's own word order.
3. Decoding joins the ids that a page has, each once, with the vocabulary's id-to-piece
   table (broadcast: its size is the vocabulary's, never the data's). A page gets its
   pieces as one row, of at most as many pieces as the vocabulary has.
4. Ids and pieces join back by position: number -> word's ids and text.

Only distinct words and ids are shuffled, packed; documents wait in their page's file,
so a worker holds one page's words and one chunk of texts. The input must give the same
rows in the same order when a task is run again, as a stored table does.

Edge cases: null text is empty; an empty text has no ids and decodes to ''. An id
without a piece decodes to ''. Null, repeated or tied ids are carried through, one
output row per input row. A very long text is a chunk of its own, held whole by one
worker. Other input columns are not read, whatever they are called. An empty table gives
an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, fragment_count, open_fs, pack, pack_ints, pack_sorted, scale_parts, small_batches, trim, unpack, unpack_ints, unpack_sorted, write_atomically
from .wordbpe import default_vocabulary, encoder

#: Words and distinct words after which a page is closed; they bound a worker's memory.
PAGE_WORDS, PAGE_DISTINCT = 2_000_000, 110_000
#: Words after which the texts of a page are written as one row.
CHUNK_WORDS = 100_000


class _Page:
    """Distinct words of a run of documents, and the documents as numbers of words.

    The documents go to the page's own file in the shared folder, as Arrow chunks.
    """

    def __init__(self, number: int, uri: str, kind: pa.DataType):
        self.number, self.uri, self.index, self.words = number, uri, {}, 0
        self.schema = pa.schema([("ids", pa.list_(kind)), ("a", pa.binary()), ("b", pa.binary())])
        self.chunks: list[pa.RecordBatch] = []
        self._start()

    def _start(self) -> None:
        self.ids, self.counts, self.at, self.held = [], [], [], 0

    def add(self, doc_id, words: list[str]) -> None:
        index = self.index
        try:
            at = np.fromiter(map(index.__getitem__, words), np.uint32, len(words))
        except KeyError:
            at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint32, len(words))
        self.ids.append(doc_id)
        self.counts.append(len(words))
        self.at.append(at)
        self.held += len(words)
        self.words += len(words)
        if self.held >= CHUNK_WORDS:
            self.flush()

    def flush(self) -> None:
        if self.ids:
            cols = [pa.array([x], f.type) for x, f in zip((self.ids, pack_ints(np.array(self.counts)), pack_ints(np.concatenate(self.at))), self.schema, strict=True)]
            self.chunks.append(pa.RecordBatch.from_arrays(cols, schema=self.schema))
            self._start()

    def save(self) -> None:
        self.flush()
        out = io.BytesIO()
        with pa.ipc.new_stream(out, self.schema) as stream:
            for chunk in self.chunks:
                stream.write_batch(chunk)
        write_atomically(self.uri, [out.getvalue()])
        self.chunks = []


def _split_pages(path: str, folder: str, buckets: int, schema: pa.Schema, kind: pa.DataType):
    """Documents to the distinct words of their pages, a row for each page and bucket."""

    def row(page: int, bucket: int, at: np.ndarray, words: list[str]) -> pa.RecordBatch:
        values = (page, bucket, pack_sorted(at), pack("\n".join(words).encode()), None, None)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

    def close(page: _Page) -> Iterator[pa.RecordBatch]:
        page.save()
        words = list(page.index)
        own = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint32, len(words)) % buckets
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(buckets + 1))
        for b in range(buckets):
            at = order[cuts[b] : cuts[b + 1]]
            if len(at) or not words and not b:  # a page without words is named all the same
                yield row(page.number, b, at, [words[i] for i in at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = encoder(path).words
        number = TaskContext.get().partitionId() << 24
        page = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = page or _Page(number, _page_uri(folder, number), kind)
                page.add(doc_id, split(text) if text else [])
                if page.words >= PAGE_WORDS or len(page.index) >= PAGE_DISTINCT:
                    yield from close(page)
                    page, number = None, number + 1
        if page:
            yield from close(page)
            page = None
            trim()

    return run


def _page_uri(folder: str, number: int) -> str:
    return f"{folder}/page-{number >> 24:06d}-{number & 0xFFFFFF:06d}.arrow"


def _encode_bucket(path: str, schema: pa.Schema):
    """A bucket's words from all pages: each distinct one is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        lists = [raw.decode().split("\n") if (raw := unpack(b)) else [] for b in table.column("b").to_pylist()]
        distinct = list(set().union(*lists))
        known: dict[str, bytes] = {}
        for lo in range(0, len(distinct), 20_000):
            part = distinct[lo : lo + 20_000]
            known.update(zip(part, enc.encode_words(part), strict=True))
        size = enc.dtype.itemsize
        cols: dict[str, list] = {f.name: [] for f in schema}
        for page, slots, words in zip(table.column("page").to_pylist(), table.column("a").to_pylist(), lists, strict=True):
            found = [known[w] for w in words]
            cols["page"].append(page)
            cols["bucket"].append(None)
            cols["a"].append(slots)
            cols["b"].append(pack_ints(np.array([len(x) // size for x in found])))
            ids = np.frombuffer(b"".join(found), enc.dtype)
            cols["c"].append(pack_ints(ids))
            cols["d"].append(np.unique(ids).tolist())
        return pa.table({f.name: pa.array(cols[f.name], f.type) for f in schema}, schema=schema)

    return run


class _Words:
    """A page's words by number: their ids, and their pieces joined by one space."""

    def __init__(self):
        self.pieces: dict[int, str] = {}
        self.parts: list[tuple] = []

    def add(self, slots: bytes, counts: bytes, ids: bytes) -> None:
        self.parts.append((unpack_sorted(slots), unpack_ints(counts), unpack_ints(ids)))

    def finish(self) -> None:
        size = sum(len(p[0]) for p in self.parts)
        self.ids: list = [None] * size
        self.text: list = [None] * size
        piece = self.pieces.__getitem__
        for slots, counts, ids in self.parts:
            flat, ends = ids.tolist(), np.cumsum(counts).tolist()
            lo = 0
            for slot, hi in zip(slots.tolist(), ends, strict=True):
                own = flat[lo:hi]
                self.ids[slot], self.text[slot] = own, " ".join(map(piece, own))
                lo = hi
        self.parts = []


def _join_back(folder: str, schema: pa.Schema):
    """Answers sorted by page: each page's documents get their ids and their decoded text."""

    def texts(page: int, words: _Words) -> Iterator[pa.RecordBatch]:
        words.finish()
        fs, name = open_fs(_page_uri(folder, page))
        with fs.open_input_stream(name) as file, pa.ipc.open_stream(file) as chunks:
            for chunk in chunks:
                yield documents(words, *(chunk.column(i)[0].as_py() for i in range(3)))

    def documents(words: _Words, ids: list, counts: bytes, at: bytes) -> pa.RecordBatch:
        at, lo = unpack_ints(at).tolist(), 0
        flat: list[int] = []
        ends, decoded = [0], []
        for n in unpack_ints(counts).tolist():
            own = at[lo : lo + n]
            for x in map(words.ids.__getitem__, own):
                flat += x
            ends.append(len(flat))
            decoded.append(" ".join(map(words.text.__getitem__, own)))
            lo += n
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), lists.cast(schema.field(1).type), pa.array(decoded, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, words = None, _Words()
        for batch in batches:
            for number, a, b, c, own, pieces in zip(*(batch.column(k).to_pylist() for k in ("page", "a", "b", "c", "d", "pieces")), strict=True):
                if number != page:
                    if page is not None:
                        yield from texts(page, words)
                    page, words = number, _Words()
                if pieces is not None:
                    words.pieces = dict(zip(own, pieces, strict=True))
                else:
                    words.add(a, b, c)
        if page is not None:
            yield from texts(page, words)
            del words
            trim()

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>, decoded string)``, one row per document.

    ids are those of the whole text without added special tokens; decoded joins the
    pieces as the vocabulary file's missing decoder does: by one space.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType
    buckets = fragment_count(docs.select(text_col), spark)
    ws = Workspace(spark, "bpe")
    packed = T.StructType([T.StructField(n, t) for n, t in (("page", T.LongType()), ("bucket", T.IntegerType()), ("a", T.BinaryType()), ("b", T.BinaryType()), ("c", T.BinaryType()), ("d", T.ArrayType(T.IntegerType())))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in packed])
    words = docs.select(id_col, text_col).mapInArrow(_split_pages(path, ws.root, buckets, arrow, to_arrow_type(kind)), packed)
    answers = ws.table(words.groupBy("bucket").applyInArrow(_encode_bucket(path, arrow), packed), "answers")
    # Decoding: the distinct ids of each page meet the id-to-piece table.
    pieces = F.broadcast(ws.table(spark.createDataFrame(piece_table(path)), "pieces"))
    own = answers.groupBy("page").agg(F.array_distinct(F.flatten(F.collect_list("d"))).alias("d"))
    met = own.select("page", F.explode("d").alias("id")).join(pieces, "id", "left")
    met = met.groupBy("page").agg(F.collect_list(F.struct("id", F.coalesce("piece", F.lit("")).alias("piece"))).alias("met"))
    none = [F.lit(None).cast(packed[c].dataType).alias(c) for c in ("bucket", "a", "b", "c")]
    met = met.select("page", *none, F.col("met.id").alias("d"), F.col("met.piece").alias("pieces"))
    rows = answers.drop("d").withColumn("d", F.lit(None).cast("array<int>")).withColumn("pieces", F.lit(None).cast("array<string>")).unionByName(met)
    dealt = rows.repartition(scale_parts(spark), "page").sortWithinPartitions("page")
    out = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return dealt.mapInArrow(_join_back(ws.root, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])), out)


def piece_table(path: str) -> pa.Table:
    """The vocabulary's ``(id, piece)``, a row for each id."""
    tokenizer = encoder(path).tokenizer
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    return pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(vocabulary.keys(), pa.string())})


def query(spark, sf_dir: str) -> DataFrame:
    """op4: token counts and digests of ids and decoded texts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
