"""Language identification by hyperdimensional profiles.

Every code point has a random bipolar letter vector. An n-gram's vector binds its
letters' vectors, each permuted (rolled) by its place; a text's vector bundles (sums)
its n-grams' vectors. A language's prototype bundles all its labelled texts. A text
gets the language whose prototype has the largest cosine with it.

Letters are lower-cased; a run of anything else is one space, also at both ends. All
labelled documents outside the held-out fold are learned from. Sums are of whole
numbers, so prototypes don't depend on the order of tasks. Prototypes are files of
BLOCK_LANGS languages in the shared folder: a worker keeps some, and reads the others
for each batch of texts, so any number of label values will do.

Edge cases: null text, or text without a letter: ``und`` with score 0; so is every text
if nothing could be learned. Rows with a null label teach nothing. A null id is in
neither fold. Equal cosines: the smaller language name. Repeated rows count as often
as they come. Long texts are read whole, a slice at a time. Columns named in ``extra``
are carried in one struct, whatever they are called; others aren't read. An empty table
gives an empty result.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, read_bytes, small_batches, trim, write_atomically

#: Dimensions, letters in an n-gram, characters worked on at once, n-gram vectors kept.
DIMS, GRAM, SLICE_CHARS, CACHE_GRAMS = 1024, 3, 400_000, 16_384
#: Texts in a slice, at most; languages in a file of prototypes; files that a worker keeps;
#: languages that a task sums before it hands them on.
SLICE_TEXTS, BLOCK_LANGS, KEPT_BLOCKS, HELD_LANGS = 128, 512, 2, 512
#: N-gram vectors that are multiplied at once.
STEP_GRAMS = 4096
_CODE = 21  # bits of a code point


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


class Space:
    """The vectors of letters and n-grams; n-gram vectors are cached and bounded in number."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((CACHE_GRAMS, dims), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng(0x5EED + code).integers(0, 2, self.dims, np.int8) * 2 - 1
        return self.letters[code]

    def gram(self, code: int) -> np.ndarray:
        out = np.ones(self.dims, np.int8)
        for place in range(GRAM):
            out = out * np.roll(self.letter(code >> _CODE * place & (1 << _CODE) - 1), place)
        return out

    def bundle(self, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Counts (texts x n-grams) times the n-grams' vectors."""
        out = np.zeros((len(counts), self.dims))
        for lo in range(0, len(codes), STEP_GRAMS):
            part = codes[lo : lo + STEP_GRAMS].tolist()
            new = [c for c in part if c not in self.rows]
            if len(self.rows) + len(new) > CACHE_GRAMS:
                self.rows.clear()
                new = part
            for c in new:
                self.rows[c] = len(self.rows)
                self.vectors[self.rows[c]] = self.gram(c)
            own = self.vectors[[self.rows[c] for c in part]].astype(np.float32)
            out += counts[:, lo : lo + STEP_GRAMS].astype(np.float32) @ own
        return out


@lru_cache(maxsize=1)
def _space() -> Space:
    return Space()


def _symbols(text: str) -> np.ndarray:
    """Lower-case letters and single spaces, as code points; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_is_letter()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    return codes if len(codes) > 1 else codes[:0]


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows with letters and their symbols, some SLICE_CHARS at a time; a long text goes in pieces that overlap."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        if not text or not len(codes := _symbols(text)):
            continue
        for lo in range(0, max(1, len(codes) - GRAM + 1), SLICE_CHARS):
            piece = codes[lo : lo + SLICE_CHARS + GRAM - 1]
            at.append(i)
            held.append(piece)
            size += len(piece)
            if size >= SLICE_CHARS or len(held) >= SLICE_TEXTS:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


def _counts(held: list[np.ndarray], groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of each group of symbol runs, and the n-grams' codes."""
    flat = np.concatenate(held)
    ends = np.cumsum([len(x) for x in held])
    present = np.zeros(int(flat.max()) + 1, bool)
    present[flat] = True
    alphabet = np.flatnonzero(present)
    rank = np.cumsum(present) - 1
    own = rank[flat].astype(np.int64)
    k = len(alphabet)
    grams = own[2:] + k * (own[1:-1] + k * own[:-2])
    group = np.repeat(groups, [len(x) for x in held])[2:]
    ok = np.ones(len(grams), bool)
    for cut in (ends[:-1] - 1, ends[:-1] - 2):
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    grams, group = grams[ok], group[ok]
    if k**3 <= 1 << 22:
        seen = np.zeros(k**3, bool)
        seen[grams] = True
        found = np.flatnonzero(seen)
        inverse = (np.cumsum(seen) - 1)[grams]
    else:
        found, inverse = np.unique(grams, return_inverse=True)
    counts = np.bincount(group * len(found) + inverse, minlength=n_groups * len(found)).reshape(n_groups, len(found))
    codes = sum(alphabet[found // k**p % k].astype(np.int64) << (_CODE * p) for p in range(GRAM))
    return counts, np.atleast_1d(codes)


def held_out(id_col: str) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Prototypes:
    """Languages' unit vectors, in files of a folder, named by number."""

    folder: str
    blocks: tuple[int, ...]

    def block(self, k: int) -> tuple[list[str], np.ndarray]:
        z = np.load(io.BytesIO(read_bytes(f"{self.folder}/{k:06d}.npz")))
        names, ends = z["names"].tobytes(), np.cumsum(z["sizes"]).tolist()
        return [names[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)], z["matrix"]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Prototypes:
    """Prototypes of the languages of all labelled rows, summed in Spark by language and dimension."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        close = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], schema.field(1).type)], schema=schema)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, held in _slices(batch.column(0).to_pylist()):
                names = sorted({labels[i] for i in at})
                number = {x: k for k, x in enumerate(names)}
                counts, codes = _counts(held, np.array([number[labels[i]] for i in at]), len(names))
                for name, v in zip(names, _space().bundle(counts, codes), strict=True):
                    sums[name] = sums.get(name, 0) + v
                if len(sums) >= HELD_LANGS:
                    yield close()
                    sums = {}
        if sums:
            yield close()
        trim()

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, vector array<double>")
    total = rows.select("lang", F.posexplode("vector").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    ws = Workspace(spark, "languages")
    folder = ws.root
    found = ws.table(total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("v")), "sums")
    blocks = -(-found.count() // BLOCK_LANGS)

    def write(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        matrix = np.array(table.column("v").to_pylist())
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        names = [x.encode("utf-8", "surrogatepass") for x in table.column("lang").to_pylist()]
        file = io.BytesIO()
        np.savez(file, matrix=matrix, names=np.frombuffer(b"".join(names), np.uint8), sizes=np.array([len(x) for x in names]))
        write_atomically(f"{folder}/{k:06d}.npz", [file.getvalue()])
        return pa.table({"block": pa.array([k], pa.int64())})

    if not blocks:
        return Prototypes(folder, ())
    dealt = found.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("long"))
    return Prototypes(folder, tuple(sorted(r.block for r in dealt.groupBy("block").applyInArrow(write, "block long").collect())))


def predict(docs: DataFrame, prototypes: Prototypes, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """``(id_col, lang_pred, score)`` and the ``extra`` columns as one struct ``row``."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *([F.struct(*extra).alias("row")] if extra else []))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([source.schema["row"]] if extra else [])])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {k: prototypes.block(k) for k in prototypes.blocks[:KEPT_BLOCKS]}

        def nearest(vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
            """The language of each vector: largest cosine, then smallest name."""
            names, scores = ["und"] * len(vectors), np.full(len(vectors), -2.0)
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
            for k in prototypes.blocks:
                own, matrix = kept[k] if k in kept else prototypes.block(k)
                cosines = vectors @ matrix.T
                top = cosines.max(axis=1)
                for i in np.flatnonzero(top >= scores).tolist():
                    name = min(own[j] for j in np.flatnonzero(cosines[i] == top[i]).tolist())
                    if top[i] > scores[i] or name < names[i]:
                        names[i], scores[i] = name, top[i]
            return names, np.clip(scores, 0.0, 1.0)

        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            rows: list[int] = []
            vectors: list[np.ndarray] = []

            def settle(last: int, langs=langs, scores=scores, rows=rows, vectors=vectors) -> None:
                """All finished texts; the last one may go on in the next slice."""
                n = len(rows) - last
                if n > 0:
                    for i, name, score in zip(rows, *nearest(np.array(vectors[:n]))):  # noqa: B905
                        langs[i], scores[i] = name, float(score)
                    del rows[:n], vectors[:n]

            for at, held in _slices(batch.column(1).to_pylist()) if prototypes.blocks else ():
                own = sorted(set(at))
                number = {i: k for k, i in enumerate(own)}
                counts, codes = _counts(held, np.array([number[i] for i in at]), len(own))
                for i, v in zip(own, _space().bundle(counts, codes), strict=True):
                    if rows and rows[-1] == i:
                        vectors[-1] = vectors[-1] + v
                    else:
                        rows.append(i)
                        vectors.append(v)
                if len(rows) > SLICE_TEXTS:
                    settle(1)
            settle(0)
            cols = [batch.column(0).cast(arrow.field(0).type), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + ([batch.column(2).cast(arrow.field(3).type)] if extra else []), schema=arrow)
        trim()

    return source.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: learn outside the held-out fold, predict every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    prototypes = learn(docs.filter(~held_out("doc_id") & F.col("doc_id").isNotNull()))
    return predict(docs, prototypes).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
