"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word shingles, hashed to 64 bits. Two documents link when
``100 * intersection >= percent * union``.

1. Documents with equal sets are one class; its smallest id stands for it.
2. The n-gram order is cut into fragments (ranges of hash). Each fragment's postings
   are gathered from all documents and give every n-gram's document frequency. Only
   n-grams of two or more documents are *live*; no other can be part of an overlap.
3. The global order is (frequency, hash), rarest first. A document with fewer live
   n-grams than ``percent`` of its set can't link. Of the others, two that link share
   an n-gram among their first ``n - ceil(percent * n / 100) + 1`` in this order.
4. Candidates' overlaps are counted in each of PARTS vertical parts separately and
   summed by pair; the sum decides. A pair that meets at places i and j of the order is
   a candidate only if the live n-grams from there on are enough for a link.
5. Within a bucket of candidates all are held against one hub first: the document whose
   n-grams are the most frequent on average, which near copies gather around; then
   against the document with most links. So a group of near copies costs a pair each.
   What is then still in different components is compared in blocks of the bucket: a
   parity bitmap of a document's live n-grams (a bit is flipped by each that hashes to
   it) differs in no more bits than the sets do, so pairs whose bitmaps differ too much
   are dropped inside the block, and only the few others become pairs. No link that
   joins components is lost. The links found so are a subset that spans the components.
6. With ``every_link`` the blocks of all buckets of three or more give the candidates
   instead: all links, and their number for each document.

Postings travel as packed arrays by (page, fragment): a page is a run of documents of
one task. With more fragments a blob gets shorter, down to a row for each n-gram.

Edge cases: null or blank text is an empty set, linked with nothing. With fewer words
than a shingle has, the whole sequence is the one shingle. Rows with equal id are one
document. A null id is described but never linked; its component is null. Other
columns aren't read. The input must give the same rows in the same order when a task
is run again, as a stored table does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fragment_count, mix64, pack_ints, pack_sorted, scale_parts, small_batches, small_side, trim, unpack_ints, unpack_sorted
from .components import connected

#: Postings after which a page is closed; words that a worker keeps hashed; vertical parts.
PAGE_POSTINGS, CACHE_WORDS, PARTS = 2_000_000, 150_000, 8
#: Pairs of a round beyond which parts are counted one after the other.
STAGED = 20_000
#: Documents of a bucket in one side of a block; pairs of bitmaps compared at once, in words.
SHARE, BLOCK_WORDS = 512, 1 << 21
#: Bits of the bitmaps, at least and at most; twice the set's size between them.
LEAST_BITS, MOST_BITS = 256, 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = mix64(h * _STEP + words[k : len(words) - size + 1 + k])
    return h


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), n))


@dataclass
class JaccardJoin:
    """documents: id, n_shingles, class_id, component_id. links: a, b, overlap, between representatives.

    links spans the components; with ``every_link`` it holds all links, and documents has
    n_links: how many other classes the document's class links with.
    """

    documents: DataFrame
    links: DataFrame


def _describe(n: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
            d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], schema=schema)

    return run


_POSTINGS = pa.schema([("page", pa.int64()), ("frag", pa.int32()), ("head", pa.binary()), ("h", pa.binary()), ("d", pa.binary()), ("f", pa.binary())])
_POSTINGS_DDL = "page long, frag int, head binary, h binary, d binary, f binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _postings(n: int, fragments: int):
    """Pages of documents to their postings, a row for each fragment; the first names the documents."""
    width = np.uint64(-(-(1 << 64) // fragments))

    def close(page: int, ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        h = np.concatenate(sets)
        d = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(h)
        h, d = h[order], d[order]
        cuts = np.append(np.searchsorted(h, np.arange(fragments, dtype=np.uint64) * width), len(h))
        for f in range(fragments):
            lo, hi = cuts[f], cuts[f + 1]
            head = np.array(ids, "<i8").tobytes() + sizes.astype("<i8").tobytes() if not f else None
            if hi > lo or not f:
                yield _batch([(page, f, head, pack_sorted(h[lo:hi] - np.uint64(f) * width), pack_ints(d[lo:hi]), None)], _POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        page = TaskContext.get().partitionId() << 24
        ids, sets, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is not None and len(s := shingle_set(text, n)):
                    ids.append(doc)
                    sets.append(s)
                    held += len(s)
                    if held >= PAGE_POSTINGS:
                        yield from close(page, ids, sets)
                        page, ids, sets, held = page + 1, [], [], 0
        if ids:
            yield from close(page, ids, sets)
            del ids, sets
            trim()

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """A fragment's postings from all pages: those of n-grams with two documents or more, and how many."""
    pages, heads = table.column("page").to_pylist(), table.column("head").to_pylist()
    hs = [unpack_sorted(b) for b in table.column("h").to_pylist()]
    sizes = [len(x) for x in hs]
    h = np.concatenate(hs)
    del hs
    order = np.argsort(h, kind="stable")
    s = h[order]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(s)))
    df = np.empty(len(s), np.int64)
    df[order] = np.repeat(runs, runs)
    del order, s
    rows, at = [], 0
    for page, head, size, d in zip(pages, heads, sizes, table.column("d").to_pylist(), strict=True):
        live = df[at : at + size] >= 2
        if live.any() or head is not None:
            rows.append((page, int(table.column("frag")[0].as_py()), head, pack_sorted(h[at : at + size][live]), pack_ints(unpack_ints(d)[live]), pack_ints(df[at : at + size][live])))
        at += size
    return pa.Table.from_batches([_batch(rows, _POSTINGS)])


def bitmap(live: np.ndarray, n: int) -> np.ndarray:
    """Parity bitmap of n-gram hashes, as 64-bit words: a power of two of bits, 2 n or more up to MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * n - 1).bit_length()))
    odd = np.bincount((live % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of words) narrowed to ``width`` words: parities of the places that fall together."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width), axis=1)


_PARTS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("live", pa.binary()), ("prefix", pa.list_(pa.int64())), ("e1", pa.int64()), ("e2", pa.int64()), ("w", pa.float64()), ("bits", pa.binary())])
_PARTS_DDL = "id long, n long, size long, part int, live binary, prefix array<long>, e1 long, e2 long, w double, bits binary"


def _survivors(percent: int, fragments: int):
    """Pages' live postings to documents that can link: their live n-grams and prefix by vertical part."""
    width = np.uint64(-(-(1 << 64) // fragments))

    def close(head: bytes, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        both = np.frombuffer(head, "<i8").reshape(2, -1)
        h, d, f = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((h, f, d))
        h, d, f = h[order], d[order].astype(np.int64), f[order]
        cuts = np.searchsorted(d, np.arange(both.shape[1] + 1))
        rows = []
        for i in range(both.shape[1]):
            doc, size = int(both[0, i]), int(both[1, i])
            own = h[cuts[i] : cuts[i + 1]]
            need = -(-percent * size // 100)
            if len(own) < need:
                continue
            prefix = own[: len(own) - need + 1]  # n-grams of one document come first in the order and are gone
            whole = (own >> np.uint64(61)).astype(np.int64)
            e1, e2 = np.frombuffer(xxhash.xxh3_128_digest(np.sort(own).tobytes()), "<i8").tolist()
            order, bits = prefix.view(np.int64).tolist(), bitmap(own, size).tobytes()
            weight = float(f[cuts[i] : cuts[i + 1]].sum()) / size
            for part in range(PARTS):
                live = np.sort(own[whole == part])
                if len(live):
                    rows.append((doc, size, len(own), part, live.astype("<u8").tobytes(), order, e1, e2, weight, bits))
                    order = bits = None  # with the first part only
            if len(rows) > 4000:
                yield _batch(rows, _PARTS)
                rows = []
        yield _batch(rows, _PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, head, parts = None, b"", []
        for batch in batches:
            for number, frag, head_, h, d, f in zip(*(batch.column(c).to_pylist() for c in _POSTINGS.names), strict=True):
                if number != page:
                    if page is not None:
                        yield from close(head, parts)
                    page, parts = number, []
                if head_ is not None:
                    head = head_
                parts.append((unpack_sorted(h) + np.uint64(frag) * width, unpack_ints(d), unpack_ints(f)))
        if page is not None:
            yield from close(head, parts)

    return run


def _shared(x: bytes | None, y: bytes | None) -> int:
    return len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) if x and y else 0


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of each (pair, part)."""
    for batch in batches:
        n = list(map(_shared, batch.column("va").to_pylist(), batch.column("vb").to_pylist()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb", "got")), pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "got", "partial"])


def _part_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with one part's overlap added to got, and its n-grams taken off sa and sb."""
    names = ["a", "b", "na", "nb", "sa", "sb", "got"]
    for batch in batches:
        va, vb = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("sa", "sb", "got")}
        own["got"] = own["got"] + np.fromiter(map(_shared, va, vb), np.int64, len(va))
        own["sa"] = own["sa"] - np.array([len(x or b"") // 8 for x in va], np.int64)
        own["sb"] = own["sb"] - np.array([len(x or b"") // 8 for x in vb], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own[c]) if c in own else batch.column(c) for c in names], names=names)


class _Verifier:
    """Counts overlaps of pairs part by part and sums them; remembers what was tested."""

    def __init__(self, ws: Workspace, parts: DataFrame, percent: int):
        self.ws, self.parts, self.percent, self.rounds = ws, parts.select("id", "part", "live"), percent, 0
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None

    def fits(self, x: str, y: str):
        """Whether two documents that meet at a token can link, if it is the first they share:
        no more than the live n-grams from there on can be common to both."""
        of = lambda d, f: F.col(f"{d}.{f}")
        both = of(x, "n") + of(y, "n")
        most = F.least(of(x, "size") - of(x, "place"), of(y, "size") - of(y, "place"))
        return most * (100 + self.percent) >= both * self.percent

    def _part(self, pairs: DataFrame, part: int) -> DataFrame:
        """Pairs after one more part: got grows by its overlap, what is left of a and b shrinks; hopeless ones go."""
        side = lambda d, v: self.parts.filter(F.col("part") == part).select(F.col("id").alias(d), F.col("live").alias(v))
        rows = pairs.join(side("a", "va"), "a", "left").join(side("b", "vb"), "b", "left")
        out = rows.mapInArrow(_part_overlaps, pairs.schema)
        most = F.col("got") + F.least("sa", "sb")
        return out.filter(most * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent)

    def test(self, pairs: DataFrame) -> int:
        """Test pairs (a, b, na, nb, sa, sb) that weren't tested before; returns how many.

        Many pairs are counted in the first parts one by one, and only those that can
        still link go on to the others.
        """
        self.rounds += 1
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.ws.table(pairs.select("a", "b", "na", "nb", "sa", "sb", F.lit(0).cast("long").alias("got")), f"pairs-{self.rounds}")
        n = pairs.count()
        self.tested = pairs.select("a", "b") if self.tested is None else self.tested.unionByName(pairs.select("a", "b"))
        if not n:
            return 0
        done = 0
        while n > STAGED and done < PARTS - 2:
            pairs = self.ws.table(self._part(pairs, done), f"pairs-{self.rounds}-{done}")
            done += 1
        rest = self.parts.filter(F.col("part") >= done)
        left = rest.select(F.col("id").alias("a"), "part", F.col("live").alias("va"))
        right = rest.select(F.col("id").alias("b"), "part", F.col("live").alias("vb"))
        rows = left.join(small_side(pairs), "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", "got", "va", "vb")
        partial = rows.mapInArrow(_overlaps, "a long, b long, na long, nb long, got long, partial long")
        if done:
            # A pair whose n-grams are all in the parts counted before has no row in the others.
            partial = partial.unionByName(pairs.select("a", "b", "na", "nb", "got", F.lit(0).cast("long").alias("partial")))
        total = partial.groupBy("a", "b", "na", "nb", "got").agg(F.sum("partial").alias("more")).withColumn("overlap", F.col("got") + F.col("more"))
        good = total.filter(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * self.percent)
        good = self.ws.table(good.select("a", "b", "overlap"), f"links-{self.rounds}")
        self.links = good if self.links is None else self.links.unionByName(good)
        return n


def _pairs(joined: DataFrame) -> DataFrame:
    """Rows with documents x and y as pairs, smaller id first."""
    small = F.col("x.id") < F.col("y.id")
    pick = lambda x, y: F.when(small, F.col(x)).otherwise(F.col(y))
    return joined.select(pick("x.id", "y.id").alias("a"), pick("y.id", "x.id").alias("b"), pick("x.n", "y.n").alias("na"), pick("y.n", "x.n").alias("nb"), pick("x.size", "y.size").alias("sa"), pick("y.size", "x.size").alias("sb"))


def _near(percent: int, x: dict[str, np.ndarray], y: dict[str, np.ndarray], bx: list[bytes], by: list[bytes], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows of x and y) in different components that can link by size, place and bitmap."""
    out = []
    wide = lambda b: np.array([len(v) // 8 for v in b])
    wx, wy = wide(bx), wide(by)
    for p in np.unique(wx).tolist():
        for q in np.unique(wy).tolist():
            i, j = np.flatnonzero(wx == p), np.flatnonzero(wy == q)
            width = min(p, q)
            words = lambda b, at: folded(np.frombuffer(b"".join([b[k] for k in at.tolist()]), "<u8").reshape(len(at), -1), width)
            u, v = words(bx, i), words(by, j)
            step = max(1, BLOCK_WORDS // max(1, len(j)))
            for lo in range(0, len(i), step):
                r = i[lo : lo + step]
                n = x["n"][r, None] + y["n"][None, j]
                live = x["size"][r, None] + y["size"][None, j]
                most = np.minimum((x["size"] - x["place"])[r, None], (y["size"] - y["place"])[None, j])
                ok = (most * (100 + percent) >= n * percent) & (x["c"][r, None] != y["c"][None, j])
                ok &= x["id"][r, None] < y["id"][None, j] if same else x["id"][r, None] != y["id"][None, j]
                a, b = np.nonzero(ok)
                for at in range(0, len(a), k := max(1, BLOCK_WORDS // width)):
                    s, t = a[at : at + k], b[at : at + k]
                    apart = np.bitwise_count(u[lo + s] ^ v[t]).sum(axis=1, dtype=np.int64)
                    # The overlap is at most half of what the sets hold less what they don't share.
                    fit = (live[s, t] - apart) * (100 + percent) >= 2 * n[s, t] * percent
                    out.append((r[s[fit]], j[t[fit]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _blocks(percent: int):
    """Blocks of buckets, sorted by (token, i, j), to the pairs that are worth a test."""
    numbers = ("id", "n", "size", "place", "c")
    key = ("token", "i", "j")

    def close(rows: list[tuple]) -> pa.RecordBatch:
        cols = {c: np.array(v) for c, v in zip(numbers, list(zip(*rows, strict=True))[:5], strict=True)}
        bits, right = [r[5] for r in rows], np.array([r[6] for r in rows])
        side = lambda at: ({c: v[at] for c, v in cols.items()}, [bits[k] for k in at.tolist()])
        left = np.flatnonzero(~right)
        x, bx = side(left)
        y, by = (x, bx) if not right.any() else side(np.flatnonzero(right))
        a, b = _near(percent, x, y, bx, by, not right.any())
        swap = x["id"][a] > y["id"][b]
        pick = lambda c: (np.where(swap, y[c][b], x[c][a]), np.where(swap, x[c][a], y[c][b]))
        return pa.RecordBatch.from_arrays([pa.array(v) for c in ("id", "n", "size") for v in pick(c)], names=["a", "b", "na", "nb", "sa", "sb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            data = [batch.column(c).to_pylist() for c in (*numbers, "bits", "right")]
            for own, row in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), zip(*data, strict=True), strict=True):
                if own != at:
                    if len(held) > 1:
                        yield close(held)
                    at, held = own, []
                held.append(row)
        if len(held) > 1:
            yield close(held)

    return run


def _compared(rows: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows (token, x, c) that share a token, differ in c and can link; buckets in blocks of two shares.

    A block holds at most some 2 * SHARE documents; of a bucket of s shares a document
    goes to s + 1 blocks.
    """
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("__k"))
    bits = parts.filter("bits IS NOT NULL").select(F.col("id").alias("__id"), "bits")
    own = rows.join(sizes, "token").join(bits, F.col("x.id") == F.col("__id"))
    own = own.withColumn("shares", F.ceil(F.col("__k") / SHARE).cast("int")).withColumn("share", F.pmod(F.xxhash64("x.id"), F.col("shares")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    dealt = own.select("token", other.alias("other"), "share", "x.id", "x.n", "x.size", "x.place", "c", "bits")
    i, j = F.least("share", "other"), F.greatest("share", "other")
    dealt = dealt.select("token", i.alias("i"), j.alias("j"), "id", "n", "size", "place", "c", "bits", ((F.col("share") == j) & (i != j)).alias("right"))
    near = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return near.mapInArrow(_blocks(percent), "a long, b long, na long, nb long, sa long, sb long")


def _with_all_kin(links: DataFrame | None, kin: DataFrame, percent: int) -> DataFrame | None:
    """All links of the heads and of their kin: kin link with whatever their head links with, and with each other."""
    if not kin.limit(1).count():
        return links
    one = kin.select("head", "id", "n", "size")
    members = one.unionByName(one.select("head", F.col("head").alias("id"), "n", "size").distinct())
    inner = members.filter(F.col("size") * (100 + percent) >= 2 * F.col("n") * percent)
    out = inner.select("head", F.col("id").alias("a"), F.col("size").alias("overlap")).join(inner.select("head", F.col("id").alias("b")), "head").filter("a < b").select("a", "b", "overlap")
    if links is None:
        return out
    side = lambda d: members.select(F.col("head").alias(d), F.col("id").alias(f"{d}_kin"))
    rows = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_kin", "a").alias("x"), F.coalesce("b_kin", "b").alias("y"), "overlap")
    return out.unionByName(rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap"))


def _with_kin(links: DataFrame | None, kin: DataFrame, percent: int) -> DataFrame | None:
    """Links of the heads and of their kin: to the head if they link with each other, and as the head does."""
    if not kin.limit(1).count():
        return links
    inner = F.col("size") * (100 + percent) >= 2 * F.col("n") * percent
    out = kin.filter(inner).select(F.col("head").alias("a"), F.col("id").alias("b"), F.col("size").alias("overlap"))
    if links is None:
        return out
    ends = links.select(F.col("a").alias("head"), F.col("b").alias("other"), "overlap").unionByName(links.select(F.col("b").alias("head"), F.col("a").alias("other"), "overlap"))
    one = ends.groupBy("head").agg(F.min(F.struct("other", "overlap")).alias("y"))
    as_head = kin.filter(~inner).join(one, "head").select(F.least("id", "y.other").alias("a"), F.greatest("id", "y.other").alias("b"), F.col("y.overlap").alias("overlap"))
    return links.unionByName(out).unionByName(as_head)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, every_link: bool = False) -> JaccardJoin:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    ``every_link``: all links and their number by document, not only links that span the components.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "jaccard")
    fragments = fragment_count(docs.select(text_col), spark)
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    described = ws.table(source.mapInArrow(_describe(n), "id long, n long, d1 long, d2 long"), "described")
    classes = ws.table(described.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("rep")), "classes")

    postings = source.mapInArrow(_postings(n, fragments), _POSTINGS_DDL)
    live = postings.groupBy("frag").applyInArrow(_frequencies, _POSTINGS_DDL)
    dealt = live.repartition(scale_parts(spark), "page").sortWithinPartitions("page", "frag")
    parts = dealt.mapInArrow(_survivors(percent, fragments), _PARTS_DDL)
    parts = ws.table(parts.join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "all-parts")
    # Equal live n-grams and size: equal overlaps with everything else. One document of each such kin is compared.
    kin = ws.table(parts.groupBy("id", "n", "size", "e1", "e2").agg(F.count(F.lit(1)).alias("rows")).drop("rows"), "live")
    heads = kin.groupBy("n", "e1", "e2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("k"))
    kin = ws.table(kin.join(heads.filter("k > 1"), ["n", "e1", "e2"]).filter("id <> head").select("id", "n", "size", "head"), "kin")
    parts = ws.table(parts.drop("e1", "e2").join(kin.select("id"), "id", "left_anti"), "parts")
    met = parts.filter("prefix IS NOT NULL").select("id", "n", "size", "w", F.posexplode("prefix").alias("place", "token"))
    doc = F.struct("id", "n", "size", "place", "w")
    tokens = ws.table(met.select("token", doc.alias("x")), "tokens")
    buckets = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max_by("x", F.struct("x.w", -F.col("x.id"))).alias("y")).filter("k > 1")

    check = _Verifier(ws, parts, percent)
    other = F.col("x.id") != F.col("y.id")
    check.test(_pairs(tokens.join(buckets.select("token", "y"), "token").filter(other & check.fits("x", "y"))))
    # Buckets of two are done: their one pair was tested. The others may hold more links.
    rows = ws.table(tokens.join(buckets.filter("k > 2").select("token"), "token", "left_semi"), "rows")
    if every_link:
        check.test(_compared(rows.withColumn("c", F.col("x.id")), parts, percent))
    for last in () if every_link else (False, True):
        # Without a link yet, every document is a component of its own, and there is no hub with links.
        if check.links is None:
            if not last:
                continue
            own = ws.table(rows.select("token", "x", F.col("x.id").alias("c")), f"own-{check.rounds}")
        else:
            nodes = connected(check.links, ws, name=f"cc{check.rounds}")
            own = rows.join(nodes.select(F.col("node").alias("__node"), "component"), F.col("x.id") == F.col("__node"), "left")
            own = ws.table(own.select("token", "x", F.coalesce("component", "x.id").alias("c")), f"own-{check.rounds}")
        mixed = own.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
        if not last:
            ends = check.links.select(F.col("a").alias("__end")).unionByName(check.links.select(F.col("b").alias("__end")))
            degrees = ends.groupBy("__end").agg(F.count(F.lit(1)).alias("degree"))
            ranked = own.join(mixed, "token", "left_semi").join(degrees, F.col("x.id") == F.col("__end"), "left")
            hubs = ranked.groupBy("token").agg(F.max_by(F.struct("x", "c"), F.struct(F.coalesce("degree", F.lit(0)), "x.w", -F.col("x.id"))).alias("hub"))
            hubs = hubs.select("token", F.col("hub.x").alias("y"), F.col("hub.c").alias("yc"))
            check.test(_pairs(own.join(hubs, "token").filter((F.col("c") != F.col("yc")) & check.fits("x", "y"))))
        else:
            check.test(_compared(own.join(mixed, "token", "left_semi"), parts, percent))

    links = (_with_all_kin if every_link else _with_kin)(check.links, kin, percent)
    if links is not None:
        links = ws.table(links, "links")
        nodes = connected(links, ws, name="all")
        of = classes.join(nodes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    else:
        of = classes.withColumn("component", F.lit(None).cast("long"))
    of = of.select("d1", "d2", "rep", F.coalesce("component", "rep").alias("component"))
    if every_link and links is not None:
        ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
        of = of.join(ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links")), "rep", "left")
    elif every_link:
        of = of.withColumn("n_links", F.lit(0).cast("long"))
    out = described.join(of, ["d1", "d2"], "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id"))
    documents = out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("rep")).alias("class_id"),
        F.when(F.col("id").isNull() | (F.col("n") == 0), own).otherwise(F.col("component")).cast("long").alias("component_id"),
        *([F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if every_link else []),
    )
    return JaccardJoin(documents, links if links is not None else spark.createDataFrame([], "a long, b long, overlap long"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, list_sort(s) AS s FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sizes UNION SELECT v, root FROM reach JOIN ways ON u = node WHERE root <> v),
roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
classes AS (SELECT s, min(doc_id) AS class_id FROM sizes WHERE n > 0 GROUP BY s)
SELECT doc_id, n AS n_shingles, component_id, coalesce(class_id, doc_id) AS class_id
FROM sizes JOIN roots ON node = doc_id LEFT JOIN classes ON sizes.s = classes.s AND n > 0
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: components of documents that share nine tenths of their 3-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs).documents.select("doc_id", "n_shingles", "component_id", "class_id")


ORACLE_LINKS = (
    ORACLE.rpartition("SELECT doc_id, n AS")[0].rstrip()
    + """,
named AS (SELECT doc_id, n, coalesce(class_id, doc_id) AS class_id FROM sizes LEFT JOIN classes ON sizes.s = classes.s AND n > 0),
others AS (
  SELECT u AS doc_id, count(DISTINCT y.class_id) AS n_links FROM ways JOIN named x ON u = x.doc_id JOIN named y ON v = y.doc_id
  WHERE x.class_id <> y.class_id GROUP BY u)
SELECT named.doc_id AS doc_id, n AS n_shingles, component_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM named JOIN roots ON node = named.doc_id LEFT JOIN others ON others.doc_id = named.doc_id
"""
)


def query_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2, all links: as ``query``, with how many different texts each document links with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs, every_link=True).documents.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
