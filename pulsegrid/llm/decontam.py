"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

1. A window that shares no five-word shingle with any item has similarity 0. So words
   are looked up once in the set of all items' shingles, and windows start where a run
   of found shingles starts (or an item's first shingle is found): moving a window's
   start right to its first shared shingle never lowers its intersection, as long as
   the window still fits. Where it would leave the text, it is the text's last window
   of that size, and where the text is shorter than the item, the whole text.
2. From each start there is a window of every item size. Its SimHash is built from
   running sums over its shingles: lanes of a long count several bits at once (16 bits
   a lane, 32 where an item has more shingles than 16 bits count). The windows at a
   text's end are running sums from its end (start TAIL).
3. Items of the window's size are found by a multi-index: 64 bits in BLOCKS blocks of 3
   or 4 bits; two fingerprints within RADIUS = BLOCKS - 1 bits agree in at least one
   block, so every one within the radius is found. Of random pairs with a similarity of
   0.80 to 0.83, 99.9 % are within the radius (16,000 pairs of 20 to 100 shingles); the
   rest is what this method misses. Exact passages have distance 0.
4. Candidates are verified by exact weighted similarity: sum of minima over sum of
   maxima of the shingles' counts in window and item.

Texts are worked on once by digest, however many rows hold them. The items' shingles
and the texts with hits are broadcast only if counted small; beyond that the joins are
shuffled. A text that everybody copies is one text here.

Edge cases: words are `[^\\x20\\x09-\\x0D]+`, lower-cased. Null text has no words. Items
with fewer than five words have no shingle and match nothing. Repeated rows, null ids
and equal ids are reported row by row (one row for each distinct id and text). Of
windows with equal similarity the first is reported; one window with several items is
a row for each. A very long text is one row of hashes, and each of its starts costs as
many rows as the longest item has shingles. Other columns aren't read, whatever they
are called. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, small_side

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS = 20
RADIUS = BLOCKS - 1
#: In place of a start: the text's shingles from its end backwards.
TAIL = -1
#: Most distinct shingles of items that are broadcast (a hash and a flag each: some 100 MB).
KNOWN_ROWS = 3_000_000
_SPACES = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    one = F.translate(F.lower(F.coalesce(text, F.lit(""))), _SPACES, " " * 5)
    return F.array_remove(F.split(one, " ", -1), "")


def shingles_of(words: Column) -> Column:
    """64-bit hashes of a word array's shingles, in order; none for a short array."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, hashes).otherwise(F.array().cast("array<bigint>"))


def text_shingles(text: Column) -> Column:
    return F.element_at(F.transform(F.array(words_of(text)), shingles_of), 1)


def blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of the fingerprint's blocks."""
    cuts = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def lane(h: Column, bit: int, width: int) -> Column:
    """Bits bit, bit + width, ... of a hash, each in a lane of this width."""
    mask = sum(1 << k for k in range(0, 64, width))
    return F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(mask).cast("long"))


def fingerprint(n: Column, width: int) -> Column:
    """SimHash from the lanes' sums s0, s1, ...: a bit is set where more than half of the n shingles have it."""
    count = lambda b, j: F.shiftrightunsigned(F.col(f"s{b}"), width * j).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    bits = [F.when(count(b, j) * 2 > n, F.shiftleft(F.lit(1).cast("long"), width * j + b)).otherwise(F.lit(0).cast("long")) for b in range(width) for j in range(64 // width)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _keys(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int") + F.lit(16 * k) for k, (at, bits) in enumerate(blocks())])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, item_col, start, n_words, distance, similarity)``: each document's best window for each item it holds.

    start is the window's first word (from 0), n_words its length, distance the
    fingerprints' Hamming distance.
    """
    ws = Workspace(docs.sparkSession, "decontam")
    items = benchmark.select(F.col(item_col).alias("item"), text_shingles(F.col(item_text)).alias("h")).filter(F.size("h") > 0)
    items = ws.table(items.select("item", "h", F.size("h").alias("m")), "items")
    known = items.select(F.posexplode("h").alias("i", "h")).groupBy("h").agg((F.min("i") == 0).alias("first"))
    known = ws.table(known, "known")

    # Places of documents' shingles that any item has.
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), F.posexplode(text_shingles(F.col(text_col))).alias("pos", "h"))
    hits = ws.table(rows.join(small_side(known, KNOWN_ROWS), "h").select("doc", "k1", "k2", "pos", "first"), "hits")
    before = F.lag("pos").over(Window.partitionBy("k1", "k2").orderBy("pos"))
    places = hits.groupBy("k1", "k2", "pos").agg(F.max("first").alias("first"))
    starts = places.withColumn("before", before).filter(F.col("first") | F.col("before").isNull() | (F.col("before") < F.col("pos") - 1))
    starts = ws.table(starts.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "starts")

    # The shingles after each start, as far as the longest item reaches; texts once each.
    wanted = ws.table(items.select("m").distinct(), "sizes")  # not from Python: its rows would go through workers
    sizes = sorted(r.m for r in wanted.collect())
    longest = sizes[-1] if sizes else 1
    width = 16 if longest < 1 << 16 else 32
    again = docs.select(F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), F.col(text_col).alias("text"))
    own = again.join(small_side(starts), ["k1", "k2"]).select("k1", "k2", "starts", text_shingles(F.col("text")).alias("h")).dropDuplicates(["k1", "k2"])
    own = own.select("k1", "k2", "h", "starts", F.size("h").alias("n"), F.array_max("starts").alias("last"))
    ends = F.when(F.col("last") + longest > F.col("n"), F.array(F.lit(TAIL))).otherwise(F.array().cast("array<int>"))
    spread = own.select("k1", "k2", "h", "n", "last", F.explode(F.concat("starts", ends)).alias("start"))
    piece = F.when(F.col("start") == TAIL, F.slice(F.reverse("h"), 1, longest)).otherwise(F.slice("h", F.col("start") + 1, F.lit(longest)))
    spread = ws.table(spread.select("k1", "k2", "n", "last", "start", F.posexplode(piece).alias("off", "h")), "spread")

    # Running sums give the fingerprints of all window sizes.
    run = Window.partitionBy("k1", "k2", "start").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    lanes = [F.sum(lane(F.col("h"), b, width)).over(run).alias(f"s{b}") for b in range(width)]
    sums = lambda rows: rows.select("k1", "k2", "n", "last", "start", (F.col("off") + 1).alias("len"), *lanes)
    wanted = F.broadcast(wanted)
    full = sums(spread).join(wanted, F.col("len") == F.col("m")).filter((F.col("start") != TAIL) | (F.col("last") + F.col("m") > F.col("n")))
    short = sums(spread.filter((F.col("start") == TAIL) & (F.col("n") < longest))).filter(F.col("len") == F.col("n"))
    short = short.join(wanted, (F.col("m") > F.col("len")) & (F.col("len") / F.col("m") >= threshold))
    at = F.when(F.col("start") == TAIL, F.col("n") - F.col("len")).otherwise(F.col("start"))
    windows = full.unionByName(short).select("k1", "k2", "start", at.alias("at"), "len", "m", fingerprint(F.col("len"), width).alias("fp"))
    windows = ws.table(windows, "windows")
    totals = items.select("item", "m", F.explode("h").alias("h")).groupBy("item", "m").agg(*[F.sum(lane(F.col("h"), b, width)).alias(f"s{b}") for b in range(width)])
    prints = totals.select("item", "m", fingerprint(F.col("m"), width).alias("item_fp"))

    # Multi-index: equal size and an equal block; each distinct fingerprint is looked up once.
    left = windows.select("m", "fp").distinct().withColumn("block", F.explode(_keys(F.col("fp"))))
    right = prints.withColumn("block", F.explode(_keys(F.col("item_fp"))))
    near = left.join(right, ["m", "block"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("distance") <= RADIUS).select("m", "fp", "item", "distance").distinct()
    found = ws.table(windows.join(small_side(ws.table(near, "near")), ["m", "fp"]).select("k1", "k2", "start", "at", "len", "m", "item", "distance"), "candidates")

    # Exact weighted similarity.
    inside = spread.select("k1", "k2", "start", "off", "h").join(small_side(found), ["k1", "k2", "start"]).filter(F.col("off") < F.col("len"))
    of = ["k1", "k2", "at", "len", "item", "m", "distance"]
    counts = inside.groupBy(*of, "start", "h").agg(F.count(F.lit(1)).alias("n"))
    own_counts = items.select("item", F.explode("h").alias("h")).groupBy("item", "h").agg(F.count(F.lit(1)).alias("item_n"))
    shared = counts.join(own_counts, ["item", "h"]).groupBy(*of, "start").agg(F.sum(F.least("n", "item_n")).alias("shared"))
    similarity = F.col("shared") / (F.col("len") + F.col("m") - F.col("shared"))
    good = shared.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold)
    best = good.groupBy("k1", "k2", "item").agg(F.max_by(F.struct("at", "len", "distance", "similarity"), F.struct("similarity", -F.col("at"))).alias("w"))
    return (
        hits.select("doc", "k1", "k2").distinct().join(best, ["k1", "k2"])
        .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("w.at").cast("long").alias("start"), (F.col("w.len") + SHINGLE - 1).cast("long").alias("n_words"), F.col("w.distance").cast("int").alias("distance"), F.col("w.similarity").alias("similarity"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: benchmark items that documents hold."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
