"""Histogram functions: classic buckets by ``le``, and native histograms.

Classic ones are column expressions over a group's buckets (a histogram's bounds, so a
short list). Sums of native ones are explode-and-sum over buckets, which spreads a large
group; quantiles, fractions and variances fold over an array of buckets. Only kernels
over one series' window that holds histograms, and over two histograms, run in Arrow
batches; windows of floats never do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import histograms as H
from ..functions import numeric as N
from ..grid import Grid, Scalar, Vector, col, ref
from ..lang.nodes import RESERVED
from . import native
from .window import windows


# Classic histograms.


def _cumulative(x: Vector) -> tuple[DataFrame, tuple[str, ...]]:
    """Rows (labels but le, step, b): b the buckets (le, count), merged, ascending, monotonic."""
    labels = tuple(n for n in x.labels if n != "le")
    keys = [*[col(n) for n in labels], "step"]
    le = (ref("le") if "le" in x.labels else F.lit("")).try_cast("double")
    rows = x.floats().df.select(*[ref(n) for n in labels], "step", le.alias("le"), "v").filter("le IS NOT NULL")
    rows = rows.groupBy(*keys, "le").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("le", "v"))).alias("b"), F.sum("n").alias("n"))
    start = F.struct(F.array().cast("array<struct<le: double, v: double>>").alias("out"), F.lit(-math.inf).alias("top"))

    def grow(acc: Column, b: Column) -> Column:
        top = F.greatest(acc["top"], b["v"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(b["le"].alias("le"), top.alias("v")))).alias("out"), top.alias("top"))

    return out.withColumn("b", F.aggregate("b", start, grow, lambda acc: acc["out"])), labels


def classic_quantile(q: Scalar, x: Vector) -> tuple[DataFrame, tuple[str, ...]]:
    df, labels = _cumulative(x)
    df, quant = q.joined(df)
    df = df.withColumn("q", quant).withColumn("k", F.size("b")).withColumn("total", F.element_at("b", -1)["v"])
    rank = F.col("q") * F.col("total")
    df = df.withColumn("rank", rank)
    hit = F.array_position(F.transform(F.slice("b", F.lit(1), F.greatest(F.col("k") - 1, F.lit(1))), lambda b: b["v"] >= F.col("rank")), True).cast("int")
    df = df.withColumn("i", F.when(hit > 0, hit).otherwise(F.col("k")))
    at = lambda i: F.try_element_at("b", i)
    upper, count = at(F.col("i"))["le"], at(F.col("i"))["v"]
    first = F.col("i") == 1
    low = F.when(first, N.d(0)).otherwise(at(F.greatest(F.col("i") - 1, F.lit(1)))["le"])
    before = F.when(first, N.d(0)).otherwise(at(F.greatest(F.col("i") - 1, F.lit(1)))["v"])
    inside = low + (upper - low) * N.divide(F.col("rank") - before, count - before)
    value = (
        F.when(F.col("n") == 1, N.nan()).when(F.isnan("q"), N.nan()).when(F.col("q") < 0, -N.inf()).when(F.col("q") > 1, N.inf())
        .when((F.element_at("b", -1)["le"] != N.inf()) | (F.col("k") < 2) | (F.col("total") == 0) | F.isnan("total"), N.nan())
        .when(F.col("i") == F.col("k"), at(F.greatest(F.col("k") - 1, F.lit(1)))["le"])
        .when(first & (upper <= 0), upper).otherwise(inside)
    )
    return df.withColumn("v", value), labels


def classic_fraction(lo: Scalar, hi: Scalar, x: Vector) -> tuple[DataFrame, tuple[str, ...]]:
    df, labels = _cumulative(x)
    df, a = lo.joined(df)
    df = df.withColumn("lo", a)
    df, b = hi.joined(df)
    df = df.withColumn("hi", b).withColumn("k", F.size("b")).withColumn("total", F.element_at("b", -1)["v"])

    def below(x: Column) -> Column:
        """Observations at or below x, linear inside a bucket."""

        def add(acc: Column, b: Column) -> Column:
            low = F.when(acc["i"] == 0, F.when(b["le"] <= 0, -N.inf()).otherwise(N.d(0))).otherwise(acc["le"])
            part = F.when(x >= b["le"], d(b, acc)).when(x <= low, N.d(0)).when((low == -N.inf()) | (b["le"] == N.inf()), F.when(low == -N.inf(), d(b, acc)).otherwise(N.d(0))).otherwise(d(b, acc) * N.divide(x - low, b["le"] - low))
            return F.struct((acc["n"] + part).alias("n"), b["le"].alias("le"), b["v"].alias("v"), (acc["i"] + 1).alias("i"))

        d = lambda b, acc: b["v"] - acc["v"]
        start = F.struct(N.d(0).alias("n"), N.d(0).alias("le"), N.d(0).alias("v"), F.lit(0).alias("i"))
        return F.aggregate("b", start, add, lambda acc: acc["n"])

    value = (
        F.when((F.element_at("b", -1)["le"] != N.inf()) | (F.col("k") < 2) | (F.col("total") == 0) | F.isnan("total") | F.isnan("lo") | F.isnan("hi"), N.nan())
        .when(F.col("lo") >= F.col("hi"), N.d(0)).otherwise((below(F.col("hi")) - below(F.col("lo"))) / F.col("total"))
    )
    return df.withColumn("v", value), labels


# Native histograms.


def with_hist(x: Vector) -> Vector:
    """The vector with a histogram column, null where it had none."""
    return x if x.hist else Vector(x.df.withColumn("h", F.lit(None).cast(H.DDL)), x.labels, True, x.unique, x.named)


def kernel(df: DataFrame, keep: list[str], fn: Callable[[dict], tuple | None], out: str = "v double, h " + H.DDL) -> DataFrame:
    """``fn`` of every row as a dictionary; None drops the row. Rows go in Arrow batches."""
    added = T.StructType.fromDDL(out)
    schema = T.StructType([*[df.schema[c] for c in keep], *added.fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if (x := fn(row)) is not None:
                    rows.append({**{c: row[c] for c in keep}, **dict(zip([f.name for f in added.fields], x, strict=True))})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def instant_function(fn: str, x: Vector) -> Vector:
    """histogram_count, _sum, _avg, _stddev, _stdvar: floats have none."""
    if not x.hist:
        return Vector(x.df.filter(F.lit(False)), x.labels, False, x.unique, x.named).anonymous()
    df = x.df.filter("h IS NOT NULL")
    plain = {"histogram_count": F.col("h.count"), "histogram_sum": F.col("h.sum"), "histogram_avg": N.divide(F.col("h.sum"), F.col("h.count"))}
    if fn in plain:
        df = df.withColumn("v", plain[fn])
    else:
        spread = native.variance(F.col("h"), F.col("__b"))
        df = df.withColumn("__b", native.buckets(F.col("h"))).withColumn("v", F.sqrt(spread) if fn == "histogram_stddev" else spread)
    return Vector(df.select(*x.cols, "step", "v"), x.labels, False, x.unique, x.named).anonymous()


def buckets_function(fn: str, args: list[Scalar], x: Vector) -> Vector:
    """histogram_quantile and histogram_fraction, classic and native; both for one series at a step is neither."""
    df, labels = classic_quantile(args[0], x) if fn == "histogram_quantile" else classic_fraction(*args, x)
    df = df.select(*[ref(n) for n in labels], "step", "v")
    if x.hist:
        rows = x.df.filter("h IS NOT NULL").select(*[ref(n) for n in x.labels], "step", "h")
        for i, s in enumerate(args):
            rows, value = s.joined(rows)
            rows = rows.withColumn(f"p{i}", value)
        of = native.quantile if fn == "histogram_quantile" else native.fraction
        rows = rows.withColumn("__b", native.buckets(F.col("h"))).withColumn("v", of(*[F.col(f"p{i}") for i in range(len(args))], F.col("h"), F.col("__b")))
        rows = rows.select(*[ref(n) for n in labels], "step", "v")
        both = df.withColumn("__k", F.lit(0)).unionByName(rows.withColumn("__k", F.lit(1)))
        df = both.groupBy(*[col(n) for n in labels], "step").agg(F.count_distinct("__k").alias("kinds"), F.first("v").alias("v")).filter("kinds = 1")
    out = Vector(df.select(*[ref(n) for n in labels], "step", "v"), labels, False, True, x.named)
    return out.anonymous()


def combined(df: DataFrame, keys: list[str], op: str) -> DataFrame:
    """sum or avg of floats or of histograms in each group; groups with both have no result."""
    own = df.groupBy(*keys).agg(
        F.sum("v").alias("fs"), N.mean(F.col("v")).alias("fa"), F.count("v").alias("nf"), F.count("h").alias("nh"), F.min("h.schema").alias("schema"), F.max("h.schema").alias("high"),
        F.sum("h.count").alias("hc"), F.sum("h.sum").alias("hs"), F.max("h.zero_threshold").alias("zt"), F.sum("h.zero_count").alias("zc"), F.min("h.custom").alias("custom"), F.max("h.custom").alias("other"),
    ).filter("(nf = 0 OR nh = 0) AND (nh = 0 OR (schema = -53) = (high = -53)) AND custom IS NOT DISTINCT FROM other")
    rows = df.filter("h IS NOT NULL").join(own.filter("nh > 0").select(*[F.col(f"`{k}`") for k in keys], "schema", "zt"), keys)
    side = lambda m, s: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<int,double>"))), lambda e: F.struct(F.lit(s).alias("s"), e["key"].alias("i"), e["value"].alias("c")))
    entry = F.explode(F.concat(side(F.col("h.pos"), 1), side(F.col("h.neg"), -1)))
    cells = rows.select(*[F.col(f"`{k}`") for k in keys], "schema", "zt", F.col("h.schema").alias("fine"), entry.alias("e"))
    scale = F.when(F.col("fine") == -53, N.d(1)).otherwise(F.pow(N.d(2), (F.col("fine") - F.col("schema")).cast("double")))
    i = F.ceil(F.col("e.i") / scale).cast("int")
    cells = cells.select(*[F.col(f"`{k}`") for k in keys], "schema", "zt", F.col("e.s").alias("s"), i.alias("i"), F.col("e.c").alias("c"))
    upper = F.pow(N.d(2), F.col("i") * F.pow(N.d(2), -F.col("schema").cast("double")))
    sums = cells.groupBy(*keys, "schema", "zt", "s", "i").agg(F.sum("c").alias("c")).withColumn("zero", (F.col("schema") != -53) & (upper <= F.col("zt")))
    maps = sums.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when((F.col("s") == 1) & ~F.col("zero"), F.struct("i", "c")))).alias("pos"),
        F.map_from_entries(F.collect_list(F.when((F.col("s") == -1) & ~F.col("zero"), F.struct("i", "c")))).alias("neg"),
        F.sum(F.when(F.col("zero"), F.col("c")).otherwise(0)).alias("more"),
    )
    out = own.join(maps, keys, "left")
    n = F.col("nh") if op == "avg" else F.lit(1)
    none = F.create_map().cast("map<int,double>")
    h = F.struct(
        F.col("schema"), (F.col("hc") / n).alias("count"), (F.col("hs") / n).alias("sum"), F.col("zt").alias("zero_threshold"), ((F.col("zc") + F.coalesce("more", F.lit(0))) / n).alias("zero_count"),
        F.transform_values(F.coalesce("pos", none), lambda k, v: v / n).alias("pos"), F.transform_values(F.coalesce("neg", none), lambda k, v: v / n).alias("neg"), F.col("custom"), F.lit(0).cast("tinyint").alias("hint"),
    ).cast(H.DDL)
    return out.select(*[F.col(f"`{k}`") for k in keys], F.when(F.col("nf") > 0, F.col("fs") if op == "sum" else F.col("fa")).alias("v"), F.when(F.col("nh") > 0, h).alias("h"))


def scaled(h: Column, f: Column) -> Column:
    return F.when(
        h.isNotNull(),
        F.struct(
            h["schema"].alias("schema"), (h["count"] * f).alias("count"), (h["sum"] * f).alias("sum"), h["zero_threshold"].alias("zero_threshold"), (h["zero_count"] * f).alias("zero_count"),
            F.transform_values(h["pos"], lambda k, v: v * f).alias("pos"), F.transform_values(h["neg"], lambda k, v: v * f).alias("neg"), h["custom"].alias("custom"), h["hint"].alias("hint"),
        ).cast(H.DDL),
    )


def matched(op: str, boolean: bool, df: DataFrame, ah: bool, bh: bool) -> tuple[DataFrame, bool]:
    """Values of joined rows where either side may be a histogram; undefined mixes have none."""
    from .binary import _value

    null = F.lit(None).cast(H.DDL)
    df = df.withColumn("ah", F.col("ah") if ah else null).withColumn("bh", F.col("bh") if bh else null)
    keep = [c for c in df.columns if c not in ("av", "bv", "ah", "bh")]
    floats = df.filter("ah IS NULL AND bh IS NULL")
    v, cond = _value(op, boolean, F.col("av"), F.col("bv"))
    floats = (floats.filter(cond) if cond is not None else floats).select(*[F.col(f"`{c}`") for c in keep], v.alias("v"), null.alias("h"))
    mixed = df.filter("ah IS NOT NULL OR bh IS NOT NULL")

    def of(r: dict):
        a, b = r["ah"], r["bh"]
        if a and b:
            if op in ("+", "-"):
                h = H.combine(a, b, 1.0 if op == "+" else -1.0)
                return None if h is None else (None, h)
            if op in ("==", "!="):
                same = {k: (dict(x) if k in ("pos", "neg") else x) for k, x in a.items() if k != "hint"} == {k: (dict(x) if k in ("pos", "neg") else x) for k, x in b.items() if k != "hint"}
                yes = same == (op == "==")
                return (1.0 if yes else 0.0, None) if boolean else (None, H.copied(a)) if yes else None
            return None
        if op == "*":
            return None, H.times(a or b, r["bv"] if a else r["av"])
        if op == "/" and a:
            f = r["bv"]
            return None, H.times(a, 1 / f if f else math.copysign(math.inf, f))
        return None

    return floats.unionByName(kernel(mixed, keep, of)), True


def over_windows(fn: str, r, grid: Grid, args: list[Scalar], floats: Callable[..., DataFrame]) -> DataFrame:
    """Range functions of series with histograms: a kernel over each window that holds one, ``floats`` of the others."""
    keys = [*[col(x) for x in r.labels], "step"]
    held = windows(r.df.filter("h IS NOT NULL"), grid, r.width, r.offset).select(*keys).distinct()
    plain = floats(fn, replace(r, df=r.df.filter("h IS NULL").drop("h"), hist=False), grid, args)
    plain = plain.select(*keys, "v").join(held, keys, "left_anti").withColumn("h", F.lit(None).cast(H.DDL))
    rows = windows(r.df, grid, r.width, r.offset).join(held, keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("t", "v", "h")).alias("w"))
    for i, s in enumerate(args):
        rows, value = s.joined(rows)
        rows = rows.withColumn(f"p{i}", value)
    width, offset = r.width, r.offset

    def of(row: dict):
        return window_value(fn, sorted(row["w"], key=lambda s: s["t"]), row["step"], width, offset, [row[f"p{i}"] for i in range(len(args))])

    return kernel(rows, keys, of).unionByName(plain)


def window_value(fn: str, w: list[dict], step: int, width: int, offset: int, args: list[float]):
    """(v, h) of a window of floats and histograms; None for no sample."""
    hs, fs = [s for s in w if s["h"] is not None], [s for s in w if s["h"] is None]
    if fn == "count_over_time":
        return float(len(w)), None
    if fn == "present_over_time":
        return 1.0, None
    if fn in ("last_over_time", "first_over_time"):
        s = w[-1 if fn[0] == "l" else 0]
        return (s["v"], None) if s["h"] is None else (None, H.copied(s["h"]))
    if fn in ("ts_of_first_over_time", "ts_of_last_over_time"):
        return w[0 if "first" in fn else -1]["t"] / 1000.0, None
    if fn in ("changes", "resets"):
        n = 0
        for a, b in zip(w, w[1:], strict=False):
            if (a["h"] is None) != (b["h"] is None):
                n += 1
            elif a["h"] is None:
                n += (b["v"] < a["v"]) if fn == "resets" else (a["v"] != b["v"] and not (a["v"] != a["v"] and b["v"] != b["v"]))
            else:
                n += H.is_reset(b["h"], a["h"]) if fn == "resets" else H.copied(a["h"]) != H.copied(b["h"])
        return float(n), None
    if fn in ("sum_over_time", "avg_over_time"):
        if hs and fs:
            return None
        if hs:
            total = H.copied(hs[0]["h"])
            for s in hs[1:]:
                if (total := H.combine(total, s["h"])) is None:
                    return None
            return None, total if fn[0] == "s" else H.times(total, 1 / len(hs))
    if fn in ("rate", "increase", "delta", "irate", "idelta") and hs:
        if fs or len(hs) < 2:
            return None
        own = hs[-2:] if fn[0] == "i" and fn != "increase" else hs
        h = H.counter_increase([s["h"] for s in own], fn not in ("delta", "idelta"))
        if h is None:
            return None
        sampled = (own[-1]["t"] - own[0]["t"]) / 1000
        if fn == "irate":
            return None, H.times(h, 1 / sampled)
        if fn == "idelta":
            return None, h
        mean = sampled / (len(own) - 1)
        a, b = (own[0]["t"] - (step - width - offset)) / 1000, (step - offset - own[-1]["t"]) / 1000
        a = mean / 2 if a >= mean * 1.1 else a
        if fn != "delta" and h["count"] > 0 and own[0]["h"]["count"] >= 0:
            a = min(a, sampled * own[0]["h"]["count"] / h["count"])
        b = mean / 2 if b >= mean * 1.1 else b
        f = (sampled + a + b) / sampled
        return None, H.times(h, f / (width / 1000) if fn == "rate" else f)
    if not fs:
        return None
    from .floats import window_float

    v = window_float(fn, [(s["t"], s["v"]) for s in fs], step, width, offset, args)
    return None if v is None else (v, None)
