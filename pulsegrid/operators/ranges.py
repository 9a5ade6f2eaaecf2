"""Range functions: aggregates over the windows of a range selector or subquery."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import UnsupportedExpression
from ..functions import numeric as N
from ..grid import Grid, Scalar, Vector, col, ref
from ..lang.nodes import RESERVED
from .along import accumulated, previous
from .window import bucket_end, grain, windows

#: Functions over a window and the sample before it.
EXTENDED = ("xrate", "xincrease", "xdelta")
KEEPS_NAME = ("last_over_time", "first_over_time")
COUNTERS = ("rate", "increase", "irate", "xrate", "xincrease")


@dataclass(frozen=True)
class Ranged:
    """Samples for windows: rows (l_..., t, v[, h]), stale ones gone."""

    df: DataFrame
    labels: tuple[str, ...]
    hist: bool
    named: bool
    width: int
    offset: int
    from_subquery: bool = False
    #: Cut of long series, see ``along``.
    chunk: int = 0
    #: Names are kept through sub-expressions whose series are unique.
    unique: bool = True


def _state() -> dict[str, tuple[Column, Column]]:
    """State of a bucket of samples: column -> (of one sample, merged).

    Fixed-width columns, not structs: so Spark aggregates by hash, without a sort. Column e
    is the time of a sample that can be a window's first or last: of several at one time
    the first stands for all, and the others (null) are only counted.
    """
    return {
        "n": (F.lit(1).cast("long"), F.sum("n")),
        "s0": (N.pieces(F.col("v"))[0], F.sum("s0")),
        "s1": (N.pieces(F.col("v"))[1], F.sum("s1")),
        "s2": (N.pieces(F.col("v"))[2], F.sum("s2")),
        "lo": (F.col("v"), F.min("lo")),
        "hi": (N.not_nan(F.col("v")), F.max("hi")),
        "first_t": (F.col("e"), F.min("first_t")),
        "first_v": (F.col("v"), F.min_by("first_v", "first_t")),
        "first_c": (F.col("c"), F.min_by("first_c", "first_t")),
        "last_t": (F.col("e"), F.max("last_t")),
        "last_v": (F.col("v"), F.max_by("last_v", "last_t")),
        "last_c": (F.col("c"), F.max_by("last_c", "last_t")),
        "least_c": (F.col("c"), F.min("least_c")),
        "most_c": (F.col("c"), F.max("most_c")),
        "top": (F.when(~F.isnan("v"), F.struct(F.col("v"), F.col("t"))), F.max("top")),
        "low": (F.when(~F.isnan("v"), F.struct((-F.col("v")).alias("v"), F.col("t"))), F.max("low")),
    }


_ENDS = ("n", "first_t", "first_v", "first_c", "last_t", "last_v", "last_c")

#: Functions of mergeable state: columns they need, and their value from them.
_SIMPLE = {
    "sum_over_time": (("s0", "s1", "s2"), lambda: F.col("s0") + (F.col("s1") + F.col("s2"))),
    "count_over_time": (("n",), lambda: F.col("n").cast("double")),
    "min_over_time": (("lo",), lambda: F.col("lo")),
    "max_over_time": (("hi",), lambda: F.coalesce(F.col("hi"), N.nan())),
    "present_over_time": (("n",), lambda: N.d(1)),
    "last_over_time": (("last_t", "last_v"), lambda: F.col("last_v")),
    "first_over_time": (("first_t", "first_v"), lambda: F.col("first_v")),
    "ts_of_first_over_time": (("first_t",), lambda: F.col("first_t") / 1000.0),
    "ts_of_last_over_time": (("last_t",), lambda: F.col("last_t") / 1000.0),
    "ts_of_max_over_time": (("top", "last_t"), lambda: F.coalesce(F.col("top.t"), F.col("last_t")) / 1000.0),
    "ts_of_min_over_time": (("low", "last_t"), lambda: F.coalesce(F.col("low.t"), F.col("last_t")) / 1000.0),
    "changes": (("least_c", "most_c"), lambda: (F.col("most_c") - F.col("least_c")).cast("double")),
    "resets": (("least_c", "most_c"), lambda: (F.col("most_c") - F.col("least_c")).cast("double")),
    "rate": (_ENDS, None),
    "increase": (_ENDS, None),
    "delta": (_ENDS, None),
}

#: What accumulates along a series, so that a window's total is a difference of two samples.
_RUNNING = {
    "rate": lambda v, p: F.when(N.compare("<", v, p), p).otherwise(N.d(0)),
    "increase": lambda v, p: F.when(N.compare("<", v, p), p).otherwise(N.d(0)),
    "changes": lambda v, p: F.when((v != p) & ~(F.isnan(v) & F.isnan(p)), F.lit(1)).otherwise(F.lit(0)),
    "resets": lambda v, p: F.when(N.compare("<", v, p), F.lit(1)).otherwise(F.lit(0)),
}


def extrapolated(fn: str, width: int, offset: int) -> tuple[Column, Column]:
    """(keep, value) of rate, increase or delta from the state n, first, last."""
    counter = fn != "delta"
    raw = F.col("last_v") - F.col("first_v") + ((F.col("last_c") - F.col("first_c")) if counter else N.d(0))
    sampled = (F.col("last_t") - F.col("first_t")) / 1000.0
    mean = sampled / (F.col("n") - 1)
    to_start = (F.col("first_t") - (F.col("step") - (width + offset))) / 1000.0
    to_end = (F.col("step") - offset - F.col("last_t")) / 1000.0
    to_start = F.when(to_start >= mean * 1.1, mean / 2).otherwise(to_start)
    if counter:
        zero = F.when((raw > 0) & ~F.isnan(raw) & (F.col("first_v") >= 0), sampled * N.divide(F.col("first_v"), raw))
        to_start = F.when(zero < to_start, zero).otherwise(to_start)
    to_end = F.when(to_end >= mean * 1.1, mean / 2).otherwise(to_end)
    factor = N.divide(sampled + to_start + to_end, sampled)
    value = raw * (factor / (width / 1000.0) if fn == "rate" else factor)
    return F.col("n") >= 2, value


def _mergeable(fn: str, r: Ranged, grid: Grid) -> DataFrame:
    needs, value = _SIMPLE[fn]
    labels = [col(x) for x in r.labels]
    if fn in _RUNNING:
        df = accumulated(r.df, labels, _RUNNING[fn], "c", r.chunk, again="__again").withColumn("e", F.when(~F.col("__again"), F.col("t")))
    else:
        df = r.df.withColumns({"c": F.lit(0), "e": F.col("t")})
    size = grain(grid, r.width)
    parts = _state()
    merge = [parts[k][1].alias(k) for k in needs]
    state = df.select(*[ref(x) for x in r.labels], "t", *[parts[k][0].alias(k) for k in needs])
    if size:
        end = bucket_end(F.col("t"), grid, r.offset, size)
        state = state.groupBy(*labels, end.alias("t")).agg(*merge)
    out = windows(state, grid, r.width, r.offset).groupBy(*labels, "step").agg(*merge)
    if value is None:
        keep, v = extrapolated(fn, r.width, r.offset)
        return out.filter(keep).withColumn("v", v)
    return out.withColumn("v", value())


def _last_two(fn: str, r: Ranged, grid: Grid) -> DataFrame:
    """irate and idelta: the last two samples of the window."""
    labels = [col(x) for x in r.labels]
    df = previous(r.df, labels, {"pt": "t", "pv": "v"}, r.chunk)
    out = windows(df, grid, r.width, r.offset).groupBy(*labels, "step").agg(F.max("t").alias("xt"), *[F.max_by(c, "t").alias(f"x{c}") for c in ("v", "pt", "pv")])
    out = out.filter(F.col("xpt") > F.col("step") - (r.width + r.offset))
    diff = F.col("xv") - F.col("xpv")
    if fn == "idelta":
        return out.withColumn("v", diff)
    diff = F.when(N.compare("<", F.col("xv"), F.col("xpv")), F.col("xv")).otherwise(diff)
    return out.withColumn("v", diff / ((F.col("xt") - F.col("xpt")) / 1000.0))


def _moments(fn: str, r: Ranged, grid: Grid) -> DataFrame:
    of = {"avg_over_time": N.mean(F.col("v")), "stddev_over_time": N.spread(F.col("v"), F.stddev_pop), "stdvar_over_time": N.spread(F.col("v"), F.var_pop)}[fn]
    return windows(r.df, grid, r.width, r.offset).groupBy(*[col(x) for x in r.labels], "step").agg(of.alias("v"))


def _regression(fn: str, r: Ranged, grid: Grid, args: list[Scalar]) -> DataFrame:
    """deriv and predict_linear: least squares over seconds from the step."""
    df = windows(r.df, grid, r.width, r.offset).withColumn("x", (F.col("t") - F.col("step")) / 1000.0)
    out = df.groupBy(*[col(x) for x in r.labels], "step").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.regr_slope("v", "x").alias("m"), F.regr_intercept("v", "x").alias("b")
    ).filter("n >= 2")
    level = (F.col("lo") == F.col("hi")) & ~F.isnan("lo")
    flat = F.when(F.abs(F.col("lo")) == N.inf(), N.nan())
    slope = F.when(level, F.coalesce(flat, N.d(0))).otherwise(F.coalesce("m", N.nan()))
    if fn == "deriv":
        return out.withColumn("v", slope)
    out, ahead = args[0].joined(out)
    base = F.when(level, F.coalesce(flat, F.col("lo"))).otherwise(F.coalesce("b", N.nan()))
    return out.withColumn("v", slope * ahead + base)


def ranked(df: DataFrame, keys: list[str], q: Column) -> DataFrame:
    """Quantile ``q`` (a column, one value a group) of v in each group: rows (keys, v).

    By rank: the one or two rows next to the rank are picked from the sorted group, so a
    large group is sorted with spilling, never held as one value. NaN sorts first.
    """
    part = W.partitionBy(*keys)
    rows = df.withColumn("__q", q)
    n = F.count(F.lit(1)).over(part)
    i = F.row_number().over(part.orderBy(~F.isnan("v"), "v")) - 1
    rows = rows.withColumn("__n", n).withColumn("__i", i)
    rank = F.col("__q") * (F.col("__n") - 1)
    low = F.greatest(F.lit(0), F.least(F.floor(F.when(F.isnan(rank) | (F.abs(rank) == N.inf()), N.d(0)).otherwise(rank)), F.col("__n") - 1))
    rows = rows.withColumn("__low", low).filter((F.col("__i") == F.col("__low")) | (F.col("__i") == F.least(F.col("__low") + 1, F.col("__n") - 1)))
    out = rows.groupBy(*keys).agg(F.min_by("v", "__i").alias("lo"), F.max_by("v", "__i").alias("hi"), F.first("__q").alias("q"), F.first("__n").alias("n"))
    rank = F.col("q") * (F.col("n") - 1)
    weight = rank - N.floor(rank)
    value = F.when(F.isnan("q"), N.nan()).when(F.col("q") < 0, -N.inf()).when(F.col("q") > 1, N.inf()).otherwise(F.col("lo") * (1 - weight) + F.col("hi") * weight)
    return out.withColumn("v", value).select(*keys, "v")


def _quantile(r: Ranged, grid: Grid, q: Scalar) -> DataFrame:
    df, column = q.joined(windows(r.df, grid, r.width, r.offset))
    return ranked(df, [*[col(x) for x in r.labels], "step"], column)


def _mad(r: Ranged, grid: Grid) -> DataFrame:
    """Median distance from the median."""
    keys = [*[col(x) for x in r.labels], "step"]
    df = windows(r.df, grid, r.width, r.offset)
    middle = ranked(df, keys, N.d(0.5)).withColumnRenamed("v", "__m")
    return ranked(df.join(middle, keys).withColumn("v", F.abs(F.col("v") - F.col("__m"))), keys, N.d(0.5))


def _smooth(r: Ranged, grid: Grid, sf: Scalar, tf: Scalar) -> DataFrame:
    """Holt's linear smoothing over the window's samples in order (a window of one series)."""
    keys = [*[col(x) for x in r.labels], "step"]
    out = windows(r.df, grid, r.width, r.offset).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("w")).filter(F.size("w") >= 2)
    out, s = sf.joined(out)
    out = out.withColumn("__s", s)
    out, t = tf.joined(out)
    out = out.withColumn("__t", t).filter((F.col("__s") > 0) & (F.col("__s") < 1) & (F.col("__t") > 0) & (F.col("__t") < 1))
    w, a, b = F.col("w"), F.col("__s"), F.col("__t")
    start = F.struct(N.d(0).alias("s0"), w[0]["v"].alias("s1"), (w[1]["v"] - w[0]["v"]).alias("b"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        trend = F.when(acc["i"] == 0, acc["b"]).otherwise(b * (acc["s1"] - acc["s0"]) + (1 - b) * acc["b"])
        return F.struct(acc["s1"].alias("s0"), (a * x["v"] + (1 - a) * (acc["s1"] + trend)).alias("s1"), trend.alias("b"), (acc["i"] + 1).alias("i"))

    return out.withColumn("v", F.aggregate(F.slice(w, F.lit(2), F.size(w)), start, step, lambda acc: acc["s1"]))


def _extended(fn: str, r: Ranged, grid: Grid, extra: int) -> DataFrame:
    """xrate, xincrease, xdelta: the window and the last sample before it, not extrapolated."""
    labels = [col(x) for x in r.labels]
    counter, plain = fn != "xdelta", fn == "xincrease"
    df = accumulated(r.df, labels, _RUNNING["rate"], "c", r.chunk)
    # Also how often the value changed so far: none within a span of samples means all are equal.
    df = accumulated(df, labels, lambda v, p: F.when(N.compare("==", v, p), 0).otherwise(1), "k", r.chunk)
    born = r.df.groupBy(*labels).agg(F.min("t").alias("appeared"))
    df = df.join(born, labels, "left") if labels else df.crossJoin(F.broadcast(born))
    df = windows(df, grid, r.width + extra, r.offset)
    edge = F.col("step") - (r.width + r.offset)
    x = F.struct("t", "v", "c", "k")
    inside = F.col("t") > edge
    out = df.groupBy(*labels, "step").agg(
        F.max_by(x, F.when(~inside, F.col("t"))).alias("before"), F.min_by(x, F.when(inside, F.col("t"))).alias("first"),
        F.max_by(x, F.when(inside, F.col("t"))).alias("last"), F.count(F.when(inside, 1)).alias("m"), F.min("appeared").alias("appeared"),
    )
    had = F.col("before").isNotNull()
    n = F.col("m") + had.cast("int")
    head = F.coalesce("before", "first")
    tail = F.coalesce("last", "before")
    out = out.filter((F.col("m") >= 1) | had).withColumn("head", head).withColumn("tail", tail).withColumn("n", n)
    mean = N.divide((F.col("tail.t") - F.col("head.t")).cast("double"), (F.col("n") - 1).cast("double"))
    same = F.col("tail.k") == F.col("head.k")
    end = F.col("step") - r.offset
    if plain:
        fresh = same & (end <= r.width + F.col("appeared"))
        value = F.when(fresh, F.col("head.v")).otherwise(F.col("tail.v") - F.col("head.v") + F.col("tail.c") - F.col("head.c"))
        return out.withColumn("v", value)
    far = (edge - F.col("head.t")).cast("double") > mean
    used = F.when(far, F.col("first")).otherwise(F.col("head"))
    out = out.withColumn("far", far).withColumn("used", used)
    gap = N.divide((F.col("tail.t") - F.col("used.t")).cast("double"), (F.col("n") - F.when(F.col("far"), 2).otherwise(1)).cast("double"))
    total = F.col("tail.v") - F.col("used.v") + ((F.col("tail.c") - F.col("used.c")) if counter else N.d(0))
    sampled = (F.col("tail.t") - F.col("used.t")).cast("double")
    seconds = float(r.width // 1000)
    covers = (F.col("used.t") <= edge) & ~F.isnan(gap) & ((end - F.col("tail.t")).cast("double") < gap)
    total = F.when(covers, total * N.divide(N.d(seconds), sampled / 1000.0)).otherwise(total)
    total = N.divide(total, N.d(seconds)) if fn == "xrate" else total
    return out.withColumn("v", F.when(F.col("far") & (F.col("n") < 3), N.d(0)).otherwise(total))


def apply(fn: str, r: Ranged, grid: Grid, args: list[Scalar], extra: int = 0) -> Vector:
    """A range function over all windows; windows with histograms go to ``hist.over_windows``."""
    if fn in EXTENDED and r.from_subquery:
        raise UnsupportedExpression(f"{fn} over a subquery")
    if r.hist and fn not in EXTENDED:
        from .hist import over_windows

        df = over_windows(fn, r, grid, args, _floats)
    else:
        df = _floats(fn, replace(r, df=r.df.filter("h IS NULL")) if r.hist else r, grid, args, extra)
    value = ["v", "h"] if "h" in df.columns else ["v"]
    out = Vector(df.select(*[ref(x) for x in r.labels], "step", *value), r.labels, "h" in value, r.unique, r.named)
    keeps = fn == "last_over_time" or fn == "first_over_time" and not r.from_subquery
    return out if keeps else out.drop(*RESERVED)


def _floats(fn: str, r: Ranged, grid: Grid, args: list[Scalar], extra: int = 0) -> DataFrame:
    """Rows (labels, step, v) of a range function over float samples."""
    if fn in EXTENDED:
        return _extended(fn, r, grid, extra)
    if fn in _SIMPLE:
        return _mergeable(fn, r, grid)
    if fn in ("irate", "idelta"):
        return _last_two(fn, r, grid)
    if fn in ("avg_over_time", "stddev_over_time", "stdvar_over_time"):
        return _moments(fn, r, grid)
    if fn in ("deriv", "predict_linear"):
        return _regression(fn, r, grid, args)
    if fn == "quantile_over_time":
        return _quantile(r, grid, args[0])
    if fn == "mad_over_time":
        return _mad(r, grid)
    if fn == "double_exponential_smoothing":
        return _smooth(r, grid, *args)
    raise UnsupportedExpression(fn)
