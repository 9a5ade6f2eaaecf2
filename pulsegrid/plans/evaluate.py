"""Logical plans to DataFrames. Nothing is computed here: the result is one lazy plan."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError, UnsupportedExpression
from ..functions import numeric as N
from ..grid import Grid, Scalar, Vector, col, ref
from ..lang.nodes import (
    NAME, SET_OPS, SORTS, Aggregate, Binary, Call, Dedup, Gather, Node, Nothing, Number, Once, Paren, Remote, Select, Subquery, Text, Unary, Unique, UserNode, Window, kind,
)
from ..operators import aggregate as agg
from ..operators import binary, labels, ranges
from ..operators import hist as histograms
from ..operators import select as selects
from ..options import Options

_CALENDAR_NOW = tuple(N.DATES)


class Evaluator:
    """Evaluates plans over one source. ``sources`` are those of remote parts."""

    def __init__(self, spark: SparkSession, source, options: Options, sources: tuple = ()):
        self.spark, self.source, self.options, self.sources = spark, source, options, sources
        self.warnings: list[str] = []
        self.checks: list[tuple] = []
        self.held: list[DataFrame] = []
        self._scalars = 0

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)

    def check(self, text: str, rows) -> None:
        """A warning that holds if ``rows`` has any."""
        self.checks.append((text, rows))

    # Scalars.

    def scalar(self, node: Node, grid: Grid) -> Scalar:
        if isinstance(node, Number):
            return Scalar.of(node.value)
        if isinstance(node, Paren | Once | Unique):
            return self.scalar(node.expr, grid)
        if isinstance(node, Unary):
            s = self.scalar(node.expr, grid)
            return s if node.op == "+" else Scalar(lambda step: -s.make(step), s.tables, None if s.value is None else -s.value)
        if isinstance(node, Binary):
            return binary.scalars(node.op, self.scalar(node.left, grid), self.scalar(node.right, grid))
        if isinstance(node, Call):
            if node.fn == "pi":
                return Scalar.of(3.141592653589793)
            if node.fn == "time":
                return Scalar(lambda step: step / 1000.0)
            if node.fn == "scalar":
                self._scalars += 1
                return labels.scalar(self.vector(node.args[0], grid), grid, self._scalars)
        raise UnsupportedExpression(f"not a scalar: {type(node).__name__}")

    # Vectors.

    def vector(self, node: Node, grid: Grid) -> Vector:
        if isinstance(node, Select):
            return selects.instant(self.source, node, grid, self.options, self.held)
        if isinstance(node, Paren):
            return self.vector(node.expr, grid)
        if isinstance(node, Unique):
            return checked(self.vector(node.expr, grid))
        if isinstance(node, Once):
            return self.once(node, grid)
        if isinstance(node, Unary):
            return self.unary(node, grid)
        if isinstance(node, Binary):
            return self.binary(node, grid)
        if isinstance(node, Aggregate):
            return self.aggregate(node, grid)
        if isinstance(node, Call):
            return self.call(node, grid)
        if isinstance(node, Remote):
            return self.remote(node, grid)
        if isinstance(node, Dedup):
            return self.dedup(node, grid)
        if isinstance(node, Gather):
            return self.gather(node, grid)
        if isinstance(node, Nothing):
            return Vector(self.spark.createDataFrame([], ", ".join([*(f"`{col(x)}` string" for x in node.labels), "step long", "v double"])), node.labels)
        if isinstance(node, UserNode):
            return node.to_vector(self, grid)
        raise UnsupportedExpression(f"{type(node).__name__} can't be evaluated on its own")

    def once(self, node: Once, grid: Grid) -> Vector:
        if grid.count == 1:
            return self.vector(node.expr, grid)
        x = self.vector(node.expr, Grid(grid.start, grid.start, 1))
        return replace(x, df=selects.repeated(x.df, grid).select(*x.cols, "step", *x.value))

    def unary(self, node: Unary, grid: Grid) -> Vector:
        x = self.vector(node.expr, grid)
        if node.op == "+":
            return x
        if x.hist:
            df = x.df.select(*x.cols, "step", (-F.col("v")).alias("v"), histograms.scaled(F.col("h"), N.d(-1)).alias("h"))
            return replace(x, df=df).anonymous()
        return x.with_values(-F.col("v")).anonymous()

    def binary(self, node: Binary, grid: Grid) -> Vector:
        kinds = kind(node.left), kind(node.right)
        if kinds == ("v", "v"):
            a, b = self.vector(node.left, grid), self.vector(node.right, grid)
            if node.op in SET_OPS:
                return binary.sets(node.op, a, b, node.match)
            return binary.vectors(node.op, a, b, node.match, node.boolean)
        left = kinds[0] == "s"
        x = self.vector(node.right if left else node.left, grid)
        s = self.scalar(node.left if left else node.right, grid)
        return binary.with_scalar(node.op, x, s, left, node.boolean)

    def aggregate(self, node: Aggregate, grid: Grid) -> Vector:
        param = None
        if node.param is not None:
            param = node.param.value if isinstance(node.param, Text) else self.scalar(node.param, grid)
            self.check_param(node.op, param)
        x = self.vector(node.expr, grid)
        if x.hist and node.op in ("sum", "avg"):
            keys = [*[col(n) for n in agg.group_labels(x, node.labels, node.without)], "step"]
            self.check("encountered a mix of histograms and floats for aggregation", x.df.groupBy(*keys).agg(F.count("v").alias("f"), F.count("h").alias("n")).filter("f > 0 AND n > 0"))
        elif x.hist and node.op in ("min", "max", "stddev", "stdvar", "quantile", "topk", "bottomk"):
            self.check(f"ignored histogram in {node.op} aggregation", x.df.filter("h IS NOT NULL"))
        return agg.aggregate(node.op, x, node.labels, node.without, param)

    def check_param(self, op: str, param) -> None:
        value = param.value if isinstance(param, Scalar) else None
        if op == "count_values" and not param.replace(":", "_").isidentifier():
            raise QueryError(f"invalid label name {param!r}")
        if value is None:
            return
        if op == "quantile" and not 0 <= value <= 1:
            self.warn(f"quantile value should be between 0 and 1, got {value}")
        if op == "limit_ratio":
            if value != value:
                raise QueryError("ratio value is NaN")
            if not -1 <= value <= 1:
                self.warn(f"ratio value should be between -1 and 1, got {value}")
        if op in ("topk", "bottomk", "limitk") and not -(2.0**63) <= value < 2.0**63:
            raise QueryError(f"parameter of {op} is out of range: {value}")

    # Functions.

    def call(self, node: Call, grid: Grid) -> Vector:
        fn, args = node.fn, node.args
        if any(kind(a) == "m" for a in args):
            return self.range_call(node, grid)
        if fn in SORTS:
            return self.vector(args[0], grid)
        if fn == "absent":
            inner = _bare(args[0])
            return labels.absent(self.vector(args[0], grid).df, inner.matchers if isinstance(inner, Select) else (), grid)
        if fn == "vector":
            return labels.vector(self.scalar(args[0], grid), grid, self.spark)
        if fn in _CALENDAR_NOW and not args:
            now = Vector(grid.df(self.spark), (), False, True, True)
            return now.with_values(N.DATES[fn](F.col("step") / 1000.0))
        if fn in ("histogram_quantile", "histogram_fraction"):
            given = [self.scalar(a, grid) for a in args[:-1]]
            if fn == "histogram_quantile" and given[0].value is not None and not 0 <= given[0].value <= 1:
                self.warn(f"quantile value should be between 0 and 1, got {given[0].value}")
            x = self.vector(args[-1], grid)
            if "le" in x.labels:
                self.check("bucket label 'le' is missing or has a malformed value", x.floats().df.filter(F.col("l_le").try_cast("double").isNull()))
            return histograms.buckets_function(fn, given, x)
        x = self.vector(args[0], grid)
        if fn == "timestamp":
            own = isinstance(_bare(args[0]), Select) and _bare(args[0]).own_time
            if own:
                return x.anonymous()
            df = x.df.select(*x.cols, "step", (F.col("step") / 1000.0).alias("v"))
            return replace(x, df=df, hist=False).anonymous()
        if fn == "label_replace":
            return labels.label_replace(x, *[_text(a) for a in args[1:]])
        if fn == "label_join":
            return labels.label_join(x, _text(args[1]), _text(args[2]), [_text(a) for a in args[3:]])
        if fn.startswith("histogram_"):
            return histograms.instant_function(fn, x)
        x = x.floats()
        if fn in N.MATH:
            return x.with_values(N.MATH[fn](F.col("v"))).anonymous()
        if fn in N.DATES:
            return x.with_values(N.DATES[fn](F.col("v"))).anonymous()
        return self.bounded(fn, x, [self.scalar(a, grid) for a in args[1:]]).anonymous()

    def bounded(self, fn: str, x: Vector, given: list[Scalar]) -> Vector:
        """round and the clamps, whose bounds may differ from step to step."""
        df = x.df
        for i, s in enumerate(given):
            df, c = s.joined(df)
            df = df.withColumn(f"__p{i}", c)
        x, v, p = replace(x, df=df), F.col("v"), [F.col(f"__p{i}") for i in range(len(given))]
        if fn == "round":
            return x.with_values(N.round_to(v, p[0] if p else N.d(1)))
        if fn == "clamp_min":
            return x.with_values(N.greatest(v, p[0]))
        if fn == "clamp_max":
            return x.with_values(N.least(v, p[0]))
        if fn == "clamp":
            return x.with_values(N.greatest(p[0], N.least(p[1], v)), ~((p[1] < p[0]) & ~F.isnan(p[0]) & ~F.isnan(p[1])))
        raise UnsupportedExpression(fn)

    def range_call(self, node: Call, grid: Grid) -> Vector:
        fn = node.fn
        arg = next(_bare(a) for a in node.args if kind(a) == "m")
        given = [self.scalar(a, grid) for a in node.args if kind(a) == "s"]
        if fn in ranges.COUNTERS and isinstance(arg, Window):
            name = next((m.value for m in arg.select.matchers if m.label == NAME and m.op == "="), "")
            if name and not name.endswith(("_total", "_sum", "_count", "_bucket")):
                self.warn(f"metric might not be a counter, name does not end in _total/_sum/_count/_bucket: {name!r}")
        if fn == "quantile_over_time" and given[0].value is not None and not 0 <= given[0].value <= 1:
            self.warn(f"quantile value should be between 0 and 1, got {given[0].value}")
        at = arg.select.at if isinstance(arg, Window) else arg.at
        own = selects.span(grid, at)
        extra = self.options.extended_lookback if fn in ("xrate", "xincrease", "xdelta") else 0
        if at is not None and fn == "predict_linear":
            raise UnsupportedExpression("predict_linear of a fixed instant")
        samples = self.subquery_samples(arg, own) if isinstance(arg, Subquery) else self.window_samples(arg, own, extra)
        if fn == "absent_over_time":
            x = ranges.apply("last_over_time", samples, own, [])
            matchers = arg.select.matchers if isinstance(arg, Window) else ()
            out = labels.absent(x.df, matchers, own)
        else:
            out = ranges.apply(fn, samples, own, given, extra)
        if at is not None:
            out = replace(out, df=selects.repeated(out.df, grid).select(*out.cols, "step", *out.value))
        return out

    def window_samples(self, node: Window, grid: Grid, extra: int) -> ranges.Ranged:
        s = node.select
        low, high = grid.start - s.offset - node.width - extra, grid.last - s.offset
        found = selects.scan(self.source, s, low, high, self.options, self.held)
        df = found.df.filter("NOT coalesce(stale, false)") if found.stale else found.df
        df = df.select(*[ref(x) for x in found.labels], "t", "v", *(["h"] if found.hist else []))
        return ranges.Ranged(df, found.labels, found.hist, found.named, node.width, s.offset, chunk=self.options.chunk(low, high))

    def subquery_samples(self, node: Subquery, grid: Grid) -> ranges.Ranged:
        """The inner query on its own grid of absolute multiples of its step, as samples."""
        step = node.step or self.options.sub_step
        low = grid.start - node.offset - node.width
        start = int(low / step) * step
        if start < low:
            start += step
        if start == low:
            start += step  # the window is open at its start
        end = grid.last - node.offset
        inner = Grid(start, max(start, end - (end - start) % step), step)
        if kind(node.expr) == "s":
            x = labels.vector(self.scalar(node.expr, inner), inner, self.spark)
        else:
            x = self.vector(node.expr, inner)
        df = x.df.select(*x.cols, F.col("step").alias("t"), *x.value)
        return ranges.Ranged(df, x.labels, x.hist, x.named, node.width, node.offset, True, self.options.chunk(low, end), x.unique)

    # Several sources.

    def remote(self, node: Remote, grid: Grid) -> Vector:
        other = Evaluator(self.spark, self.sources[node.source], self.options)
        own = grid
        if node.start is not None and node.start > grid.start:
            skip = -(-(node.start - grid.start) // grid.step)
            own = Grid(grid.start + skip * grid.step, grid.end, grid.step)
        if node.end is not None and node.end < own.end:
            own = Grid(own.start, node.end, own.step)
        if own.count < 1:
            return self.vector(Nothing(), grid)
        return other.vector(node.expr, own)

    def gather(self, node: Gather, grid: Grid) -> Vector:
        parts = [self.vector(p, grid) for p in node.parts]
        names, hist = tuple(sorted(set().union(*(p.labels for p in parts)))), any(p.hist for p in parts)
        if hist:
            parts = [histograms.with_hist(p) for p in parts]
        return Vector(reduce(lambda a, b: a.unionByName(b), [p.aligned(names, hist) for p in parts]), names, hist, False, False)

    def dedup(self, node: Dedup, grid: Grid) -> Vector:
        """Union of sources; the last one that has a series at a step wins, as a unit."""
        parts = [self.vector(p, grid) for p in node.parts]
        names = tuple(sorted(set().union(*(p.labels for p in parts))))
        hist = any(p.hist for p in parts)
        if hist:
            parts = [histograms.with_hist(p) for p in parts]
        rows = [p.aligned(names, hist).withColumn("__r", F.lit(i)) for i, p in enumerate(parts)]
        df = reduce(lambda a, b: a.unionByName(b), rows)
        best = df.groupBy(*[col(x) for x in names], "step").agg(F.max_by(F.struct("v", *(["h"] if hist else [])), "__r").alias("x"))
        return Vector(best.select(*[ref(x) for x in names], "step", *[F.col(f"x.{c}").alias(c) for c in (["v", "h"] if hist else ["v"])]), names, hist, True, all(p.named for p in parts) and len(parts) == 1)


def _bare(node: Node) -> Node:
    while isinstance(node, Paren | Once | Unique):
        node = node.expr
    return node


def _text(node: Node) -> str:
    return _bare(node).value


def checked(x: Vector) -> Vector:
    """Fails where two series have equal labels at a step; free where that can't be."""
    if x.unique:
        return x
    n = F.count(F.lit(1))
    fail = F.raise_error(F.lit("PULSEGRID_DUPLICATE: vector cannot contain metrics with the same labelset"))
    picked = [F.when(n > 1, fail.cast(x.df.schema[c].dataType) if c == "v" else F.first(c)).otherwise(F.first(c)).alias(c) for c in x.value]
    return replace(x, df=x.df.groupBy(*[col(n) for n in x.labels], "step").agg(*picked), unique=True)
