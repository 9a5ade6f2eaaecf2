"""Selectors: the newest sample at each step."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.histograms import DDL as HISTOGRAM
from ..grid import Grid, Vector, col, ref
from ..lang.nodes import NAME, Select
from ..options import Options
from ..sources.series import Samples, passes
from .along import next_time
from .window import first_step, last_step, spread, windows

#: A lookback of more steps than this is done by each sample's successor, not by copies.
COPIES = 3


def scan(source, select: Select, low: int, high: int, options: Options, held: list[DataFrame]) -> Samples:
    """Samples of the selector's series in ``(low, high]``; residual matchers are put on a shared wide scan.

    ``held`` has the counts of the query's scans so far: the limit of samples is the query's.
    """
    found = source.scan(select.wide or select.matchers, low, high)
    df = found.df
    if select.wide:
        for m in select.matchers:
            if m not in select.wide and m.label in found.labels:
                df = df.filter(passes(m, ref(m.label)))
    if options.max_samples:
        over = F.raise_error(F.lit(f"PULSEGRID_SAMPLES: query holds more than {options.max_samples} samples"))
        # One count beside the rows, not a window over all of them in one task.
        held.append(df.agg(F.count(F.lit(1)).alias("__n")))
        n = reduce(DataFrame.unionByName, held).agg((F.sum("__n") > options.max_samples).alias("__over"))
        df = df.crossJoin(F.broadcast(n)).filter(F.when(F.col("__over"), over.cast("boolean")).otherwise(F.lit(True))).drop("__over")
    return replace(found, df=df)


def span(grid: Grid, at: int | None) -> Grid:
    """The steps at which a selector is evaluated: its own instant if it has one."""
    return grid if at is None else Grid(at, at, 1)


def repeated(df: DataFrame, grid: Grid) -> DataFrame:
    """Rows of one instant at every step of the grid."""
    return df.drop("step").crossJoin(F.broadcast(grid.df(df.sparkSession))) if grid.count > 1 else df.withColumn("step", F.lit(grid.start).cast("long"))


def without_buckets(h: Column) -> Column:
    """A histogram's schema, count and sum; of a stored one only these are read."""
    none = {"zero_threshold": F.lit(0.0), "zero_count": F.lit(0.0), "pos": F.lit(None), "neg": F.lit(None), "custom": F.lit(None), "hint": F.lit(0)}
    return F.when(h["count"].isNotNull(), F.struct(*[h[c].alias(c) for c in ("schema", "count", "sum")], *[v.alias(c) for c, v in none.items()]).cast(HISTOGRAM))


def instant(source, select: Select, grid: Grid, options: Options, held: list[DataFrame]) -> Vector:
    """For each series and step the newest sample in ``(step - offset - lookback, step - offset]``.

    Of several at one millisecond it is the first stored time's, and of those the least value,
    so that all selectors of a query take the same.
    """
    own = span(grid, select.at)
    width = options.lookback
    found = scan(source, select, own.start - select.offset - width, own.last - select.offset, options, held)
    if select.stats and found.hist:
        found = replace(found, df=found.df.withColumn("h", without_buckets(F.col("h"))))
    labels = [col(x) for x in found.labels]
    carried = ["v", *(["h"] if found.hist else []), *(["stale"] if found.stale else [])]
    if own.count > 1 and width > COPIES * own.step:
        # A sample holds from its own step until its successor's, or until it is too old.
        falling = (*([F.col("fine").desc()] if found.fine else []), F.col("v").desc_nulls_first())
        df = next_time(found.df, labels, "__later", options.chunk(own.start - width, own.last), then=falling)
        until = F.least(last_step(F.col("t"), own, select.offset, width), F.coalesce(first_step(F.col("__later"), own, select.offset) - 1, F.lit(own.count).cast("long")))
        df = spread(df, own, first_step(F.col("t"), own, select.offset), until)
        df = df.select(*[ref(x) for x in found.labels], "step", "t", *carried)
    else:
        # One long, not a struct: so Spark aggregates by hash.
        order = F.col("t") * 1000 - F.col("fine") if found.fine else F.col("t")
        newest = [F.max("t").alias("__t"), *[F.max_by(c, order).alias(c) for c in carried]]
        df = windows(found.df, own, width, select.offset).groupBy(*labels, "step").agg(*newest).withColumnRenamed("__t", "t")
    if found.stale:
        df = df.filter("NOT coalesce(stale, false)")
    hist = found.hist
    if select.own_time:
        df, hist = df.withColumn("v", F.col("t") / 1000.0), False
    df = df.select(*[ref(x) for x in found.labels], "step", "v", *(["h"] if hist else []))
    if select.at is not None:
        df = repeated(df, grid)
    return Vector(df, found.labels, hist, unique=True, named=found.named or NAME not in found.labels)
