"""Sliding windows without joins.

A sample at ``t`` lies in the window of step k exactly for consecutive k, so windows
are made by exploding each sample over those k and grouping by (labels, step). Where
windows overlap much, samples are first reduced to buckets of the windows' common grain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid

#: Steps a sample may be copied to before it is bucketed first.
MAX_COPIES = 16


def first_step(t: Column, grid: Grid, offset: int) -> Column:
    """Number of the first step at or after ``t + offset``."""
    return F.ceil((t + F.lit(offset - grid.start)) / F.lit(float(grid.step))).cast("long")


def last_step(t: Column, grid: Grid, offset: int, width: int) -> Column:
    """Number of the last step whose window of ``width`` still holds ``t``."""
    return F.floor((t + F.lit(offset + width - 1 - grid.start)) / F.lit(float(grid.step))).cast("long")


def spread(df: DataFrame, grid: Grid, low: Column, high: Column) -> DataFrame:
    """A copy of each row for every step number from ``low`` to ``high``, as column ``step``."""
    low, high = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit(grid.count - 1).cast("long"))
    if grid.count == 1:
        return df.filter(low <= high).withColumn("step", F.lit(grid.start).cast("long"))
    k = F.explode(F.sequence(F.col("__lo"), F.col("__hi")))
    out = df.withColumn("__lo", low).withColumn("__hi", high).filter("__lo <= __hi")
    return out.withColumn("__k", k).withColumn("step", F.lit(grid.start) + F.col("__k") * grid.step).drop("__lo", "__hi", "__k")


def windows(df: DataFrame, grid: Grid, width: int, offset: int, time: str = "t") -> DataFrame:
    """Rows of every window ``(step - offset - width, step - offset]``."""
    t = F.col(time)
    return spread(df, grid, first_step(t, grid, offset), last_step(t, grid, offset, width))


def grain(grid: Grid, width: int) -> int | None:
    """Bucket size, where copying samples to all their steps costs more than bucketing first."""
    if grid.count == 1 or width <= MAX_COPIES * grid.step:
        return None
    return math.gcd(grid.step, width)


def bucket_end(t: Column, grid: Grid, offset: int, size: int) -> Column:
    """End of the bucket ``(end - size, end]`` that holds ``t``; window edges are bucket ends."""
    return (first_step(t, Grid(grid.start, grid.end, size), offset) * size + F.lit(grid.start - offset)).cast("long")
