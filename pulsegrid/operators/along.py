"""Neighbours and running sums along series.

Without a chunk each series is one window partition: sorted, with spilling, by one task.
With a chunk (ms) a series is cut by time into parts that different tasks sort; what a
part needs from its neighbours is one row a part, joined back. So one series may hold
any share of the samples.

``then`` are columns that order samples of one time, which a sort by time leaves open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PART = "__part"


def _parted(df: DataFrame, chunk: int, time: str) -> DataFrame:
    return df.withColumn(_PART, F.floor(F.col(time) / F.lit(float(chunk))).cast("long"))


def _quoted(keys: list[str]) -> list[str]:
    return [f"`{k}`" for k in keys]


def previous(df: DataFrame, keys: list[str], columns: dict[str, str], chunk: int = 0, time: str = "t", then: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the sample before: new name -> column; null at a series' first."""
    if not chunk:
        order = W.partitionBy(*keys).orderBy(time, *then)
        return df.withColumns({new: F.lag(old).over(order) for new, old in columns.items()})
    df = _parted(df, chunk, time)
    inner = W.partitionBy(*keys, _PART).orderBy(time, *then)
    newest = F.struct(time, *then) if then else time
    ends = df.groupBy(*keys, _PART).agg(*[F.max_by(old, newest).alias(f"__e_{new}") for new, old in columns.items()])
    between = W.partitionBy(*keys).orderBy(_PART)
    ends = ends.select(*_quoted(keys), _PART, *[F.lag(f"__e_{new}").over(between).alias(f"__e_{new}") for new in columns])
    first = F.lag(time).over(inner).isNull()
    df = df.withColumns({f"__l_{new}": F.lag(old).over(inner) for new, old in columns.items()} | {"__first": first})
    df = _join(df, ends, keys)
    df = df.withColumns({new: F.when(F.col("__first"), F.col(f"__e_{new}")).otherwise(F.col(f"__l_{new}")) for new in columns})
    return df.drop(_PART, "__first", *[f"__{x}_{new}" for new in columns for x in "el"])


def next_time(df: DataFrame, keys: list[str], new: str, chunk: int = 0, time: str = "t", then: tuple[Column, ...] = ()) -> DataFrame:
    """Time of the sample after; null at a series' last."""
    if not chunk:
        return df.withColumn(new, F.lead(time).over(W.partitionBy(*keys).orderBy(time, *then)))
    df = _parted(df, chunk, time)
    heads = df.groupBy(*keys, _PART).agg(F.min(time).alias("__head"))
    heads = heads.select(*_quoted(keys), _PART, F.lead("__head").over(W.partitionBy(*keys).orderBy(_PART)).alias("__head"))
    df = df.withColumn(new, F.lead(time).over(W.partitionBy(*keys, _PART).orderBy(time, *then)))
    return _join(df, heads, keys).withColumn(new, F.coalesce(new, "__head")).drop(_PART, "__head")


def running(df: DataFrame, keys: list[str], value: Column, new: str, chunk: int = 0, time: str = "t", then: tuple[str, ...] = ()) -> DataFrame:
    """The sum of ``value`` over a series' samples up to each one."""
    if not chunk:
        return df.withColumn(new, F.sum(value).over(W.partitionBy(*keys).orderBy(time, *then).rowsBetween(W.unboundedPreceding, 0)))
    df = _parted(df, chunk, time).withColumn("__x", value)
    totals = df.groupBy(*keys, _PART).agg(F.sum("__x").alias("__total"))
    before = F.sum("__total").over(W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*_quoted(keys), _PART, F.coalesce(before, F.lit(0)).alias("__before"))
    df = df.withColumn(new, F.sum("__x").over(W.partitionBy(*keys, _PART).orderBy(time, *then).rowsBetween(W.unboundedPreceding, 0)))
    return _join(df, totals, keys).withColumn(new, F.col(new) + F.col("__before")).drop(_PART, "__x", "__before")


def _join(df: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a part beside its samples; both sides are dealt by (series, part)."""
    return df.join(parts, [*keys, _PART], "left")


Rule = Callable[[Column, Column], Column]


def accumulated(df: DataFrame, keys: list[str], rule: Rule, new: str, chunk: int = 0, again: str | None = None) -> DataFrame:
    """The running sum of ``rule(v, previous v)``; nothing is added at a series' first sample.

    Samples of one time are taken by rising value, so that a counter doesn't fall among
    them. ``again``: a column that marks all of them but the first.
    """
    df = previous(df, keys, {"__p": "v", **({"__pt": "t"} if again else {})}, chunk, then=("v",))
    if again:
        df = df.withColumn(again, F.coalesce(F.col("__pt") == F.col("t"), F.lit(False))).drop("__pt")
    step = F.when(F.col("__p").isNull(), 0).otherwise(rule(F.col("v"), F.col("__p")))
    return running(df, keys, step, new, chunk, then=("v",)).drop("__p")
