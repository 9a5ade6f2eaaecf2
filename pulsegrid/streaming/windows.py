"""Fixed-step windows over a stream of samples.

The batch engine evaluates a finite grid. A stream is evaluated at the ends of its
windows: rows (labels..., step, v) where step is a window's end in epoch ms and the
window is ``(step - width, step]``, as in the query language. Spark's windows are open
at their end, so samples are shifted by one millisecond. Results come out, and state
goes, when the watermark passes a window's end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

AGGREGATES = {
    "sum_over_time": lambda: F.sum("v"),
    "avg_over_time": lambda: F.avg("v"),
    "min_over_time": lambda: F.min("v"),
    "max_over_time": lambda: N.greatest_of(F.col("v")),
    "count_over_time": lambda: F.count(F.lit(1)).cast("double"),
    "last_over_time": lambda: F.max_by("v", "ts"),
    "stddev_over_time": lambda: F.stddev_pop("v"),
}


def _window(width: int, step: int) -> Column:
    # (a, b] in ms is [a + 1, b + 1).
    return F.window("ts", f"{width} milliseconds", f"{step} milliseconds", "1 millisecond")


def _step(window: Column) -> Column:
    return F.unix_millis(window["end"]) - 1


def stream_windows(samples: DataFrame, fn: str, labels: Sequence[str], width: int, step: int, late: int) -> DataFrame:
    """A function of each series' windows; ``samples`` has the labels, ts (timestamp) and v."""
    rows = samples.withWatermark("ts", f"{late} milliseconds").groupBy(*labels, _window(width, step).alias("w"))
    return rows.agg(AGGREGATES[fn]().alias("v")).select(*labels, _step(F.col("w")).alias("step"), "v")


def stream_rate(samples: DataFrame, labels: Sequence[str], width: int, step: int, late: int) -> DataFrame:
    """Counter rate of each series' windows, with resets and extrapolation.

    A window's samples are one state row (a series' window is short); the arithmetic on
    the sorted samples is of column expressions.
    """
    rows = samples.withWatermark("ts", f"{late} milliseconds").groupBy(*labels, _window(width, step).alias("w"))
    out = rows.agg(F.sort_array(F.collect_list(F.struct(F.unix_millis("ts").alias("t"), "v"))).alias("s")).select(*labels, _step(F.col("w")).alias("step"), "s").filter(F.size("s") >= 2)
    s = F.col("s")
    first, last, n = s[0], F.element_at(s, -1), F.size(s)
    start = F.struct(N.d(0).alias("lost"), N.d(0).alias("p"))
    lost = F.aggregate(s, start, lambda a, x: F.struct((a["lost"] + F.when(x["v"] < a["p"], a["p"]).otherwise(N.d(0))).alias("lost"), x["v"].alias("p")), lambda a: a["lost"])
    out = out.withColumn("raw", last["v"] - first["v"] + lost).withColumn("span", (last["t"] - first["t"]) / 1000.0)
    gap = F.col("span") / (n - 1)
    head = (first["t"] - (F.col("step") - width)) / 1000.0
    head = F.when(head >= gap * 1.1, gap / 2).otherwise(head)
    zero = F.when((F.col("raw") > 0) & (first["v"] >= 0), F.col("span") * N.divide(first["v"], F.col("raw")))
    head = F.when(zero < head, zero).otherwise(head)
    tail = (F.col("step") - last["t"]) / 1000.0
    tail = F.when(tail >= gap * 1.1, gap / 2).otherwise(tail)
    return out.select(*labels, "step", (F.col("raw") * ((F.col("span") + head + tail) / F.col("span") / (width / 1000.0))).alias("v"))


def last_values(samples: DataFrame, label: str, timeout_ms: int) -> DataFrame:
    """The newest value of each series, and staleness: a series that is silent for ``timeout_ms`` gets one stale row.

    Custom state: a row for each series with its newest time and value.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            t, v = state.get
            state.remove()
            yield pd.DataFrame({label: [key[0]], "t": [t], "v": [v], "stale": [True]})
            return
        t, v = state.get if state.exists else (-(1 << 62), float("nan"))
        for b in batches:
            newest = b.loc[b["t"].idxmax()]
            if newest["t"] > t:
                t, v = int(newest["t"]), float(newest["v"])
        state.update((t, v))
        state.setTimeoutTimestamp(max(t, state.getCurrentWatermarkMs()) + timeout_ms)
        yield pd.DataFrame({label: [key[0]], "t": [t], "v": [v], "stale": [False]})

    rows = samples.withWatermark("ts", "0 milliseconds").withColumn("t", F.unix_millis("ts")).groupBy(label)
    return rows.applyInPandasWithState(update, f"{label} string, t long, v double, stale boolean", "t long, v double", "append", GroupStateTimeout.EventTimeTimeout)
