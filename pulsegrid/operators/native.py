"""Quantile, fraction and variance of native histograms, as column expressions.

A histogram's buckets become an array of (lo, hi, c) from the lowest values to the
highest, and folds over it give the value; see ``functions.histograms`` for the layout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.histograms import CUSTOM

_CELL = "struct<lo: double, hi: double, c: double>"


def buckets(h: Column) -> Column:
    """Buckets with a count other than 0, by value."""
    custom, width = h["schema"] == CUSTOM, F.pow(N.d(2), -h["schema"].cast("double"))
    entries = lambda m: F.filter(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<int,double>")))), lambda e: e["value"] != 0)
    edge = lambda i: F.pow(N.d(2), i * width)
    cell = lambda lo, hi, c: F.struct(lo.alias("lo"), hi.alias("hi"), c.alias("c"))
    none = F.array().cast(f"array<{_CELL}>")

    def above(e: Column) -> Column:
        i = e["key"]
        lo = F.when(custom, F.coalesce(F.get(h["custom"], i - 1), -N.inf())).otherwise(edge(i - 1))
        return cell(lo, F.when(custom, F.coalesce(F.get(h["custom"], i), N.inf())).otherwise(edge(i)), e["value"])

    pos = F.transform(entries(h["pos"]), above)
    neg = F.when(custom, none).otherwise(F.transform(F.reverse(entries(h["neg"])), lambda e: cell(-edge(e["key"]), -edge(e["key"] - 1), e["value"])))
    z, some, less = h["zero_threshold"], F.size(entries(h["pos"])) > 0, F.size(entries(h["neg"])) > 0
    middle = cell(F.when(some & ~less, N.d(0)).otherwise(-z), F.when(less & ~some, N.d(0)).otherwise(z), h["zero_count"])
    return F.concat(neg, F.when(~custom & (h["zero_count"] != 0), F.array(middle)).otherwise(none), pos)


def _undefined(h: Column) -> Column:
    return (h["count"] == 0) | F.isnan(h["count"])


def _straight(h: Column, b: Column) -> Column:
    """Whether values are spread evenly within a bucket, not by their logarithm."""
    return (h["schema"] == CUSTOM) | ((b["lo"] <= 0) & (b["hi"] >= 0))


def quantile(q: Column, h: Column, rows: Column) -> Column:
    """The quantile of ``h`` with its ``rows`` (see ``buckets``)."""
    rank, last = q * h["count"], F.size(rows) - 1

    def inside(b: Column, seen: Column) -> Column:
        f = F.least(N.d(1), F.greatest(N.d(0), N.divide(rank - seen, b["c"])))
        lo = F.when((h["schema"] == CUSTOM) & (b["lo"] == -N.inf()), N.d(0)).otherwise(b["lo"])
        a, z = F.log2(F.abs(b["lo"])), F.log2(F.abs(b["hi"]))
        bent = F.pow(N.d(2), a + (z - a) * f)
        return (
            F.when((h["schema"] == CUSTOM) & (b["hi"] == N.inf()), b["lo"])
            .when((h["schema"] == CUSTOM) & (b["lo"] == -N.inf()) & (b["hi"] <= 0), b["hi"])
            .when(_straight(h, b), lo + (b["hi"] - lo) * f).otherwise(F.when(b["lo"] < 0, -bent).otherwise(bent))
        )

    def step(acc: Column, b: Column) -> Column:
        on = acc["v"].isNull() & (acc["seen"] + b["c"] < rank) & (acc["i"] < last)
        return F.struct(
            F.when(on, acc["seen"] + b["c"]).otherwise(acc["seen"]).alias("seen"),
            (acc["i"] + 1).alias("i"),
            F.when(acc["v"].isNull() & ~on, inside(b, acc["seen"])).otherwise(acc["v"]).alias("v"),
        )

    start = F.struct(N.d(0).alias("seen"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("v"))
    value = F.aggregate(rows, start, step, lambda acc: F.coalesce(acc["v"], N.nan()))
    return F.when(F.isnan(q) | _undefined(h), N.nan()).when(q < 0, -N.inf()).when(q > 1, N.inf()).otherwise(value)


def fraction(low: Column, high: Column, h: Column, rows: Column) -> Column:
    """The share of observations of ``h`` between low and high."""

    def share(b: Column, x: Column) -> Column:
        lo = F.when(b["lo"] == -N.inf(), N.d(0)).otherwise(b["lo"])
        a, z = F.log2(F.abs(b["lo"])), F.log2(F.abs(b["hi"]))
        return (
            F.when(x >= b["hi"], N.d(1)).when(x <= b["lo"], N.d(0))
            .when(_straight(h, b), F.when((b["hi"] == N.inf()) | (x <= lo), N.d(0)).otherwise(N.divide(x - lo, b["hi"] - lo)))
            .otherwise(N.divide(F.log2(F.abs(x)) - a, z - a))
        )

    def below(x: Column) -> Column:
        total = F.aggregate(rows, N.d(0), lambda acc, b: acc + b["c"] * share(b, x))
        return F.when(x == -N.inf(), N.d(0)).when(x == N.inf(), h["count"]).otherwise(total)

    value = N.divide(below(high) - below(low), h["count"])
    return F.when(F.isnan(low) | F.isnan(high) | _undefined(h), N.nan()).when(low >= high, N.d(0)).otherwise(value)


def variance(h: Column, rows: Column) -> Column:
    """By bucket middles: geometric, 0 for the zero bucket, arithmetic (so infinite at an open end) for custom bounds."""
    mean = N.divide(h["sum"], h["count"])

    def add(acc: Column, b: Column) -> Column:
        root = F.sqrt(F.abs(b["lo"] * b["hi"]))
        mid = F.when(h["schema"] == CUSTOM, (b["lo"] + b["hi"]) / 2).when((b["lo"] <= 0) & (b["hi"] >= 0), N.d(0)).otherwise(F.when(b["lo"] < 0, -root).otherwise(root))
        return acc + b["c"] * (mid - mean) * (mid - mean)

    return F.when(_undefined(h), N.nan()).otherwise(N.divide(F.aggregate(rows, N.d(0), add), h["count"]))
