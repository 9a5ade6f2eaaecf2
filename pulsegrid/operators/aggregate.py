"""Aggregations across series at each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import numeric as N
from ..grid import Scalar, Vector, col, ref
from ..lang.nodes import NAME
from .ranges import ranked

_PLAIN = {
    "sum": lambda: N.total(F.col("v")),
    "avg": lambda: N.mean(F.col("v")),
    "min": lambda: N.least_of(F.col("v")),
    "max": lambda: N.greatest_of(F.col("v")),
    "count": lambda: F.count(F.lit(1)).cast("double"),
    "group": lambda: N.d(1),
    "stddev": lambda: N.spread(F.col("v"), F.stddev_pop),
    "stdvar": lambda: N.spread(F.col("v"), F.var_pop),
}
#: These take floats and histograms alike.
_ANY = ("count", "group", "limitk", "limit_ratio")


def group_labels(x: Vector, labels: tuple[str, ...], without: bool) -> tuple[str, ...]:
    """Labels of the groups: those of ``by`` that exist, or all but those of ``without`` and the name."""
    if without:
        return tuple(n for n in x.labels if n not in labels and n != NAME)
    return tuple(sorted(n for n in set(labels) if n in x.labels))


def _out(df: DataFrame, labels: tuple[str, ...], hist: bool = False) -> Vector:
    return Vector(df.select(*[ref(n) for n in labels], "step", *(["v", "h"] if hist else ["v"])), labels, hist, True, NAME not in labels)


def aggregate(op: str, x: Vector, labels: tuple[str, ...], without: bool, param: Scalar | str | None) -> Vector:
    own = group_labels(x, labels, without)
    keys = [*[col(n) for n in own], "step"]
    if x.hist and op in ("sum", "avg"):
        from .hist import combined

        return _out(combined(x.df, keys, op), own, True)
    if x.hist and op not in _ANY and op != "count_values":
        x = x.floats()
    if op in _PLAIN:
        return _out(x.df.groupBy(*keys).agg(_PLAIN[op]().alias("v")), own)
    if op == "quantile":
        df, q = param.joined(x.df)
        return _out(ranked(df, keys, q), own)
    if op == "count_values":
        return _count_values(x.floats(), own, param)
    return _picked(op, x, keys, param)


def _count_values(x: Vector, own: tuple[str, ...], label: str) -> Vector:
    """Series of each distinct value; the value becomes a label (0 and -0 are two)."""
    labels = tuple(sorted({*own, label}))
    df = x.df.select(*[ref(n) for n in own if n != label], "step", N.shown(F.col("v")).alias(col(label)))
    return _out(df.groupBy(*[col(n) for n in labels], "step").agg(F.count(F.lit(1)).cast("double").alias("v")), labels)


def _checked(k: Column, name: str) -> Column:
    bad = F.isnan(k) | (k >= 2.0**63) | (k < -(2.0**63))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"PULSEGRID_PARAM: {name} can't take "), N.shown(k))).cast("double")).otherwise(k)


def _picked(op: str, x: Vector, keys: list[str], param: Scalar) -> Vector:
    """topk, bottomk, limitk, limit_ratio: some of each group's series, with all their labels.

    Ties go by the labels in order. Ranks are taken in two rounds, first within salted
    shares of a group, so that one large group isn't sorted by one task alone.
    """
    names = [col(n) for n in x.labels]
    if op == "limit_ratio":
        if param.value is not None and param.value != param.value:
            raise QueryError("limit_ratio can't take NaN")
        df, r = param.joined(x.df)
        r = F.greatest(F.least(_checked(r, op), N.d(1)), N.d(-1))
        share = F.pmod(F.xxhash64(*names), F.lit(1 << 52)).cast("double") / 2.0**52
        kept = df.filter(F.when(r >= 0, share < r).otherwise(share >= 1 + r))
        return Vector(kept.select(*x.cols, "step", *x.value), x.labels, x.hist, x.unique, x.named)
    df, k = param.joined(x.df)
    df = df.withColumn("__k", F.floor(_checked(k, op)))
    if op == "limitk":
        order = [F.col(c) for c in names]
    else:
        v = F.col("v")
        order = [F.isnan(v).asc(), (v.desc() if op == "topk" else v.asc()), *[F.col(c) for c in names]]
    salt = F.pmod(F.xxhash64(*names), F.lit(16)) if names else F.lit(0)
    shares = df.withColumn("__s", salt)
    rn = F.row_number().over(W.partitionBy(*keys, "__s").orderBy(*order))
    some = shares.withColumn("__r", rn).filter("__r <= __k")
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    best = some.withColumn("__r", rn).filter("__r <= __k")
    return Vector(best.select(*x.cols, "step", *x.value), x.labels, x.hist, x.unique, x.named)
