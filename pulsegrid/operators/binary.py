"""Binary operations: with scalars, between matched series, and set operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..grid import Scalar, Vector, col, ref
from ..lang.nodes import COMPARISONS, NAME, RESERVED, Match


def scalars(op: str, a: Scalar, b: Scalar) -> Scalar:
    """Two scalars; comparisons give 1 or 0."""
    fn = (lambda x, y: N.truth(N.compare(op, x, y))) if op in COMPARISONS else N.ARITHMETIC[op]
    return Scalar(lambda step: fn(a.make(step), b.make(step)), (*a.tables, *(t for t in b.tables if t not in a.tables)))


def with_scalar(op: str, x: Vector, s: Scalar, scalar_left: bool, boolean: bool) -> Vector:
    """A vector and a scalar. A filtering comparison keeps the vector's value."""
    if x.hist and op in ("*", "/") and not (op == "/" and scalar_left):
        from .hist import scaled

        df, f = s.joined(x.df)
        factor = f if op == "*" else N.divide(N.d(1), f)
        v = F.col("v") * f if op == "*" else N.divide(F.col("v"), f)
        out = df.select(*x.cols, "step", v.alias("v"), scaled(F.col("h"), factor).alias("h"))
        return replace(x, df=out).anonymous()
    x = x.floats()
    df, f = s.joined(x.df)
    v = F.col("v")
    a, b = (f, v) if scalar_left else (v, f)
    x = replace(x, df=df)
    if op not in COMPARISONS:
        return x.with_values(N.ARITHMETIC[op](a, b)).anonymous()
    if boolean:
        return x.with_values(N.truth(N.compare(op, a, b))).anonymous()
    return x.with_values(v, N.compare(op, a, b))


def _key(a: Vector, b: Vector, match: Match) -> tuple[str, ...]:
    if match.on:
        return tuple(sorted(set(match.labels) & {*a.labels, *b.labels}))
    return tuple(sorted({*a.labels, *b.labels} - set(match.labels) - {NAME}))


def _keyed(x: Vector, key: tuple[str, ...], prefix: str) -> DataFrame:
    """Columns k_<label>, step and the vector's own columns under a prefix."""
    keys = [(ref(n) if n in x.labels else F.lit("")).alias(f"k_{n}") for n in key]
    return x.df.select(*keys, "step", *[ref(n).alias(f"{prefix}_{n}") for n in x.labels], *[F.col(c).alias(f"{prefix}{c}") for c in x.value])


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two vectors, always by shuffle.

    A vector's rows are made by copying samples to steps, which Spark's estimate from file
    sizes doesn't see: it would broadcast, and first gather on the driver, a side of any size.
    """
    return left.join(right.hint("merge"), on, how)


def _on(key: tuple[str, ...]) -> list[str]:
    return [*[f"k_{n}" for n in key], "step"]


def sets(op: str, a: Vector, b: Vector, match: Match) -> Vector:
    """and, unless, or: by the keys present at a step."""
    key = _key(a, b, match)
    on = _on(key)
    left, right = _keyed(a, key, "a"), _keyed(b, key, "b")
    back = lambda df, x, p: replace(x, df=df.select(*[F.col(f"`{p}_{n}`").alias(col(n)) for n in x.labels], "step", *[F.col(f"{p}{c}").alias(c) for c in x.value]))
    if op in ("and", "unless"):
        return back(_joined(left, right.select(*[f"`{c}`" for c in on]), on, "left_semi" if op == "and" else "left_anti"), a, "a")
    rest = back(_joined(right, left.select(*[f"`{c}`" for c in on]), on, "left_anti"), b, "b")
    labels = tuple(sorted({*a.labels, *b.labels}))
    hist = a.hist or b.hist
    if hist:
        from .hist import with_hist

        a, rest = with_hist(a), with_hist(rest)
    # Rows of both sides can have equal labels only where the key leaves some out.
    unique = a.unique and b.unique and (set(labels) <= set(key))
    return Vector(a.aligned(labels, hist).unionByName(rest.aligned(labels, hist)), labels, hist, unique, False)


def _single(df: DataFrame, on: list[str], cols: list[str], other: DataFrame, sure: bool, what: str, side: str = "") -> DataFrame:
    """One row a key and step; more than one fails where the other side has data at the step.

    With a side (left or right) the message names the group and two of its series.
    """
    if sure:
        return df.withColumn("__n", F.lit(1))
    steps = other.select("step").distinct()
    seen = df.join(steps, "step", "left_semi")
    labels = [c for c in df.columns if c[1:2] == "_" and c[0] in "ab"] if side else []
    one = F.struct(*[F.col(f"`{c}`") for c in labels])
    ends = [F.min(one).alias("__first"), F.max(one).alias("__last")] if labels else []
    out = seen.groupBy(*[f"`{c}`" for c in on]).agg(F.count(F.lit(1)).alias("__n"), *ends, *[F.first(f"`{c}`").alias(c) for c in cols])
    message = F.lit(f"PULSEGRID_MANY: {what}")
    if labels:
        group = _series([(c[2:], F.col(f"`{c}`")) for c in on if c != "step"])
        two = [_series([(c[2:], F.col(x)[c]) for c in labels]) for x in ("__first", "__last")]
        tail = F.lit("];many-to-many matching not allowed: matching labels must be unique on one side")
        message = F.concat(F.lit("PULSEGRID_MANY: found duplicate series for the match group "), group, F.lit(f" on the {side} hand-side of the operation: ["), F.least(*two), F.lit(", "), F.greatest(*two), tail)
    return out.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(message).cast("long")).otherwise(F.col("__n"))).drop("__first", "__last")


def _series(labels: list[tuple[str, Column]]) -> Column:
    """A series as text: its labels in order, without absent ones."""
    parts = [F.when(v != "", F.concat(F.lit(f'{n}="'), v, F.lit('"'))) for n, v in sorted(labels, key=lambda x: x[0])]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts) if parts else F.lit(""), F.lit("}"))


def vectors(op: str, a: Vector, b: Vector, match: Match, boolean: bool) -> Vector:
    """Matched series of two vectors."""
    if match.card == "right":
        # One to many is many to one with the sides, and the operands, exchanged.
        return _many_to_one(op, b, a, replace(match, card="left"), boolean, swapped=True)
    if match.card == "left":
        return _many_to_one(op, a, b, match, boolean, swapped=False)
    return _one_to_one(op, a, b, match, boolean)


def _value(op: str, boolean: bool, x: Column, y: Column) -> tuple[Column, Column | None]:
    if op not in COMPARISONS:
        return N.ARITHMETIC[op](x, y), None
    if boolean:
        return N.truth(N.compare(op, x, y)), None
    return x, N.compare(op, x, y)


def _covers(x: Vector, key: tuple[str, ...]) -> bool:
    """Whether a key and step can have one row of ``x`` at most."""
    left = set(x.labels) - set(key)
    return x.unique and (not left or x.named and left == {NAME})


def _combine(op: str, boolean: bool, df: DataFrame, a: Vector, b: Vector) -> tuple[DataFrame, bool]:
    """Columns v (and h) of the joined rows a.., b..; rows without a result go."""
    if a.hist or b.hist:
        from .hist import matched

        return matched(op, boolean, df, a.hist, b.hist)
    v, keep = _value(op, boolean, F.col("av"), F.col("bv"))
    df = df.filter(keep) if keep is not None else df
    return df.withColumn("v", v), False


def _one_to_one(op: str, a: Vector, b: Vector, match: Match, boolean: bool) -> Vector:
    key = _key(a, b, match)
    on = _on(key)
    left, right = _keyed(a, key, "a"), _keyed(b, key, "b")
    keeps_name = op in COMPARISONS and not boolean and not match.on
    extra = [f"a_{n}" for n in a.labels if keeps_name and n == NAME]
    left = _single(left, on, [*(f"a{c}" for c in a.value), *extra], right, _covers(a, key), "multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)")
    right = _single(right, on, [f"b{c}" for c in b.value], left, _covers(b, key), "", "right")
    # Where a side was grouped, its count is read so that the check isn't pruned away.
    joined = _joined(left.withColumnRenamed("__n", "__na"), right.withColumnRenamed("__n", "__nb"), on).filter("__na = 1 AND __nb = 1")
    df, hist = _combine(op, boolean, joined, a, b)
    labels = [(n, F.col(f"`k_{n}`")) for n in key]
    if extra:
        labels.append((NAME, F.col(f"`a_{NAME}`")))
    drop = () if op in COMPARISONS and not boolean else RESERVED
    labels = sorted((n, c) for n, c in labels if n not in drop or match.on and n in match.labels)
    names = tuple(n for n, _ in labels)
    return Vector(df.select(*[c.alias(col(n)) for n, c in labels], "step", *(["v", "h"] if hist else ["v"])), names, hist, True, NAME not in names or a.named)


def _many_to_one(op: str, a: Vector, b: Vector, match: Match, boolean: bool, swapped: bool) -> Vector:
    """``a`` is the side with many; it keeps its labels and takes the included ones from ``b``."""
    key = _key(a, b, match)
    on = _on(key)
    left, right = _keyed(a, key, "a"), _keyed(b, key, "b")
    take = [f"b_{n}" for n in match.include if n in b.labels]
    side = "left" if swapped else "right"
    right = _single(right, on, [*(f"b{c}" for c in b.value), *take], left, _covers(b, key), "", side)
    joined = _joined(left, right.withColumnRenamed("__n", "__nb"), on).filter("__nb = 1")
    if swapped:
        # Operands stand in the order written: the one side is on the left. A filter keeps the left value.
        names = [*(f"a{c}" for c in a.value), *(f"b{c}" for c in b.value)]
        flip = {n: ("b" if n[0] == "a" else "a") + n[1:] for n in names}
        joined = joined.select(*[F.col(f"`{c}`").alias(flip.get(c, c)) for c in joined.columns])
        df, hist = _combine(op, boolean, joined, b, a)
    else:
        df, hist = _combine(op, boolean, joined, a, b)
    drop = () if op in COMPARISONS and not boolean else RESERVED
    labels = {n: F.col(f"`a_{n}`") for n in a.labels if n not in drop}
    for n in match.include:
        labels[n] = F.col(f"`b_{n}`") if n in b.labels else F.lit("")
    names = tuple(sorted(labels))
    lost = set(a.labels) - set(names)
    overwritten = set(match.include) & set(a.labels)
    unique = a.unique and not overwritten and (not lost or a.named)
    return Vector(df.select(*[labels[n].alias(col(n)) for n in names], "step", *(["v", "h"] if hist else ["v"])), names, hist, unique, NAME in names and a.named or NAME not in names)
