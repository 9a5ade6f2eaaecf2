"""Functions of labels, presence and ordering."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import numeric as N
from ..grid import Grid, Scalar, Vector, col, ref
from ..lang.nodes import NAME, Matcher


def _checked(name: str) -> str:
    if not name or "\ud800" <= max(name) <= "\udfff":
        raise QueryError(f"invalid label name {name!r}")
    return name


def _template(text: str) -> str:
    """A replacement in ``$1``/``${name}`` notation as Java's; an unknown reference is empty."""
    out, at = [], 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+)|(\$))", text):
        out.append(re.sub(r"([\\$])", r"\\\1", text[at : m.start()]))
        ref_ = m[1] or m[2]
        out.append(r"\$" if m[3] else f"${ref_}" if ref_.isdigit() else f"${{{ref_}}}")
        at = m.end()
    out.append(re.sub(r"([\\$])", r"\\\1", text[at:]))
    return "".join(out)


def label_replace(x: Vector, dst: str, replacement: str, src: str, pattern: str) -> Vector:
    """Where the whole of ``src`` matches, ``dst`` becomes the expanded replacement."""
    _checked(dst)
    groups = re.compile(pattern).groups
    names = set(re.compile(pattern).groupindex)
    known = re.sub(r"\$\{?(\w+)\}?", lambda m: m[0] if (m[1].isdigit() and int(m[1]) <= groups) or m[1] in names else "", replacement.replace("$$", "\0")).replace("\0", "$$")
    whole = rf"\A(?s:{pattern.replace('(?P<', '(?<')})\z"
    value = ref(src) if src in x.labels else F.lit("")
    old = ref(dst) if dst in x.labels else F.lit("")
    new = F.when(value.rlike(whole), F.regexp_replace(value, F.lit(whole), F.lit(_template(known)))).otherwise(old)
    return _with_label(x, dst, new)


def label_join(x: Vector, dst: str, separator: str, sources: list[str]) -> Vector:
    _checked(dst)
    parts = [ref(s) if s in x.labels else F.lit("") for s in sources]
    return _with_label(x, dst, F.concat_ws(separator, *parts) if parts else F.lit(""))


def _with_label(x: Vector, dst: str, value: Column) -> Vector:
    labels = tuple(sorted({*x.labels, dst}))
    out = x.df.select(*[value.alias(col(n)) if n == dst else ref(n) for n in labels], "step", *x.value)
    # A label that was there may have told series apart.
    return replace(x, df=out, labels=labels, unique=x.unique and dst not in x.labels, named=x.named and dst != NAME)


def absent(x: DataFrame, matchers: tuple[Matcher, ...], grid: Grid) -> Vector:
    """1 at steps without a sample; labels of the selector's lone equality matchers."""
    given: dict[str, str | None] = {}
    for m in matchers:
        if m.label != NAME:
            given[m.label] = m.value if m.op == "=" and m.label not in given else None
    labels = {n: v for n, v in sorted(given.items()) if v}
    steps = grid.df(x.sparkSession).join(x.select("step").distinct(), "step", "left_anti")
    df = steps.select(*[F.lit(v).alias(col(n)) for n, v in labels.items()], "step", N.d(1).alias("v"))
    return Vector(df, tuple(labels), False, True, True)


def scalar(x: Vector, grid: Grid, number: int) -> Scalar:
    """The value where exactly one float series exists, else NaN."""
    one = x.floats().df.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    name = f"__scalar{number}"
    table = one.select("step", F.when(F.col("n") == 1, F.col("v")).otherwise(N.nan()).alias(name))
    return Scalar(lambda step: F.coalesce(F.col(name), N.nan()), (table,))


def vector(s: Scalar, grid: Grid, spark) -> Vector:
    df, v = s.joined(grid.df(spark))
    return Vector(df.select("step", v.alias("v")), (), False, True, True)


def ordered(df: DataFrame, labels: tuple[str, ...], how: str, names: list[str]) -> DataFrame:
    """Presentation order of an instant result."""
    if how in ("sort", "sort_desc"):
        v = F.col("v")
        return df.orderBy(F.isnan(v).asc(), v.desc() if how == "sort_desc" else v.asc(), *[ref(n) for n in labels])
    keys = [N.natural_key(ref(n) if n in labels else F.lit("")) for n in names] + [ref(n) for n in labels]
    return df.orderBy(*[k.desc() if how.endswith("desc") else k.asc() for k in keys])
