"""Where samples come from: tables with label columns, a time and a value."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import col, ref
from ..lang.nodes import NAME, Matcher


@dataclass(frozen=True)
class Samples:
    """Rows (l_<label>..., t, v[, h][, stale][, fine]): t in epoch ms, absent labels empty.

    ``named``: every row has the same metric name. Column fine: microseconds of the stored
    time after t, where it is a timestamp.
    """

    df: DataFrame
    labels: tuple[str, ...]
    hist: bool = False
    stale: bool = False
    named: bool = False
    fine: bool = False


class SeriesSource(Protocol):
    """A source returns the samples of the series that pass all matchers, ``low < t <= high``."""

    def scan(self, matchers: Iterable[Matcher], low: int, high: int) -> Samples: ...


def passes(m: Matcher, value: Column) -> Column:
    if m.op == "=":
        return value == m.value
    if m.op == "!=":
        return value != m.value
    full = value.rlike(rf"\A(?s:{m.value})\z")
    return full if m.op == "=~" else ~full


def admits(m: Matcher, value: str) -> bool:
    """Whether a known label value passes a matcher."""
    if m.op in ("=", "!="):
        return (m.value == value) == (m.op == "=")
    return bool(re.fullmatch(m.value, value, re.S)) == (m.op == "=~")


def fixed_name(matchers: Iterable[Matcher]) -> str | None:
    return next((m.value for m in matchers if m.label == NAME and m.op == "="), None)


class FrameSource:
    """One table of samples.

    ``name`` is the metric name of all rows, or None where ``l___name__`` is a column.
    ``bounds(low, high)`` may give a predicate on stored columns, for pruning; the exact
    time filter is added here.
    """

    def __init__(self, df: DataFrame, name: str | None = None, bounds: Callable[[int, int], Column] | None = None, stored: Mapping[str, str] | None = None):
        self.df, self.name, self.bounds, self.stored = df, name, bounds, dict(stored or {})
        labels = [c[2:] for c in df.columns if c.startswith("l_")]
        self.labels = tuple(sorted({*labels, *([NAME] if name is not None else [])}))
        self.hist, self.stale, self.fine = "h" in df.columns, "stale" in df.columns, "fine" in df.columns

    def may_have(self, matchers: Iterable[Matcher]) -> bool:
        return self.name is None or all(admits(m, self.name) for m in matchers if m.label == NAME)

    def _stored_equal(self, m: Matcher) -> Column | None:
        """An equality on the stored column, which files can be pruned by; the exact matcher follows."""
        name = self.stored[m.label]
        kind = self.df.schema[name].dataType.typeName()
        if kind == "string":
            return F.col(name) == m.value
        if kind in ("long", "integer", "short", "byte") and re.fullmatch(r"-?[1-9]\d{0,17}|0", m.value):
            return F.col(name) == int(m.value)
        return None

    def scan(self, matchers: Iterable[Matcher], low: int, high: int) -> Samples:
        matchers = list(matchers)
        df = self.df
        if not self.may_have(matchers):
            df = df.filter(F.lit(False))
        if self.bounds is not None:
            df = df.filter(self.bounds(low, high))
        df = df.filter((F.col("t") > low) & (F.col("t") <= high))
        for m in matchers:
            if m.label == NAME and self.name is not None:
                continue
            if m.label in self.labels:
                if m.op == "=" and m.value and m.label in self.stored and (same := self._stored_equal(m)) is not None:
                    df = df.filter(same)
                df = df.filter(passes(m, ref(m.label)))
            elif not admits(m, ""):
                df = df.filter(F.lit(False))
        if self.name is not None:
            df = df.withColumn(col(NAME), F.lit(self.name))
        extra = [c for c, has in (("h", self.hist), ("stale", self.stale), ("fine", self.fine)) if has]
        return Samples(df.select(*[ref(x) for x in self.labels], "t", "v", *extra), self.labels, self.hist, self.stale, self.name is not None or fixed_name(matchers) is not None, self.fine)


class Catalog:
    """Several tables behind one name space; a name matcher picks the tables that can have it.

    Sources are made on first use, so unused tables aren't even opened.
    """

    def __init__(self, makers: Mapping[str, Callable[[], SeriesSource]]):
        self.makers = dict(makers)
        self.made: dict[str, SeriesSource] = {}

    def _get(self, name: str) -> SeriesSource:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def scan(self, matchers: Iterable[Matcher], low: int, high: int) -> Samples:
        matchers = list(matchers)
        names = [n for n in self.makers if all(admits(m, n) for m in matchers if m.label == NAME)]
        if not names:
            first = self._get(next(iter(self.makers)))
            return first.scan([*matchers, Matcher(NAME, "=", "\0")], low, high)
        found = [self._get(n).scan(matchers, low, high) for n in names]
        return found[0] if len(found) == 1 else merged(found)


def merged(found: list[Samples]) -> Samples:
    """Rows of all, with the labels of any."""
    labels = tuple(sorted(set().union(*(s.labels for s in found))))
    hist, stale, fine = any(s.hist for s in found), any(s.stale for s in found), any(s.fine for s in found)
    kind = next((s.df.schema["h"].dataType for s in found if s.hist), None)
    out = None
    for s in found:
        cols = [ref(x) if x in s.labels else F.lit("").alias(col(x)) for x in labels]
        cols += [F.col("t"), F.col("v")]
        if hist:
            cols.append(F.col("h") if s.hist else F.lit(None).cast(kind).alias("h"))
        if stale:
            cols.append(F.col("stale") if s.stale else F.lit(False).alias("stale"))
        if fine:
            cols.append(F.col("fine") if s.fine else F.lit(0).alias("fine"))
        df = s.df.select(*cols)
        out = df if out is None else out.unionByName(df)
    return Samples(out, labels, hist, stale, False, fine)


def from_table(df: DataFrame, name: str | None, labels: Mapping[str, str | Column], time: str, value: str | Column, **extra: str | Column) -> FrameSource:
    """A source from any table: label name -> column, a timestamp (UTC) or epoch-ms column, a value.

    The time filter is put on the stored column too, so file statistics apply.
    """
    kind = df.schema[time].dataType.typeName()
    stamp = kind.startswith("timestamp") or kind == "date"
    t = F.unix_millis(F.col(time).cast("timestamp")) if stamp else F.col(time).cast("long")
    cols = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")).alias(col(x)) for x, c in labels.items()]
    v = F.col(value) if isinstance(value, str) else value
    more = [(F.col(c) if isinstance(c, str) else c).alias(x) for x, c in extra.items()]
    if stamp and kind != "date":
        more.append((F.unix_micros(F.col(time).cast("timestamp")) - t * 1000).cast("int").alias("fine"))
    stored = {x: f"__stored_{x}" for x, c in labels.items() if isinstance(c, str)}
    out = df.select(*cols, t.alias("t"), v.cast("double").alias("v"), *more, F.col(time).alias("__stored"), *[F.col(labels[x]).alias(c) for x, c in stored.items()])

    def bounds(low: int, high: int) -> Column:
        if not stamp:
            return (F.col("__stored") > low) & (F.col("__stored") <= high)
        # A stored time may be finer than a millisecond: the range is widened, the filter on t is exact.
        at = lambda ms: F.lit(dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).cast(df.schema[time].dataType if kind != "date" else "date")
        safe = lambda ms: max(-62_000_000_000_000, min(ms, 250_000_000_000_000))
        return (F.col("__stored") >= at(safe(low))) & (F.col("__stored") <= at(safe(high + 1)))

    return FrameSource(out, name, bounds, stored)


def parquet_series(spark: SparkSession, path: str, name: str | None, labels: Mapping[str, str], time: str, value: str) -> FrameSource:
    return from_table(spark.read.parquet(path), name, labels, time, value)


_SERIES = re.compile(r"^\s*([a-zA-Z_:][\w:]*)?\s*(?:\{(.*?)\})?\s+(.+)$")
_RUN = re.compile(r"^(-?[\d.eE]+|-?Inf|NaN|_|stale)(?:([+-][\d.eE]+)?x(\d+))?$")


def load_script(spark: SparkSession, text: str) -> FrameSource:
    """Samples from the load notation used in tests: ``load 30s`` and lines ``metric{a="x"} 1 2+1x3 _ stale``."""
    from ..lang.lexer import duration_ms
    from ..lang.parser import parse

    rows, names, step = [], set(), 0
    for line in filter(str.strip, text.splitlines()):
        if line.strip().startswith("load "):
            step = duration_ms(line.split()[1])
            continue
        m = _SERIES.match(line)
        select = parse(f"{m[1] or ''}{{{m[2] or ''}}}" if m[1] or m[2] else m[1])
        labels = {x.label: x.value for x in select.matchers}
        names |= set(labels)
        k = 0
        for word in m[3].split():
            r = _RUN.match(word)
            if r is None:
                raise ValueError(f"bad sample {word!r}")
            first, inc, times = r[1], float(r[2] or 0), int(r[3] or 0)
            for i in range(times + 1):
                if first == "stale":
                    rows.append((labels, k * step, 0.0, True))
                elif first != "_":
                    rows.append((labels, k * step, float(first.replace("Inf", "inf")) + i * inc, False))
                k += 1
            if first == "_" and times:
                k -= 1
    labels = sorted(names | {NAME})
    data = [(*(x.get(n, "") for n in labels), t, v, s) for x, t, v, s in rows]
    schema = ", ".join([*(f"`{col(n)}` string" for n in labels), "t long", "v double", "stale boolean"])
    return FrameSource(spark.createDataFrame(data, schema))
