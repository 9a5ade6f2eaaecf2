"""Evaluation steps, and the relations that a query is evaluated to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang.nodes import NAME, RESERVED


@dataclass(frozen=True)
class Grid:
    """Steps ``start, start + step, ... <= end`` in epoch ms."""

    start: int
    end: int
    step: int = 1

    @property
    def count(self) -> int:
        return max(0, (self.end - self.start) // self.step + 1)

    @property
    def last(self) -> int:
        return self.start + (self.count - 1) * self.step

    def df(self, spark: SparkSession) -> DataFrame:
        """One row a step. Its size is the query's, never the data's."""
        parts = max(1, min(8, self.count // 10_000))
        return spark.range(0, self.count, 1, parts).select((F.lit(self.start) + F.col("id") * self.step).alias("step"))


def col(label: str) -> str:
    """Column of a label."""
    return f"l_{label}"


def ref(label: str) -> Column:
    return F.col(f"`l_{label}`")


@dataclass(frozen=True)
class Vector:
    """Rows (l_<label>..., step, v[, h]): an instant vector at every step of a grid.

    ``unique``: no two rows have equal labels at one step. ``named``: all rows have one
    metric name, so dropping it keeps them unique. ``hist``: there is a column h, and
    exactly one of v and h isn't null.
    """

    df: DataFrame
    labels: tuple[str, ...]
    hist: bool = False
    unique: bool = True
    named: bool = False

    @property
    def cols(self) -> list[Column]:
        return [ref(x) for x in self.labels]

    @property
    def value(self) -> list[str]:
        return ["v", "h"] if self.hist else ["v"]

    def with_values(self, v: Column, keep: Column | None = None) -> Vector:
        """New float values (histogram rows go), maybe filtered."""
        df = self.df.filter("h IS NULL") if self.hist else self.df
        df = df.filter(keep) if keep is not None else df
        return replace(self, df=df.select(*self.cols, "step", v.alias("v")), hist=False)

    def drop(self, *names: str) -> Vector:
        left = tuple(x for x in self.labels if x not in names)
        if left == self.labels:
            return self
        gone = set(self.labels) - set(left)
        same = self.unique and gone <= set(RESERVED) and self.named
        return replace(self, df=self.df.select(*[ref(x) for x in left], "step", *self.value), labels=left, unique=same, named=False if NAME in gone else self.named)

    def anonymous(self) -> Vector:
        return self.drop(*RESERVED)

    def floats(self) -> Vector:
        return self if not self.hist else replace(self, df=self.df.filter("h IS NULL").drop("h"), hist=False)

    def aligned(self, labels: tuple[str, ...], hist: bool) -> DataFrame:
        """Columns of these labels, absent ones empty."""
        out = [ref(x) if x in self.labels else F.lit("").alias(col(x)) for x in labels]
        df = self.df
        if hist and not self.hist:
            raise ValueError("a histogram column must come from the other side")
        return df.select(*out, "step", *(["v", "h"] if hist else ["v"]))


@dataclass(frozen=True)
class Scalar:
    """One float a step: an expression of the step's time, and of tables with a row for each step.

    ``value`` is set where the scalar is a constant.
    """

    make: Callable[[Column], Column]
    tables: tuple[DataFrame, ...] = field(default=())
    value: float | None = None

    @staticmethod
    def of(x: float) -> Scalar:
        return Scalar(lambda step: F.lit(float(x)), (), float(x))

    def joined(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """``df`` with what the expression needs, and the expression. Tables have the grid's size."""
        for t in self.tables:
            df = df.join(F.broadcast(t), "step", "left")
        return df, self.make(F.col("step"))
