"""Floating-point expressions with IEEE rules where Spark's own differ.

Spark (ANSI) raises on division by zero, takes NaN as equal to NaN and larger than all
numbers, returns BIGINT from floor and NULL from the logarithm of zero. A metric query
wants infinities and NaN, and every comparison with NaN but != is false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(math.nan)


def inf() -> Column:
    return F.lit(math.inf)


def d(x: float) -> Column:
    return F.lit(float(x))


def divide(a: Column, b: Column) -> Column:
    """``a / b``; ``b`` zero gives a signed infinity or NaN."""
    return F.when(b == 0, a * F.pow(b, d(-1))).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, nan()).otherwise(F.try_mod(a, b))


def power(a: Column, b: Column) -> Column:
    """pow(1, anything) is 1, and pow(-1, infinity) is 1."""
    return F.when(a == 1, d(1)).when((a == -1) & (F.abs(b) == inf()), d(1)).otherwise(F.pow(a, b))


def atan2(y: Column, x: Column) -> Column:
    """Keeps the sign of a negative zero ``y``."""
    negative = (y == 0) & (F.pow(y, d(-1)) < 0)
    return F.when(negative, -F.atan2(d(0), x)).otherwise(F.atan2(y, x))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": power, "atan2": atan2}


def compare(op: str, a: Column, b: Column) -> Column:
    nan = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return nan | (a != b)
    plain = {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return ~nan & plain


def truth(c: Column) -> Column:
    return F.when(c, d(1)).otherwise(d(0))


def _whole(v: Column, fn) -> Column:
    """floor or ceil as DOUBLE: beyond 2**52 every double is whole; NaN and infinities stay."""
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(fn(v).cast("double"))


def floor(v: Column) -> Column:
    return _whole(v, F.floor)


def ceil(v: Column) -> Column:
    return _whole(v, F.ceil)


def _log(fn):
    return lambda v: F.when(v == 0, -inf()).when(v < 0, nan()).otherwise(fn(v))


def round_to(v: Column, to: Column) -> Column:
    """Halves go up; by the inverse, as whole multiples are exact that way."""
    inverse = divide(d(1), to)
    return divide(floor(v * inverse + 0.5), inverse)


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.greatest(a, b))


MATH = {
    "abs": F.abs, "ceil": ceil, "floor": floor, "exp": F.exp, "sqrt": F.sqrt,
    "ln": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": lambda v: F.when((v == 0) | F.isnan(v) | (F.abs(v) == inf()), v).otherwise(F.signum(v) * F.asinh(F.abs(v))),
    "acosh": lambda v: F.when(v < 1, nan()).otherwise(F.acosh(v)),
    "atanh": lambda v: F.when(v == 1, inf()).when(v == -1, -inf()).when(F.abs(v) > 1, nan()).otherwise(F.atanh(v)),
    "rad": lambda v: v * math.pi / 180, "deg": lambda v: v * 180 / math.pi,
    "sgn": lambda v: F.when((v == 0) | F.isnan(v), v).otherwise(F.signum(v)),
}


def _day(v: Column) -> Column:
    return F.timestamp_seconds(F.expr("null").cast("bigint")) if v is None else F.timestamp_seconds(F.when(F.isnan(v) | (F.abs(v) > 8e12), F.lit(None)).otherwise(v).cast("bigint"))


def _part(fn):
    """A calendar part in UTC; out of range gives NaN."""
    return lambda v: F.coalesce(fn(_day(v)).cast("double"), nan())


#: Calendar functions; the session's time zone must be UTC.
DATES = {
    "days_in_month": _part(lambda t: F.dayofmonth(F.last_day(t))),
    "day_of_month": _part(F.dayofmonth),
    "day_of_week": _part(lambda t: F.dayofweek(t) - 1),
    "day_of_year": _part(F.dayofyear),
    "hour": _part(F.hour),
    "minute": _part(F.minute),
    "month": _part(F.month),
    "year": _part(F.year),
}


def not_nan(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def least_of(v: Column) -> Column:
    """Aggregate: the smallest number; NaN only if all are."""
    return F.min(v)


def greatest_of(v: Column) -> Column:
    """Aggregate: the largest number; NaN only if all are."""
    return F.coalesce(F.max(not_nan(v)), F.max(v))


def spread(v: Column, fn) -> Column:
    """Aggregate: population deviation or variance; NaN if any value is NaN or infinite."""
    odd = F.isnan(v) | (F.abs(v) == inf())
    return F.when(F.max(odd), nan()).otherwise(fn(F.when(~odd, v)))


def pieces(v: Column) -> tuple[Column, Column, Column]:
    """``v`` as three numbers that add up to it: multiples of 2**20, of 2**-20, and the rest.

    Sums of the first two are exact while they stay below 2**73 and 2**33, in whatever
    order partial sums meet; so large numbers that cancel leave the small ones whole.
    """
    odd = F.isnan(v) | (F.abs(v) == inf())
    coarse = F.rint(v * 2.0**-20) * 2.0**20
    rest = v - coarse
    fine = F.rint(rest * 2.0**20) * 2.0**-20
    return F.when(odd, v).otherwise(coarse), F.when(odd, d(0)).otherwise(fine), F.when(odd, d(0)).otherwise(rest - fine)


def total(v: Column) -> Column:
    """Aggregate: the sum by pieces."""
    coarse, fine, rest = pieces(v)
    return F.sum(coarse) + (F.sum(fine) + F.sum(rest))


def mean(v: Column) -> Column:
    """Aggregate: mean that doesn't overflow where the sum does."""
    return F.when(F.abs(F.sum(v)) == inf(), F.when(F.max(F.abs(v)) == inf(), F.avg(v)).otherwise(F.avg(v / 2.0**20) * 2.0**20)).otherwise(F.avg(v))


def shown(v: Column) -> Column:
    """A number as label text: shortest digits, never an exponent."""
    s = v.cast("string")
    bare = F.regexp_replace(F.regexp_replace(s, "^-", ""), "E.*$", "")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.substring_index(bare, ".", 1)
    part = F.regexp_replace(F.substring_index(bare, ".", -1), "0+$", "")
    e = F.coalesce(F.regexp_extract(s, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.concat(whole, part)
    grown = F.when(F.length(part) <= e, F.concat(digits, F.repeat(F.lit("0"), F.greatest(e - F.length(part), F.lit(0))))).otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1) + e), F.lit("."), F.substring(digits, F.lit(2) + e, F.length(digits))))
    shrunk = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), digits)
    plain = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    out = F.when(e > 0, grown).when(e < 0, shrunk).otherwise(plain)
    return F.when(F.isnan(v), F.lit("NaN")).when(v == inf(), F.lit("+Inf")).when(v == -inf(), F.lit("-Inf")).otherwise(F.concat(sign, out))


def natural_key(s: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 40, "0")).otherwise(x))
