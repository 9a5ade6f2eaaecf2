"""Range functions of the floats in one window, for series that also have histograms."""

from __future__ import annotations

import math
import statistics


def _quantile(q: float, vs: list[float]) -> float:
    if not vs or math.isnan(q):
        return math.nan
    if q < 0 or q > 1:
        return math.copysign(math.inf, q)
    own = sorted(vs, key=lambda v: (not math.isnan(v), v))
    rank = q * (len(own) - 1)
    lo = math.floor(rank)
    hi = min(lo + 1, len(own) - 1)
    return own[lo] * (1 - (rank - lo)) + own[hi] * (rank - lo)


def _line(w: list[tuple[int, float]], at: int) -> tuple[float, float]:
    """Slope a second, and value at ``at``."""
    ys = [v for _, v in w]
    if all(y == ys[0] for y in ys):
        return (math.nan, math.nan) if math.isinf(ys[0]) else (0.0, ys[0])
    xs = [(t - at) / 1000 for t, _ in w]
    mx, my = statistics.fmean(xs), statistics.fmean(ys)
    m = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    return m, my - m * mx


def window_float(fn: str, w: list[tuple[int, float]], step: int, width: int, offset: int, args: list[float]) -> float | None:
    """Value of ``fn`` over (t, v) in time order; None for no sample."""
    ts, vs = [t for t, _ in w], [v for _, v in w]
    odd = any(not math.isfinite(v) for v in vs)
    real = [v for v in vs if not math.isnan(v)]
    if fn == "sum_over_time":
        return math.nan if any(math.isnan(v) for v in vs) or odd else math.fsum(vs)
    if fn == "avg_over_time":
        return sum(vs) / len(vs) if odd else math.fsum(vs) / len(vs)
    if fn in ("min_over_time", "max_over_time"):
        return (min if fn[1] == "i" else max)(real) if real else math.nan
    if fn in ("ts_of_min_over_time", "ts_of_max_over_time"):
        if not real:
            return ts[-1] / 1000
        best = min(real) if "min" in fn else max(real)
        return max(t for t, v in w if v == best) / 1000
    if fn in ("stddev_over_time", "stdvar_over_time"):
        if odd:
            return math.nan
        return statistics.pstdev(vs) if fn == "stddev_over_time" else statistics.pvariance(vs)
    if fn == "quantile_over_time":
        return _quantile(args[0], vs)
    if fn == "mad_over_time":
        m = _quantile(0.5, vs)
        return _quantile(0.5, [abs(v - m) for v in vs])
    if fn in ("deriv", "predict_linear"):
        if len(w) < 2:
            return None
        m, b = _line(w, step)
        return m if fn == "deriv" else m * args[0] + b
    if fn == "double_exponential_smoothing":
        sf, tf = args
        if len(vs) < 2 or not (0 < sf < 1 and 0 < tf < 1):
            return None
        level, trend = vs[0], vs[1] - vs[0]
        for i, v in enumerate(vs[1:]):
            if i:
                trend = tf * (level - before) + (1 - tf) * trend  # noqa: F821
            before, level = level, sf * v + (1 - sf) * (level + trend)
        return level
    if len(w) < 2:
        return None
    if fn in ("irate", "idelta"):
        d = vs[-1] - vs[-2]
        if fn == "idelta":
            return d
        return (vs[-1] if vs[-1] < vs[-2] else d) / ((ts[-1] - ts[-2]) / 1000)
    if fn in ("rate", "increase", "delta"):
        raw = vs[-1] - vs[0] + (sum(a for a, b in zip(vs, vs[1:], strict=False) if b < a) if fn != "delta" else 0.0)
        sampled = (ts[-1] - ts[0]) / 1000
        mean = sampled / (len(ts) - 1)
        a, b = (ts[0] - (step - width - offset)) / 1000, (step - offset - ts[-1]) / 1000
        a = mean / 2 if a >= mean * 1.1 else a
        if fn != "delta" and raw > 0 and vs[0] >= 0:
            a = min(a, sampled * (vs[0] / raw))
        b = mean / 2 if b >= mean * 1.1 else b
        f = (sampled + a + b) / sampled
        return raw * (f / (width / 1000) if fn == "rate" else f)
    raise ValueError(fn)
