"""Arithmetic of native histograms, one at a time, as plain dictionaries.

A histogram has exponential buckets: bucket i of ``pos`` holds (base**(i-1), base**i]
with base = 2**(2**-schema); ``neg`` mirrors it; the zero bucket holds
[-zero_threshold, zero_threshold]. With schema CUSTOM its bounds are in ``custom``.
"""

from __future__ import annotations

import math

CUSTOM = -53
DDL = "struct<schema: int, count: double, sum: double, zero_threshold: double, zero_count: double, pos: map<int, double>, neg: map<int, double>, custom: array<double>, hint: tinyint>"


def _map(m) -> dict[int, float]:
    return dict(m or ())


def copied(h: dict) -> dict:
    return {**h, "pos": _map(h["pos"]), "neg": _map(h["neg"]), "custom": list(h["custom"] or ()), "hint": 0}


def coarser(h: dict, schema: int) -> dict:
    """The histogram at a lower resolution: neighbouring buckets merge."""
    h = copied(h)
    if h["schema"] == schema or h["schema"] == CUSTOM:
        return h
    d = 1 << (h["schema"] - schema)
    for side in ("pos", "neg"):
        out: dict[int, float] = {}
        for i, c in h[side].items():
            k = -((-i) // d)
            out[k] = out.get(k, 0.0) + c
        h[side] = out
    return {**h, "schema": schema}


def _wider_zero(h: dict, threshold: float) -> dict:
    """Buckets inside a larger zero bucket join it."""
    if h["zero_threshold"] >= threshold:
        return h
    for side in ("pos", "neg"):
        for i in [i for i in h[side] if bounds(h["schema"], i)[1] <= threshold]:
            h["zero_count"] += h[side].pop(i)
    return {**h, "zero_threshold": threshold}


def combine(a: dict, b: dict, sign: float = 1.0) -> dict | None:
    """a + sign * b; None if their buckets can't be brought together."""
    if (a["schema"] == CUSTOM) != (b["schema"] == CUSTOM) or a["schema"] == CUSTOM and list(a["custom"] or ()) != list(b["custom"] or ()):
        return None
    schema = min(a["schema"], b["schema"])
    a, b = coarser(a, schema), coarser(b, schema)
    z = max(a["zero_threshold"], b["zero_threshold"])
    if schema != CUSTOM:
        a, b = _wider_zero(a, z), _wider_zero(b, z)
    for side in ("pos", "neg"):
        for i, c in b[side].items():
            a[side][i] = a[side].get(i, 0.0) + sign * c
    for k in ("count", "sum", "zero_count"):
        a[k] += sign * b[k]
    return a


def times(h: dict, f: float) -> dict:
    h = copied(h)
    for side in ("pos", "neg"):
        h[side] = {i: c * f for i, c in h[side].items()}
    return {**h, **{k: h[k] * f for k in ("count", "sum", "zero_count")}}


def is_reset(now: dict, before: dict) -> bool:
    """Whether a counter histogram started anew between two samples."""
    if now["count"] < before["count"] or now["schema"] > before["schema"] or now["zero_threshold"] < before["zero_threshold"]:
        return True
    if (d := combine(now, before, -1.0)) is None:
        return True
    return d["zero_count"] < 0 or any(c < 0 for side in ("pos", "neg") for c in d[side].values())


def bounds(schema: int, i: int, custom: list[float] | None = None) -> tuple[float, float]:
    if schema == CUSTOM:
        return (custom[i - 1] if i > 0 else -math.inf), (custom[i] if i < len(custom) else math.inf)
    step = 2.0**-schema
    return 2.0 ** ((i - 1) * step), 2.0 ** (i * step)


def counter_increase(hs: list[dict], counter: bool) -> dict | None:
    """Last minus first, adding back what was lost at resets, at the lowest resolution."""
    schema = min(h["schema"] for h in hs)
    out = combine(coarser(hs[-1], schema), coarser(hs[0], schema), -1.0)
    if counter and out is not None:
        for before, now in zip(hs, hs[1:], strict=False):
            if is_reset(now, before):
                out = combine(out, coarser(before, schema))
                if out is None:
                    return None
    return out
