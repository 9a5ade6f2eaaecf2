"""Plans to JSON and back; numbers keep NaN and infinities."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math

from ..lang import nodes as L

_KINDS = {c.__name__: c for c in vars(L).values() if isinstance(c, type) and dataclasses.is_dataclass(c)}


def _out(x):
    if dataclasses.is_dataclass(x):
        return {"type": type(x).__name__, **{f.name: _out(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, tuple):
        return [_out(y) for y in x]
    if isinstance(x, float) and not math.isfinite(x):
        return {"float": "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"}
    return x


def _in(x):
    if isinstance(x, list):
        return tuple(_in(y) for y in x)
    if isinstance(x, dict):
        if "float" in x:
            return float(x["float"].replace("Inf", "inf"))
        return _KINDS[x["type"]](**{k: _in(v) for k, v in x.items() if k != "type"})
    return x


def plan_to_json(node: L.Node) -> str:
    return json.dumps(_out(node), ensure_ascii=False)


def fingerprint(node: L.Node) -> str:
    """Equal plans have equal ones; 16 hexadecimal digits."""
    return hashlib.sha256(plan_to_json(node).encode()).hexdigest()[:16]


def plan_from_json(data: str) -> L.Node:
    return _in(json.loads(data))
