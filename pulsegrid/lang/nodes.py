"""The logical plan: immutable nodes of a metric query."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

NAME = "__name__"
#: Labels that describe the metric itself; most functions drop them.
RESERVED = (NAME, "__type__", "__unit__")


@dataclass(frozen=True)
class Node:
    """A plan node. ``children`` are its node-valued fields in order."""

    def children(self) -> list[Node]:
        out: list[Node] = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                out.append(v)
            elif isinstance(v, tuple):
                out += [x for x in v if isinstance(x, Node)]
        return out

    def mapped(self, fn) -> Node:
        """A copy whose children went through ``fn``; the node itself if none changed."""
        new: dict[str, Any] = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                w: Any = fn(v)
            elif isinstance(v, tuple) and any(isinstance(x, Node) for x in v):
                w = tuple(fn(x) if isinstance(x, Node) else x for x in v)
            else:
                continue
            if w != v:
                new[f.name] = w
        return replace(self, **new) if new else self


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str  # = != =~ !~
    value: str


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Select(Node):
    """Instant selector. ``at`` is None, 'start', 'end' or epoch ms; ``own_time`` returns samples' own times.

    ``wide`` is a broader set of matchers to scan by, where several selectors share a scan.
    ``stats`` returns histograms' counts and sums without their buckets.
    """

    matchers: tuple[Matcher, ...]
    offset: int = 0
    at: Any = None
    own_time: bool = False
    wide: tuple[Matcher, ...] = ()
    stats: bool = False


@dataclass(frozen=True)
class Window(Node):
    """Range selector: the samples of ``select`` in a window of ``width`` ms."""

    select: Select
    width: int


@dataclass(frozen=True)
class Subquery(Node):
    expr: Node
    width: int
    step: int | None = None
    offset: int = 0
    at: Any = None


@dataclass(frozen=True)
class Call(Node):
    fn: str
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Aggregate(Node):
    op: str
    expr: Node
    param: Node | None = None
    labels: tuple[str, ...] = ()
    without: bool = False


@dataclass(frozen=True)
class Match:
    """How a binary operation pairs series."""

    on: bool = False
    labels: tuple[str, ...] = ()
    card: str = "one"  # one, left (many to one), right (one to many), many (sets)
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    match: Match | None = None
    boolean: bool = False


@dataclass(frozen=True)
class Unary(Node):
    op: str
    expr: Node


@dataclass(frozen=True)
class Paren(Node):
    expr: Node


@dataclass(frozen=True)
class Once(Node):
    """The same value at every step: evaluated at one and repeated."""

    expr: Node


@dataclass(frozen=True)
class Unique(Node):
    """Fails if two series have equal labels at one step."""

    expr: Node


@dataclass(frozen=True)
class Remote(Node):
    """A query answered by one of several sources; ``start`` and ``end`` narrow the grid."""

    source: int
    expr: Node
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class Dedup(Node):
    """Series of several sources; at equal labels and step the last source wins."""

    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Gather(Node):
    """Partial aggregates of several sources, all kept; an aggregation follows."""

    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Nothing(Node):
    """No series."""

    labels: tuple[str, ...] = field(default=())


class UserNode(Node):
    """A node that brings its own evaluation: ``to_vector(evaluator, grid) -> Vector``."""

    def to_vector(self, evaluator, grid):  # pragma: no cover - interface
        raise NotImplementedError


SET_OPS = ("and", "or", "unless")
COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")
ARITHMETIC = ("+", "-", "*", "/", "%", "^", "atan2")
AGGREGATES = ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "count_values", "topk", "bottomk", "limitk", "limit_ratio")
WITH_PARAM = ("quantile", "count_values", "topk", "bottomk", "limitk", "limit_ratio")
K_AGGREGATES = ("topk", "bottomk", "limitk", "limit_ratio")

#: Argument and result types of every function. s scalar, v vector,
#: m range, t string; ? may be left out, * any number.
FUNCTIONS = {
    "abs": ("v", "v"), "absent": ("v", "v"), "absent_over_time": ("m", "v"),
    "acos": ("v", "v"), "acosh": ("v", "v"), "asin": ("v", "v"), "asinh": ("v", "v"), "atan": ("v", "v"), "atanh": ("v", "v"),
    "avg_over_time": ("m", "v"), "ceil": ("v", "v"), "changes": ("m", "v"),
    "clamp": ("vss", "v"), "clamp_max": ("vs", "v"), "clamp_min": ("vs", "v"),
    "cos": ("v", "v"), "cosh": ("v", "v"), "count_over_time": ("m", "v"),
    "day_of_month": ("v?", "v"), "day_of_week": ("v?", "v"), "day_of_year": ("v?", "v"), "days_in_month": ("v?", "v"),
    "deg": ("v", "v"), "delta": ("m", "v"), "deriv": ("m", "v"), "double_exponential_smoothing": ("mss", "v"),
    "exp": ("v", "v"), "first_over_time": ("m", "v"), "floor": ("v", "v"),
    "histogram_avg": ("v", "v"), "histogram_count": ("v", "v"), "histogram_fraction": ("ssv", "v"), "histogram_quantile": ("sv", "v"),
    "histogram_stddev": ("v", "v"), "histogram_stdvar": ("v", "v"), "histogram_sum": ("v", "v"),
    "hour": ("v?", "v"), "idelta": ("m", "v"), "increase": ("m", "v"), "irate": ("m", "v"),
    "label_join": ("vttt*", "v"), "label_replace": ("vtttt", "v"),
    "last_over_time": ("m", "v"), "ln": ("v", "v"), "log10": ("v", "v"), "log2": ("v", "v"),
    "mad_over_time": ("m", "v"), "max_over_time": ("m", "v"), "min_over_time": ("m", "v"), "minute": ("v?", "v"), "month": ("v?", "v"),
    "pi": ("", "s"), "predict_linear": ("ms", "v"), "present_over_time": ("m", "v"),
    "quantile_over_time": ("sm", "v"), "rad": ("v", "v"), "rate": ("m", "v"), "resets": ("m", "v"), "round": ("vs?", "v"),
    "scalar": ("v", "s"), "sgn": ("v", "v"), "sin": ("v", "v"), "sinh": ("v", "v"),
    "sort": ("v", "v"), "sort_desc": ("v", "v"), "sort_by_label": ("vt*", "v"), "sort_by_label_desc": ("vt*", "v"),
    "sqrt": ("v", "v"), "stddev_over_time": ("m", "v"), "stdvar_over_time": ("m", "v"), "sum_over_time": ("m", "v"),
    "tan": ("v", "v"), "tanh": ("v", "v"), "time": ("", "s"), "timestamp": ("v", "v"),
    "ts_of_first_over_time": ("m", "v"), "ts_of_last_over_time": ("m", "v"), "ts_of_max_over_time": ("m", "v"), "ts_of_min_over_time": ("m", "v"),
    "vector": ("s", "v"), "year": ("v?", "v"),
}
#: Only with the option for extended functions.
EXTENDED = {"xdelta": ("m", "v"), "xincrease": ("m", "v"), "xrate": ("m", "v")}
#: Known to the language, not evaluated here.
NOT_EVALUATED = ("info",)
SORTS = ("sort", "sort_desc", "sort_by_label", "sort_by_label_desc")


def kind(node: Node) -> str:
    """Type of a node's value: s, v, m or t."""
    if isinstance(node, Number):
        return "s"
    if isinstance(node, Text):
        return "t"
    if isinstance(node, Window | Subquery):
        return "m"
    if isinstance(node, Call):
        return (FUNCTIONS.get(node.fn) or EXTENDED[node.fn])[1]
    if isinstance(node, Unary | Paren | Once | Unique):
        return kind(node.expr)
    if isinstance(node, Binary):
        return "s" if kind(node.left) == kind(node.right) == "s" else "v"
    return "v"
