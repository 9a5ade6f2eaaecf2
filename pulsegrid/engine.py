"""The engine: queries over a source, as lazy results."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError, QueryTimeout, UnsupportedExpression, translated
from .grid import Grid, Vector, ref
from .lang.lexer import duration_ms
from .lang.nodes import K_AGGREGATES, SORTS, Aggregate, Call, Node, Paren, Text, kind
from .lang.parser import parse
from .operators import labels as label_ops
from .options import Options
from .plans import rules as R
from .plans.codec import fingerprint
from .plans.evaluate import Evaluator, checked
from .session import reachable


def shown(label: str) -> str:
    """Result column of a label: its own name, unless that is a value's."""
    return f"l_{label}" if label in ("step", "v", "h") else label


@dataclass
class Result:
    """A query's answer: ``df`` has label columns (see ``shown``), ``step`` (epoch ms) and ``v`` (and ``h``).

    kind is matrix, vector, scalar or string. A string has no table but ``text``.
    """

    kind: str
    df: DataFrame | None
    labels: tuple[str, ...] = ()
    warnings: list[str] = field(default_factory=list)
    plan: Node | None = None
    text: str | None = None
    timeout: float = 0
    #: (warning, rows that cause it): see ``data_warnings``.
    checks: list = field(default_factory=list)

    def collect(self) -> list:
        """All rows; Spark's errors come as the query errors behind them."""
        if self.df is None:
            return []
        context, tag = self.df.sparkSession.sparkContext, f"pulsegrid-{uuid.uuid4().hex}"
        late = threading.Event()
        timer = threading.Timer(self.timeout, lambda: (late.set(), context.cancelJobsWithTag(tag))) if self.timeout else None
        context.addJobTag(tag)
        if timer:
            timer.start()
        try:
            return self.df.collect()
        except Exception as e:
            if late.is_set():
                raise QueryTimeout(f"query took longer than {self.timeout} s") from None
            own = translated(e)
            if own is e:
                raise
            raise own from None
        finally:
            if timer:
                timer.cancel()
            context.removeJobTag(tag)

    def data_warnings(self) -> list[str]:
        """Warnings that depend on the data. Each possible one is looked for by a job of its
        own that stops at the first row, so they are only looked for when asked."""
        return self.warnings + [text for text, rows in self.checks if rows.limit(1).count()]

    def operators(self) -> list[dict]:
        """The plan's operators from the root: depth, kind, and the fingerprint of the plan below it."""
        out: list[dict] = []

        def visit(node: Node, depth: int) -> None:
            out.append({"id": fingerprint(node), "depth": depth, "operator": type(node).__name__})
            for x in node.children():
                visit(x, depth + 1)

        if self.plan is not None:
            visit(self.plan, 0)
        return out

    def analyze(self) -> dict:
        """Runs the query without keeping its rows: rows, seconds, both plans, and what each Spark operator counted."""
        seen = Observation()
        df = self.df.observe(seen, F.count(F.lit(1)).alias("rows"))
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return {"rows": seen.get["rows"], "seconds": time.perf_counter() - start, "plan": self.explain(), "spark": df._jdf.queryExecution().executedPlan().toString(), "operators": _measured(df.sparkSession)}

    def series(self) -> dict[tuple[tuple[str, str], ...], list[tuple[int, float]]]:
        """For small results: label pairs (absent ones left out) to points in time order."""
        out: dict = {}
        for r in self.collect():
            key = tuple((n, r[shown(n)]) for n in self.labels if r[shown(n)])
            out.setdefault(key, []).append((r["step"], r["v"] if r["v"] is not None else r["h"]))
        return {k: sorted(v, key=lambda p: p[0]) for k, v in out.items()}

    def explain(self) -> str:
        """The logical plan; ``df.explain`` shows what Spark makes of it."""
        return R.explain(self.plan) if self.plan is not None else ""


def _measured(spark: SparkSession) -> list[dict]:
    """The last execution's Spark operators with their metrics, as the session's status store has them."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsList()
    if not done.size():
        return []
    number = done.last().executionId()
    values, nodes, out = store.executionMetrics(number), store.planGraph(number).allNodes(), []
    for i in range(nodes.size()):
        node, own = nodes.apply(i), {}
        for k in range(node.metrics().size()):
            metric = node.metrics().apply(k)
            if (v := values.get(metric.accumulatorId())).isDefined():
                own[metric.name()] = v.get()
        out.append({"operator": node.name(), "metrics": own})
    return out


def milliseconds(x: int | float | str | dt.datetime | dt.timedelta) -> int:
    """Epoch ms or a duration: numbers are ms, strings durations, datetimes UTC."""
    if isinstance(x, str):
        return duration_ms(x)
    if isinstance(x, dt.timedelta):
        return round(x.total_seconds() * 1000)
    if isinstance(x, dt.datetime):
        return round((x if x.tzinfo else x.replace(tzinfo=dt.UTC)).timestamp() * 1000)
    return int(x)


class MetricsEngine:
    """Evaluates queries over a source of series.

    ``rules`` are plan -> plan functions run after the default ones; a rule may put in
    ``UserNode`` subclasses that bring their own evaluation.
    """

    def __init__(self, spark: SparkSession, source, options: Options | None = None, rules: Iterable[Callable[[Node], Node]] = ()):
        self.spark, self.source, self.options, self.rules = reachable(spark), source, options or Options(), tuple(rules)
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT"):
            raise QueryError("the session's time zone must be UTC (spark.sql.session.timeZone)")

    def parse(self, query: str) -> Node:
        return parse(query, self.options.extended)

    def instant(self, query: str, ts, **change) -> Result:
        return self.instant_from_plan(self.parse(query), ts, **change)

    def range(self, query: str, start, end, step, **change) -> Result:
        return self.range_from_plan(self.parse(query), start, end, step, **change)

    def _rules(self) -> tuple:
        return (*(R.DEFAULT_RULES if self.options.optimize else ()), *self.rules)

    def prepared(self, node: Node, start: int, end: int) -> Node:
        return R.prepare(node, start, end, self._rules())

    def evaluator(self, options: Options) -> Evaluator:
        return Evaluator(self.spark, self.source, options)

    def range_from_plan(self, node: Node, start, end, step, **change) -> Result:
        if kind(node) not in "sv":
            raise QueryError("a range query must be a scalar or an instant vector")
        grid = Grid(milliseconds(start), milliseconds(end), milliseconds(step))
        if grid.step <= 0 or grid.end < grid.start:
            raise QueryError("the step must be positive, and the end not before the start")
        return self._evaluate(node, grid, "matrix", change)

    def instant_from_plan(self, node: Node, ts, **change) -> Result:
        at = milliseconds(ts)
        root = _bare(node)
        if isinstance(root, Text):
            return Result("string", None, plan=node, text=root.value)
        if kind(node) == "m":
            raise UnsupportedExpression("a range or subquery can't be the whole query")
        result = self._evaluate(node, Grid(at, at, 1), "scalar" if kind(node) == "s" else "vector", change)
        return self._ordered(result, root)

    def _evaluate(self, node: Node, grid: Grid, form: str, change: dict) -> Result:
        options = replace(self.options, **change) if change else self.options
        plan = self.prepared(node, grid.start, grid.last)
        ev = self.evaluator(options)
        if kind(plan) == "s":
            df, v = ev.scalar(plan, grid).joined(grid.df(self.spark))
            out = Vector(df.select("step", v.alias("v")), ())
        else:
            out = checked(ev.vector(plan, grid))
        df = out.df.select(*[ref(n).alias(shown(n)) for n in out.labels], "step", *out.value)
        return Result(form, df, out.labels, ev.warnings, plan, timeout=options.timeout, checks=ev.checks)

    def _ordered(self, r: Result, root: Node) -> Result:
        """Order of an instant result, where the query asks for one."""
        prefixed = lambda: r.df.select(*[F.col(f"`{shown(n)}`").alias(f"l_{n}") for n in r.labels], "step", *[c for c in ("v", "h") if c in r.df.columns])
        back = lambda df: df.select(*[ref(n).alias(shown(n)) for n in r.labels], *[c for c in df.columns if c in ("step", "v", "h")])
        if isinstance(root, Call) and root.fn in SORTS:
            df = prefixed()
            df = df.filter("h IS NULL").drop("h") if "h" in df.columns else df
            r.df = back(label_ops.ordered(df, r.labels, root.fn, [a.value for a in root.args[1:]]))
        elif isinstance(root, Aggregate) and root.op in K_AGGREGATES:
            groups = [n for n in r.labels if (n in root.labels) != root.without]
            v = F.col("v")
            r.df = back(prefixed().orderBy(*[ref(n) for n in groups], F.isnan(v), v.asc() if root.op == "bottomk" else v.desc()))
        return r

    def explain(self, query: str, start=0, end=0) -> str:
        return R.explain(self.prepared(self.parse(query), milliseconds(start), milliseconds(end)))


def _bare(node: Node) -> Node:
    while isinstance(node, Paren):
        node = node.expr
    return node
