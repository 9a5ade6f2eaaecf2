"""Golden values, and differential tests against the row-at-a-time oracle."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.engine import MetricsEngine
from pulsegrid.errors import DuplicateSeries, ManyToMany, QueryError, TooManySamples, UnsupportedExpression
from pulsegrid.federated import FederatedEngine, Member, Part
from pulsegrid.grid import Vector
from pulsegrid.lang.nodes import Matcher, Select, UserNode
from pulsegrid.lang.parser import parse
from pulsegrid.options import Options
from pulsegrid.plans import rules as R
from pulsegrid.sources.series import from_table, load_script

from .oracle import Failure, Oracle

MIXED = """load 30s
 requests_total{pod="a",route="x"} 0+3x40
 requests_total{pod="b",route="x"} 5+7x12 0+2x20
 requests_total{pod="c",route="y"} 100-2x30 _ _ 7 8
 limits{pod="a"} 10+1x40
 limits{pod="b"} 1 2 _ _ 5 stale _ 3+0.5x25
 gauge{pod="a",route="x",version="10"} 1.5 -2 0 8 NaN 3 4 -7 2.25 1x20
 gauge{pod="a",route="x",version="9"} -1.5 2 0 -8 6 3 NaN 7 2.25 stale 4x20
 gauge{pod="b",route="z",version="9"} 4x35
"""


def series_of(source):
    out = {}
    for r in source.df.collect():
        ls = frozenset((n, r[f"l_{n}"]) for n in source.labels if r[f"l_{n}"])
        out.setdefault(ls, []).append((r["t"], "stale" if r["stale"] else r["v"]))
    return {k: sorted(v) for k, v in out.items()}


def close(a, b):
    return math.isnan(a) and math.isnan(b) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def same(got, want):
    got = {frozenset(k): v for k, v in got.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert [t for t, _ in got[k]] == [t for t, _ in want[k]], k
        assert all(close(x, y) for (_, x), (_, y) in zip(got[k], want[k])), (k, got[k], want[k])


@pytest.fixture(scope="module")
def mixed(spark):
    source = load_script(spark, MIXED)
    source.df = source.df.cache()
    return source, series_of(source)


QUERIES = [
    "requests_total", "gauge offset 1m", "gauge offset -90s", "gauge @ 120", "sum(gauge @ end())", 'requests_total{pod=~"a|b",route!="y"}', '{pod="a"}', "timestamp(gauge)", "timestamp(gauge * 1)",
    "sum by (pod) (requests_total)", "avg without (version) (gauge)", "min(gauge)", "max by (route) (gauge)", "count(gauge)", "group by (pod) (gauge)", "stddev(gauge)", "stdvar by (pod) (gauge)",
    "quantile(0.4, gauge)", "quantile by (pod) (2, gauge)", "quantile(scalar(count(gauge)) / 10, gauge)", 'count_values("v", limits)', 'count_values by (pod) ("pod", limits)',
    "topk(2, gauge)", "bottomk by (pod) (1, gauge)", "limitk(2, requests_total)", "topk(0, gauge)", "topk(scalar(min(limits)), gauge)",
    "rate(requests_total[2m])", "increase(requests_total[5m])", "delta(gauge[3m])", "irate(requests_total[2m])", "idelta(gauge[2m])", "sum by (route) (rate(requests_total[4m]))", "rate(requests_total[2m] offset 1m)",
    "resets(requests_total[5m])", "changes(gauge[5m])", "deriv(requests_total[5m])", "predict_linear(limits[5m], 60)", "double_exponential_smoothing(limits[5m], 0.5, 0.3)",
    *[f"{f}_over_time(gauge[150s])" for f in ("sum", "avg", "min", "max", "count", "last", "first", "present", "stddev", "stdvar", "mad")],
    "quantile_over_time(0.7, gauge[150s])", "quantile_over_time(scalar(count(gauge)) / 10, gauge[150s:30s])", 'absent_over_time(limits{pod="b"}[1m])', 'absent_over_time(nothing{a="1",b=~"x"}[1m])',
    "count_over_time(gauge[1h])", "sum_over_time(gauge[1h])", "rate(requests_total[1h])", "max_over_time(limits[1h])",
    "abs(gauge)", "ceil(gauge / 3) + floor(gauge / 3)", "exp(gauge)", "sqrt(gauge)", "ln(gauge)", "log2(gauge)", "log10(gauge)", "sgn(gauge)", "round(gauge)", "round(gauge, 0.2)", "clamp(gauge, -1, 3)",
    "clamp(gauge, 3, -1)", "clamp_min(gauge, 1)", "clamp_max(gauge, scalar(limits{pod='a'}) - 10)", "vector(time())", "scalar(gauge)", "scalar(limits{pod='b'}) + 1", "time() % 7", "pi() * 2",
    'absent(limits{pod="b"})', "absent(nothing)", "absent(sum(nothing))", 'label_replace(gauge, "short", "$1-v", "version", "(.).*")', 'label_replace(gauge, "pod", "", "pod", "a")', 'label_join(gauge, "j", "/", "pod", "route", "none")',
    "gauge + 1", "2 - gauge", "gauge % 3", "gauge ^ 2", "2 ^ gauge", "gauge / 0", "gauge atan2 2", "-gauge", "+gauge", "gauge > 1", "1 > gauge", "gauge >= bool 2", "gauge == gauge", "gauge != bool 2", "1 < bool 2",
    "requests_total / on (pod) group_left () limits", "limits * on (pod) group_right (route) requests_total", "sum by (pod) (gauge) + sum by (pod) (requests_total)", "gauge - ignoring (version) group_left () sum by (pod, route) (gauge)",
    "limits > on (pod) sum by (pod) (requests_total)", "limits > bool ignoring (route) sum by (pod) (requests_total)", "requests_total > on (pod) group_left () limits", "limits < on (pod) group_right () requests_total",
    "gauge and on (pod) limits", "gauge unless on (pod) limits", "limits or on (pod) requests_total", "limits or requests_total", "gauge and ignoring (version, route) limits",
    "max_over_time(rate(requests_total[2m])[3m:1m])", "avg_over_time((gauge > 1)[4m:30s])", "sum_over_time(time()[2m:30s])", "last_over_time(sum by (pod) (gauge)[3m:45s] offset 1m)", "max_over_time(gauge[3m:1m] @ 300)", "count_over_time(gauge[5m:])",
    "sum(requests_total) / count(requests_total) - avg(requests_total)", 'sum(gauge{pod="a"}) / sum(gauge)', "sort_desc(gauge)", "sum(sort(gauge))",
]


@pytest.mark.parametrize("lookback", [300_000, 60_000])
@pytest.mark.parametrize("query", QUERIES)
def test_range_against_oracle(spark, mixed, query, lookback):
    source, data = mixed
    want = Oracle(data, lookback).run(parse(query), 0, 900_000, 45_000)
    got = MetricsEngine(spark, source, Options(lookback=lookback)).range(query, 0, 900_000, 45_000).series()
    same(got, want)


@pytest.mark.parametrize("query", ["requests_total / on (pod) group_left () limits", "limits * on (pod) group_right () requests_total", "gauge + gauge", "gauge and on (pod) limits", "gauge unless on (pod) limits", "limits or on (pod) requests_total"])
def test_matched_vectors_are_not_gathered_on_the_driver(spark, mixed, query):
    """Tables this small would be broadcast, though what is made of them may be large."""
    plan = MetricsEngine(spark, mixed[0]).range(query, 0, 900_000, 45_000).df._jdf.queryExecution().executedPlan().toString()
    # The steps of a side (one row a step at most) may be.
    assert any(f"SortMergeJoin [{side}_" in plan for side in "kl")
    assert not any(f"BroadcastHashJoin [{side}_" in plan for side in "kl")


def test_random_queries_against_oracle(spark, mixed):
    """Seeded; operators whose answer depends on ties or on number formatting are left out."""
    source, data = mixed
    rng = random.Random(7)

    def vector(depth):
        kind = rng.randrange(8 if depth else 2)
        name = rng.choice(["requests_total", "gauge", "limits"])
        if kind == 0:
            return name + rng.choice(["", ' {pod="a"}', ' {route=~"x|"}']) + rng.choice(["", " offset 1m", " @ 200"])
        if kind == 1:
            fn = rng.choice(["rate", "increase", "delta", "sum_over_time", "max_over_time", "count_over_time", "changes", "resets", "last_over_time", "irate"])
            return f"{fn}({name}[{rng.choice(['90s', '3m', '10m'])}])"
        if kind == 2:
            return f"{rng.choice(['sum', 'avg', 'min', 'max', 'count', 'stddev'])} {rng.choice(['by (pod)', 'without (route)', 'by (pod, route)', ''])} ({vector(depth - 1)})"
        if kind == 3:
            return f"({vector(depth - 1)} {rng.choice(['+', '-', '*', '/', '>', '<=', '== bool', '%'])} {rng.choice(['2', '0', '-1.5', 'scalar(sum(limits))'])})"
        if kind == 4:
            return f"(sum by (pod) ({vector(depth - 1)}) {rng.choice(['+', '/', '>', 'and', 'or', 'unless'])} max by (pod) ({vector(depth - 1)}))"
        if kind == 5:
            return f"{rng.choice(['abs', 'ceil', 'sgn', 'sqrt', 'ln'])}({vector(depth - 1)})"
        if kind == 6:
            return f"{rng.choice(['max_over_time', 'avg_over_time', 'count_over_time'])}(({vector(depth - 1)})[3m:1m])"
        return f"clamp_min({vector(depth - 1)}, 1)"

    for _ in range(25):
        query = vector(2)
        try:
            want = Oracle(data).run(parse(query), 30_000, 600_000, 60_000)
        except Failure:
            with pytest.raises((DuplicateSeries, ManyToMany)):
                MetricsEngine(spark, source).range(query, 30_000, 600_000, 60_000).series()
            continue
        same(MetricsEngine(spark, source).range(query, 30_000, 600_000, 60_000).series(), want)


@pytest.mark.parametrize("chunk", [0, 4_000])
def test_samples_of_one_time_are_no_resets(spark, chunk):
    """Three samples each second, stored by falling value: a counter rises among them, and the first stands for its time."""
    rows = [(1000 * (i // 3), float(i)) for i in reversed(range(30))]
    df = spark.createDataFrame(rows, "t long, v double").coalesce(1)
    engine = MetricsEngine(spark, from_table(df, "n_total", {}, "t", "v"), Options(series_chunk=chunk))
    want = {"resets(n_total[5s])": 0, "changes(n_total[5s])": 14, "increase(n_total[5s])": 12 * (4 + 2 / 14) / 4, "rate(n_total[5s])": 12 * (4 + 2 / 14) / 4 / 5}
    for query, value in want.items():
        ((points),) = engine.range(query, 9000, 9000, 1000).series().values()
        assert points == [(9000, pytest.approx(value))], query


@pytest.mark.parametrize("chunk", [0, 4_000])
@pytest.mark.parametrize("lookback", [2_000, 20_000])
def test_newest_of_one_millisecond_is_the_first_stored(spark, chunk, lookback):
    """Two samples a millisecond: every selector of a query takes the earlier microsecond's, or else the least value."""
    at = dt.datetime(2024, 1, 1)
    late, soon = at + dt.timedelta(microseconds=1900), at + dt.timedelta(microseconds=1100)
    rows = [("a", soon, 5.0), ("a", late, 7.0), ("b", late, 5.0), ("b", soon, 7.0), ("c", soon, 9.0), ("c", late, 9.0)]
    if lookback > 3_000:
        rows += [("d", soon, 3.0), ("d", soon, 8.0), ("e", soon, 8.0), ("e", soon, 3.0)]
    df = spark.createDataFrame(rows, "x string, ts timestamp_ntz, v double").coalesce(1)
    engine = MetricsEngine(spark, from_table(df, "n", {"x": "x"}, "ts", "v"), Options(lookback=lookback, series_chunk=chunk))
    start = 1_704_067_201_000
    got = engine.range("n * 1 + n * 10", start, start + 1000, 1000).series()
    want = {"a": 55.0, "b": 77.0, "c": 99.0, **({"d": 33.0, "e": 33.0} if lookback > 3_000 else {})}
    assert {dict(k)["x"]: {v for _, v in points} for k, points in got.items()} == {k: {v} for k, v in want.items()}


GOLDEN_RANGE = [
    ("load 30s\n bar 0 1 10 100 1000", "sum_over_time(bar[30s])", 120, 60, [0, 10, 1000]),
    ("load 30s\n bar 0 1 10 100 1000", "sum_over_time(bar[45s])", 120, 60, [0, 11, 1100]),
    ("load 30s\n bar 5 17 42 2 7 905 51", "sum_over_time(bar[45s])", 180, 60, [5, 59, 9, 956]),
    ("load 30s\n metric 1+1x4", "metric", 120, 60, [1, 3, 5]),
    ("load 10s\n r 1 5 10 20 _ 40", "xincrease(r[10s])", 60, 20, [1, 5, 0, 0]),
    ("load 10s\n r 1 5 10 20 _ 40", "xincrease(r[10s])", 60, 10, [1, 4, 5, 10, 0, 20, 0]),
    ("load 10s\n r 1 5 10 20 _ 40", "xincrease(r[20s])", 60, 10, [1, 4, 9, 15, 10, 20, 20]),
]


@pytest.mark.parametrize("script,query,end,step,want", GOLDEN_RANGE)
def test_golden_range(spark, script, query, end, step, want):
    r = MetricsEngine(spark, load_script(spark, script), Options(extended=True)).range(query, 0, end * 1000, step * 1000)
    (points,) = r.series().values()
    assert points == [(i * step * 1000, float(v)) for i, v in enumerate(want)]


A = 'load 5s\n b{path="/foo"} 0+10x10\n b{path="/bar"} 0+10x5 0+10x4'
B = 'load 5m\n b{path="/foo"} 0 50 300 150 200\n b{path="/bar"} 200 150 300 50 0'
C = 'load 5s\n b{path="/foo"} 1 1 1 2 2 2 2 2 3 3 3\n b{path="/bar"} 1+1x10'
D, E5 = "load 5m\n b 0 1 2 3 2 3 4", "load 5m\n b stale stale stale 5"
G = "load 30s\n b 0 0 0 0 1 1 1 1"
GOLDEN_INSTANT = [
    (A, "xincrease(b[50s])", 50, [90, 100]), (A, "xincrease(b[5s])", 50, [10, 10]), (A, "xincrease(b[3s])", 50, [10, 10]), (A, "xrate(b[50s])", 50, [1.8, 2]), (A, "xrate(b[100s])", 50, [0.9, 1]),
    (B, "xdelta(b[20m])", 1200, [-200, 200]), (B, "xdelta(b[19m])", 1200, [-190, 190]), (B, "xdelta(b[1m])", 1200, [-10, 10]),
    (C, "rate(b[50s])", 25, [0.11, 0.022]), (C, "xrate(b[50s])", 25, [0.1, 0.02]), (C, "rate(b[50s])", 24, [0.106, 0.0265]), (C, "xrate(b[50s])", 24, [0.08, 0.02]),
    (C, "rate(b[50s])", 26, [0.114, 0.0228]), (C, "rate(b[50s])", 75, [0.11, 0.0275]), (C, "xrate(b[50s])", 75, [0.1, 0.02]),
    (E5, "xincrease(b[1h15m])", 4500, [5]), (D, "increase(b[30m])", 1800, [7]), (D, "xincrease(b[30m])", 1800, [7]), (G, "xincrease(b[2m1s])", 240, [1]), (G, "xincrease(b[2m])", 240, [0]),
]


@pytest.mark.parametrize("script,query,at,want", GOLDEN_INSTANT)
def test_golden_instant(spark, script, query, at, want):
    r = MetricsEngine(spark, load_script(spark, script), Options(extended=True)).instant(query, at * 1000)
    got = [v[0][1] for _, v in sorted(r.series().items())]
    assert len(got) == len(want) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(got, want)), got


HIST = """load 30s
 h_bucket{pod="a",le="1"} 1x5
 h_bucket{pod="a",le="2"} 3x5
 h_bucket{pod="a",le="5"} 3x5
 h_bucket{pod="a",le="+Inf"} 6x5
 h_bucket{pod="b",le="0"} 4x5
 h_bucket{pod="b",le="+Inf"} 4x5
 h_bucket{pod="c",le="1"} 4x5
 h_bucket{pod="d",le="1"} 4x5
 h_bucket{pod="d",le="2"} 2x5
 h_bucket{pod="d",le="+Inf"} 8x5
 h_bucket{pod="e",le="bad"} 8x5
 h_bucket{pod="f",le="1"} 0x5
 h_bucket{pod="f",le="+Inf"} 0x5
"""


@pytest.mark.parametrize(
    "q,want",
    [(0.5, {"a": 2.0, "b": 0.0, "c": math.nan, "d": 1.0, "f": math.nan}), (0.25, {"a": 1.25, "b": 0.0, "c": math.nan, "d": 0.5, "f": math.nan}), (0.9, {"a": 5.0, "b": 0.0, "c": math.nan, "d": 2.0, "f": math.nan}), (-1, {"a": -math.inf, "b": -math.inf, "c": math.nan, "d": -math.inf, "f": -math.inf}), (2, {"a": math.inf, "b": math.inf, "c": math.nan, "d": math.inf, "f": math.inf})],
)
def test_classic_quantile(spark, q, want):
    r = MetricsEngine(spark, load_script(spark, HIST)).instant(f"histogram_quantile({q}, h_bucket)", 60_000)
    got = {dict(k)["pod"]: v[0][1] for k, v in r.series().items()}
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want), got


def test_classic_fraction(spark):
    e = MetricsEngine(spark, load_script(spark, HIST))
    got = {dict(k)["pod"]: v[0][1] for k, v in e.instant("histogram_fraction(0, 1.5, h_bucket)", 60_000).series().items()}
    assert close(got["a"], 2 / 6) and close(got["b"], 0) and close(got["d"], 0.5) and math.isnan(got["c"]) and math.isnan(got["f"])


def test_duplicate_and_many_to_many(spark):
    e = MetricsEngine(spark, load_script(spark, 'load 30s\n a{x="1"} 1x9\n b{x="1"} 2x9\n c{x="1",y="1"} 3x9\n c{x="1",y="2"} 4x9'))
    with pytest.raises(DuplicateSeries):
        e.instant('-{x="1",y=""}', 60_000).series()
    with pytest.raises(ManyToMany):
        e.instant("a / on (x) c", 60_000).series()
    with pytest.raises(ManyToMany):
        e.instant("c / on (x) a", 60_000).series()
    with pytest.raises(ManyToMany):
        e.instant("c / on (x) group_left () c", 60_000).series()
    assert len(e.instant("c / on (x) group_left () a", 60_000).series()) == 2
    with pytest.raises(DuplicateSeries):
        e.instant('label_replace(c, "y", "z", "", "")', 60_000).series()


def test_limits_and_parameters(spark, mixed):
    source, _ = mixed
    with pytest.raises(TooManySamples):
        MetricsEngine(spark, source, Options(max_samples=20)).instant("requests_total", 900_000).series()
    assert MetricsEngine(spark, source, Options(max_samples=5000)).instant("requests_total", 600_000).series()
    e = MetricsEngine(spark, source)
    for q in ("topk(NaN, gauge)", "topk(1e19, gauge)", "limit_ratio(NaN, gauge)", "topk(scalar(nothing), gauge)"):
        with pytest.raises(QueryError):
            e.instant(q, 60_000).series()
    assert e.range("limit_ratio(2, gauge)", 0, 60_000, 30_000).warnings
    assert e.range("quantile(2, gauge)", 0, 60_000, 30_000).warnings
    assert e.range("rate(gauge[5m])", 0, 60_000, 30_000).warnings and not e.range("rate(requests_total[5m])", 0, 60_000, 30_000).warnings
    with pytest.raises(UnsupportedExpression):
        e.instant("gauge[5m]", 0)
    with pytest.raises(QueryError):
        e.range("gauge[5m]", 0, 1, 1)
    assert e.instant('"hello"', 0).text == "hello"
    assert e.instant("1 + 1", 0).kind == "scalar"


def test_limit_ratio_splits_the_series(spark, mixed):
    e = MetricsEngine(spark, mixed[0])
    everything = set(e.instant('{pod=~".+"}', 60_000).series())
    some = set(e.instant('limit_ratio(0.4, {pod=~".+"})', 60_000).series())
    rest = set(e.instant('limit_ratio(-0.6, {pod=~".+"})', 60_000).series())
    assert some | rest == everything and not some & rest


def test_order_of_instant_results(spark, mixed):
    e = MetricsEngine(spark, mixed[0])
    rows = e.instant("sort_desc(gauge)", 120_000).collect()
    assert [r.v for r in rows] == sorted([r.v for r in rows], reverse=True)
    rows = e.instant('sort_by_label(gauge, "version")', 60_000).collect()
    assert [r.version for r in rows] == ["9", "9", "10"]
    rows = e.instant('sort_by_label_desc(gauge, "version")', 60_000).collect()
    assert [r.version for r in rows][0] == "10"


def test_plan_reads_one_scan_and_prunes(spark, tmp_path):
    from pulsegrid.sources.series import from_table

    spark.createDataFrame([(i, f"u{i % 3}", float(i), "unused") for i in range(100)], "ts long, u string, v double, junk string").write.parquet(str(tmp_path / "t"))
    source = from_table(spark.read.parquet(str(tmp_path / "t")), "m", {"u": "u"}, "ts", "v")
    df = MetricsEngine(spark, source).range('sum(m{u="u1"})', 0, 100, 10).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.replace(str(tmp_path), "").split("Location")[0] + plan.split("PushedFilters")[1]
    assert "junk" not in plan and "EqualTo(u,u1)" in plan and "LessThanOrEqual(ts" in plan
    assert "NestedLoop" not in plan and "Python" not in plan and "EqualTo(u,u1)" in plan


class Sevens(UserNode):
    """Every series of a selector, with the value 7."""

    def __init__(self, inner):
        object.__setattr__(self, "inner", inner)

    def children(self):
        return []

    def mapped(self, fn):
        return self

    def __eq__(self, other):
        return self is other

    def to_vector(self, evaluator, grid):
        from pyspark.sql import functions as F

        x = evaluator.vector(self.inner, grid)
        return Vector(x.df.withColumn("v", F.lit(7.0)), x.labels, False, x.unique, x.named)


def test_injected_operator(spark):
    e = MetricsEngine(spark, load_script(spark, 'load 30s\n m{a="1"} 1x30\n m{a="2"} 2x30'), rules=[lambda n: R.bottom_up(n, lambda x: Sevens(x) if isinstance(x, Select) else x)])
    (points,) = e.range("sum(m)", 0, 60_000, 30_000).series().values()
    assert [v for _, v in points] == [14.0] * 3


ZONES = """load 30s
 bar{zone="east-1",pod="n1"} 2+1x9
 bar{zone="east-1",pod="n2"} 3+2x9
 bar{zone="west-1",pod="n1"} 4+3x9
 bar{zone="west-2",pod="n2"} 5+4x9
"""


@pytest.mark.parametrize("disjoint", [True, False])
@pytest.mark.parametrize("query", ["sum by (pod) (bar)", "avg(bar)", "count(bar)", "max by (zone) (rate(bar[2m]))", "topk(2, bar)", "bar", "quantile(0.5, bar)", "sum(bar) / count(bar)", 'sum(bar{zone="west-1"})', "absent(bar)", "stddev(bar)", "-bar", "absent(nothing)"])
def test_federation_equals_one_engine(spark, query, disjoint):
    from pyspark.sql import functions as F

    source = load_script(spark, ZONES)
    zone = lambda z: Part(source, lambda: F.col("l_zone") == z)
    members = [Member(zone(z), {"zone": z}) for z in ("east-1", "west-1", "west-2")]
    if not disjoint:
        members.append(Member(zone("west-1"), {"zone": "west-1"}))
    want = MetricsEngine(spark, source).range(query, 0, 240_000, 60_000).series()
    got = FederatedEngine(spark, members, disjoint=disjoint).range(query, 0, 240_000, 60_000)
    same(got.series(), {frozenset(k): v for k, v in want.items()})
    if query == "sum by (pod) (bar)" and disjoint:
        assert "Gather" in got.explain()


HISTOGRAM = "struct<schema: int, count: double, sum: double, zero_threshold: double, zero_count: double, pos: map<int, double>, neg: map<int, double>, custom: array<double>, hint: tinyint>"


@pytest.fixture(scope="module")
def native(spark):
    from pulsegrid.sources.series import FrameSource

    def h(schema, n, pos, zero=0.0, s=None):
        return (schema, float(n), float(s if s is not None else n), 0.001, zero, {k: float(v) for k, v in pos.items()}, {}, None, 0)

    rows = []
    for i in range(6):
        rows.append(("m", "a", i * 30_000, None, h(1, 4 * i + 2, {1: 2 * i + 1, 3: 2 * i + 1}, s=10.0 * i)))
        rows.append(("m", "b", i * 30_000, None, h(0, 2 * i + 2, {0: i + 1, 2: i + 1}, s=4.0 * i)))
        rows.append(("m", "f", i * 30_000, 1.0 + i, None))
    return FrameSource(spark.createDataFrame(rows, f"l___name__ string, l_pod string, t long, v double, h {HISTOGRAM}"))


def one(r):
    ((_, points),) = r.series().items()
    return points[-1][1]


def test_native_histograms(spark, native):
    e = MetricsEngine(spark, native)
    at = 150_000
    assert one(e.instant('histogram_count(m{pod="a"})', at)) == 22 and one(e.instant('histogram_sum(m{pod="a"})', at)) == 50
    assert close(one(e.instant('histogram_avg(m{pod="a"})', at)), 50 / 22)
    total = one(e.instant('sum(m{pod!="f"})', at))
    assert total["schema"] == 0 and total["count"] == 34 and dict(total["pos"]) == {0: 6.0, 1: 11.0, 2: 6.0 + 11.0}
    assert e.instant("sum(m)", at).series() == {}
    assert one(e.instant("count(m)", at)) == 3
    assert close(one(e.instant('histogram_count(avg(m{pod!="f"}))', at)), 17)
    r = one(e.instant('histogram_count(increase(m{pod="a"}[2m]))', at))
    assert close(r, 16.0)
    assert close(one(e.instant('histogram_quantile(0.5, m{pod="a"})', at)), 2**0.5)
    assert close(one(e.instant('histogram_fraction(0, 2, m{pod="a"})', at)), 0.5 + 0.5 * 0.0)
    assert one(e.instant('histogram_stdvar(m{pod="a"})', at)) > 0
    assert one(e.instant('(m{pod="a"} * 2)', at))["count"] == 44
    assert one(e.instant('m{pod="a"} + ignoring (pod) m{pod="b"}', at))["count"] == 34
    assert e.instant('m{pod="a"} > ignoring (pod) m{pod="b"}', at).series() == {}
    assert one(e.instant('histogram_count(-m{pod="b"})', at)) == -12
    assert one(e.instant('histogram_count(sum_over_time(m{pod="b"}[1m]))', at)) == 22
    assert one(e.instant("max(m)", at)) == 6 and one(e.instant('resets(m{pod="a"}[3m])', at)) == 0
    assert one(e.instant('last_over_time(m{pod="a"}[1m])', at))["count"] == 22
    assert len(e.instant("m and m", at).series()) == 3 and len(e.instant("limitk(2, m)", at).series()) == 2


def test_orders_and_lineitem_are_read_whole(spark):
    import os

    from pulsegrid import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    for name, table, day in (("sel_orders", "orders", "o_orderdate"), ("agg_sum_lineitem", "lineitem", "l_shipdate")):
        days = {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(f"unix_millis(cast({day} as timestamp))").collect()}
        # The lookback is one step, so the steps with a value are the table's own days.
        assert {r.step for r in queries.QUERIES[name].run(spark, sf).collect()} == days


def test_no_named_query_is_empty(spark):
    import os

    from pulsegrid import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    for name in ("sel_matchers", "absent_over_time", "fed_overlapping", "quantile_over_time_varying", "native_select", "native_sum_rate", "native_custom_quantile", "bin_vector_cmp", "set_and"):
        assert queries.queries()[name](spark, sf).limit(1).count(), name


def test_limit_of_samples_is_the_querys(spark, mixed):
    source, _ = mixed
    n = sum(source.scan([Matcher("__name__", "=", m)], -1, 10**12).df.count() for m in ("gauge", "limits"))
    ask = lambda most: MetricsEngine(spark, source, Options(max_samples=most)).instant("sum(count_over_time(gauge[1h])) + sum(count_over_time(limits[1h]))", 2_000_000).series()
    assert ask(n)
    with pytest.raises(TooManySamples):
        ask(n - 1)


def test_counts_of_stored_histograms_read_no_buckets(spark, native, tmp_path):
    from pulsegrid.sources.series import from_table

    rows = native.scan([], -1, 10**9).df.filter("h IS NOT NULL")
    rows.select(F.col("l_pod").alias("pod"), "t", "h").write.parquet(str(tmp_path / "h"))
    stored = from_table(spark.read.parquet(str(tmp_path / "h")), "m", {"pod": "pod"}, "t", F.lit(None).cast("double"), h="h")
    e = MetricsEngine(spark, stored)
    for q in ("histogram_count(m)", "histogram_avg(m)", "histogram_sum(m)"):
        r = e.instant(q, 150_000)
        plan = r.df._jdf.queryExecution().executedPlan().toString()
        assert "h:struct<schema:int,count:double,sum:double>" in plan[plan.index("ReadSchema") :], plan
        whole = {k: v for k, v in MetricsEngine(spark, native).instant(q, 150_000).series().items()}
        got = r.series()
        assert got and all(close(got[k][0][1], whole[k][0][1]) for k in got)


def test_sums_keep_small_values_beside_large_ones(spark):
    source = load_script(spark, """load 30s
 big{s="a"} 1e16 1 -1e16 0.25
 big{s="b"} 1 1 1 1
 big{s="c"} -1e16 3 1e16 Inf
""")
    e = MetricsEngine(spark, source)
    assert one(e.instant('sum_over_time(big{s="a"}[2m])', 90_000)) == 1.25
    assert one(e.instant("sum(big)", 0)) == 1 and one(e.instant("sum(big)", 30_000)) == 5 and one(e.instant("sum(big)", 60_000)) == 1
    assert one(e.instant("sum(big)", 90_000)) == math.inf


def test_many_to_many_names_both_series(spark):
    source = load_script(spark, """load 30s
 many{k="x",s="1"} 1
 one{k="x",z="p"} 2
 one{k="x",z="b"} 3
""")
    e = MetricsEngine(spark, source)
    told = r'group \{k="x"\} on the %s hand-side of the operation: \[\{__name__="one", k="x", z="b"\}, \{__name__="one", k="x", z="p"\}\];many-to-many'
    with pytest.raises(ManyToMany, match=told % "right"):
        e.instant("many * on (k) one", 0).series()
    with pytest.raises(ManyToMany, match=told % "right"):
        e.instant("many * on (k) group_left (z) one", 0).series()
    with pytest.raises(ManyToMany, match=told % "left"):
        e.instant("one * on (k) group_right (z) many", 0).series()


def test_operators_are_named_by_what_they_compute(spark, mixed):
    e = MetricsEngine(spark, mixed[0])
    a, b, c = (e.range(q, 0, 60_000, 30_000).operators() for q in ("sum(gauge) / 2", "sum( gauge )/2", "sum(limits) / 2"))
    assert a == b and a[0]["id"] != c[0]["id"] and [x["depth"] for x in a][:2] == [0, 1] and len({x["id"] for x in a}) == len(a)


def test_named_queries_have_sql():
    from pulsegrid import queries

    missing = set(queries.queries()) - set(queries.oracle_sql())
    assert missing == {"limit_ratio"}


@pytest.mark.parametrize("query", ["gauge", "rate(requests_total[2m])", "irate(requests_total[2m])", "changes(gauge[5m])", "xrate(requests_total[2m])", "xincrease(limits[1m])", "last_over_time(gauge[1h])"])
def test_cut_series_equal_whole_ones(spark, mixed, query):
    whole = MetricsEngine(spark, mixed[0], Options(extended=True)).range(query, 0, 900_000, 45_000).series()
    cut = MetricsEngine(spark, mixed[0], Options(extended=True, series_chunk=100_000)).range(query, 0, 900_000, 45_000).series()
    same(cut, {frozenset(k): v for k, v in whole.items()})


def test_warnings_timeouts_and_analysis(spark, native, mixed):
    from pulsegrid.errors import QueryTimeout

    e = MetricsEngine(spark, native)
    assert e.instant("sum(m)", 150_000).data_warnings() and not e.instant('sum(m{pod="a"})', 150_000).data_warnings()
    assert e.instant("max(m)", 150_000).data_warnings()
    h = MetricsEngine(spark, load_script(spark, HIST))
    assert h.instant("histogram_quantile(0.5, h_bucket)", 60_000).data_warnings()
    assert not h.instant('histogram_quantile(0.5, h_bucket{pod="a"})', 60_000).data_warnings()
    seen = MetricsEngine(spark, mixed[0]).range("sum(gauge)", 0, 120_000, 30_000).analyze()
    assert seen["rows"] == 5 and "Aggregate" in seen["plan"] and "HashAggregate" in seen["spark"]
    assert any("Aggregate" in x["operator"] and any("rows" in m for m in x["metrics"]) for x in seen["operators"])
    slow = spark.range(0, 1 << 40).selectExpr("'m' l___name__", "id % 1000 t", "cast(hash(id) as double) v")
    from pulsegrid.sources.series import FrameSource

    with pytest.raises(QueryTimeout):
        MetricsEngine(spark, FrameSource(slow), Options(timeout=1)).instant("sum(m)", 1000).collect()
    assert MetricsEngine(spark, mixed[0], Options(timeout=60)).instant("sum(limits)", 60_000).collect()
