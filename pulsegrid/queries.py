"""Named queries over the driver's tables, each with the SQL that means the same.

A query returns its labels (strings), ``step`` (epoch ms) and ``v`` rounded to eight
significant digits (see NUDGE). A result of native histograms has a row for each part:
count, sum, zero and every bucket. The SQL joins samples to the grid by time, which is how the language defines
windows; the engine has no such join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import MetricsEngine
from .options import Options
from .sources.tables import table_catalog

HOUR, DAY = 3_600_000, 86_400_000
START, END, STEP = 1_704_153_600_000, 1_706_659_200_000, 21_600_000
#: The days of orders and lineitem, 1995-01-01 to 2001-11-04; their queries have this grid.
SPAN = (788_918_400_000, 1_004_832_000_000, DAY)


#: Values are scaled by this before rounding, so that one just between two roundings
#: isn't decided by the last bit of a sum; smaller ones than TINY are 0.
NUDGE, TINY = 1.0 + 3.14159e-11, 1e-11


def rounded(v: Column) -> Column:
    digits = F.format_string("%.7e", v * NUDGE).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).when(F.abs(v) < TINY, F.lit(0.0)).otherwise(digits)


def parts_of(df: DataFrame, labels: list[Column]) -> DataFrame:
    """Rows (labels, part, step, v) of a result with histograms."""
    h = F.col("h")
    part = lambda name, v: F.struct(name.alias("part"), v.alias("v"))
    cells = F.transform(F.filter(F.map_entries(h["pos"]), lambda e: e["value"] != 0), lambda e: part(F.concat(F.lit("p"), e["key"].cast("string")), e["value"]))
    fixed = F.array(*[part(F.lit(n), h[c]) for n, c in (("count", "count"), ("sum", "sum"), ("zero", "zero_count"))])
    return df.filter("h IS NOT NULL").select(*labels, "step", F.explode(F.concat(fixed, cells)).alias("__p")).select(*labels, "__p.part", "step", rounded(F.col("__p.v")).alias("v"))


@dataclass(frozen=True)
class Named:
    """A query text, its grid and the equivalent SQL (None: rows only)."""

    query: str
    sql: str | None
    options: Options = Options(lookback=DAY, sub_step=STEP)
    instant: int | None = None
    grid: tuple[int, int, int] = (START, END, STEP)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        engine = MetricsEngine(spark, table_catalog(spark, sf_dir), self.options)
        r = engine.range(self.query, *self.grid) if self.instant is None else engine.instant(self.query, self.instant)
        labels = [F.col(f"`{n}`") for n in r.labels]
        if "h" in r.df.columns:
            return parts_of(r.df, labels)
        return r.df.select(*labels, "step", rounded(F.col("v")).alias("v"))


# SQL parts. ``s`` are samples, ``g`` the grid.

_EV = "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts)//1000 AS t, value AS v FROM events"
_EVT = "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts)//1000 AS t, sum(value) OVER (PARTITION BY event_type, user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM events"
_ET = "SELECT event_type, epoch_us(ts)//1000 AS t, CAST(count(*) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS v FROM events"
_EVB = """SELECT event_type, le, epoch_us(ts)//1000 AS t,
 CAST(sum(CASE WHEN le = '+Inf' OR value <= TRY_CAST(le AS DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, le ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS v
 FROM events CROSS JOIN (SELECT unnest(['1','5','10','50','100','500','+Inf']) AS le)"""
_LQ = "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_us(l_shipdate)//1000 AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
_OP = "SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_us(o_orderdate)//1000 AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL"
_CI = "SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS segment, epoch_ms(h) AS t, 1.0::DOUBLE AS v FROM customer CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 6 HOUR)) AS h)"
_G = f"SELECT unnest(range({START}, {END} + 1, {STEP})) AS step"
_G_SPAN = f"SELECT unnest(range({SPAN[0]}, {SPAN[1]} + 1, {SPAN[2]})) AS step"
USER = "event_type, user_id"
TYPE = "event_type"


def _with(**parts: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in {"g": _G, **parts}.items()) + " "


def _newest(src: str = "s", labels: str = USER, width: int = DAY, off: int = 0, where: str = "TRUE") -> str:
    return f"SELECT {labels}, step, arg_max(v, t) AS v, max(t) AS t FROM {src} JOIN g ON t <= step - ({off}) AND t > step - ({off}) - {width} WHERE {where} GROUP BY {labels}, step"


def _final(labels: str, v: str, src: str, more: str = "") -> str:
    cols = f"{labels}, " if labels else ""
    value = f"CASE WHEN abs(__v) < {TINY} THEN 0.0 WHEN isfinite(__v) THEN CAST(printf('%.7e', __v * {NUDGE!r}::DOUBLE) AS DOUBLE) ELSE __v END"
    return f"SELECT * EXCLUDE (__v) REPLACE ({value} AS v) FROM (SELECT {cols}CAST(step AS BIGINT) AS step, CAST({v} AS DOUBLE) AS __v, CAST(0 AS DOUBLE) AS v FROM {src} {more})"


def _over_newest(v: str, labels: str = TYPE, more: str = "", group: bool = True) -> str:
    """An aggregate over the newest event_value of each series."""
    inner = f"SELECT {labels + ', ' if labels else ''}step, {v} AS v FROM i GROUP BY {labels + ', ' if labels else ''}step" if group else f"SELECT {labels}, step, {v} AS v FROM i {more}"
    return _with(s=_EV, i=_newest(), r=inner) + _final(labels, "v", "r")


def _over_window(v: str, src: str = _EV, labels: str = USER, width: int = DAY, having: str = "", off: int = 0) -> str:
    """An aggregate over each window of the raw samples."""
    inner = f"SELECT {labels}, step, {v} AS v FROM s JOIN g ON t <= step - ({off}) AND t > step - ({off}) - {width} GROUP BY {labels}, step {having}"
    return _with(s=src, r=inner) + _final(labels, "v", "r")


def _mapped(v: str, keep: str = "", labels: str = USER) -> str:
    """An expression of the newest event_value of each series."""
    return _with(s=_EV, i=_newest()) + _final(labels, v, "i", f"WHERE {keep}" if keep else "")


def _rate_parts(src: str, labels: str, width: int, fn: str) -> dict[str, str]:
    fall = "CASE WHEN v < lag(v) OVER p THEN lag(v) OVER p ELSE 0 END" if fn != "delta" else "0"
    w = f"""SELECT {labels}, step, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, t) AS v0,
 arg_max(v, t) - arg_min(v, t) + sum(r) - arg_min(r, t) AS raw
 FROM x JOIN g ON t <= step AND t > step - {width} GROUP BY {labels}, step HAVING count(*) >= 2"""
    a = f"SELECT *, (t1 - t0) / 1000.0 AS sampled, (t1 - t0) / 1000.0 / (n - 1) AS gap, (t0 - (step - {width})) / 1000.0 AS a, (step - t1) / 1000.0 AS b FROM w"
    b = "SELECT *, CASE WHEN a >= gap * 1.1 THEN gap / 2 ELSE a END AS a1, CASE WHEN b >= gap * 1.1 THEN gap / 2 ELSE b END AS b1 FROM e"
    zero = "CASE WHEN raw > 0 AND v0 >= 0 THEN least(a1, sampled * v0 / raw) ELSE a1 END" if fn != "delta" else "a1"
    per = f" / {width / 1000.0}" if fn == "rate" else ""
    c = f"SELECT {labels}, step, raw * ((sampled + {zero} + b1) / sampled{per}) AS v FROM f"
    return {"s": src, "x": f"SELECT *, {fall} AS r FROM s WINDOW p AS (PARTITION BY {labels} ORDER BY t)", "w": w, "e": a, "f": b, "c": c}


def _rate(fn: str, src: str, labels: str, width: int) -> str:
    return _with(**_rate_parts(src, labels, width, fn)) + _final(labels, "v", "c")


def _last_two(v: str) -> str:
    x = f"SELECT *, lag(v) OVER p AS pv, lag(t) OVER p AS pt FROM s WINDOW p AS (PARTITION BY {USER} ORDER BY t)"
    w = f"SELECT {USER}, step, arg_max(v, t) AS v, arg_max(pv, t) AS pv, max(t) AS t, arg_max(coalesce(pt, -1), t) AS pt FROM x JOIN g ON t <= step AND t > step - {DAY} GROUP BY {USER}, step"
    return _with(s=_EV, x=x, w=w, r=f"SELECT {USER}, step, {v} AS v FROM w WHERE pt > step - {DAY}") + _final(USER, "v", "r")


def _count_along(flag: str) -> str:
    x = f"SELECT *, CASE WHEN {flag} THEN 1 ELSE 0 END AS f FROM s WINDOW p AS (PARTITION BY {USER} ORDER BY t)"
    w = f"SELECT {USER}, step, sum(f) - arg_min(f, t) AS v FROM x JOIN g ON t <= step AND t > step - {DAY} GROUP BY {USER}, step"
    return _with(s=_EV, x=x, w=w) + _final(USER, "v", "w")


def _ranked(k: int, order: str) -> str:
    r = f"SELECT {USER}, step, v, row_number() OVER (PARTITION BY event_type, step ORDER BY {order}) AS n FROM i"
    return _with(s=_EV, i=_newest(), r=r) + _final(f"{USER}, 'event_value' AS __name__", "v", "r", f"WHERE n <= {k}")


_NAMED = f"'event_value' AS __name__, {USER}"
_E = "event_value"
#: Newest values of two series families that match on event_type.
_PAIR = {"s": _EV, "s2": _ET, "i": _newest(), "a": "SELECT event_type, step, sum(v) AS v FROM i GROUP BY ALL", "b": _newest("s2", TYPE)}


def _pair(v: str, keep: str = "TRUE") -> str:
    return _with(**_PAIR) + _final("a.event_type AS event_type", v, "(SELECT a.event_type, a.step, a.v AS x, b.v AS y FROM a JOIN b ON a.event_type = b.event_type AND a.step = b.step) a", f"WHERE {keep}")


_INFO = {"s": _EV, "s2": _CI, "i": _newest(), "n": _newest("s2", "user_id, segment")}
_HIST_RATE = {**_rate_parts(_EVB, "event_type, le", DAY, "rate")}
_BUCKETS = """SELECT event_type, step, TRY_CAST(CASE WHEN le = '+Inf' THEN 'Infinity' ELSE le END AS DOUBLE) AS ub, sum(v) AS v0 FROM c GROUP BY ALL"""
_MONO = "SELECT event_type, step, ub, max(v0) OVER (PARTITION BY event_type, step ORDER BY ub ROWS UNBOUNDED PRECEDING) AS v FROM q0"
_FLOW = "SELECT *, coalesce(lag(v) OVER p, 0) AS below, coalesce(lag(ub) OVER p, 0) AS low, max(v) OVER (PARTITION BY event_type, step) AS total, row_number() OVER p AS i, count(*) OVER (PARTITION BY event_type, step) AS k FROM q1 WINDOW p AS (PARTITION BY event_type, step ORDER BY ub)"


def _hist_quantile(q: float) -> str:
    pick = f"SELECT event_type, step, min(i) AS i FROM q2 WHERE total > 0 AND (v >= {q} * total OR i = k) GROUP BY ALL"
    r = f"SELECT x.event_type, x.step, CASE WHEN x.i = x.k THEN x.low ELSE x.low + (x.ub - x.low) * (({q} * x.total - x.below) / (x.v - x.below)) END AS v FROM q2 x JOIN q3 USING (event_type, step, i)"
    zero = "SELECT event_type, step, 'NaN'::DOUBLE AS v FROM q2 WHERE total = 0 GROUP BY ALL"
    return _with(**_HIST_RATE, q0=_BUCKETS, q1=_MONO, q2=_FLOW, q3=pick, r=f"{r} UNION ALL {zero}") + _final(TYPE, "v", "r")


def _hist_fraction(lo: float, hi: float) -> str:
    share = lambda x: f"sum(CASE WHEN ub <= {x} THEN v - below WHEN low >= {x} OR ub = 'Infinity'::DOUBLE THEN 0 ELSE (v - below) * ({x} - low) / (ub - low) END)"
    r = f"SELECT event_type, step, CASE WHEN max(total) = 0 THEN 'NaN'::DOUBLE ELSE ({share(hi)} - {share(lo)}) / max(total) END AS v FROM q2 GROUP BY ALL"
    return _with(**_HIST_RATE, q0=_BUCKETS, q1=_MONO, q2=_FLOW, r=r) + _final(TYPE, "v", "r")


def _sub(inner: dict[str, str], v: str, labels: str, width: int) -> str:
    """A range function over a subquery with the grid's own step: ``y`` on a grid that starts a width earlier."""
    wide = f"SELECT unnest(range({START - width} + {STEP}, {END} + 1, {STEP})) AS step"
    cte = ", ".join(f"{k} AS ({x})" for k, x in {"g": wide, **inner}.items())
    r = f"SELECT {labels}, h.step AS step, {v} AS v FROM y JOIN h ON y.step <= h.step AND y.step > h.step - {width} GROUP BY {labels}, h.step"
    return f"WITH {cte}, h AS ({_G}), r AS ({r}) " + _final(labels, "v", "r")


def _holt(sf: float, tf: float) -> str | None:
    """Recursion along each window: list folds in SQL."""
    w = f"SELECT {USER}, step, list(v ORDER BY t) AS w FROM s JOIN g ON t <= step AND t > step - {3 * DAY} GROUP BY {USER}, step HAVING count(*) >= 2"
    seed = f"SELECT {USER}, step, w, 2 AS i, {sf} * w[2] + (1 - {sf}) * (w[1] + (w[2] - w[1])) AS s1, w[1] AS s0, w[2] - w[1] AS b FROM w"
    nxt = f"SELECT {USER}, step, w, i + 1, {sf} * w[i + 1] + (1 - {sf}) * (s1 + ({tf} * (s1 - s0) + (1 - {tf}) * b)), s1, {tf} * (s1 - s0) + (1 - {tf}) * b FROM z WHERE i < len(w)"
    return f"WITH RECURSIVE g AS ({_G}), s AS ({_EV}), w AS ({w}), z AS ({seed} UNION ALL {nxt}) " + _final(USER, "s1", "z", "WHERE i = len(w)")


def _x(fn: str, width: int) -> str:
    """xrate, xincrease, xdelta of event_value_total, with the last sample before the window."""
    extra = HOUR
    fall = "CASE WHEN v < lag(v) OVER p THEN lag(v) OVER p ELSE 0 END" if fn != "xdelta" else "0"
    low = START - width - extra
    x = f"SELECT *, sum(r) OVER p AS c, min(t) OVER (PARTITION BY {USER}) AS born, sum(d) OVER p AS k FROM (SELECT *, {fall} AS r, CASE WHEN lag(v) OVER p IS NULL OR lag(v) OVER p = v THEN 0 ELSE 1 END AS d FROM s WHERE t > {low} AND t <= {END} WINDOW p AS (PARTITION BY {USER} ORDER BY t)) WINDOW p AS (PARTITION BY {USER} ORDER BY t ROWS UNBOUNDED PRECEDING)"
    e = f"step - {width}"
    w = f"""SELECT {USER}, step, max(t) FILTER (WHERE t <= {e}) AS tb, min(t) FILTER (WHERE t > {e}) AS tf, max(t) FILTER (WHERE t > {e}) AS tl, count(*) FILTER (WHERE t > {e}) AS m, min(born) AS born,
 arg_max(v, t) FILTER (WHERE t <= {e}) AS vb, arg_max(c, t) FILTER (WHERE t <= {e}) AS cb, arg_max(k, t) FILTER (WHERE t <= {e}) AS kb,
 arg_min(v, t) FILTER (WHERE t > {e}) AS vf, arg_min(c, t) FILTER (WHERE t > {e}) AS cf, arg_min(k, t) FILTER (WHERE t > {e}) AS kf,
 arg_max(v, t) FILTER (WHERE t > {e}) AS vl, arg_max(c, t) FILTER (WHERE t > {e}) AS cl, arg_max(k, t) FILTER (WHERE t > {e}) AS kl
 FROM x JOIN g ON t <= step AND t > step - {width + extra} GROUP BY {USER}, step"""
    h = f"""SELECT {USER}, step, born, m + (CASE WHEN tb IS NULL THEN 0 ELSE 1 END) AS n, coalesce(tb, tf) AS th, coalesce(vb, vf) AS vh, coalesce(cb, cf) AS ch, coalesce(kb, kf) AS kh,
 coalesce(tl, tb) AS tt, coalesce(vl, vb) AS vt, coalesce(cl, cb) AS ct, coalesce(kl, kb) AS kt, tf, vf, cf FROM w"""
    if fn == "xincrease":
        v = f"CASE WHEN kt = kh AND step <= {width} + born THEN vh ELSE vt - vh + ct - ch END"
        return _with(s=_EVT, x=x, w=w, h=h, r=f"SELECT {USER}, step, {v} AS v FROM h") + _final(USER, "v", "r")
    u = f"SELECT *, CASE WHEN n > 1 THEN (step - {width} - th) > (tt - th) / (n - 1.0) ELSE FALSE END AS far FROM h"
    q = "SELECT *, CASE WHEN far THEN tf ELSE th END AS tu, CASE WHEN far THEN vf ELSE vh END AS vu, CASE WHEN far THEN cf ELSE ch END AS cu FROM u"
    gap = "(tt - tu) / (n - CASE WHEN far THEN 2.0 ELSE 1.0 END)"
    counter = "ct - cu" if fn == "xrate" else "0"
    covers = f"tu <= step - {width} AND n - (CASE WHEN far THEN 1 ELSE 0 END) > 1 AND (step - tt) < {gap}"
    total = f"(vt - vu + {counter}) * CASE WHEN {covers} THEN {width // 1000}.0 / ((tt - tu) / 1000.0) ELSE 1.0 END"
    per = f" / {width // 1000}.0" if fn == "xrate" else ""
    v = f"CASE WHEN far AND n < 3 THEN 0.0 ELSE {total}{per} END"
    return _with(s=_EVT, x=x, w=w, h=h, u=u, q=q, r=f"SELECT {USER}, step, {v} AS v FROM q") + _final(USER, "v", "r")


_ZERO_CELL = "CASE WHEN value <= 0.001 THEN -1000 ELSE CAST(ceil(log2(value)) AS INT) END"
_CUSTOM_CELL = " + ".join(f"CAST(value > {b} AS INT)" for b in (1, 5, 10, 50, 100, 500))
_BY_STEP = "step, i"
_BY_TYPE = "event_type, step, i"


def _native(cell: str = _ZERO_CELL) -> dict[str, str]:
    """nb: running counts and sums of every bucket at each hour; sel: those of the newest hour at each step."""
    return {
        "cells": f"SELECT event_type, (epoch_ms(ts) // {HOUR} + 1) * {HOUR} AS t, {cell} AS i, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL",
        "nb": "SELECT event_type, t, i, CAST(sum(coalesce(n, 0)) OVER w AS DOUBLE) AS c, sum(coalesce(s, 0)) OVER w AS s FROM (SELECT DISTINCT event_type, t FROM cells) JOIN (SELECT DISTINCT event_type, i FROM cells) USING (event_type) LEFT JOIN cells USING (event_type, t, i) WINDOW w AS (PARTITION BY event_type, i ORDER BY t)",
        "nt": "SELECT event_type, t, sum(c) AS v FROM nb GROUP BY ALL",
        "sel": f"SELECT event_type, step, i, c, nb.s AS s FROM (SELECT event_type, step, max(t) AS t FROM nt JOIN g ON t <= step AND t > step - {DAY} GROUP BY ALL) JOIN nb USING (event_type, t)",
    }


def _native_rate(cell: str = _ZERO_CELL) -> dict[str, str]:
    """rt: the rate of every bucket over a day, extrapolated as the count's."""
    rate = {k: x for k, x in _rate_parts("SELECT * FROM nt", TYPE, DAY, "rate").items() if k != "c"}
    near = "CASE WHEN raw > 0 AND v0 >= 0 THEN least(a1, sampled * v0 / raw) ELSE a1 END"
    fx = f"SELECT event_type, step, t0, t1, (sampled + {near} + b1) / sampled / {DAY / 1000} AS k FROM f"
    rt = "SELECT l.event_type AS event_type, step, l.i AS i, (l.c - z.c) * k AS c, (l.s - z.s) * k AS s FROM fx JOIN nb l ON fx.event_type = l.event_type AND t1 = l.t JOIN nb z ON fx.event_type = z.event_type AND t0 = z.t AND l.i = z.i"
    return _native(cell) | rate | {"fx": fx, "rt": rt}


def _parts(parts: dict[str, str], src: str, labels: str = TYPE) -> str:
    """Histograms ``src`` as rows: count, sum, zero, and buckets that hold something."""
    own = f"{labels}, " if labels else ""
    total = lambda name, v: f"SELECT {own}step, '{name}' AS part, {v} AS v FROM {src} GROUP BY {own}step"
    rows = [total("count", "sum(c)"), total("sum", "sum(s)"), total("zero", "sum(CASE WHEN i = -1000 THEN c ELSE 0 END)"), f"SELECT {own}step, 'p' || i AS part, c AS v FROM {src} WHERE i <> -1000 AND c <> 0"]
    return _with(**parts, r=" UNION ALL ".join(rows)) + _final(f"{own}part", "v", "r")


def _of_native(parts: dict[str, str], src: str, v: str) -> str:
    """A value of each histogram ``src`` from its cells' bounds lo, hi, counts c, running counts up, total n and mean."""
    b = "SELECT *, CASE WHEN i = -1000 THEN 0 ELSE 2.0 ** (i - 1) END AS lo, CASE WHEN i = -1000 THEN 0.001 ELSE 2.0 ** i END AS hi FROM " + src
    return _with(**parts, b=b, q=_CELLS, r=f"SELECT event_type, step, {v} AS v FROM q GROUP BY event_type, step") + _final(TYPE, "v", "r")


def _of_custom(parts: dict[str, str], src: str, v: str) -> str:
    bounds = "[1.0, 5.0, 10.0, 50.0, 100.0, 500.0]"
    b = f"SELECT *, CASE WHEN i = 0 THEN '-inf'::DOUBLE ELSE {bounds}[i] END AS lo, CASE WHEN i = 6 THEN 'inf'::DOUBLE ELSE {bounds}[i + 1] END AS hi FROM " + src
    return _with(**parts, b=b, q=_CELLS, r=f"SELECT event_type, step, {v} AS v FROM q GROUP BY event_type, step") + _final(TYPE, "v", "r")


_CELLS = "SELECT *, sum(c) OVER (PARTITION BY event_type, step ORDER BY i) AS up, sum(c) OVER (PARTITION BY event_type, step) AS n, sum(s) OVER (PARTITION BY event_type, step) / sum(c) OVER (PARTITION BY event_type, step) AS mean, max(i) OVER (PARTITION BY event_type, step) AS top FROM b WHERE c <> 0"
_MIDDLE = "CASE WHEN i = -1000 THEN 0 ELSE sqrt(lo * hi) END"
_SPREAD = f"sum(c * ({_MIDDLE} - mean) ** 2) / max(n)"


def _native_quantile(q: float) -> str:
    f = f"least(1, greatest(0, ({q} * n - (up - c)) / c))"
    return f"arg_min(CASE WHEN i = -1000 THEN hi * {f} ELSE lo * 2 ** {f} END, i) FILTER (WHERE up >= {q} * n OR i = top)"


def _custom_quantile(q: float) -> str:
    low = "CASE WHEN i = 0 THEN 0 ELSE lo END"
    f = f"least(1, greatest(0, ({q} * n - (up - c)) / c))"
    return f"arg_min(CASE WHEN i = 6 THEN lo ELSE {low} + (hi - {low}) * {f} END, i) FILTER (WHERE up >= {q} * n OR i = top)"


def _native_fraction(lo: float, hi: float) -> str:
    share = lambda x: f"sum(CASE WHEN hi <= {x} THEN c WHEN lo >= {x} THEN 0 WHEN i = -1000 THEN c * {x} / hi ELSE c * (log2({x}) - log2(lo)) / (log2(hi) - log2(lo)) END)"
    return f"({share(hi)} - {share(lo)}) / max(n)"


_NH, _NC = "event_value_native", "event_value_custom"
_RATE_SUM = {**_native_rate(), "rs": "SELECT step, i, sum(c) AS c, sum(s) AS s FROM rt GROUP BY ALL"}
_SEL_SUM = {**_native(), "sm": "SELECT step, i, sum(c) AS c, sum(s) AS s FROM sel GROUP BY ALL"}
_MATH = "abs(-v) + ceil(v) + floor(v) + sqrt(v) + ln(v) + log2(v) + log10(v) + exp(v / 1000)"
_QUANT = "quantile_cont(v, 0.9)"
_X = Options(lookback=DAY, sub_step=STEP, extended=True)
AT = 1_705_000_000_000

QUERIES: dict[str, Named] = {
    # Selectors.
    "sel_lookback": Named(_E, _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i")),
    "sel_offset": Named(f"{_E} offset 1d", _with(s=_EV, i=_newest(off=DAY)) + _final(_NAMED, "v", "i")),
    "sel_negative_offset": Named(f"{_E} offset -6h", _with(s=_EV, i=_newest(off=-6 * HOUR)) + _final(_NAMED, "v", "i")),
    "sel_at": Named(f"{_E} @ 1705000000", _with(s=_EV, i=f"SELECT {USER}, arg_max(v, t) AS v FROM s WHERE t <= {AT} AND t > {AT} - {DAY} GROUP BY {USER}") + _final(_NAMED, "v", "i CROSS JOIN g")),
    "sel_at_end_offset": Named(f"{_E} @ end() offset 1d", _with(s=_EV, i=f"SELECT {USER}, arg_max(v, t) AS v FROM s WHERE t <= {END - DAY} AND t > {END - 2 * DAY} GROUP BY {USER}") + _final(_NAMED, "v", "i CROSS JOIN g")),
    "sel_matchers": Named(f'{_E}{{event_type=~"c.*|v.*",user_id!="1"}}', _with(s=_EV, i=_newest(where="(event_type LIKE 'c%' OR event_type LIKE 'v%') AND user_id <> '1'")) + _final(_NAMED, "v", "i")),
    "sel_not_regex": Named(f'{_E}{{event_type!~"c.*",user_id="3"}}', _with(s=_EV, i=_newest(where="event_type NOT LIKE 'c%' AND user_id = '3'")) + _final(_NAMED, "v", "i")),
    "sel_timestamp": Named(f"timestamp({_E})", _with(s=_EV, i=_newest()) + _final(USER, "t / 1000.0", "i")),
    "sel_orders": Named("order_price", _with(g=_G_SPAN, s=_OP, i=_newest(labels="status, priority")) + _final("'order_price' AS __name__, priority, status", "v", "i"), grid=SPAN),
    # Aggregations.
    "agg_sum_by": Named(f"sum by (event_type) ({_E})", _over_newest("sum(v)")),
    "agg_avg_by": Named(f"avg by (event_type) ({_E})", _over_newest("avg(v)")),
    "agg_min_by": Named(f"min by (event_type) ({_E})", _over_newest("min(v)")),
    "agg_max_by": Named(f"max by (event_type) ({_E})", _over_newest("max(v)")),
    "agg_count_by": Named(f"count by (event_type) ({_E})", _over_newest("count(*)")),
    "agg_group_by": Named(f"group by (event_type) ({_E})", _over_newest("1")),
    "agg_stddev_by": Named(f"stddev by (event_type) ({_E})", _over_newest("stddev_pop(v)")),
    "agg_stdvar_by": Named(f"stdvar by (event_type) ({_E})", _over_newest("var_pop(v)")),
    "agg_quantile_by": Named(f"quantile by (event_type) (0.9, {_E})", _over_newest(_QUANT)),
    "agg_quantile_varying": Named(f"quantile by (event_type) (scalar(count({_E})) % 2 / 2, {_E})", _with(s=_EV, i=_newest(), n="SELECT step, count(*) % 2 / 2.0 AS q FROM i GROUP BY step", r="SELECT event_type, i.step AS step, CASE WHEN max(q) = 0 THEN min(v) ELSE median(v) END AS v FROM i JOIN n USING (step) GROUP BY ALL") + _final(TYPE, "v", "r")),
    "agg_sum_without": Named(f"sum without (user_id) ({_E})", _over_newest("sum(v)")),
    "agg_sum_all": Named(f"sum({_E})", _over_newest("sum(v)", "")),
    "agg_count_values": Named(f'count_values by (event_type) ("value", round({_E}))', _with(s=_EV, i=_newest(), r="SELECT event_type, CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) AS value, step, count(*) AS v FROM i GROUP BY ALL") + _final("event_type, value", "v", "r")),
    "agg_sum_lineitem": Named("sum by (returnflag) (line_quantity)", _with(g=_G_SPAN, s=_LQ, i=_newest(labels="returnflag, linestatus"), r="SELECT returnflag, step, sum(v) AS v FROM i GROUP BY ALL") + _final("returnflag", "v", "r"), grid=SPAN),
    "topk_by": Named(f"topk by (event_type) (3, {_E})", _ranked(3, f"v DESC, {USER}")),
    "bottomk_by": Named(f"bottomk by (event_type) (2, {_E})", _ranked(2, f"v, {USER}")),
    "limitk_by": Named(f"limitk by (event_type) (2, {_E})", _ranked(2, USER)),
    "limit_ratio": Named(f"limit_ratio(0.5, {_E})", None),
    "limit_ratio_rest": Named(f"count(limit_ratio(0.3, {_E}) or limit_ratio(-0.7, {_E}))", _over_newest("count(*)", "")),
    # Range functions.
    "sum_rate": Named("sum by (event_type) (rate(event_value_total[6h]))", _with(**_rate_parts(_EVT, USER, 6 * HOUR, "rate"), r="SELECT event_type, step, sum(v) AS v FROM c GROUP BY ALL") + _final(TYPE, "v", "r")),
    "rate": Named("rate(event_value_total[1d])", _rate("rate", _EVT, USER, DAY)),
    "rate_events": Named("rate(events_total[6h])", _rate("rate", _ET, TYPE, 6 * HOUR)),
    "rate_resets": Named("rate(event_value[1d])", _rate("rate", _EV, USER, DAY)),
    "increase": Named("increase(event_value_total[1d])", _rate("increase", _EVT, USER, DAY)),
    "delta": Named("delta(event_value[1d])", _rate("delta", _EV, USER, DAY)),
    "irate": Named("irate(event_value[1d])", _last_two("(CASE WHEN v < pv THEN v ELSE v - pv END) / ((t - pt) / 1000.0)")),
    "idelta": Named("idelta(event_value[1d])", _last_two("v - pv")),
    "resets": Named("resets(event_value[1d])", _count_along("v < lag(v) OVER p")),
    "changes": Named("changes(event_value[1d])", _count_along("v <> lag(v) OVER p")),
    "deriv": Named("deriv(event_value[3d])", _over_window("CASE WHEN min(v) = max(v) THEN 0 ELSE regr_slope(v, (t - step) / 1000.0) END", width=3 * DAY, having="HAVING count(*) >= 2")),
    "predict_linear": Named("predict_linear(event_value[3d], 3600)", _over_window("CASE WHEN min(v) = max(v) THEN min(v) ELSE regr_slope(v, (t - step) / 1000.0) * 3600 + regr_intercept(v, (t - step) / 1000.0) END", width=3 * DAY, having="HAVING count(*) >= 2")),
    "holt": Named("double_exponential_smoothing(event_value[3d], 0.5, 0.3)", _holt(0.5, 0.3)),
    "sum_over_time": Named("sum_over_time(event_value[1d])", _over_window("sum(v)")),
    "avg_over_time": Named("avg_over_time(event_value[1d])", _over_window("avg(v)")),
    "min_over_time": Named("min_over_time(event_value[1d])", _over_window("min(v)")),
    "max_over_time": Named("max_over_time(event_value[1d])", _over_window("max(v)")),
    "count_over_time": Named("count_over_time(event_value[1d])", _over_window("count(*)")),
    "count_long_window": Named("count_over_time(event_value[10d])", _over_window("count(*)", width=10 * DAY)),
    "stddev_over_time": Named("stddev_over_time(event_value[1d])", _over_window("stddev_pop(v)")),
    "stdvar_over_time": Named("stdvar_over_time(event_value[1d])", _over_window("var_pop(v)")),
    "last_over_time": Named("last_over_time(event_value[1d])", _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i")),
    "first_over_time": Named("first_over_time(event_value[1d])", _over_window("arg_min(v, t)").replace(f"SELECT {USER}, CAST(step", f"SELECT {_NAMED}, CAST(step")),
    "present_over_time": Named("present_over_time(event_value[1d])", _over_window("1")),
    "quantile_over_time": Named("quantile_over_time(0.9, event_value[1d])", _over_window(_QUANT)),
    "quantile_over_time_varying": Named(f"quantile_over_time(scalar(count({_E})) % 2 / 2, event_value[1d])", _with(s=_EV, i=_newest(), n="SELECT step, count(*) % 2 / 2.0 AS q FROM i GROUP BY step", w=f"SELECT {USER}, step, min(v) AS lo, median(v) AS mid FROM s JOIN g ON t <= step AND t > step - {DAY} GROUP BY {USER}, step", r=f"SELECT {USER}, step, CASE WHEN q = 0 THEN lo ELSE mid END AS v FROM w JOIN n USING (step)") + _final(USER, "v", "r")),
    "mad_over_time": Named("mad_over_time(event_value[3d])", _over_window("mad(v)", width=3 * DAY)),
    "ts_of_max_over_time": Named("ts_of_max_over_time(event_value[1d])", _over_window("arg_max(t, v) / 1000.0")),
    "ts_of_min_over_time": Named("ts_of_min_over_time(event_value[1d])", _over_window("arg_min(t, v) / 1000.0")),
    "ts_of_first_over_time": Named("ts_of_first_over_time(event_value[1d])", _over_window("min(t) / 1000.0")),
    "ts_of_last_over_time": Named("ts_of_last_over_time(event_value[1d])", _over_window("max(t) / 1000.0")),
    "absent_over_time": Named('absent_over_time(event_value{user_id="3",event_type="error"}[12h])', _with(s=_EV, r=f"SELECT step, 1 AS v FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE user_id = '3' AND event_type = 'error' AND t <= step AND t > step - {12 * HOUR})") + _final("'error' AS event_type, '3' AS user_id", "v", "r")),
    "xrate": Named("xrate(event_value_total[1d])", _x("xrate", DAY), _X),
    "xincrease": Named("xincrease(event_value_total[1d])", _x("xincrease", DAY), _X),
    "xdelta": Named("xdelta(event_value_total[1d])", _x("xdelta", DAY), _X),
    "rate_offset": Named("rate(events_total[6h] offset 6h)", _with(**{k: x.replace("t <= step AND t > step - ", f"t <= step - {6 * HOUR} AND t > step - {6 * HOUR} - ").replace("(step - t1)", f"(step - {6 * HOUR} - t1)").replace("(t0 - (step - ", f"(t0 - (step - {6 * HOUR} - ") for k, x in _rate_parts(_ET, TYPE, 6 * HOUR, "rate").items()}) + _final(TYPE, "v", "c")),
    # Instant functions.
    "fn_math": Named(f"abs(-{_E}) + ceil({_E}) + floor({_E}) + sqrt({_E}) + ln({_E}) + log2({_E}) + log10({_E}) + exp({_E} / 1000)", _mapped(_MATH)),
    "fn_trig": Named(f"sin({_E}) + cos({_E}) + atan({_E}) + tan({_E} / 1000) + asin({_E} / 1000) + acos({_E} / 1000)", _mapped("sin(v) + cos(v) + atan(v) + tan(v / 1000) + asin(v / 1000) + acos(v / 1000)")),
    "fn_hyperbolic": Named(f"sinh({_E} / 100) + cosh({_E} / 100) + tanh({_E}) + asinh({_E}) + acosh({_E} + 1) + atanh({_E} / 1000)", _mapped("sinh(v / 100) + cosh(v / 100) + tanh(v) + asinh(v) + acosh(v + 1) + atanh(v / 1000)")),
    "fn_angle": Named(f"rad({_E}) + deg({_E}) * pi()", _mapped("radians(v) + degrees(v) * pi()")),
    "fn_round": Named(f"round({_E}, 5)", _mapped("floor(v * (1 / 5.0::DOUBLE) + 0.5) / (1 / 5.0::DOUBLE)")),
    "fn_clamp": Named(f"clamp({_E}, 50, 200) + clamp_min({_E}, 100) + clamp_max({_E}, 10)", _mapped("greatest(50, least(200, v)) + greatest(v, 100) + least(v, 10)")),
    "fn_clamp_varying": Named(f"clamp_max({_E}, scalar(avg({_E})))", _with(s=_EV, i=_newest(), m="SELECT step, avg(v) AS m FROM i GROUP BY step", r=f"SELECT {USER}, step, least(v, m) AS v FROM i JOIN m USING (step)") + _final(USER, "v", "r")),
    "fn_sgn": Named(f"sgn({_E} - 100)", _mapped("sign(v - 100)")),
    "fn_dates": Named(f"year(timestamp({_E})) * 1 + month(timestamp({_E})) * 2 + day_of_month(timestamp({_E})) * 3 + day_of_week(timestamp({_E})) * 5 + day_of_year(timestamp({_E})) * 7 + hour(timestamp({_E})) * 11 + minute(timestamp({_E})) * 13 + days_in_month(timestamp({_E})) * 17", _with(s=_EV, i=_newest(), d=f"SELECT {USER}, step, make_timestamp((t // 1000) * 1000000) AS x FROM i") + _final(USER, "year(x) + month(x) * 2 + day(x) * 3 + dayofweek(x) * 5 + dayofyear(x) * 7 + hour(x) * 11 + minute(x) * 13 + day(last_day(x)) * 17", "d")),
    "fn_dates_now": Named("hour() + day_of_week() * 100", _with(d="SELECT step, make_timestamp(step * 1000) AS x FROM g") + _final("", "hour(x) + dayofweek(x) * 100", "d")),
    "fn_time": Named("time()", _with() + _final("", "step / 1000.0", "g")),
    "fn_scalar": Named(f"scalar(sum({_E})) * 2", _with(s=_EV, i=_newest(), a="SELECT step, sum(v) * 2 AS v FROM i GROUP BY step") + _final("", "coalesce(a.v, 'NaN'::DOUBLE)", "g LEFT JOIN a USING (step)")),
    "fn_vector": Named("vector(time() / 2)", _with() + _final("", "step / 2000.0", "g")),
    "fn_absent": Named('absent(event_value{user_id="3",event_type="error"})', _with(s=_EV, r=f"SELECT step, 1 AS v FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE user_id = '3' AND event_type = 'error' AND t <= step AND t > step - {DAY})") + _final("'error' AS event_type, '3' AS user_id", "v", "r")),
    "fn_label_replace": Named(f'label_replace({_E}, "kind", "k-$1", "event_type", "(.).*")', _with(s=_EV, i=_newest()) + _final(f"{_NAMED}, 'k-' || event_type[1] AS kind", "v", "i")),
    "fn_label_join": Named(f'label_join({_E}, "both", "/", "event_type", "user_id", "nothing")', _with(s=_EV, i=_newest()) + _final(f"{_NAMED}, event_type || '/' || user_id || '/' AS both", "v", "i")),
    "fn_sort": Named(f"sort_desc({_E})", _with(s=_EV, i=f"SELECT {USER}, {AT} AS step, arg_max(v, t) AS v FROM s WHERE t <= {AT} AND t > {AT} - {DAY} GROUP BY {USER}") + _final(_NAMED, "v", "i"), instant=AT),
    "fn_sort_by_label": Named(f'sort_by_label({_E}, "user_id")', _with(s=_EV, i=f"SELECT {USER}, {AT} AS step, arg_max(v, t) AS v FROM s WHERE t <= {AT} AND t > {AT} - {DAY} GROUP BY {USER}") + _final(_NAMED, "v", "i"), instant=AT),
    "fn_timestamp_of_expression": Named(f"timestamp(sum by (event_type) ({_E}))", _over_newest("step / 1000.0")),
    # Binary operations.
    "bin_scalar_arith": Named(f"({_E} * 2 - 1) / 3 % 7 + 2 ^ ({_E} / 500)", _mapped("((v * 2 - 1) / 3) % 7 + 2 ^ (v / 500)")),
    "bin_scalar_left": Named(f"1000 - {_E}", _mapped("1000 - v")),
    "bin_atan2": Named(f"{_E} atan2 100", _mapped("atan2(v, 100)")),
    "bin_cmp_filter": Named(f"{_E} > 250", _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i", "WHERE v > 250")),
    "bin_cmp_scalar_left": Named(f"250 <= {_E}", _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i", "WHERE v >= 250")),
    "bin_cmp_bool": Named(f"{_E} >= bool 250", _mapped("CASE WHEN v >= 250 THEN 1 ELSE 0 END")),
    "bin_scalars": Named("time() % 86400 > bool 3600", _with() + _final("", "CASE WHEN (step / 1000.0) % 86400 > 3600 THEN 1 ELSE 0 END", "g")),
    "bin_one_to_one": Named(f"sum by (event_type) ({_E}) / on (event_type) events_total", _pair("x / y")),
    "bin_ignoring": Named(f"{_E} - ignoring (user_id) group_left () sum by (event_type) ({_E})", _with(s=_EV, i=_newest(), a="SELECT event_type, step, sum(v) AS m FROM i GROUP BY ALL", r=f"SELECT i.event_type, user_id, i.step AS step, v - m AS v FROM i JOIN a ON i.event_type = a.event_type AND i.step = a.step") + _final(USER, "v", "r")),
    "bin_group_left": Named(f"{_E} * on (user_id) group_left (segment) customer_info", _with(**_INFO, r="SELECT i.event_type, i.user_id, segment, i.step AS step, i.v * n.v AS v FROM i JOIN n ON i.user_id = n.user_id AND i.step = n.step") + _final(f"{USER}, segment", "v", "r")),
    "bin_group_right": Named(f"customer_info * on (user_id) group_right (segment) {_E}", _with(**_INFO, r="SELECT i.event_type, i.user_id, segment, i.step AS step, i.v * n.v AS v FROM i JOIN n ON i.user_id = n.user_id AND i.step = n.step") + _final(f"{USER}, segment", "v", "r")),
    "bin_vector_cmp": Named(f"sum by (event_type) ({_E}) > on (event_type) events_total", _pair("x", "x > y")),
    "bin_vector_cmp_bool": Named(f"sum by (event_type) ({_E}) < bool on (event_type) events_total", _pair("CASE WHEN x < y THEN 1 ELSE 0 END")),
    "set_and": Named(f"{_E} and on (user_id, event_type) ({_E} > 250)", _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i", "WHERE v > 250")),
    "set_and_labels": Named(f'{_E} and on (user_id) {_E}{{event_type="error"}}', _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i", "WHERE EXISTS (SELECT 1 FROM i e WHERE e.event_type = 'error' AND e.user_id = i.user_id AND e.step = i.step)")),
    "set_or": Named(f'{_E}{{event_type="error"}} or on (user_id) {_E}{{event_type="click"}}', _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i", "WHERE event_type = 'error' OR event_type = 'click' AND NOT EXISTS (SELECT 1 FROM i e WHERE e.event_type = 'error' AND e.user_id = i.user_id AND e.step = i.step)")),
    "set_unless": Named(f'{_E} unless on (user_id) {_E}{{event_type="error"}}', _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i", "WHERE NOT EXISTS (SELECT 1 FROM i e WHERE e.event_type = 'error' AND e.user_id = i.user_id AND e.step = i.step)")),
    "unary_minus": Named(f"-{_E}", _mapped("-v")),
    "unary_plus": Named(f"+{_E}", _with(s=_EV, i=_newest()) + _final(_NAMED, "v", "i")),
    # Classic histograms.
    "hist_quantile": Named("histogram_quantile(0.9, sum by (event_type, le) (rate(event_value_bucket[1d])))", _hist_quantile(0.9)),
    "hist_quantile_low": Named("histogram_quantile(0.1, sum by (event_type, le) (rate(event_value_bucket[1d])))", _hist_quantile(0.1)),
    "hist_fraction": Named("histogram_fraction(20, 200, sum by (event_type, le) (rate(event_value_bucket[1d])))", _hist_fraction(20, 200)),
    # Native histograms.
    "native_select": Named(_NH, _parts(_native(), "sel", TYPE).replace("SELECT event_type, part, CAST", "SELECT event_type, 'event_value_native' AS __name__, part, CAST")),
    "native_sum": Named(f"sum({_NH})", _parts(_SEL_SUM, "sm", "")),
    "native_avg": Named(f"avg({_NH})", _parts({**_native(), "sm": "SELECT step, i, sum(c) / max(k) AS c, sum(s) / max(k) AS s FROM sel JOIN (SELECT step, count(DISTINCT event_type) AS k FROM sel GROUP BY step) USING (step) GROUP BY step, i"}, "sm", "")),
    "native_rate": Named(f"rate({_NH}[1d])", _parts(_native_rate(), "rt")),
    "native_sum_rate": Named(f"sum(rate({_NH}[1d]))", _parts(_RATE_SUM, "rs", "")),
    "native_scaled": Named(f"{_NH} * 3 / 2", _parts({**_native(), "x": "SELECT event_type, step, i, c * 1.5 AS c, s * 1.5 AS s FROM sel"}, "x")),
    "native_count": Named(f"histogram_count(rate({_NH}[1d]))", _of_native(_native_rate(), "rt", "max(n)")),
    "native_sum_of_values": Named(f"histogram_sum(rate({_NH}[1d]))", _of_native(_native_rate(), "rt", "max(n) * max(mean)")),
    "native_mean": Named(f"histogram_avg({_NH})", _of_native(_native(), "sel", "max(mean)")),
    "native_quantile": Named(f"histogram_quantile(0.9, rate({_NH}[1d]))", _of_native(_native_rate(), "rt", _native_quantile(0.9))),
    "native_quantile_low": Named(f"histogram_quantile(0.1, {_NH})", _of_native(_native(), "sel", _native_quantile(0.1))),
    "native_fraction": Named(f"histogram_fraction(20, 200, rate({_NH}[1d]))", _of_native(_native_rate(), "rt", _native_fraction(20, 200))),
    "native_stddev": Named(f"histogram_stddev({_NH})", _of_native(_native(), "sel", f"sqrt({_SPREAD})")),
    "native_stdvar": Named(f"histogram_stdvar(rate({_NH}[1d]))", _of_native(_native_rate(), "rt", _SPREAD)),
    "native_count_values": Named(f"count({_NH}) + group({_NH})", _with(**_native(), r="SELECT step, count(DISTINCT event_type) + 1 AS v FROM sel GROUP BY step") + _final("", "v", "r")),
    "native_custom_quantile": Named(f"histogram_quantile(0.6, rate({_NC}[1d]))", _of_custom(_native_rate(_CUSTOM_CELL), "rt", _custom_quantile(0.6))),
    "native_custom_sum": Named(f"sum({_NC})", _parts({**_native(_CUSTOM_CELL), "sm": "SELECT step, i, sum(c) AS c, sum(s) AS s FROM sel GROUP BY ALL"}, "sm", "")),
    # Subqueries.
    "sub_max_rate": Named("max_over_time(rate(events_total[6h])[1d:6h])", _sub({**_rate_parts(_ET, TYPE, 6 * HOUR, "rate"), "y": "SELECT * FROM c"}, "max(y.v)", TYPE, DAY)),
    "sub_avg_sum": Named(f"avg_over_time(sum by (event_type) ({_E})[2d:6h])", _sub({"s": _EV, "i": _newest(), "y": "SELECT event_type, step, sum(v) AS v FROM i GROUP BY ALL"}, "avg(y.v)", TYPE, 2 * DAY)),
    "sub_default_step": Named(f"count_over_time((sum by (event_type) ({_E}) > 1000)[2d:])", _sub({"s": _EV, "i": _newest(), "y": "SELECT event_type, step, sum(v) AS v FROM i GROUP BY ALL HAVING sum(v) > 1000"}, "count(*)", TYPE, 2 * DAY)),
    # Plans.
    "opt_merge_selects": Named(f'sum({_E}{{event_type="error"}}) / sum({_E})', _with(s=_EV, i=_newest(), a="SELECT step, sum(v) AS v FROM i GROUP BY step", b="SELECT step, sum(v) AS v FROM i WHERE event_type = 'error' GROUP BY step", r="SELECT a.step AS step, b.v / a.v AS v FROM a JOIN b USING (step)") + _final("", "v", "r")),
    "opt_step_invariant": Named(f"{_E} - on () group_left () sum({_E} @ 1705000000)", _with(s=_EV, i=_newest(), o=f"SELECT sum(v) AS m FROM (SELECT {USER}, arg_max(v, t) AS v FROM s WHERE t <= {AT} AND t > {AT} - {DAY} GROUP BY {USER})") + _final(USER, "v - m", "i CROSS JOIN o")),
    "opt_propagate": Named(f'{_E}{{event_type="click"}} / on (event_type, user_id) event_value_total', _with(s=_EV, s2=_EVT, i=_newest(where="event_type = 'click'"), j=_newest("s2", where="event_type = 'click'"), r=f"SELECT {USER}, step, i.v / j.v AS v FROM i JOIN j USING (event_type, user_id, step)") + _final(USER, "v", "r")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .federated import overlapping_sources, two_sources

    return {name: q.run for name, q in QUERIES.items()} | {"fed_two_sources": two_sources, "fed_overlapping": overlapping_sources}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql} | {"fed_two_sources": QUERIES["agg_avg_by"].sql, "fed_overlapping": QUERIES["agg_sum_by"].sql}
