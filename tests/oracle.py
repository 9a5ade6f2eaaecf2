"""A row-at-a-time evaluator of metric queries, for tests only.

Written from the language's rules, without Spark and without the engine's evaluation
code; only the parser is shared. Series are {labels: [(t, v or 'stale')]}.
"""

from __future__ import annotations

import math
import re

from pulsegrid.lang.nodes import NAME, RESERVED, SORTS, Aggregate, Binary, Call, Number, Paren, Select, Subquery, Text, Unary, Window, kind

Labels = frozenset


def labels(**kw) -> Labels:
    return frozenset((k, v) for k, v in kw.items() if v)


def get(ls, n):
    return dict(ls).get(n, "")


def without(ls, names):
    return frozenset(x for x in ls if x[0] not in names)


class Failure(Exception):
    pass


def _passes(m, value):
    if m.op in ("=", "!="):
        return (value == m.value) == (m.op == "=")
    return bool(re.fullmatch(m.value, value, re.S)) == (m.op == "=~")


def _quantile(q, vs):
    if math.isnan(q) or not vs:
        return math.nan
    if q < 0:
        return -math.inf
    if q > 1:
        return math.inf
    vs = sorted(vs, key=lambda v: (0, 0) if math.isnan(v) else (1, v))
    r = q * (len(vs) - 1)
    lo = max(0, math.floor(r))
    return vs[lo] * (1 - (r - math.floor(r))) + vs[min(lo + 1, len(vs) - 1)] * (r - math.floor(r))


def _div(a, b):
    if b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(1, a) * math.copysign(1, b) * math.inf
    return a / b


def _arith(op, a, b):
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return _div(a, b)
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) or math.isnan(a) or math.isnan(b) else math.fmod(a, b)
    if op == "^":
        try:
            r = math.pow(a, b)
        except OverflowError:
            return math.inf
        except ValueError:
            return math.inf if a == 0 else math.nan
        return r
    return math.atan2(a, b)


def _cmp(op, a, b):
    return {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


class Oracle:
    def __init__(self, series, lookback=300_000, sub_step=60_000, ext=3_600_000):
        self.series, self.lookback, self.sub_step, self.ext = series, lookback, sub_step, ext

    def run(self, node, start, end, step):
        self.start, self.end = start, end
        out = {}
        for t in range(start, end + 1, step):
            v = self.eval(node, t)
            if isinstance(v, float):
                v = {Labels(): v}
            for ls, x in v.items():
                out.setdefault(ls, []).append((t, x))
        return out

    def at(self, n, t):
        return t if n.at is None else self.start if n.at == "start" else self.end if n.at == "end" else n.at

    def matching(self, s):
        return [(ls, pts) for ls, pts in self.series.items() if all(_passes(m, get(ls, m.label)) for m in s.matchers)]

    def eval(self, n, t):
        if isinstance(n, Number):
            return n.value
        if isinstance(n, Paren):
            return self.eval(n.expr, t)
        if isinstance(n, Unary):
            v = self.eval(n.expr, t)
            if n.op == "+":
                return v
            return -v if isinstance(v, float) else self.renamed({ls: -x for ls, x in v.items()})
        if isinstance(n, Select):
            return {ls: v for ls, (_, v) in self.newest(n, t).items()}
        if isinstance(n, Binary):
            return self.binary(n, t)
        if isinstance(n, Aggregate):
            return self.aggregate(n, t)
        return self.call(n, t)

    def newest(self, n, t):
        at = self.at(n, t) - n.offset
        out = {}
        for ls, pts in self.matching(n):
            own = [p for p in pts if at - self.lookback < p[0] <= at]
            if own and own[-1][1] != "stale":
                out[ls] = own[-1]
        return out

    @staticmethod
    def renamed(v):
        out = {}
        for ls, x in v.items():
            k = without(ls, RESERVED)
            if k in out:
                raise Failure("duplicate")
            out[k] = x
        return out

    def window(self, n, t):
        """{labels: points}, window end."""
        if isinstance(n, Window):
            s = n.select
            end = self.at(s, t) - s.offset
            pts = {ls: [p for p in own if end - n.width < p[0] <= end and p[1] != "stale"] for ls, own in self.matching(s)}
            return {k: v for k, v in pts.items() if v}, end
        end = self.at(n, t) - n.offset
        step = n.step or self.sub_step
        out = {}
        k = math.floor((end - n.width) / step) + 1
        while k * step <= end:
            v = self.eval(n.expr, k * step)
            for ls, x in ({Labels(): v} if isinstance(v, float) else v).items():
                out.setdefault(ls, []).append((k * step, x))
            k += 1
        return out, end

    def call(self, n, t):
        fn, args = n.fn, n.args
        if fn == "time":
            return t / 1000
        if fn == "pi":
            return math.pi
        if fn == "scalar":
            v = self.eval(args[0], t)
            return next(iter(v.values())) if len(v) == 1 else math.nan
        if fn == "vector":
            return {Labels(): self.eval(args[0], t)}
        if fn in SORTS:
            return self.eval(args[0], t)
        if any(kind(a) == "m" for a in args):
            return self.range_fn(n, t)
        if fn == "absent":
            a = args[0]
            return {} if self.eval(a, t) else {self.absent_labels(a): 1.0}
        if fn == "timestamp":
            a = args[0]
            while isinstance(a, Paren):
                a = a.expr
            if isinstance(a, Select):
                return self.renamed({ls: p[0] / 1000 for ls, p in self.newest(a, t).items()})
            return self.renamed({ls: t / 1000 for ls in self.eval(a, t)})
        v = self.eval(args[0], t)
        if fn == "label_replace":
            dst, rep, src, pat = (a.value for a in args[1:])
            out = {}
            for ls, x in v.items():
                m = re.fullmatch(pat, get(ls, src), re.S)
                if m:
                    new = re.sub(r"\$(\d+)|\$\{(\d+)\}", lambda g, m=m: m[int(g[1] or g[2])] or "", rep)
                    ls = without(ls, (dst,)) | (frozenset([(dst, new)]) if new else frozenset())
                if ls in out:
                    raise Failure("duplicate")
                out[ls] = x
            return out
        if fn == "label_join":
            dst, sep, *srcs = (a.value for a in args[1:])
            return {without(ls, (dst,)) | (frozenset([(dst, sep.join(get(ls, s) for s in srcs))])): x for ls, x in v.items()}
        extra = [self.eval(a, t) for a in args[1:]]
        return self.renamed({ls: y for ls, x in v.items() if (y := self.number_fn(fn, x, extra)) is not None})

    @staticmethod
    def number_fn(fn, x, extra):
        big = math.isnan(x) or math.isinf(x)
        if fn in ("floor", "ceil"):
            return x if big else float(getattr(math, fn)(x))
        if fn == "abs":
            return abs(x)
        if fn == "sgn":
            return x if x == 0 or math.isnan(x) else math.copysign(1, x)
        if fn == "sqrt":
            return math.nan if x < 0 or math.isnan(x) else math.sqrt(x)
        if fn in ("ln", "log2", "log10"):
            if x == 0:
                return -math.inf
            if x < 0 or math.isnan(x):
                return math.nan
            return {"ln": math.log, "log2": math.log2, "log10": math.log10}[fn](x)
        if fn == "exp":
            try:
                return math.exp(x)
            except OverflowError:
                return math.inf
        if fn == "round":
            to = extra[0] if extra else 1.0
            inv = _div(1.0, to)
            y = x * inv + 0.5
            return _div(y if math.isnan(y) or math.isinf(y) else float(math.floor(y)), inv)
        nan = math.isnan(x) or any(map(math.isnan, extra))
        if fn == "clamp":
            if extra[1] < extra[0]:
                return None
            return math.nan if nan else max(extra[0], min(extra[1], x))
        if fn == "clamp_min":
            return math.nan if nan else max(x, extra[0])
        if fn == "clamp_max":
            return math.nan if nan else min(x, extra[0])
        raise NotImplementedError(fn)

    def absent_labels(self, a):
        while isinstance(a, Paren):
            a = a.expr
        ms = a.matchers if isinstance(a, Select) else a.select.matchers if isinstance(a, Window) else ()
        seen, bad = {}, set()
        for m in ms:
            if m.label == NAME:
                continue
            if m.op == "=" and m.label not in seen:
                seen[m.label] = m.value
            else:
                bad.add(m.label)
        return labels(**{k: v for k, v in seen.items() if k not in bad})

    def range_fn(self, n, t):
        fn = n.fn
        m = next(a for a in n.args if kind(a) == "m")
        extra = [self.eval(a, t) for a in n.args if kind(a) == "s"]
        wins, end = self.window(m, t)
        if fn == "absent_over_time":
            return {} if wins else {self.absent_labels(m) if isinstance(m, Window) else Labels(): 1.0}
        out = {ls: y for ls, w in wins.items() if (y := self.over(fn, w, end, m.width, extra, t)) is not None}
        keep = fn == "last_over_time" or fn == "first_over_time" and isinstance(m, Window)
        return out if keep else self.renamed(out)

    def over(self, fn, w, end, width, extra, t):
        ts, vs = [p[0] for p in w], [p[1] for p in w]
        real = [v for v in vs if not math.isnan(v)]
        if fn == "sum_over_time":
            return float(sum(vs))
        if fn == "avg_over_time":
            return sum(vs) / len(vs)
        if fn == "count_over_time":
            return float(len(vs))
        if fn == "min_over_time":
            return min(real) if real else math.nan
        if fn == "max_over_time":
            return max(real) if real else math.nan
        if fn == "last_over_time":
            return vs[-1]
        if fn == "first_over_time":
            return vs[0]
        if fn == "present_over_time":
            return 1.0
        if fn in ("stddev_over_time", "stdvar_over_time"):
            if any(not math.isfinite(v) for v in vs):
                return math.nan
            mu = sum(vs) / len(vs)
            var = sum((v - mu) ** 2 for v in vs) / len(vs)
            return math.sqrt(var) if fn == "stddev_over_time" else var
        if fn == "quantile_over_time":
            return _quantile(extra[0], vs)
        if fn == "mad_over_time":
            mid = _quantile(0.5, vs)
            return _quantile(0.5, [abs(v - mid) for v in vs])
        if fn == "changes":
            return float(sum(1 for a, b in zip(vs, vs[1:]) if a != b and not (math.isnan(a) and math.isnan(b))))
        if fn == "resets":
            return float(sum(1 for a, b in zip(vs, vs[1:]) if b < a))
        if len(w) < 2:
            return None
        if fn in ("irate", "idelta"):
            d = vs[-1] - vs[-2]
            if fn == "idelta":
                return d
            return (vs[-1] if vs[-1] < vs[-2] else d) / ((ts[-1] - ts[-2]) / 1000)
        if fn in ("deriv", "predict_linear"):
            if all(v == vs[0] for v in vs):
                return 0.0 if fn == "deriv" else vs[0]
            xs = [(x - t) / 1000 for x in ts]
            mx, my = sum(xs) / len(xs), sum(vs) / len(vs)
            k = sum((x - mx) * (v - my) for x, v in zip(xs, vs)) / sum((x - mx) ** 2 for x in xs)
            return k if fn == "deriv" else my - k * mx + k * extra[0]
        if fn == "double_exponential_smoothing":
            sf, tf = extra
            s0, s1, b = 0.0, vs[0], vs[1] - vs[0]
            for i in range(1, len(vs)):
                if i > 1:
                    b = tf * (s1 - s0) + (1 - tf) * b
                s0, s1 = s1, sf * vs[i] + (1 - sf) * (s1 + b)
            return s1
        if fn in ("rate", "increase", "delta"):
            raw = vs[-1] - vs[0]
            if fn != "delta":
                raw += sum(a for a, b in zip(vs, vs[1:]) if b < a)
            span = (ts[-1] - ts[0]) / 1000
            gap = span / (len(ts) - 1)
            a, b = (ts[0] - (end - width)) / 1000, (end - ts[-1]) / 1000
            if a >= gap * 1.1:
                a = gap / 2
            if fn != "delta" and raw > 0 and vs[0] >= 0:
                a = min(a, span * vs[0] / raw)
            if b >= gap * 1.1:
                b = gap / 2
            f = (span + a + b) / span
            return raw * f / (width / 1000 if fn == "rate" else 1)
        raise NotImplementedError(fn)

    def aggregate(self, n, t):
        v = self.eval(n.expr, t)
        groups = {}
        for ls, x in v.items():
            k = without(ls, (*n.labels, NAME)) if n.without else frozenset(p for p in ls if p[0] in n.labels)
            groups.setdefault(k, {})[ls] = x
        out = {}
        p = None if n.param is None else n.param.value if isinstance(n.param, Text) else self.eval(n.param, t)
        for k, own in groups.items():
            vs = list(own.values())
            real = [x for x in vs if not math.isnan(x)]
            odd = any(not math.isfinite(x) for x in vs)
            if n.op in ("topk", "bottomk", "limitk"):
                key = (lambda i: sorted(i[0])) if n.op == "limitk" else (lambda i: (math.isnan(i[1]), -i[1] if n.op == "topk" else i[1], sorted(i[0])))
                out |= dict(sorted(own.items(), key=key)[: max(0, math.floor(p))])
            elif n.op == "count_values":
                for x in vs:
                    text = str(int(x)) if x == int(x) else repr(x)
                    ls = without(k, (p,)) | labels(**{p: text})
                    out[ls] = out.get(ls, 0.0) + 1.0
            else:
                mu = sum(vs) / len(vs)
                var = math.nan if odd else sum((x - mu) ** 2 for x in vs) / len(vs)
                out[k] = {"sum": lambda: sum(vs), "avg": lambda: mu, "count": lambda: float(len(vs)), "group": lambda: 1.0, "min": lambda: min(real, default=math.nan), "max": lambda: max(real, default=math.nan), "stdvar": lambda: var, "stddev": lambda: math.sqrt(var), "quantile": lambda: _quantile(p, vs)}[n.op]()
        return out

    def binary(self, n, t):
        a, b = self.eval(n.left, t), self.eval(n.right, t)
        comparing = n.op in ("==", "!=", ">", "<", ">=", "<=")
        if isinstance(a, float) and isinstance(b, float):
            return float(_cmp(n.op, a, b)) if comparing else _arith(n.op, a, b)
        if isinstance(a, float) or isinstance(b, float):
            out = {}
            for ls, x in (b if isinstance(a, float) else a).items():
                l, r = (a, x) if isinstance(a, float) else (x, b)
                if comparing and not n.boolean:
                    if _cmp(n.op, l, r):
                        out[ls] = x
                else:
                    out[ls] = float(_cmp(n.op, l, r)) if comparing else _arith(n.op, l, r)
            return out if comparing and not n.boolean else self.renamed(out)
        m = n.match
        key = lambda ls: frozenset(p for p in ls if (p[0] in m.labels if m.on else p[0] not in m.labels and p[0] != NAME))
        if m.card == "many":
            left, right = {key(x) for x in a}, {key(x) for x in b}
            if n.op == "and":
                return {ls: x for ls, x in a.items() if key(ls) in right}
            if n.op == "unless":
                return {ls: x for ls, x in a.items() if key(ls) not in right}
            return a | {ls: x for ls, x in b.items() if key(ls) not in left}
        many, one = (b, a) if m.card == "right" else (a, b)
        if not many or not one:
            return {}
        by = {}
        for ls, x in one.items():
            if key(ls) in by:
                raise Failure("many")
            by[key(ls)] = (ls, x)
        out, used = {}, set()
        for ls, x in many.items():
            if key(ls) not in by:
                continue
            other, y = by[key(ls)]
            if m.card == "one":
                if key(ls) in used:
                    raise Failure("many")
                used.add(key(ls))
            l, r = (y, x) if m.card == "right" else (x, y)
            if comparing and not n.boolean:
                if not _cmp(n.op, l, r):
                    continue
                v = l
            else:
                v = float(_cmp(n.op, l, r)) if comparing else _arith(n.op, l, r)
            new = ls if comparing and not n.boolean else without(ls, RESERVED)
            if m.card == "one":
                new = frozenset(p for p in new if p[0] in m.labels) if m.on else without(new, m.labels)
            for inc in m.include:
                new = without(new, (inc,)) | labels(**{inc: get(other, inc)})
            if new in out:
                raise Failure("duplicate")
            out[new] = v
        return out
