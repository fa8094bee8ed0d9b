"""PromQL trees as DataFrame plans.

A vector is a DataFrame with labels (map), sig (the labels as one comparable string), t (the
evaluation time in µs) and v. A range is a DataFrame of samples with labels, sig, ts and v and a
width; it meets the grid of evaluation times by an equi-explode: for functions with a mergeable form,
each sample names the grid points whose window it falls into, and partial aggregates meet on
(sig, t); for the others samples meet in blocks of grid points, and a function sees the sorted array
of its window. Either way a selector costs one shuffle, whatever its width. A scalar is a Column over t.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import TIME, Catalog
from . import parser as P

LOOKBACK = 300_000_000
MAX_POINTS = 30_000
#: Columns of a metric stream that are no labels.
NOT_LABELS = {TIME, "value", "__hash__", "is_monotonic", "exemplars", "flag", "p_date", "p_hour"}
_NAN, _INF = "double('NaN')", "double('Infinity')"


@dataclass
class Vector:
    df: DataFrame


@dataclass
class Range:
    df: DataFrame
    wide: int
    offset: int = 0


@dataclass
class Scalar:
    col: Column
    literal: float | None = None


@dataclass
class Text:
    value: str


def _sig(labels: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("\x1f"), e["value"])), "\x1e")


def _relabel(df: DataFrame, labels: Column) -> DataFrame:
    return df.withColumn("labels", labels).withColumn("sig", _sig(F.col("labels")))


def _without(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def _only(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names)) if names else F.map_filter(labels, lambda k, _: F.lit(False))


def round_step(seconds: float) -> int:
    """A step in µs, at least one second and whole seconds."""
    return max(1, round(seconds)) * 1_000_000


def _extrapolated(counter: bool, per_second: bool) -> str:
    n = "size(s)"
    first, last = "s[0]", f"s[{n} - 1]"
    resets = "aggregate(sequence(1, size(s) - 1), 0D, (a, i) -> a + CASE WHEN s[i].v < s[i - 1].v THEN s[i - 1].v ELSE 0D END)" if counter else "0D"
    delta = f"({last}.v - {first}.v + {resets})"
    took = f"(({last}.ts - {first}.ts) / 1e6)"
    gap = f"({took} / ({n} - 1))"
    start = f"(({first}.ts - (t - w)) / 1e6)"
    if counter:  # a counter isn't extended to below zero
        start = f"CASE WHEN {delta} > 0 AND {first}.v >= 0 AND {took} * ({first}.v / {delta}) < {start} THEN {took} * ({first}.v / {delta}) ELSE {start} END"
    end = f"((t - {last}.ts) / 1e6)"
    reach = " + ".join(f"CASE WHEN ({x}) < 1.1 * {gap} THEN ({x}) ELSE {gap} / 2 END" for x in (start, end))
    value = f"{delta} * (({took} + {reach}) / {took})" + (" / (w / 1e6)" if per_second else "")
    return f"CASE WHEN {n} >= 2 AND {took} > 0 THEN {value} END"


_PAIRS = "aggregate(sequence(1, size(s) - 1), 0D, (a, i) -> a + CASE WHEN {} THEN 1D ELSE 0D END)"
_LAST, _PREV = "s[size(s) - 1]", "s[size(s) - 2]"
_X = "((p.ts - {0}) / 1e6)"


def _line(origin: str) -> tuple[str, str]:
    """Slope and intercept of the least-squares line with x in seconds from the origin."""
    x = _X.format(origin)
    fold = lambda e: f"aggregate(s, 0D, (a, p) -> a + {e})"
    n, sx, sy, sxy, sxx = "size(s)", fold(x), fold("p.v"), fold(f"{x} * p.v"), fold(f"{x} * {x}")
    slope = f"(({sxy} - {sx} * {sy} / {n}) / ({sxx} - {sx} * {sx} / {n}))"
    return slope, f"({sy} / {n} - {slope} * {sx} / {n})"


def _range_expressions(name: str, args: list[float]) -> str | None:
    """SQL over s (the window's samples in order of time), t (evaluation time) and w (width)."""
    steady = "forall(s, p -> p.v = s[0].v)"
    if name in ("rate", "increase", "delta"):
        return _extrapolated(name != "delta", name == "rate")
    if name == "irate":
        dt = f"(({_LAST}.ts - {_PREV}.ts) / 1e6)"
        return f"CASE WHEN size(s) >= 2 THEN CASE WHEN {dt} = 0 THEN 0D ELSE (CASE WHEN {_LAST}.v < {_PREV}.v THEN {_LAST}.v ELSE {_LAST}.v - {_PREV}.v END) / {dt} END END"
    if name == "idelta":
        return f"CASE WHEN size(s) >= 2 THEN {_LAST}.v - {_PREV}.v END"
    if name == "changes":
        return "CASE WHEN size(s) < 2 THEN 0D ELSE " + _PAIRS.format("isnan(s[i].v) OR isnan(s[i - 1].v) OR s[i].v <> s[i - 1].v") + " END"
    if name == "resets":
        return "CASE WHEN size(s) < 2 THEN 0D ELSE " + _PAIRS.format("NOT isnan(s[i - 1].v) AND s[i - 1].v > s[i].v") + " END"
    if name == "deriv":
        return f"CASE WHEN size(s) >= 2 THEN CASE WHEN {steady} THEN 0D ELSE {_line('s[0].ts')[0]} END END"
    if name == "predict_linear":
        slope, intercept = _line("t")
        flat = f"CASE WHEN abs(s[0].v) = {_INF} THEN NULL ELSE s[0].v END"
        return f"CASE WHEN size(s) >= 2 THEN CASE WHEN {steady} THEN {flat} ELSE {slope} * {args[0]!r}D + {intercept} END END"
    if name == "holt_winters":
        sf, tf = args
        if not (0 < sf < 1 and 0 < tf < 1):
            raise P.PromqlError("smoothing factors lie between 0 and 1")
        step = (
            f"aggregate(slice(s, 2, size(s)), struct(s[0].v AS level, s[1].v - s[0].v AS trend), (a, p) -> struct("
            f"{sf!r}D * p.v + (1 - {sf!r}D) * (a.level + a.trend) AS level, "
            f"{tf!r}D * ({sf!r}D * p.v + (1 - {sf!r}D) * (a.level + a.trend) - a.level) + (1 - {tf!r}D) * a.trend AS trend), a -> a.level)"
        )
        return f"CASE WHEN size(s) >= 2 THEN {step} END"
    return None


def _order(v: str = "v") -> Column:
    """NaN sorts lowest."""
    return F.struct(~F.isnan(v), F.col(v))


def _quantile(q: float, v: Column) -> Column:
    if q != q:
        return F.lit(float("nan"))
    if q < 0 or q > 1:
        return F.lit(float("-inf") if q < 0 else float("inf"))
    return F.percentile(v, F.lit(q))


def _range_aggregates(name: str, args: list[float]) -> Column | None:
    v = F.col("v")
    plain = {
        "avg_over_time": lambda: F.avg(v), "sum_over_time": lambda: F.sum(v), "count_over_time": lambda: F.count(v).cast("double"),
        "min_over_time": lambda: F.min(_order())["v"], "max_over_time": lambda: F.max(_order())["v"], "last_over_time": lambda: F.max(F.struct("ts", "v"))["v"],
        "stddev_over_time": lambda: F.stddev_pop(v), "stdvar_over_time": lambda: F.var_pop(v), "present_over_time": lambda: F.lit(1.0),
        "quantile_over_time": lambda: _quantile(args[0], v),
    }
    return plain[name]() if name in plain else None


def _log(x: Column, base: str) -> Column:
    """IEEE logarithms: Spark's give null at and below zero."""
    fn = {"ln": F.log, "log2": F.log2, "log10": F.log10}[base]
    return F.when(x == 0, float("-inf")).when((x < 0) | F.isnan(x), float("nan")).otherwise(fn(x))


def _arith(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op in "/%":
        zero = F.when(a.eqNullSafe(F.lit(float("nan"))) | (a == 0), float("nan")).otherwise(F.signum(a) * float("inf")) if op == "/" else F.lit(float("nan"))
        return F.when(b == 0, zero).otherwise(a / b if op == "/" else F.when(F.abs(a) == float("inf"), float("nan")).otherwise(a % b))
    return F.pow(a, b) if op == "^" else F.atan2(a, b)


def _compare(op: str, a: Column, b: Column) -> Column:
    # Spark holds NaN equal to itself and greatest; here a comparison with NaN only holds for !=
    nan = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return nan | (a != b)
    return ~nan & {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


_TIME_PARTS = {"minute": F.minute, "hour": F.hour, "day_of_week": lambda x: F.dayofweek(x) - 1, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "days_in_month": lambda x: F.dayofmonth(F.last_day(x)), "month": F.month, "year": F.year}


class Engine:
    """Evaluates PromQL over a catalog's metric streams.

    strict=True follows Prometheus where the default differs: regular expressions are anchored as
    a whole, quantile() groups, absent_over_time() works, and sgn() of zero is zero."""

    def __init__(self, catalog: Catalog, start: int, end: int, step: int, lookback: int = LOOKBACK, strict: bool = False, placeholder: str = "_o2_all_"):
        if step <= 0:
            raise P.PromqlError("the step must be positive")
        if (end - start) // step + 1 > MAX_POINTS:
            raise P.PromqlError(f"more than {MAX_POINTS} points per series")
        self.catalog, self.spark = catalog, catalog.spark
        self.start, self.end, self.step, self.lookback = start, max(start, end), step, lookback
        self.strict, self.placeholder = strict, placeholder

    # -- samples and the grid ----------------------------------------------------------------

    def grid(self) -> DataFrame:
        n = (self.end - self.start) // self.step + 1
        return self.spark.range(n).select((F.lit(self.start) + F.col("id") * self.step).alias("t"))

    def _samples(self, s: P.Selector, back: int) -> DataFrame:
        """A selector's samples, with the offset taken off their times."""
        if s.name is None:
            names = [n for (kind, n) in self.catalog.streams if kind == "metrics"]
            keep = [m for m in s.matchers if m.name == "__name__"]
            names = [n for n in names if all(self._matches(n, m) for m in keep)]
        else:
            names = [s.name] if ("metrics", s.name) in self.catalog.streams else []
        parts = []
        for name in names:
            df = self.catalog.df(name, "metrics")
            lo, hi = self.start - s.offset - back, self.end - s.offset
            df = df.where((F.col(TIME) >= lo) & (F.col(TIME) <= hi))
            for m in s.matchers:
                if m.name in ("__name__", TIME, "value") or m.name not in df.columns or m.value == self.placeholder:
                    continue
                x = F.coalesce(F.col(f"`{m.name}`"), F.lit(""))
                # without a group, ^a|b$ anchors each half once only
                pattern = f"^(?:{m.value})$" if self.strict else f"^{m.value}$"
                df = df.where({"=": x == m.value, "!=": x != m.value, "=~": x.rlike(pattern), "!~": ~x.rlike(pattern)}[m.op])
            labels = [c for c in df.columns if c not in NOT_LABELS and c != "__name__"]
            pairs = [F.lit("__name__"), F.lit(name), *[x for c in labels for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]]
            map_ = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
            parts.append(df.select(map_.alias("labels"), (F.col(TIME) + s.offset).alias("ts"), F.col("value").cast("double").alias("v")))
        if not parts:
            return self.spark.createDataFrame([], "labels map<string,string>, sig string, ts long, v double")
        return reduce(DataFrame.unionByName, parts).withColumn("sig", _sig(F.col("labels")))

    @staticmethod
    def _matches(name: str, m: P.Matcher) -> bool:
        import re

        hit = name == m.value if m.op in ("=", "!=") else re.fullmatch(m.value, name) is not None
        return hit == (m.op in ("=", "=~"))

    def _reach(self, df: DataFrame, wide: int, open_left: bool) -> DataFrame:
        """Adds a and b, the first and last of the grid points t that a sample counts at: those with
        ts <= t <= ts + wide (or < with open_left)."""
        first = F.ceil((F.greatest(F.col("ts"), F.lit(self.start)) - self.start) / self.step)
        last = F.floor((F.least(F.col("ts") + wide - (1 if open_left else 0), F.lit(self.end)) - self.start) / self.step)
        return df.withColumn("a", first.cast("long")).withColumn("b", last.cast("long")).where("a <= b")

    def _windows(self, df: DataFrame, wide: int) -> DataFrame:
        """s, the samples in each window in order of time, per series and grid point. Samples meet in
        blocks of as many grid points as a window spans, so that each is shuffled twice at most;
        windows are cut out of a block's samples afterwards."""
        block = max(1, -(-wide // self.step))
        df = self._reach(df, wide, False)
        df = df.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))))
        met = df.groupBy("sig", "block").agg(F.any_value("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("ts", "v"))).alias("all"))
        n = (self.end - self.start) // self.step
        points = F.sequence(F.col("block") * block, F.least(F.col("block") * block + block - 1, F.lit(n)))
        at = lambda k: F.lit(self.start) + k * self.step
        inside = lambda k: F.filter("all", lambda p: (p["ts"] >= at(k) - wide) & (p["ts"] <= at(k)))
        # made by the generator, as a projection would be copied into every place that uses it
        each = F.explode(F.transform(points, lambda k: F.struct(at(k).alias("t"), inside(k).alias("s")))).alias("x")
        return met.select("labels", "sig", each).select("labels", "sig", "x.t", "x.s").where("size(s) > 0")

    def _touch(self, df: DataFrame, wide: int, open_left: bool) -> DataFrame:
        """Each sample once for every grid point that it counts at."""
        df = self._reach(df, wide, open_left)
        points = F.transform(F.sequence("a", "b"), lambda k: F.lit(self.start) + k * self.step)
        return df.withColumn("t", F.explode(points)).drop("a", "b")

    def _instant(self, s: P.Selector) -> Vector:
        touched = self._touch(self._samples(s, self.lookback), self.lookback, True)
        out = touched.groupBy("sig", "t").agg(F.any_value("labels").alias("labels"), F.max(F.struct("ts", "v")).alias("x"))
        return Vector(out.select("labels", "sig", "t", F.col("x.v").alias("v")))

    # -- evaluation --------------------------------------------------------------------------

    def eval(self, node):
        if isinstance(node, P.Number):
            return Scalar(F.lit(node.value), node.value)
        if isinstance(node, P.String):
            return Text(node.value)
        if isinstance(node, P.Selector):
            if node.at is not None and not node.range:
                return self._pinned(node)
            if node.range:
                return Range(self._samples(node, node.range), node.range)
            return self._instant(node)
        if isinstance(node, P.Subquery):
            return self._subquery(node)
        if isinstance(node, P.Unary):
            x = self.eval(node.expr)
            if node.op == "+":
                return x
            if isinstance(x, Scalar):
                return Scalar(-x.col, None if x.literal is None else -x.literal)
            return Vector(self._unnamed(x.df).withColumn("v", -F.col("v")))
        if isinstance(node, P.Aggregate):
            return self._aggregate(node)
        if isinstance(node, P.Binary):
            return self._binary(node)
        return self._call(node)

    def _pinned(self, node: P.Selector):
        """@: the value at one time, at every grid point (a grid has a bounded number of points)."""
        at = {"start": self.start, "end": self.end}.get(node.at, node.at)
        inner = Engine(self.catalog, at, at, self.step, self.lookback, self.strict, self.placeholder)
        return self._everywhere(inner._instant(P.Selector(node.name, node.matchers, None, node.offset)))

    def _everywhere(self, x: Vector) -> Vector:
        """Values of one time at every grid point; there are at most MAX_POINTS of these."""
        return Vector(x.df.drop("t").crossJoin(F.broadcast(self.grid())).select("labels", "sig", "t", "v"))

    def _subquery(self, node: P.Subquery) -> Range:
        step = node.step or self.step
        lo, hi = self.start - node.offset - node.range, self.end - node.offset
        first = -(-lo // step) * step
        inner = Engine(self.catalog, first, max(first, hi // step * step), step, self.lookback, self.strict, self.placeholder)
        x = inner.eval(node.expr)
        df = x.df if isinstance(x, Vector) else inner._as_vector(x).df
        return Range(df.select("labels", "sig", (F.col("t") + node.offset).alias("ts"), "v"), node.range)

    def _as_vector(self, x: Scalar) -> Vector:
        labels = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return Vector(self.grid().select(labels.alias("labels"), F.lit("").alias("sig"), "t", x.col.cast("double").alias("v")))

    @staticmethod
    def _unnamed(df: DataFrame) -> DataFrame:
        return _relabel(df, _without(F.col("labels"), ["__name__"]))

    def _over(self, name: str, r: Range, args: list[float]) -> Vector:
        whole = _range_aggregates(name, args)
        if whole is not None:
            out = self._touch(r.df, r.wide, False).groupBy("sig", "t").agg(F.any_value("labels").alias("labels"), whole.alias("v"))
        else:
            sql = _range_expressions(name, args)
            if sql is None:
                raise P.PromqlError(f"unknown function {name}")
            out = self._windows(r.df, r.wide).withColumn("w", F.lit(r.wide)).withColumn("v", F.expr(sql)).where("v IS NOT NULL")
        out = out.select("labels", "sig", "t", "v")
        return Vector(out if name == "last_over_time" else self._unnamed(out))

    def _call(self, node: P.Call):
        pinned = next((a for a in node.args if isinstance(a, P.Selector | P.Subquery) and a.at is not None and a.range), None)
        if pinned is not None:  # a window that ends at one time, whatever the grid point
            at = {"start": self.start, "end": self.end}.get(pinned.at, pinned.at)
            inner = Engine(self.catalog, at, at, self.step, self.lookback, self.strict, self.placeholder)
            return self._everywhere(inner._call(P.Call(node.name, [replace(a, at=None) if a is pinned else a for a in node.args])))
        name, args = node.name, [self.eval(a) for a in node.args]
        numbers = [a.literal for a in args if isinstance(a, Scalar)]
        if name == "time":
            return Scalar(F.col("t") / 1e6)
        if name == "pi":
            return Scalar(F.lit(3.141592653589793), 3.141592653589793)
        if name == "vector":
            if not isinstance(args[0], Scalar):
                raise P.PromqlError("vector() takes a scalar")
            return self._as_vector(args[0])
        if name == "scalar":
            return args[0]
        if name == "absent_over_time":
            return self._absent(self._over("count_over_time", args[0], [])) if self.strict else Vector(args[0].df.select("labels", "sig", F.col("ts").alias("t"), "v").where("false"))
        ranged = next((a for a in args if isinstance(a, Range)), None)
        if ranged is not None:
            return self._over(name, ranged, [float("nan") if x is None else x for x in numbers])
        if name == "absent":
            return self._absent(args[0])
        if name in _TIME_PARTS and not args:
            return Scalar(_TIME_PARTS[name](F.timestamp_micros(F.col("t"))).cast("double"))
        if name in ("label_replace", "label_join"):
            return self._labels(name, args)
        if name == "histogram_quantile":
            return self._histogram_quantile(args[0], args[1])
        if name == "histogram_fraction":
            return self._histogram_fraction(args[0], args[1], args[2])
        if name in ("histogram_count", "histogram_sum"):
            suffix = name.removeprefix("histogram")
            return Vector(self._unnamed(args[0].df.where(F.element_at("labels", "__name__").endswith(suffix))))
        x = args[-1] if name in ("sort", "sort_desc") else args[0]
        if isinstance(x, Scalar):
            x = self._as_vector(x)
        v = F.col("v")
        if name in ("sort", "sort_desc"):
            return Vector(x.df.orderBy(F.col("v").asc() if name == "sort" else F.col("v").desc(), "sig"))
        extra = [a.col for a in args[1:] if isinstance(a, Scalar)]
        if name == "timestamp":
            new = F.floor(F.col("t") / 1_000_000).cast("double")
        elif name in _TIME_PARTS:
            new = _TIME_PARTS[name](F.timestamp_micros(F.expr("epoch_micros(cast(v AS BIGINT))"))).cast("double")
        elif name in ("ln", "log2", "log10"):
            new = _log(v, name)
        elif name == "sgn":
            new = F.when(F.isnan(v), v).when(v > 0, 1.0).when(v < 0, -1.0).otherwise(v if self.strict else F.when(F.lit(1.0) / 1 * F.atan2(v, F.lit(-1.0)) < 0, -1.0).otherwise(1.0))
        elif name in ("clamp", "clamp_min", "clamp_max"):
            new = v
            if name != "clamp_max":
                new = F.greatest(new, extra[0])
            if name != "clamp_min":
                new = F.least(new, extra[-1])
            new = F.when(F.isnan(v), v).otherwise(new)
            if name == "clamp" and None not in numbers and numbers[0] > numbers[1]:
                return Vector(self._unnamed(x.df).where("false"))
        elif name == "round":
            new = F.when(F.abs(v) >= 4503599627370496.0, v).otherwise(F.signum(v) * F.floor(F.abs(v) + 0.5)) if not extra else F.floor(v / extra[0] + 0.5) * extra[0]
        else:
            simple = {"abs": F.abs, "ceil": lambda c: F.when(F.abs(c) >= 9e15, c).otherwise(F.ceil(c).cast("double")), "floor": lambda c: F.when(F.abs(c) >= 9e15, c).otherwise(F.floor(c).cast("double")), "exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians}
            if name not in simple:
                raise P.PromqlError(f"unknown function {name}")
            new = simple[name](v)
        return Vector(self._unnamed(x.df.withColumn("v", new.cast("double"))))

    def _absent(self, x) -> Vector:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        seen = x.df.select("t").distinct()
        return Vector(self.grid().join(seen, "t", "left_anti").select(none.alias("labels"), F.lit("").alias("sig"), "t", F.lit(1.0).alias("v")))

    def _labels(self, name: str, args: list) -> Vector:
        df, texts = args[0].df, [a.value for a in args[1:]]
        labels = F.col("labels")
        import re

        if not re.fullmatch(r"[A-Za-z_]\w*", texts[0]):
            raise P.PromqlError(f"invalid destination label name {texts[0]!r}")
        if name == "label_replace":
            dest, replacement, source, pattern = texts
            try:
                re.compile(pattern)
            except re.error as e:
                raise P.PromqlError(f"invalid regular expression: {e}") from e
            old = F.coalesce(F.element_at(labels, source), F.lit(""))
            java = re.sub(r"\$\{?(\w+)\}?", lambda m: "$" + m[1] if m[1].isdigit() else "${" + m[1] + "}", replacement)
            if self.strict:
                new = F.when(old.rlike(f"^(?:{pattern})$"), F.regexp_replace(old, f"^(?:{pattern})$", java)).otherwise(old)
            else:
                new = F.regexp_replace(old, pattern, java)
        else:
            dest, glue, names = texts[0], texts[1], texts[2:]
            held = F.filter(F.array_sort(F.map_entries(labels)), lambda e: e["key"].isin(*names) & (e["key"] != "__name__"))
            new, old = F.array_join(F.transform(held, lambda e: e["value"]), glue), None
        rest = F.map_filter(labels, lambda k, _: k != dest)
        put = F.when(new == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(dest), new)))
        return Vector(_relabel(df, put if old is None else F.when(new != old, put).otherwise(labels)))

    @staticmethod
    def _buckets(x: Vector) -> DataFrame:
        """Per series and time, b: its buckets by bound, with bounds that are equal added together and
        counts made to rise. Without a +Inf bucket there is nothing."""
        bound = F.when(F.element_at("labels", "le").isin("+Inf", "Inf"), float("inf")).otherwise(F.element_at("labels", "le").try_cast("double"))
        df = x.df.withColumn("le", bound).where("le IS NOT NULL")
        df = _relabel(df, _without(F.col("labels"), ["__name__", "le", "__hash__"]))
        df = df.groupBy("sig", "t", "le").agg(F.any_value("labels").alias("labels"), F.sum("v").alias("c"))
        df = df.groupBy("sig", "t").agg(F.any_value("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("le", "c"))).alias("b"))
        rising = "transform(b, (x, i) -> struct(x.le AS le, array_max(transform(slice(b, 1, i + 1), y -> y.c)) AS c))"
        return df.withColumn("b", F.expr(rising)).where(f"b[size(b) - 1].le = {_INF}")

    def _histogram_fraction(self, low: Scalar, high: Scalar, x: Vector) -> Vector:
        """The share of observations between two values, linear inside buckets."""

        def below(value: str) -> str:
            k = f"size(filter(b, x -> x.le < {value}))"
            lo, c = f"CASE WHEN {k} = 0 THEN 0D ELSE b[{k} - 1].le END", f"CASE WHEN {k} = 0 THEN 0D ELSE b[{k} - 1].c END"
            return f"CASE WHEN {value} <= 0 AND b[0].le > 0 THEN 0D WHEN {k} >= size(b) - 1 THEN CASE WHEN {value} = {_INF} THEN b[size(b) - 1].c ELSE b[size(b) - 2].c END ELSE ({c}) + (b[{k}].c - ({c})) * ({value} - ({lo})) / (b[{k}].le - ({lo})) END"

        df = self._buckets(x).withColumn("lo", low.col.cast("double")).withColumn("hi", high.col.cast("double"))
        value = f"CASE WHEN size(b) < 2 OR b[size(b) - 1].c = 0 THEN {_NAN} WHEN hi <= lo THEN 0D ELSE (({below('hi')}) - ({below('lo')})) / b[size(b) - 1].c END"
        return Vector(df.select("labels", "sig", "t", F.expr(value).alias("v")))

    def _histogram_quantile(self, q, x: Vector) -> Vector:
        """Linear inside the bucket that holds the rank."""
        df = self._buckets(x).withColumn("phi", q.col.cast("double"))
        df = df.withColumn("rank", F.expr("phi * b[size(b) - 1].c"))
        df = df.withColumn("k", F.expr("least(size(filter(b, x -> x.c < rank)), size(b) - 1)"))
        value = f"""CASE WHEN size(b) < 2 OR b[size(b) - 1].c = 0 OR isnan(phi) THEN {_NAN} WHEN phi < 0 THEN -{_INF} WHEN phi > 1 THEN {_INF}
            WHEN k = size(b) - 1 THEN b[size(b) - 2].le WHEN k = 0 AND b[0].le <= 0 THEN b[0].le
            ELSE (CASE WHEN k = 0 THEN 0D ELSE b[k - 1].le END) + (b[k].le - CASE WHEN k = 0 THEN 0D ELSE b[k - 1].le END)
              * ((rank - CASE WHEN k = 0 THEN 0D ELSE b[k - 1].c END) / (b[k].c - CASE WHEN k = 0 THEN 0D ELSE b[k - 1].c END)) END"""
        return Vector(df.select("labels", "sig", "t", F.expr(value).alias("v")))

    def _aggregate(self, node: P.Aggregate) -> Vector:
        x = self.eval(node.expr)
        df = x.df if isinstance(x, Vector) else self._as_vector(x).df
        labels = F.col("labels")
        by, without = node.by, node.without
        if node.name == "quantile" and not self.strict:
            by = without = None
        if by is not None:
            kept = _only(labels, by)
        elif without is not None:
            kept = _without(labels, [*without, "__name__"])
        else:
            kept = _only(labels, [])
        grouped = df.withColumn("glabels", kept).withColumn("gsig", _sig(F.col("glabels")))
        if node.name in ("topk", "bottomk"):
            k = self.eval(node.param).literal
            if not k or k < 1:
                return Vector(df.where("false"))
            rank = F.row_number().over(Window.partitionBy("gsig", "t").orderBy(_order().desc() if node.name == "topk" else _order().asc(), "sig"))
            return Vector(grouped.withColumn("k", rank).where(F.col("k") <= int(k)).select("labels", "sig", "t", "v"))
        if node.name == "count_values":
            text = F.when(F.col("v") == F.floor("v"), F.col("v").cast("decimal(38,0)").cast("string")).otherwise(F.col("v").cast("string"))
            name = self.eval(node.param).value
            put = F.map_concat(F.map_filter("glabels", lambda k, _: k != name), F.create_map(F.lit(name), text))
            out = _relabel(grouped.drop("labels", "sig"), put).groupBy("sig", "t").agg(F.any_value("labels").alias("labels"), F.count(F.lit(1)).cast("double").alias("v"))
            return Vector(out.select("labels", "sig", "t", "v"))
        v = F.col("v")
        nan = lambda x, other: F.when(F.isnan(x), other).otherwise(x)
        value = {
            "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "count": lambda: F.count(v).cast("double"), "group": lambda: F.max(F.lit(1.0)),
            "min": lambda: F.min(nan(v, float("inf"))), "max": lambda: F.max(nan(v, float("-inf"))), "stddev": lambda: F.stddev_pop(v), "stdvar": lambda: F.var_pop(v),
            "quantile": lambda: _quantile(self.eval(node.param).literal, v),
        }[node.name]()
        out = grouped.groupBy("gsig", "t").agg(F.any_value("glabels").alias("labels"), value.alias("v"))
        return Vector(out.select("labels", F.col("gsig").alias("sig"), "t", "v"))

    def _binary(self, node: P.Binary):
        a, b = self.eval(node.left), self.eval(node.right)
        op, compares = node.op, node.op in P.COMPARISONS
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            if compares and not node.bool:
                raise P.PromqlError("comparisons between scalars must use bool modifier")
            return Scalar(_compare(op, a.col, b.col).cast("double") if compares else _arith(op, a.col, b.col))
        if isinstance(a, Scalar) or isinstance(b, Scalar):
            if op in P.SETS:
                raise P.PromqlError(f"{op} needs two vectors")
            vector, left = (b, False) if isinstance(a, Scalar) else (a, True)
            v, s = F.col("v"), (b if left else a).col.cast("double")
            x, y = (v, s) if left else (s, v)
            if compares and not node.bool:
                return Vector(vector.df.where(_compare(op, x, y)))
            new = _compare(op, x, y).cast("double") if compares else _arith(op, x, y)
            return Vector(self._unnamed(vector.df.withColumn("v", new)))
        key = lambda labels: _only(labels, node.on) if node.on is not None else _without(labels, ["__name__", *(node.ignoring or [])])
        l = a.df.withColumn("k", _sig(key(F.col("labels"))))  # noqa: E741
        r = b.df.withColumn("k", _sig(key(F.col("labels"))))
        if op in ("and", "unless"):
            return Vector(l.join(r.select("k", "t").distinct(), ["k", "t"], "left_semi" if op == "and" else "left_anti").select("labels", "sig", "t", "v"))
        if op == "or":
            rest = r.join(l.select("k", "t").distinct(), ["k", "t"], "left_anti").select("labels", "sig", "t", "v")
            return Vector(l.select("labels", "sig", "t", "v").unionByName(rest))
        many_right = node.side == "group_right"
        many, one = (r, l) if many_right else (l, r)
        met = many.join(one.select("k", "t", F.col("labels").alias("one_labels"), F.col("v").alias("one_v")), ["k", "t"])
        x, y = (F.col("one_v"), F.col("v")) if many_right else (F.col("v"), F.col("one_v"))
        if compares and not node.bool:
            return Vector(met.where(_compare(op, x, y)).select("labels", "sig", "t", x.alias("v")))
        labels = _without(F.col("labels"), ["__name__"])
        if node.side is None:
            labels = key(F.col("labels"))
        elif node.include:
            extra = F.map_filter("one_labels", lambda k, _: k.isin(*node.include))
            labels = F.map_concat(_without(labels, node.include), extra)
        value = _compare(op, x, y).cast("double") if compares else _arith(op, x, y)
        return Vector(_relabel(met, labels).select("labels", "sig", "t", value.alias("v")))


def query_range(catalog: Catalog, text: str, start: int, end: int, step: int, **options) -> DataFrame:
    """labels, t and v of every series at every grid point (times in µs)."""
    engine = Engine(catalog, start, end, step, **options)
    x = engine.eval(P.parse(text))
    if isinstance(x, Range):
        raise P.PromqlError("a range vector can't be the result of a range query")
    df = engine._as_vector(x).df if isinstance(x, Scalar) else x.df
    return df.select("labels", "t", "v")


def query(catalog: Catalog, text: str, at: int, **options) -> DataFrame:
    """labels, t and v of every series at one time; a range selector gives its raw samples."""
    engine = Engine(catalog, at, at, 1_000_000, **options)
    x = engine.eval(P.parse(text))
    if isinstance(x, Range):
        return x.df.where((F.col("ts") >= at - x.wide) & (F.col("ts") <= at)).select("labels", F.col("ts").alias("t"), "v")
    df = engine._as_vector(x).df if isinstance(x, Scalar) else x.df
    return df.select("labels", "t", "v")


def series(catalog: Catalog, matchers: list[str], start: int, end: int) -> DataFrame:
    """The label sets of the series that any of the selectors match."""
    engine = Engine(catalog, start, end, max(1, end - start))
    parts = [engine._samples(P.parse(m), 0).select("labels", "sig") for m in matchers]
    return reduce(DataFrame.unionByName, parts).groupBy("sig").agg(F.any_value("labels").alias("labels")).select("labels")


def label_values(catalog: Catalog, label: str, metric: str, start: int, end: int) -> DataFrame:
    engine = Engine(catalog, start, end, max(1, end - start))
    found = engine._samples(P.Selector(metric), 0).select(F.element_at("labels", label).alias("value"))
    return found.where("value IS NOT NULL").distinct().orderBy("value")


def format_query(text: str) -> str:
    return P.show(P.parse(text))


def exemplars(catalog: Catalog, text: str, start: int, end: int) -> DataFrame:
    """The exemplars of the series that a query's selectors name, merged by label set."""
    found: list[P.Selector] = []

    def walk(node) -> None:
        if isinstance(node, P.Selector):
            found.append(node)
        for child in vars(node).values() if hasattr(node, "__dict__") else ():
            for x in child if isinstance(child, list) else [child]:
                if hasattr(x, "__dict__"):
                    walk(x)

    walk(P.parse(text))
    parts = []
    for s in found:
        if s.name is None or ("metrics", s.name) not in catalog.streams or "exemplars" not in catalog.get(s.name, "metrics").columns:
            continue
        df = catalog.df(s.name, "metrics").where(f"{TIME} >= {start} AND {TIME} <= {end} AND exemplars IS NOT NULL")
        labels = [c for c in df.columns if c not in NOT_LABELS]
        pairs = [F.lit("__name__"), F.lit(s.name), *[x for c in labels for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]]
        parts.append(df.select(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("labels"), "exemplars"))
    if not parts:
        return catalog.spark.createDataFrame([], "labels map<string,string>, exemplars array<string>")
    merged = reduce(DataFrame.unionByName, parts).withColumn("sig", _sig(F.col("labels")))
    return merged.groupBy("sig").agg(F.any_value("labels").alias("labels"), F.flatten(F.collect_list("exemplars")).alias("exemplars")).drop("sig")
