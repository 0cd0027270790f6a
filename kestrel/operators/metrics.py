"""Evaluation of metric-vector queries: one syntax node, one DataFrame transformation.

A vector is a DataFrame (key, t, value): label set, evaluation time in milliseconds, number.  Scalars are Python floats.
``__name__`` stays on labels except where vectors are matched with vectors.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.units import NUMBER
from ..plans import metric_query as Q
from ..plans.grid import Grid
from ..plans.lexing import Unsupported

LOOKBACK_MS, AHEAD_MS = 300_000, 1_000
EPSILON = 2.220446049250313e-16
NAN, INF = float("nan"), float("inf")
ROW = f"key {L.KEY_TYPE}, t long, value double"


@dataclass
class Vector:
    """``ranged``: raw samples of a range selector at the top level, which only prints."""

    df: DataFrame
    ranged: bool = False


class EvalError(ValueError):
    """A query whose arguments have the wrong kind."""


def order_of(*columns: str) -> Column:
    return F.struct(*columns)


def nan_free(agg, empty: float) -> Column:
    """min or max over the numbers that are not NaN; ``empty`` if all are."""
    v = F.col("value")
    return F.coalesce(agg(F.when(~F.isnan(v), v)), F.lit(empty))


#: Aggregates of a window's samples (value, ts, ingest_seq).
OVER_TIME = {
    "avg_over_time": lambda: F.avg("value"),
    "sum_over_time": lambda: F.sum("value"),
    "count_over_time": lambda: F.count("value").cast("double"),
    "min_over_time": lambda: nan_free(F.min, INF),
    "max_over_time": lambda: nan_free(F.max, -INF),
    "last_over_time": lambda: F.max_by("value", order_of("ts_ms", "ingest_seq")),
    "present_over_time": lambda: F.max(F.lit(1.0)),
    "stddev_over_time": lambda: F.stddev_pop("value"),
    "stdvar_over_time": lambda: F.var_pop("value"),
}
RATES = ("rate", "increase", "irate", "delta", "deriv")
STEPWISE = ("changes", "resets")
AGGREGATES = {
    "sum": lambda: F.sum("value"),
    "avg": lambda: F.avg("value"),
    "max": lambda: nan_free(F.max, -INF),
    "min": lambda: nan_free(F.min, INF),
    "count": lambda: F.count("value").cast("double"),
    "group": lambda: F.max(F.lit(1.0)),
    "stddev": lambda: F.stddev_pop("value"),
    "stdvar": lambda: F.var_pop("value"),
}


def logarithm(f) -> callable:
    return lambda x: F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x))


def whole(f) -> callable:
    """ceil and floor give integers in Spark: only where those hold the number."""
    return lambda x: F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x)


MATH = {
    "abs": F.abs,
    "ceil": whole(F.ceil),
    "floor": whole(F.floor),
    "round": lambda x: F.when(F.abs(x) < 2.0**52, F.signum(x) * F.floor(F.abs(x) + 0.5)).otherwise(x),
    "ln": logarithm(F.ln),
    "log2": logarithm(F.log2),
    "log10": logarithm(F.log10),
    "exp": F.exp,
    "sqrt": F.sqrt,
    "sgn": lambda x: F.signum(x) + F.lit(0.0),
}


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison: false with NaN; equality within an epsilon."""
    ok = ~F.isnan(a) & ~F.isnan(b)
    if op in ("==", "!="):
        near = F.abs(a - b)
        return ok & ~F.isnan(near) & ((near < EPSILON) if op == "==" else (near >= EPSILON))
    return ok & {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return F.when(b == 0, F.lit(NAN)).otherwise(a / F.when(b != 0, b))
    if op == "%":
        return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b))
    return F.pow(a, b) if op == "^" else F.lit(NAN)


def scalar_op(op: str, a: float, b: float) -> float:
    if op in Q.COMPARISONS:
        near = abs(a - b)
        return float({">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": near < EPSILON, "!=": near >= EPSILON}[op])
    if op in ("/", "%"):
        return NAN if b == 0 or math.isnan(b) else a / b if op == "/" else math.fmod(a, b) if math.isfinite(a) else NAN
    try:
        return {"+": a + b, "-": a - b, "*": a * b}[op] if op in "+-*" else math.pow(a, b) if op == "^" else NAN
    except (OverflowError, ValueError):
        return INF if op == "^" and a > 0 else NAN


class Metrics:
    """``samples``: (metric, labels map, key, ts_ms, value, ingest_seq)."""

    def __init__(self, samples: DataFrame):
        self.samples, self.spark = samples, samples.sparkSession

    def instant(self, query: str, at_ms: int | None = None):
        """At ``at_ms``, by default the time of the newest sample."""
        if at_ms is None:
            at_ms = self.samples.agg(F.max("ts_ms")).first()[0] or 0
        return _Evaluation(self, Grid(at_ms, at_ms, 0), True).run(Q.parse(query))

    def range(self, query: str, start_ms: int, end_ms: int, step_ms: int):
        if step_ms <= 0 or end_ms < start_ms:
            raise ValueError("a range query needs a positive step and an end that is not before its start")
        return _Evaluation(self, Grid(start_ms, end_ms, step_ms), False).run(Q.parse(query))

    def frame(self, result) -> DataFrame:
        """Any result as (series, t, value)."""
        if isinstance(result, float):
            return self.spark.createDataFrame([("", None, result)], "series string, t long, value double")
        return result.df.select(L.text(F.col("key")).alias("series"), "t", "value")

    def series(self, selectors: list[str], start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """Distinct label sets that match any of the selectors and have a sample in the closed interval."""
        out = None
        for text in selectors:
            e = Q.parse(text)
            if not isinstance(e, Q.Selector) or e.range_ms is not None:
                raise EvalError("series takes vector selectors")
            found = self.select(e)
            if start_ms is not None:
                found = found.filter(F.col("ts_ms") >= start_ms)
            if end_ms is not None:
                found = found.filter(F.col("ts_ms") <= end_ms)
            found = found.select("key")
            out = found if out is None else out.union(found)
        return out.distinct()

    def label_names(self) -> DataFrame:
        return self.samples.select(F.explode(F.map_keys("labels")).alias("name")).distinct()

    def label_values(self, name: str) -> DataFrame:
        return self.samples.select(F.col("labels")[name].alias("value")).filter("value is not null").distinct()

    def select(self, s: Q.Selector) -> DataFrame:
        matchers = list(s.matchers)
        if s.name and not any(m.name == L.NAME for m in matchers):
            matchers.insert(0, L.Matcher(L.NAME, "=", s.name))
        return self.samples.filter(L.matches(F.col("labels"), matchers, {L.NAME: F.col("metric")})).select("key", "ts_ms", "value", "ingest_seq")


class _Evaluation:
    def __init__(self, store: Metrics, grid: Grid, instant: bool):
        self.store, self.grid, self.is_instant, self.spark = store, grid, instant, store.spark
        self.end = grid.start if instant else grid.end

    def run(self, e):
        if isinstance(e, Q.Number):
            return float(e.value)
        if isinstance(e, Q.Selector):
            return self.raw(e) if e.range_ms is not None else Vector(self.at_steps(e))
        if isinstance(e, Q.Negate):
            x = self.run(e.of)
            return -x if isinstance(x, float) else x if x.ranged else Vector(x.df.withColumn("value", -F.col("value")))
        if isinstance(e, Q.Binary):
            return self.binary(e)
        if isinstance(e, Q.Aggregate):
            return self.aggregate(e)
        if isinstance(e, Q.Call):
            return self.call(e)
        raise Unsupported("unsupported expression: a string")

    # -- selectors

    def pinned(self, s: Q.Selector) -> int | None:
        return {"start": self.grid.start, "end": self.end}.get(s.at, s.at) if s.at is not None else None

    def at_steps(self, s: Q.Selector) -> DataFrame:
        """The newest sample within the lookback, at each step."""
        rows, pin = self.store.select(s), self.pinned(s)
        newest = F.max_by("value", order_of("ts_ms", "ingest_seq")).alias("value")
        if self.is_instant or pin is not None:
            e = (self.end if pin is None else pin) - s.offset_ms
            ahead = AHEAD_MS if self.is_instant else 0
            found = rows.filter(F.col("ts_ms").between(e - LOOKBACK_MS, e + ahead)).groupBy("key").agg(newest)
            if self.is_instant:
                return found.select("key", F.lit(self.end).cast("long").alias("t"), "value")
            return found.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.grid.last).cast("long")))).select("key", self.grid.time(F.col("k")).alias("t"), "value")
        return self.grid.cover(rows, "ts_ms", LOOKBACK_MS, s.offset_ms).groupBy("key", "t").agg(newest)

    def raw(self, s: Q.Selector) -> Vector:
        pin = self.pinned(s)
        e = (self.end if pin is None else pin) - s.offset_ms
        rows = self.store.select(s).filter(F.col("ts_ms").between(e - s.range_ms, e))
        return Vector(rows.select("key", F.col("ts_ms").alias("t"), "value"), True)

    def windows(self, e, pairs: bool) -> tuple[DataFrame, Q.Selector]:
        """Samples of a range selector, once for each window; with ``pairs`` also the sample before."""
        if not isinstance(e, Q.Selector) or e.range_ms is None:
            raise EvalError("expected a range vector selector")
        rows = self.store.select(e)
        g = self.grid
        rows = rows.filter(F.col("ts_ms").between(g.start - e.range_ms - e.offset_ms, g.start + g.last * g.step - e.offset_ms))
        if pairs:
            w = W.partitionBy("key").orderBy("ts_ms", "ingest_seq")
            rows = rows.withColumns({"before": F.lag("value").over(w), "before_ts": F.lag("ts_ms").over(w)})
        out = g.cover(rows, "ts_ms", e.range_ms, e.offset_ms)
        if pairs:
            inside = F.col("before_ts") >= F.col("t") - e.range_ms - e.offset_ms
            out = out.withColumn("inside", F.coalesce(inside, F.lit(False)))
        return out, e

    def rates(self, name: str, e) -> Vector:
        rows, s = self.windows(e, name in ("rate", "increase", "irate"))
        at, seconds = order_of("ts_ms", "ingest_seq"), (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
        v, before = F.col("value"), F.col("before") if "before" in rows.columns else None
        if name in ("rate", "increase"):
            up = (v - before >= 0) & ~F.isnan(v - before)
            total = F.sum(F.when(F.col("inside"), F.when(up, v - before).otherwise(v)).otherwise(0.0))
            t = rows.groupBy("key", "t").agg(F.count("*").alias("n"), total.alias("total"), seconds.alias("span")).filter("n >= 2 and span > 0")
            out = F.col("total") / F.col("span") * (s.range_ms / 1000.0 if name == "increase" else 1.0)
        elif name == "irate":
            last = F.max_by(F.struct("value", "before", "ts_ms", "before_ts", "inside"), at).alias("z")
            t = rows.groupBy("key", "t").agg(last).filter("z.inside and z.ts_ms > z.before_ts")
            d = F.col("z.value") - F.col("z.before")
            out = F.when((d >= 0) & ~F.isnan(d), d).otherwise(F.col("z.value")) / ((F.col("z.ts_ms") - F.col("z.before_ts")) / 1000.0)
        elif name == "delta":
            t = rows.groupBy("key", "t").agg(F.count("*").alias("n"), (F.max_by("value", at) - F.min_by("value", at)).alias("d")).filter("n >= 2")
            out = F.col("d")
        else:
            x = (F.col("ts_ms") - F.col("t")) / 1000.0
            t = rows.groupBy("key", "t").agg(F.count("*").alias("n"), F.regr_slope(v, x).alias("d")).filter("n >= 2 and d is not null")
            out = F.col("d")
        return Vector(t.select("key", "t", out.alias("value")))

    def stepwise(self, name: str, e) -> Vector:
        rows, _ = self.windows(e, True)
        v, before = F.col("value"), F.col("before")
        differs = (v != before) | (F.isnan(v) & F.isnan(before)) if name == "changes" else (v < before) & ~F.isnan(before)
        n = F.sum(F.when(F.col("inside") & differs, 1.0).otherwise(0.0))
        return Vector(rows.groupBy("key", "t").agg(n.alias("value")))

    # -- functions

    def vector(self, e) -> DataFrame:
        x = self.run(e)
        if isinstance(x, float) or x.ranged:
            raise EvalError("expected an instant vector")
        return x.df

    def number(self, e) -> float:
        x = self.run(e)
        if not isinstance(x, float):
            raise EvalError("expected a scalar")
        return x

    def one(self, value: float) -> Vector:
        return Vector(self.spark.createDataFrame([([], self.end, value)], ROW))

    def call(self, e: Q.Call):
        name, args = e.name, e.args

        def takes(low: int, high: int | None = None) -> None:
            if not low <= len(args) <= (low if high is None else high):
                raise EvalError(f"{name}: wrong number of arguments")

        if name in RATES:
            takes(1)
            return self.rates(name, args[0])
        if name in OVER_TIME:
            takes(1)
            return Vector(self.windows(args[0], False)[0].groupBy("key", "t").agg(OVER_TIME[name]().alias("value")))
        if name in STEPWISE:
            takes(1)
            return self.stepwise(name, args[0])
        if name == "quantile_over_time":
            takes(2)
            q, rows = self.number(args[0]), self.windows(args[1], False)[0]
            out = rows.groupBy("key", "t").agg(F.percentile("value", min(max(q, 0.0), 1.0) if q == q else 0.0).alias("value"))
            return Vector(out if 0 <= q <= 1 else out.filter(F.lit(False)))
        if name == "absent_over_time":
            takes(1)
            seen = self.windows(args[0], False)[0].select("t").distinct()
            steps = self.grid.steps(self.spark).select("t")
            return Vector(steps.join(seen, "t", "left_anti").select(F.array().cast(L.KEY_TYPE).alias("key"), "t", F.lit(1.0).alias("value")))
        if name in MATH:
            takes(1, 2 if name == "round" else 1)
            return Vector(self.vector(args[0]).withColumn("value", MATH[name](F.col("value"))))
        if name == "timestamp":
            takes(1)
            return Vector(self.vector(args[0]).withColumn("value", F.col("t") / 1000.0))
        if name in ("clamp", "clamp_min", "clamp_max"):
            takes(3 if name == "clamp" else 2)
            low = self.number(args[1]) if name != "clamp_max" else None
            high = self.number(args[-1]) if name != "clamp_min" else None
            v = F.col("value")
            if low is not None:
                v = F.when(~F.isnan(v) & (v < low), F.lit(low)).otherwise(v)
            if high is not None:
                v = F.when(~F.isnan(v) & (v > high), F.lit(high)).otherwise(v)
            return Vector(self.vector(args[0]).withColumn("value", v))
        if name == "histogram_quantile":
            takes(2)
            return self.histogram(self.number(args[0]), self.vector(args[1]))
        if name == "label_replace":
            takes(5)
            return self.label_replace(*args)
        if name == "label_join":
            return self.label_join(*args)
        if name == "absent":
            takes(1)
            x = self.run(args[0])
            empty = not isinstance(x, float) and not x.df.head(1)
            return self.one(1.0) if empty else Vector(self.spark.createDataFrame([], ROW))
        if name in ("sort", "sort_desc"):
            takes(1)
            df = self.vector(args[0])
            last = df.groupBy("key").agg(F.max_by("value", "t").alias("last"))
            by = F.col("last").asc() if name == "sort" else F.col("last").desc()
            return Vector(df.join(last, "key").orderBy(F.isnan("last"), by, "key", "t").select("key", "t", "value"))
        if name == "time":
            takes(0)
            return self.one(self.end / 1000.0)
        if name == "vector":
            takes(1)
            return self.one(self.number(args[0]))
        if name == "scalar":
            takes(1)
            found = self.vector(args[0]).groupBy("key").agg(F.min_by("value", "t").alias("v")).head(2)
            return float(found[0]["v"]) if len(found) == 1 else NAN
        raise Unsupported(f"function: {name}")

    def histogram(self, q: float, df: DataFrame) -> Vector:
        le = L.value(F.col("key"), "le")
        bound = F.when(le == "+Inf", INF).otherwise(F.coalesce(F.when(le.rlike(NUMBER), le.try_cast("double")), F.lit(INF)))
        rows = df.filter(le.isNotNull()).select(L.drop(F.col("key"), ["le"]).alias("key"), "t", bound.alias("le"), F.col("value").alias("c"))
        lowest = rows.groupBy("key").agg(F.min("le").alias("low"))
        t = rows.groupBy("key", "t").agg(F.array_sort(F.collect_list(F.struct("le", "c"))).alias("b")).join(lowest, "key").filter(F.get("b", F.lit(0))["le"] == F.col("low"))
        t = t.withColumn("total", F.element_at("b", -1)["c"]).filter("total <> 0")
        target = F.lit(q) * F.col("total")
        t = t.withColumn("i", F.array_position(F.transform("b", lambda x: (x["c"] >= target) & ~F.isnan(x["c"])), True).cast("int"))
        at, before = F.get("b", F.col("i") - 1), F.get("b", F.col("i") - 2)
        pb, pc = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["c"], F.lit(0.0))
        inside = pb + (target - pc) / F.when(at["c"] != pc, at["c"] - pc) * (at["le"] - pb)
        value = F.when(F.col("i") == 0, F.element_at("b", -1)["le"]).when(at["le"] == INF, pb).when(at["c"] == pc, at["le"]).otherwise(inside)
        return Vector(t.select("key", "t", value.alias("value")))

    @staticmethod
    def strings(args) -> list[str]:
        if not all(isinstance(a, Q.Text) for a in args):
            raise EvalError("expected string literals")
        return [a.value for a in args]

    def label_replace(self, v, *rest) -> Vector:
        dst, replacement, src, pattern = self.strings(rest)
        java = L.java_regex(pattern)
        if java is None:
            raise EvalError(f"invalid pattern {pattern!r}")
        source = F.coalesce(L.value(F.col("key"), src), F.lit(""))
        anchored, out = rf"\A(?:{java})\z", F.lit(replacement)
        for g in range(re.compile(pattern).groups, 0, -1):
            out = F.replace(out, F.lit(f"${g}"), F.regexp_extract(source, anchored, g))
        return Vector(self.vector(v).withColumn("key", F.when(source.rlike(anchored), L.put(F.col("key"), dst, out)).otherwise(F.col("key"))))

    def label_join(self, v, *rest) -> Vector:
        dst, sep, *src = self.strings(rest)
        joined = F.concat_ws(sep, *[F.coalesce(L.value(F.col("key"), s), F.lit("")) for s in src])
        return Vector(self.vector(v).withColumn("key", L.put(F.col("key"), dst, joined)))

    # -- aggregations

    def aggregate(self, e: Q.Aggregate):
        x = self.run(e.of)
        if isinstance(x, float):
            return x
        if x.ranged:
            raise EvalError("expected an instant vector")
        if e.op in ("topk", "bottomk"):
            k = self.number(e.parameter)
            k = int(k) if k == k and k > 0 else 0
            last = x.df.groupBy("key").agg(F.max_by("value", "t").alias("last"))
            by = F.col("last").desc() if e.op == "topk" else F.col("last").asc()
            best = last.orderBy(F.isnan("last"), by, "key").limit(k)
            return Vector(x.df.join(best, "key", "left_semi"))
        group = L.drop(F.col("key"), list(e.labels)) if e.without else L.keep(F.col("key"), list(e.labels))
        rows = x.df.withColumn("key", group)
        if e.op == "quantile":
            q = self.number(e.parameter)
            out = rows.groupBy("key", "t").agg(F.percentile("value", min(max(q, 0.0), 1.0) if q == q else 0.0).alias("value"))
            return Vector(out if 0 <= q <= 1 else out.filter(F.lit(False)))
        if e.op not in AGGREGATES:
            raise Unsupported(f"aggregation: {e.op}")
        return Vector(rows.groupBy("key", "t").agg(AGGREGATES[e.op]().alias("value")))

    # -- binary operators

    def binary(self, e: Q.Binary):
        left, right = self.run(e.left), self.run(e.right)
        if any(not isinstance(x, float) and x.ranged for x in (left, right)):
            raise Unsupported("binary operator on a range vector")
        if isinstance(left, float) and isinstance(right, float):
            if e.op in Q.SETS:
                raise EvalError("set operators need vectors")
            return scalar_op(e.op, left, right)
        if e.op in Q.SETS:
            if isinstance(left, float) or isinstance(right, float):
                raise EvalError("set operators need vectors")
            return self.sets(e, left.df, right.df)
        if isinstance(left, float) or isinstance(right, float):
            df = right.df if isinstance(left, float) else left.df
            v = F.col("value")
            a, b = (F.lit(left), v) if isinstance(left, float) else (v, F.lit(right))
            return Vector(self.applied(e, df, a, b, v))
        return self.matched(e, left.df, right.df)

    def applied(self, e: Q.Binary, df: DataFrame, a: Column, b: Column, kept: Column) -> DataFrame:
        if e.op not in Q.COMPARISONS:
            return df.withColumn("value", arithmetic(e.op, a, b)).select("key", "t", "value")
        test = compare(e.op, a, b)
        if e.as_bool:
            return df.withColumn("value", test.cast("double")).select("key", "t", "value")
        return df.filter(test).withColumn("value", kept).select("key", "t", "value")

    def match_key(self, m: Q.Matching) -> Column:
        if m.on:
            return L.keep(F.col("key"), list(m.labels))
        return L.drop(F.col("key"), [L.NAME, *m.labels])

    def matched(self, e: Q.Binary, left: DataFrame, right: DataFrame) -> Vector:
        m = e.matching
        l = left.select(self.match_key(m).alias("mk"), "t", F.col("key").alias("lk"), F.col("value").alias("lv"))
        r = right.select(self.match_key(m).alias("mk"), "t", F.col("key").alias("rk"), F.col("value").alias("rv"))
        if m.group == "left":
            many = r.groupBy("mk").agg(F.count_distinct("rk").alias("n")).filter("n > 1").join(l.select("mk"), "mk", "left_semi")
            if many.head(1):
                raise EvalError("group_left: several series on the right side have the same matching labels")
        base, other = ("rk", "lk") if m.group == "right" else ("lk", "rk")
        key = L.drop(F.col(base), [L.NAME])
        for name in m.include:
            carried = L.value(F.col(other), name)
            key = F.when(carried.isNotNull(), L.put(key, name, carried)).otherwise(key)
        both = l.join(r, ["mk", "t"]).select(key.alias("key"), "t", "lv", "rv")
        return Vector(self.applied(e, both, F.col("lv"), F.col("rv"), F.col("lv")))

    def sets(self, e: Q.Binary, left: DataFrame, right: DataFrame) -> Vector:
        mk = self.match_key(e.matching)
        l, r = left.withColumn("mk", mk), right.withColumn("mk", mk)
        nameless = lambda df: df.select(L.drop(F.col("key"), [L.NAME]).alias("key"), "t", "value")
        if e.op == "and":
            return Vector(nameless(l.join(r.select("mk").distinct(), "mk", "left_semi")))
        if e.op == "unless":
            return Vector(nameless(l.join(r.select("mk").distinct(), "mk", "left_anti")))
        return Vector(nameless(l).unionByName(nameless(r.join(l.select("mk").distinct(), "mk", "left_anti"))))
