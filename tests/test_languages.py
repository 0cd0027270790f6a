"""Golden values and errors of the three query languages on small literal stores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kestrel.functions import labels as L
from kestrel.functions import units
from kestrel.functions.labels import Matcher
from kestrel.operators.logs import Logs
from kestrel.operators.metrics import EvalError, Metrics
from kestrel.operators.traces import SPANS, Traces
from kestrel.plans import log_query, metric_query, trace_query
from kestrel.plans.grid import Grid
from kestrel.plans.lexing import QueryError, Unsupported


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [("http_requests_total", {"method": m, "service": "api"}, i * 1000, float(i * k)) for m, k in (("GET", 10), ("POST", 5)) for i in range(10)]
    rows.append(("memory_usage_bytes", {"service": "api"}, 5000, 1e6))
    rows += [("resets_total", {}, t, v) for t, v in ((1000, 0.0), (2000, 10.0), (3000, 20.0), (4000, 5.0), (5000, 15.0))]
    rows += [("a", {"service": "api", "env": "prod"}, 1000, 10.0), ("b", {"service": "api", "env": "staging"}, 1000, 3.0), ("b2", {"service": "api", "env": "x"}, 1000, 1.0), ("b2", {"service": "api", "env": "y"}, 1000, 2.0)]
    rows = [(m, {"__name__": m, **l}, t, v, i) for i, (m, l, t, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double, ingest_seq long")
    return Metrics(df.withColumn("key", L.of_map(F.col("labels"))))


@pytest.mark.parametrize(("query", "at", "want"), [
    ('http_requests_total{method="GET"}', 9000, 90), ('rate(http_requests_total{method="GET"}[10s])', 9000, 10), ("sum(http_requests_total) by (service)", 9000, 135), ("avg by (service) (http_requests_total)", 9000, 67.5),
    ('http_requests_total{method="GET"} / 10', 9000, 9), ("stddev(http_requests_total)", 9000, 22.5), ("group(http_requests_total)", 9000, 1), ("quantile(0.5, http_requests_total)", 9000, 67.5), ('avg_over_time(http_requests_total{method="GET"}[10s])', 9000, 45),
    ("rate(resets_total[10s])", 5000, 8.75), ("a * on(service) b", 1000, 30), ("a * ignoring(env) b", 1000, 30), ('absent(nothing{x="y"})', 1000, 1), ("time()", 1000, 1), ("vector(42)", 1000, 42), ("-a", 1000, -10), ("a / 0", 1000, math.nan), ("changes(resets_total[10s])", 5000, 4), ("resets(resets_total[10s])", 5000, 1),
])
def test_golden_metrics(metrics, query, at, want):
    rows = metrics.instant(query, at).df.collect()
    assert len(rows) == 1 and (rows[0]["value"] == pytest.approx(want, nan_ok=True))


def test_metric_results_and_errors(metrics):
    assert metrics.instant("42", 0) == 42.0 and metrics.instant("2 ^ 3 ^ 2 - 1", 0) == 511.0
    assert metrics.instant("http_requests_total > bool 50", 9000).df.count() == 2
    assert metrics.instant("http_requests_total > 50", 9000).df.count() == 1
    assert metrics.instant("quantile(2, http_requests_total)", 9000).df.count() == 0
    out = metrics.instant('label_replace(http_requests_total{method="POST"}, "short", "$1", "method", "(...).*")', 9000)
    assert "short=POS" in metrics.frame(out).first()["series"]
    assert "combined=GET-api" in metrics.frame(metrics.instant('label_join(http_requests_total{method="GET"}, "combined", "-", "method", "service")', 9000)).first()["series"]
    for bad in ("sum(", "rate(x[5m", "x{a=~}", "1 +", "foo bar"):
        with pytest.raises(QueryError):
            metric_query.parse(bad)
    for query in ("rate(x[5m:1m])", "predict_linear(x[5m], 1)", "count_values(1, x)"):
        with pytest.raises(Unsupported):
            metrics.instant(query, 0)
    with pytest.raises(EvalError):
        metrics.instant("a * on(service) group_left b2", 1000)
    with pytest.raises(ValueError):
        Grid(0, 11_000, 1)


@pytest.mark.parametrize(("matcher", "want"), [(("a", "=", "1"), [True, False, False]), (("a", "!=", "1"), [False, True, True]), (("a", "=~", ".*"), [True, True, False]), (("a", "!~", "1|x"), [False, True, True]), (("a", "=~", "("), [False] * 3), (("a", "=", ""), [False] * 3)])
def test_matchers(spark, matcher, want):
    df = spark.createDataFrame([({"a": "1"},), ({"a": "2"},), ({},)], "labels map<string,string>")
    assert [r[0] for r in df.select(L.matches(F.col("labels"), [Matcher(*matcher)])).collect()] == want


@pytest.fixture(scope="module")
def logs(spark):
    pay, gate = {"service": "payments", "level": "error"}, {"service": "gateway", "level": "info"}
    rows = [(pay, 10**9, "connection timeout to bank API"), (pay, 2 * 10**9, "retry 1/3 failed"), (pay, 3 * 10**9, "healthcheck ok"), (gate, 15 * 10**8, "request received"), ({"service": "mix"}, 1, '{"a": {"b": 1}, "n": null, "s": "x"}'), ({"service": "mix"}, 2, "plain"), ({"service": "fmt"}, 3, 'a=1 b="two" a=3 =x c=d=e')]
    df = spark.createDataFrame([(l, t, x, i) for i, (l, t, x) in enumerate(rows)], "labels map<string,string>, ts_ns long, line string, ingest_seq long")
    return Logs(df.withColumn("key", L.of_map(F.col("labels"))))


def test_golden_logs(logs):
    run = lambda q, limit=None: logs.streams(q, 0, 10**10, limit)
    assert run('{service="payments"}').count() == 3
    assert run('{service="payments"} |= "timeout"').count() == 1 and run('{service="payments"} != "healthcheck"').count() == 2
    assert [r["ts_ns"] for r in run('{service=~".*"}', 2).orderBy("ts_ns").collect()] == [2 * 10**9, 3 * 10**9]
    found = {r["line"]: r["found"] for r in run('{service="mix"} | json').collect()}
    assert found['{"a": {"b": 1}, "n": null, "s": "x"}'] == {"service": "mix", "a": '{"b":1}', "n": "null", "s": "x"} and found["plain"] == {"service": "mix"}
    assert run('{service="fmt"} | logfmt').first()["found"] == {"service": "fmt", "a": "3", "b": "two", "c": "d=e"}
    assert run('{service="payments"} | absent != "x"').count() == 0
    assert [r["value"] for r in logs.matrix('count_over_time({service="payments"}[10s])', 3 * 10**9, 3 * 10**9).collect()] == [3.0]
    for bad in ("{", '{a="b"', '{a="b"} | json |', 'rate({a="b"})', '{a="b",}', "x"):
        with pytest.raises(QueryError):
            log_query.parse(bad)


@pytest.fixture(scope="module")
def traces(spark):
    def span(t, s, parent, name, service, start, dur, status, i):
        return (t * 32, s * 16, parent and parent * 16, name, service, start, dur, status, None, 2, [("resource.service.name", ("s", service, None, None, None, service)), ("span.n", ("i", None, i, None, None, str(i)))], [], [], i)

    rows = [span("1", "1", None, "GET /api", "gateway", 10**9, 5 * 10**8, "ok", 0), span("1", "2", "1", "process_payment", "payments", 11 * 10**8, 3 * 10**8, "error", 1), span("1", "4", "2", "leaf", "db", 12 * 10**8, 10, "ok", 2), span("2", "3", None, "slow_query", "payments", 2 * 10**9, 2 * 10**9, "ok", 3)]
    return Traces(spark.createDataFrame(rows, SPANS))


@pytest.mark.parametrize(("query", "want"), [
    ('{ resource.service.name = "gateway" }', ["GET /api"]), ("{ duration > 1s }", ["slow_query"]), ("{ status = error }", ["process_payment"]), ('{ resource.service.name = "gateway" || status = error }', ["GET /api", "process_payment"]), ('{ resource.service.name = "payments" && status = error }', ["process_payment"]),
    ('{ name = "GET /api" } > { }', ["process_payment"]), ('{ name = "GET /api" } >> { }', ["process_payment", "leaf"]), ("{ } ~ { }", []), ("{ } | count() > 2", ["GET /api", "process_payment", "leaf"]), ("{ span.n >= 2 && span.n != 3 }", ["leaf"]), ('{ span.none != "x" && kind = server && name =~ "ow_q" }', ["slow_query"]), ("{ span.n = 1.0 }", ["process_payment"]), ("{ } | avg(duration) > 1s", ["slow_query"]),
])
def test_golden_traces(traces, query, want):
    assert [r["name"] for r in traces.query(query).collect()] == want


def structural_by_hand(rows, op, is_left, is_right):
    """(trace, span) by pairs of spans and walks up the parents."""
    found = set()
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        parent = {s: p for _, s, p, _ in own}  # the last of equal ids

        def above(s):
            seen = [s]
            while (s := parent.get(s)) is not None and s not in seen:
                seen.append(s)
            return seen[1:]

        for _, a, _, name in own:
            for _, b, _, other in own:
                related = {">": parent[b] == a, "~": a != b and parent[a] == parent[b], ">>": a != b and a in above(b)}[op]
                if is_left(name) and is_right(other) and related:
                    found.add((t, b))
    return found


@pytest.mark.parametrize("op", [">", ">>", "~"])
def test_structures_with_cycles_repeats_and_gaps(spark, op):
    rng = random.Random(3)
    rows = []
    for t in range(40):
        n = rng.randrange(1, 12)
        ids = [f"{i:016x}" for i in range(1, n + 1)]
        for s in ids + ([rng.choice(ids)] if t % 3 == 0 else []):
            p = rng.choice([None, *ids, "f" * 16])
            rows.append((f"{t:032x}", s, p if p != s or op == ">>" else None, rng.choice("ab")))
    chain = [("c" * 32, f"{i:016x}", f"{i - 1:016x}" if i > 1 else None, "a" if i == 1 else "b") for i in range(1, 200)]
    ring = [("d" * 32, f"{i:016x}", f"{i % 5 + 1:016x}", "a" if i == 2 else "b") for i in range(1, 6)]
    rows += chain + ring
    columns = "trace_id string, span_id string, parent_span_id string, name string, ingest_seq long, duration_ns long"
    df = spark.createDataFrame([(*r, i, 0) for i, r in enumerate(rows)], columns)
    for right, test in (("{ }", lambda _: True), ('{ name = "b" }', lambda x: x == "b")):
        got = {(r["trace_id"], r["span_id"]) for r in Traces(df).query(f'{{ name = "a" }} {op} {right}').collect()}
        assert got == structural_by_hand(rows, op, lambda x: x == "a", test)


def test_levels_of_chains_cycles_and_gaps(spark):
    rows = [("a" * 32, f"{i:016x}", f"{i - 1:016x}" if i else None) for i in range(200)] + [("b" * 32, f"{i:016x}", f"{i % 3 + 1:016x}") for i in range(1, 4)] + [("c" * 32, "1" * 16, "9" * 16), ("c" * 32, "2" * 16, "1" * 16)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "trace_id string, span_id string, parent_span_id string, ingest_seq long")
    got = {(r["trace_id"][0], r["span_id"]): (r["root"], r["depth"]) for r in Traces(df).levels().collect()}
    want = {("a", f"{i:016x}"): (f"{0:016x}", i) for i in range(128)} | {("c", "1" * 16): ("1" * 16, 0), ("c", "2" * 16): ("1" * 16, 1)}
    assert got == want


def test_trace_summaries_and_errors(traces):
    row = traces.search('{ name = "leaf" }').first()
    assert (row["root_name"], row["span_count"], row["error_count"], row["duration_ms"]) == ("GET /api", 3, 1, 500)
    assert traces.tree("1" * 32)[0]["children"][0]["children"][0]["name"] == "leaf"
    for bad in ("{", "{ status >= 5 }", "{ duration > 5 }", '{ name = "a" && }', "{ } | sum() > 1", "{ } > { } > { }"):
        with pytest.raises(QueryError):
            trace_query.parse(bad)


def test_units():
    assert units.duration_ns("1.5s") == 1_500_000_000 and units.duration_ns("2") == 2 * 10**9
    for bad in ("-1s", "1.5ms", "x", "1h30m"):
        with pytest.raises(ValueError):
            units.duration_ns(bad)
    assert [units.epoch_ns(x) for x in ("1700000000", "1700000000000", "1700000000000000", "1700000000000000000")] == [1_700_000_000 * 10**9] * 4
    assert units.epoch_ms("1700000000") == 1_700_000_000_000 and units.trace_epoch_ns(5) == 5 * 10**9
    assert [units.number_text(x) for x in (90.0, 0.5, math.inf, math.nan, 1e21)] == ["90", "0.5", "+Inf", "NaN", "1000000000000000000000"]
