"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels as L
from .operators import retention
from .operators.logs import Logs
from .operators.metrics import Metrics
from .operators.reports import Reports
from .operators.traces import Traces
from .plans.rounds import shared_path
from .sources import ingest, requests, store, tables, wire
from .streaming import pipelines

DAY = 86_400_000
START, END, STEP = 1_704_067_200_000, 1_706_659_200_000, 21_600_000
AT = 1_705_320_000_000
NS = 1_000_000
NOW_NS = 1_706_486_400_000 * NS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6) + F.lit(0.0))


# ---- metrics ----------------------------------------------------------------------------------------------------------

GAUGE = "s AS (SELECT 'svc-' || (user_id % 5) AS svc, event_type AS et, epoch_us(ts) // 1000 AS ts, value AS v, event_id AS seq FROM events)"
COUNTER = "s AS (SELECT 'svc-' || (user_id % 5) AS svc, event_type AS et, epoch_us(ts) // 1000 AS ts, (row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY events.ts, event_id) % 100)::DOUBLE AS v, event_id AS seq FROM events)"
STEPS = f"g AS (SELECT unnest(generate_series({START}, {END}, {STEP})) AS t)"
G_SERIES = "'__name__=event_value,event_type=' || et || ',service=' || svc"
C_SERIES = "'__name__=events_total,event_type=' || et || ',service=' || svc"


def windows(width: int = DAY, offset: int = 0, cond: str = "true") -> str:
    return f"{STEPS}, w AS (SELECT s.*, t, lag(v) OVER p AS pv, lag(ts) OVER p AS pt FROM g JOIN s ON ts BETWEEN t - {width + offset} AND t - {offset} WHERE {cond} WINDOW p AS (PARTITION BY svc, et, t ORDER BY ts, seq))"


def metric(name: str, query: str, sql: str, table: Callable = tables.samples, at: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = Metrics(table(spark, sf_dir))
        out = m.instant(query, at) if at is not None else m.range(query, START, END, STEP)
        return rounded(m.frame(out))

    QUERIES[name], ORACLES[name] = run, sql


def over(agg: str, source: str = GAUGE, series: str = G_SERIES, where: str = "", width: int = DAY, offset: int = 0, cond: str = "true") -> str:
    return f"WITH {source}, {windows(width, offset, cond)} SELECT {series} AS series, t, round({agg}, 6) + 0.0 AS value FROM w GROUP BY svc, et, t {where}"


ASOF = f"WITH {GAUGE}, e AS (SELECT max(ts) AS t FROM s) SELECT {G_SERIES} AS series, t, round(arg_max(v, (ts, seq)), 6) + 0.0 AS value FROM s, e WHERE ts BETWEEN t - 300000 AND t + 1000 GROUP BY svc, et, t"
QUERIES["metric_instant_selector"] = lambda spark, sf_dir: rounded((m := Metrics(tables.samples(spark, sf_dir))).frame(m.instant("event_value")))
ORACLES["metric_instant_selector"] = ASOF
metric("metric_range_selector", "event_value", over("arg_max(v, (ts, seq))", width=300_000))
metric("metric_matchers", 'count_over_time(event_value{service!="svc-1",event_type=~"c.*|p.*",service!~"svc-[34]"}[1d])', over("count(*)::DOUBLE", cond="svc <> 'svc-1' AND et SIMILAR TO '(c.*|p.*)' AND NOT svc SIMILAR TO 'svc-[34]'"))
metric("metric_equal_matcher", 'count_over_time({__name__="event_value",service="svc-2"}[1d])', over("count(*)::DOUBLE", cond="svc = 'svc-2'"))
metric("metric_raw_range", 'event_value{service="svc-1"}[6h]', f"WITH {GAUGE} SELECT {G_SERIES} AS series, ts AS t, round(v, 6) + 0.0 AS value FROM s WHERE svc = 'svc-1' AND ts BETWEEN {AT - STEP} AND {AT}", at=AT)
UP = "sum(CASE WHEN pt IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END)"
SPAN = "((max(ts) - min(ts)) / 1000.0)"
HAVING = "HAVING count(*) >= 2 AND max(ts) > min(ts)"
metric("metric_rate", "rate(events_total[1d])", over(f"{UP} / {SPAN}", COUNTER, C_SERIES, HAVING), tables.counter)
metric("metric_increase", "increase(events_total[1d])", over(f"{UP} / {SPAN} * 86400.0", COUNTER, C_SERIES, HAVING), tables.counter)
metric("metric_rate_offset", "rate(events_total[1d] offset 12h)", over(f"{UP} / {SPAN}", COUNTER, C_SERIES, HAVING, offset=DAY // 2), tables.counter)
metric("metric_irate", "irate(events_total[1d])", over("CASE WHEN arg_max(v, (ts, seq)) >= arg_max(pv, (ts, seq)) THEN arg_max(v, (ts, seq)) - arg_max(pv, (ts, seq)) ELSE arg_max(v, (ts, seq)) END / ((max(ts) - arg_max(pt, (ts, seq))) / 1000.0)", COUNTER, C_SERIES, "HAVING count(*) >= 2 AND max(ts) > arg_max(pt, (ts, seq))"), tables.counter)
metric("metric_delta", "delta(event_value[1d])", over("arg_max(v, (ts, seq)) - arg_min(v, (ts, seq))", where="HAVING count(*) >= 2"))
metric("metric_deriv", "deriv(event_value[1d])", over("regr_slope(v, (ts - t) / 1000.0)", where=HAVING))
for fn, agg in {"avg": "avg(v)", "sum": "sum(v)", "count": "count(*)::DOUBLE", "min": "min(v)", "max": "max(v)", "last": "arg_max(v, (ts, seq))", "present": "1.0::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    metric(f"metric_{fn}_over_time", f"{fn}_over_time(event_value[1d])", over(agg))
metric("metric_quantile_over_time", "quantile_over_time(0.9, event_value[1d])", over("quantile_cont(v, 0.9)"))
metric("metric_changes", "changes(events_total[1d])", over("sum(CASE WHEN pt IS NOT NULL AND v <> pv THEN 1.0 ELSE 0.0 END)::DOUBLE", COUNTER, C_SERIES), tables.counter)
metric("metric_resets", "resets(events_total[1d])", over("sum(CASE WHEN pt IS NOT NULL AND v < pv THEN 1.0 ELSE 0.0 END)::DOUBLE", COUNTER, C_SERIES), tables.counter)
metric("metric_absent_over_time", 'absent_over_time(event_value{service="svc-1",event_type="error"}[1h])', f"WITH {GAUGE}, {STEPS} SELECT '' AS series, t, 1.0::DOUBLE AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE svc = 'svc-1' AND et = 'error' AND ts BETWEEN t - 3600000 AND t)")

BASE = f"WITH {GAUGE}, {windows()}, a AS (SELECT svc, et, t, avg(v) - 50 AS v FROM w GROUP BY svc, et, t)"
X = "avg_over_time(event_value[1d]) - 50"


def mapped(expr: str, where: str = "true") -> str:
    return f"{BASE} SELECT {G_SERIES} AS series, t, round({expr}, 6) + 0.0 AS value FROM a WHERE {where}"


LOG = "CASE WHEN abs(v) = 0 THEN '-inf'::DOUBLE ELSE {}(abs(v)) END"
for fn, q, expr in (
    ("abs", f"abs({X})", "abs(v)"), ("ceil", f"ceil({X})", "ceil(v)"), ("floor", f"floor({X})", "floor(v)"), ("round", f"round({X})", "round(v)"), ("ln", f"ln(abs({X}))", LOG.format("ln")), ("log2", f"log2(abs({X}))", LOG.format("log2")),
    ("log10", f"log10(abs({X}))", LOG.format("log10")), ("exp", f"exp(({X}) / 100)", "exp(v / 100)"), ("sqrt", f"sqrt(abs({X}))", "sqrt(abs(v))"), ("sgn", f"sgn({X})", "sign(v)::DOUBLE"), ("timestamp", f"timestamp({X})", "t / 1000.0"), ("clamp", f"clamp({X}, -2, 3)", "least(greatest(v, -2), 3)"),
    ("clamp_min", f"clamp_min({X}, 0)", "greatest(v, 0)"), ("clamp_max", f"clamp_max({X}, 0)", "least(v, 0)"), ("negate", f"-({X})", "-v"), ("add", f"({X}) + 3", "v + 3"), ("subtract", f"3 - ({X})", "3 - v"), ("multiply", f"2 * ({X})", "2 * v"), ("divide", f"({X}) / 4", "v / 4"),
    ("divide_by_zero", f"({X}) / 0", "'nan'::DOUBLE"), ("modulo", f"({X}) % 7", "v % 7"), ("power", f"abs({X}) ^ 1.5", "pow(abs(v), 1.5)"), ("compare_bool", f"({X}) >= bool 1", "CASE WHEN v >= 1 THEN 1.0 ELSE 0.0 END::DOUBLE"),
):
    metric(f"metric_{fn}", q, mapped(expr))
metric("metric_compare_filter", f"({X}) < 1", mapped("v", "v < 1"))
metric("metric_compare_scalar_left", f"1 != ({X})", mapped("v", "abs(1 - v) >= 2.220446049250313e-16"))
metric("metric_label_replace", f'label_replace({X}, "short", "$1", "service", "svc-(.*)")', f"{BASE} SELECT {G_SERIES} || ',short=' || substr(svc, 5) AS series, t, round(v, 6) + 0.0 AS value FROM a")
metric("metric_label_join", f'label_join({X}, "both", "-", "service", "event_type")', f"{BASE} SELECT '__name__=event_value,both=' || svc || '-' || et || ',event_type=' || et || ',service=' || svc AS series, t, round(v, 6) + 0.0 AS value FROM a")
metric("metric_sort", f"sort_desc({X})", mapped("v"))


def grouped(agg: str, by: str, series: str) -> str:
    return f"{BASE} SELECT {series} AS series, t, round({agg}, 6) + 0.0 AS value FROM a GROUP BY {by}"


BY_SVC = "'service=' || svc"
for op, agg in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)::DOUBLE", "group": "1.0::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    metric(f"metric_{op}_by", f"{op} by (service) ({X})", grouped(agg, "svc, t", BY_SVC))
metric("metric_sum_without", f"sum without (service) ({X})", grouped("sum(v)", "et, t", "'__name__=event_value,event_type=' || et"))
metric("metric_sum_all", f"sum({X})", grouped("sum(v)", "t", "''"))
metric("metric_quantile", f"quantile by (event_type) (0.25, {X})", grouped("quantile_cont(v, 0.25)", "et, t", "'event_type=' || et"))
LAST = "z AS (SELECT svc, et, arg_max(v, t) AS last FROM a GROUP BY svc, et)"
for op, order in (("topk", "DESC"), ("bottomk", "ASC")):
    metric(f"metric_{op}", f"{op}(3, {X})", f"{BASE}, {LAST}, k AS (SELECT svc, et FROM z ORDER BY last {order}, et, svc LIMIT 3) SELECT {G_SERIES} AS series, t, round(v, 6) + 0.0 AS value FROM a JOIN k USING (svc, et)")
SUMS = f"{BASE}, b AS (SELECT svc, t, sum(v) AS v FROM a GROUP BY svc, t)"
NAMELESS = "'event_type=' || et || ',service=' || svc"
metric("metric_vector_match", f"({X}) * (({X}) + 1)", f"{BASE} SELECT {NAMELESS} AS series, t, round(v * (v + 1), 6) + 0.0 AS value FROM a")
metric("metric_on", f'sum by (service) ({X}) - on (service) sum by (service) (({X}) * 2)', f"{SUMS} SELECT {BY_SVC} AS series, t, round(v - 2 * v, 6) + 0.0 AS value FROM b")
metric("metric_group_left", f"({X}) / ignoring (event_type) group_left () sum by (service) ({X})", f"{SUMS} SELECT {NAMELESS} AS series, t, round(CASE WHEN b.v = 0 THEN 'nan'::DOUBLE ELSE a.v / b.v END, 6) + 0.0 AS value FROM a JOIN b USING (svc, t)")
metric("metric_group_right", f"sum by (service) ({X}) + on (service) group_right () ({X})", f"{SUMS} SELECT {NAMELESS} AS series, t, round(b.v + a.v, 6) + 0.0 AS value FROM a JOIN b USING (svc, t)")
PART = "a.svc IN (SELECT svc FROM a WHERE v > 20)"
metric("metric_and", f"({X}) and on (service) (({X}) > 20)", f"{BASE} SELECT {NAMELESS} AS series, t, round(v, 6) + 0.0 AS value FROM a WHERE {PART}")
metric("metric_unless", f"({X}) unless on (service, event_type) (({X}) > 40)", f"{BASE} SELECT {NAMELESS} AS series, t, round(v, 6) + 0.0 AS value FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.svc = a.svc AND b.et = a.et AND b.v > 40)")
metric("metric_or", f'(({X}) > 40) or ({X})', f"{BASE}, h AS (SELECT * FROM a WHERE v > 40) SELECT {NAMELESS} AS series, t, round(v, 6) + 0.0 AS value FROM (SELECT * FROM h UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.svc = a.svc AND h.et = a.et)) a")
metric("metric_at_modifier", f"avg_over_time(event_value[1d]) - on (service, event_type) event_value @ {AT / 1000:.0f}", f"WITH {GAUGE}, {windows()}, a AS (SELECT svc, et, t, avg(v) AS v FROM w GROUP BY svc, et, t), p AS (SELECT svc, et, arg_max(v, (ts, seq)) AS v FROM s WHERE ts BETWEEN {AT - 300_000} AND {AT} GROUP BY svc, et) SELECT {NAMELESS} AS series, t, round(a.v - p.v, 6) + 0.0 AS value FROM a JOIN p USING (svc, et)")
metric("metric_group_left_carry", f'({X}) * on (service) group_left (side) label_replace(sum by (service) ({X}), "side", "x-$1", "service", "svc-(.)")', f"{SUMS} SELECT 'event_type=' || et || ',service=' || svc || ',side=x-' || substr(svc, 5) AS series, t, round(a.v * b.v, 6) + 0.0 AS value FROM a JOIN b USING (svc, t)")
metric("metric_compare_vectors", f"({X}) > bool ignoring (event_type) group_left () avg by (service) ({X})", f"{BASE}, b AS (SELECT svc, t, avg(v) AS v FROM a GROUP BY svc, t) SELECT {NAMELESS} AS series, t, CASE WHEN a.v > b.v THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM a JOIN b USING (svc, t)")
metric("metric_sort_ascending", f"sort({X})", mapped("v"))
metric("metric_instant_rate", "sum by (service) (rate(events_total[1d]))", f"WITH {COUNTER}, w AS (SELECT s.*, lag(v) OVER p AS pv FROM s WHERE ts BETWEEN {AT - DAY} AND {AT} WINDOW p AS (PARTITION BY svc, et ORDER BY ts, seq)), r AS (SELECT svc, et, sum(CASE WHEN pv IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END) / {SPAN} AS v FROM w GROUP BY svc, et {HAVING}) SELECT {BY_SVC} AS series, {AT}::BIGINT AS t, round(sum(v), 6) + 0.0 AS value FROM r GROUP BY svc", tables.counter, AT)
metric("metric_absent", 'absent(event_value{service="none"})', f"SELECT '' AS series, {END}::BIGINT AS t, 1.0::DOUBLE AS value")
metric("metric_time", "time()", f"SELECT '' AS series, {END}::BIGINT AS t, {END} / 1000.0 AS value")
metric("metric_vector", "vector(2 ^ 10)", f"SELECT '' AS series, {END}::BIGINT AS t, 1024.0::DOUBLE AS value")
metric("metric_scalar", f'sum(event_value) * scalar(vector(2))', f"WITH {GAUGE}, {windows(300_000)}, l AS (SELECT t, arg_max(v, (ts, seq)) AS v FROM w GROUP BY svc, et, t) SELECT '' AS series, t, round(sum(v) * 2, 6) + 0.0 AS value FROM l GROUP BY t")
BOUND = "CASE WHEN isinf(le) THEN '+Inf' ELSE le::INT::VARCHAR END"
metric("metric_histogram_quantile", "histogram_quantile(0.9, last_over_time(event_value_bucket[1d]))", f"""WITH e AS (SELECT 'svc-' || (user_id % 5) AS svc, epoch_us(ts) // 1000 AS ts, event_id AS seq, value, unnest([10.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le FROM events),
c AS (SELECT svc, ts, seq, le, sum(CASE WHEN value <= le THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY svc, le ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS c FROM e), {STEPS},
l AS (SELECT svc, le, t, arg_max(c, (ts, seq)) AS c FROM g JOIN c ON ts BETWEEN t - {DAY} AND t GROUP BY svc, le, t),
n AS (SELECT *, coalesce(lag(le) OVER p, 0) AS ple, coalesce(lag(c) OVER p, 0) AS pc, 0.9 * max(c) OVER (PARTITION BY svc, t) AS target FROM l WINDOW p AS (PARTITION BY svc, t ORDER BY le)),
f AS (SELECT svc, t, arg_min(struct_pack(le := le, c := c, ple := ple, pc := pc, target := target), le) AS z FROM n WHERE c >= target AND target > 0 GROUP BY svc, t)
SELECT '__name__=event_value_bucket,service=' || svc AS series, t, round(CASE WHEN isinf(z.le) THEN z.ple WHEN z.c = z.pc THEN z.le ELSE z.ple + (z.target - z.pc) / (z.c - z.pc) * (z.le - z.ple) END, 6) + 0.0 AS value FROM f""", tables.histogram)


def register(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@register("metric_series", f"WITH {GAUGE} SELECT DISTINCT {G_SERIES} AS series FROM s WHERE svc IN ('svc-1', 'svc-2') AND ts BETWEEN {START} AND {AT}")
def metric_series(spark, sf_dir):
    m = Metrics(tables.samples(spark, sf_dir))
    return m.series(['event_value{service="svc-1"}', 'event_value{service=~"svc-[12]"}'], START, AT).select(L.text(F.col("key")).alias("series"))


@register("metric_label_values", "SELECT DISTINCT event_type AS value FROM events")
def metric_label_values(spark, sf_dir):
    return Metrics(tables.samples(spark, sf_dir)).label_values("event_type")


@register("metric_label_names", "SELECT unnest(['__name__', 'event_type', 'service']) AS name")
def metric_label_names(spark, sf_dir):
    return Metrics(tables.samples(spark, sf_dir)).label_names()


# ---- logs -------------------------------------------------------------------------------------------------------------

LINES = "s AS (SELECT 'svc-' || (user_id % 5) AS svc, event_type AS et, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, epoch_us(ts) * 1000 AS ts_ns, props AS line, event_id AS ingest_seq, 'event=' || event_type || ' user=' || user_id || ' value=' || round(value, 2) AS logfmt, round(value, 2) AS val, user_id FROM events)"
S_NS, E_NS = START * NS, END * NS
STREAM = "'event_type=' || et || ',level=' || level || ',service=' || svc"


def stream(name: str, query: str, cond: str, limit: int | None = None, table: Callable = tables.logs) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Logs(table(spark, sf_dir), ("service", "level")).streams(query, S_NS, E_NS, limit)
        return out.select(L.text(F.col("key")).alias("stream"), "ts_ns", "line", "ingest_seq")

    line = "logfmt" if table is tables.logfmt_logs else "line"
    QUERIES[name] = run
    ORACLES[name] = f"WITH {LINES} SELECT {STREAM} AS stream, ts_ns, {line} AS line, ingest_seq FROM s WHERE ts_ns BETWEEN {S_NS} AND {E_NS} AND {cond}" + (f" ORDER BY ts_ns DESC, ingest_seq DESC LIMIT {limit}" if limit else "")


stream("log_selector", '{service="svc-1",level!="info"}', "svc = 'svc-1' AND level <> 'info'")
stream("log_regex_selector", '{service=~"svc-[12]",event_type!~"c.*"}', "svc IN ('svc-1', 'svc-2') AND et NOT LIKE 'c%'")
stream("log_contains", '{service="svc-1"} |= "7" != "77"', "svc = 'svc-1' AND contains(line, '7') AND NOT contains(line, '77')")
stream("log_line_regex", '{service="svc-1"} |~ "1[0-4]" !~ "3}$"', "svc = 'svc-1' AND regexp_matches(line, '1[0-4]') AND NOT regexp_matches(line, '3}$')")
stream("log_json_compare", '{level="error"} | json | k >= 50', "level = 'error' AND json_extract_string(line, '$.k')::DOUBLE >= 50")
stream("log_json_equal", '{level="error"} | json | k = "7"', "level = 'error' AND json_extract_string(line, '$.k') = '7'")
stream("log_logfmt", '{level="warn"} | logfmt | value > 100 | user != "3"', "level = 'warn' AND val > 100 AND user_id <> 3", table=tables.logfmt_logs)
stream("log_regexp_stage", '{level="warn"} | regexp "user=(?P<u>[0-9]+)" | u =~ "^1.$"', "level = 'warn' AND user_id BETWEEN 10 AND 19", table=tables.logfmt_logs)
stream("log_missing_label", '{level="warn"} | nothing != "x"', "false")
stream("log_limit", '{level="error"}', "level = 'error'", 50)


def log_metric(name: str, query: str, agg: str, cond: str, dense: bool = True, table: Callable = tables.logs) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Logs(table(spark, sf_dir), ("service", "level")).matrix(query, S_NS, E_NS, STEP * NS)
        return rounded(out.select(L.text(F.col("key")).alias("series"), "t", "value"))

    sel, rest = cond.split(" | ") if " | " in cond else (cond, "true")
    QUERIES[name] = run
    ORACLES[name] = f"""WITH {LINES}, g AS (SELECT unnest(generate_series({S_NS}, {E_NS}, {STEP * NS})) AS t), k AS (SELECT DISTINCT svc, et, level FROM s WHERE {sel}),
w AS (SELECT s.*, t FROM g JOIN s ON ts_ns BETWEEN t - {DAY * NS} AND t WHERE {sel} AND {rest}), r AS (SELECT svc, et, level, t, {agg} AS value FROM w GROUP BY ALL)
SELECT {STREAM} AS series, t, round({'coalesce(value, 0)' if dense else 'value'}, 6) + 0.0 AS value FROM {'k CROSS JOIN g LEFT JOIN r USING (svc, et, level, t)' if dense else 'r'}"""


K = "json_extract_string(line, '$.k')::DOUBLE"
log_metric("log_count_over_time", 'count_over_time({service="svc-1"} |= "7" [1d])', "count(*)::DOUBLE", "svc = 'svc-1' | contains(line, '7')")
log_metric("log_rate", 'rate({level="error"}[1d])', "count(*) / 86400.0", "level = 'error'")
log_metric("log_bytes_over_time", 'bytes_over_time({level="error"}[1d])', "sum(strlen(line))::DOUBLE", "level = 'error'")
log_metric("log_sum_over_time", 'sum_over_time({service="svc-1"} | json | unwrap k [1d])', f"sum({K})", "svc = 'svc-1'")
log_metric("log_avg_over_time", 'avg_over_time({service="svc-1"} | json | unwrap k [1d])', f"avg({K})", "svc = 'svc-1'")
log_metric("log_min_over_time", 'min_over_time({service="svc-1"} | json | unwrap k [1d])', f"min({K})", "svc = 'svc-1'", False)
log_metric("log_max_over_time", 'max_over_time({service="svc-1"} | json | k < 90 | unwrap k [1d])', f"max({K})", f"svc = 'svc-1' | {K} < 90", False)


@register("log_label_values", "SELECT DISTINCT CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS value FROM events")
def log_label_values(spark, sf_dir):
    return Logs(tables.logs(spark, sf_dir)).label_values("level")


@register("log_label_names", "SELECT unnest(['event_type', 'level', 'service']) AS name")
def log_label_names(spark, sf_dir):
    return Logs(tables.logs(spark, sf_dir)).label_names()


# ---- traces -----------------------------------------------------------------------------------------------------------

TREE = """sp AS (SELECT lpad(lower(to_hex(o_orderkey)), 32, '0') AS trace_id, lpad(lower(to_hex(o_orderkey * 16)), 16, '0') AS span_id, NULL::VARCHAR AS parent, 'order' AS name, 'orders' AS service, epoch_us(o_orderdate) * 1000 AS start_ns,
  (floor(o_totalprice) * 1000000)::BIGINT AS dur, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'ok' ELSE 'unset' END AS status, 2 AS kind, NULL::BIGINT AS qty, o_orderpriority AS prio, o_orderkey * 16 AS seq FROM orders
UNION ALL SELECT lpad(lower(to_hex(l_orderkey)), 32, '0'), lpad(lower(to_hex(l_orderkey * 16 + l_linenumber)), 16, '0'), lpad(lower(to_hex(CASE WHEN l_linenumber <= 2 THEN l_orderkey * 16 ELSE l_orderkey * 16 + l_linenumber - 1 END)), 16, '0'), 'ship', 'supplier-' || (l_suppkey % 5),
  epoch_us(l_shipdate) * 1000, (floor(l_quantity) * 1000000)::BIGINT, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'ok' ELSE 'unset' END, 3, floor(l_quantity)::BIGINT, NULL, l_orderkey * 16 + l_linenumber FROM lineitem)"""


def trace(name: str, query: str, cond: str = "", sql: str = "", distinct: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Traces(tables.spans(spark, sf_dir)).query(query)
        return out.select("trace_id", "span_id") if distinct else out.select("trace_id", "span_id", "name", "service", "duration_ns")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {TREE}{sql}" if sql else f"WITH {TREE} SELECT trace_id, span_id, name, service, dur AS duration_ns FROM sp WHERE {cond}"


trace("trace_attribute", '{ resource.service.name = "supplier-1" }', "service = 'supplier-1'")
trace("trace_and_or", '{ status = error && duration > 40ms || name = "order" && kind = server }', "(status = 'error' AND dur > 40000000) OR (name = 'order' AND kind = 2)")
trace("trace_name_regex", '{ name =~ "or.er" && status != ok }', "name = 'order' AND status <> 'ok'")
trace("trace_number_attribute", '{ span.quantity >= 45 && span.quantity != 47 }', "qty >= 45 AND qty <> 47")
trace("trace_absent_attribute", '{ span.priority != "1-URGENT" && name = "ship" }', "name = 'ship'")
trace("trace_event", '{ event.name = "exception" && event.exception.type = "Returned" }', "name = 'ship' AND status = 'error'")
trace("trace_all", "{ }", "true")
L_ERR = "name = 'order' AND status = 'error'"
trace("trace_child", '{ name = "order" && status = error } > { status = error }', sql=f" SELECT DISTINCT b.trace_id, b.span_id FROM sp b JOIN sp a ON a.trace_id = b.trace_id AND b.parent = a.span_id WHERE a.name = 'order' AND a.status = 'error' AND b.status = 'error'", distinct=True)
trace("trace_descendant", '{ name = "order" && status = error } >> { name = "ship" }', sql=" ", distinct=True)
ORACLES["trace_descendant"] = f"WITH RECURSIVE {TREE}, d AS (SELECT trace_id, span_id FROM sp WHERE {L_ERR} UNION SELECT sp.trace_id, sp.span_id FROM sp JOIN d ON sp.trace_id = d.trace_id AND sp.parent = d.span_id) SELECT DISTINCT trace_id, span_id FROM d JOIN sp USING (trace_id, span_id) WHERE name = 'ship'"
trace("trace_sibling", '{ name = "ship" && status = ok } ~ { status = error }', sql=" SELECT DISTINCT b.trace_id, b.span_id FROM sp b JOIN sp a ON a.trace_id = b.trace_id AND a.parent IS NOT DISTINCT FROM b.parent AND a.span_id <> b.span_id WHERE a.name = 'ship' AND a.status = 'ok' AND b.status = 'error'", distinct=True)
M = ", m AS (SELECT * FROM sp WHERE status = 'error'), t AS (SELECT trace_id FROM m GROUP BY trace_id HAVING {}) SELECT trace_id, span_id, name, service, dur AS duration_ns FROM m JOIN t USING (trace_id)"
trace("trace_count_stage", "{ status = error } | count() > 3", sql=M.format("count(*) > 3"))
trace("trace_duration_stages", "{ status = error } | avg(duration) > 1s | max(duration) >= 20s | min(duration) < 40ms", sql=M.format("sum(dur)::HUGEINT // count(*) > 1000000000 AND max(dur) >= 20000000000 AND min(dur) < 40000000"))
SUMMARY = "SELECT trace_id, arg_min(name, (parent IS NOT NULL, CASE WHEN parent IS NULL THEN seq ELSE start_ns END, seq)) AS root_name, min(start_ns) AS start_ns, max(start_ns + dur) - min(start_ns) AS duration_ns, count(*) AS span_count, count(*) FILTER (WHERE status = 'error') AS error_count FROM sp GROUP BY trace_id"


@register("trace_search", f"WITH {TREE}, m AS (SELECT trace_id, count(*) AS matched FROM sp WHERE status = 'error' AND qty > 48 GROUP BY trace_id ORDER BY trace_id LIMIT 100), u AS ({SUMMARY}) SELECT trace_id, root_name, start_ns, duration_ns, span_count, error_count, matched FROM u JOIN m USING (trace_id)")
def trace_search(spark, sf_dir):
    out = Traces(tables.spans(spark, sf_dir)).search("{ status = error && span.quantity > 48 }", limit=100)
    return out.select("trace_id", "root_name", "start_ns", "duration_ns", "span_count", "error_count", "matched")


@register("trace_recent", f"WITH {TREE}, u AS ({SUMMARY}) SELECT trace_id, root_name, start_ns, duration_ns, span_count, error_count FROM u ORDER BY start_ns DESC, trace_id LIMIT 20")
def trace_recent(spark, sf_dir):
    return Traces(tables.spans(spark, sf_dir)).search().select("trace_id", "root_name", "start_ns", "duration_ns", "span_count", "error_count")


@register("trace_operations", f"WITH {TREE} SELECT service, name, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS errors FROM sp GROUP BY service, name")
def trace_operations(spark, sf_dir):
    return Traces(tables.spans(spark, sf_dir)).operations()


@register("trace_exceptions", f"WITH {TREE} SELECT trace_id, span_id FROM sp WHERE name = 'ship' AND status = 'error'")
def trace_exceptions(spark, sf_dir):
    return Traces(tables.spans(spark, sf_dir)).with_exceptions().select("trace_id", "span_id")


# ---- reports and retention --------------------------------------------------------------------------------------------


def reports(spark: SparkSession, sf_dir: str) -> Reports:
    return Reports(tables.logs(spark, sf_dir), tables.samples(spark, sf_dir), tables.spans(spark, sf_dir))


NAMES = "n AS (SELECT DISTINCT service FROM sp UNION SELECT DISTINCT svc FROM s)"
PER = "pt AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS bad FROM sp GROUP BY trace_id), ps AS (SELECT service, sum(n) AS spans, sum(bad) AS bad FROM (SELECT DISTINCT service, trace_id FROM sp) JOIN pt USING (trace_id) GROUP BY service)"


@register("report_services", f"WITH {TREE}, {LINES} SELECT DISTINCT svc AS name, 'logs,metrics' AS signals FROM s UNION ALL SELECT DISTINCT service, 'traces' FROM sp")
def report_services(spark, sf_dir):
    return reports(spark, sf_dir).services().select("name", F.array_join("signals", ",").alias("signals"))


@register("report_status", f"WITH {TREE}, {LINES} SELECT (SELECT count(*) FROM s) AS log_entries, (SELECT count(DISTINCT (svc, et)) FROM s) AS log_streams, (SELECT count(*) FROM s) AS samples, (SELECT count(DISTINCT (svc, et)) FROM s) AS series, (SELECT count(*) FROM sp) AS spans, (SELECT count(DISTINCT trace_id) FROM sp) AS traces, (SELECT count(*) FROM (SELECT DISTINCT svc FROM s UNION SELECT DISTINCT service FROM sp)) AS services")
def report_status(spark, sf_dir):
    return reports(spark, sf_dir).status()


@register("report_catalog", "SELECT 'metric' AS kind, 'event_value' AS name UNION ALL SELECT 'log_label', unnest(['event_type', 'level', 'service'])")
def report_catalog(spark, sf_dir):
    return reports(spark, sf_dir).catalog("svc-1")


@register("report_health", f"WITH {TREE}, {LINES}, {NAMES}, {PER}, er AS (SELECT svc AS service, count(*) AS errors FROM s WHERE level = 'error' GROUP BY svc) SELECT service, coalesce(errors, 0) AS errors, round(coalesce(bad / spans, 0), 6) + 0.0 AS span_error_ratio, round(greatest(0, 100 - least(coalesce(bad / spans, 0) * 30, 30) - least(coalesce(errors, 0), 40)), 6) + 0.0 AS health FROM n LEFT JOIN er USING (service) LEFT JOIN ps USING (service)")
def report_health(spark, sf_dir):
    t = reports(spark, sf_dir).check_health()
    return t.select("service", "errors", (F.round("span_error_ratio", 6) + 0.0).alias("span_error_ratio"), (F.round("health", 6) + 0.0).alias("health"))


@register("report_diagnose_all", f"WITH {TREE}, {LINES}, {NAMES}, {PER}, er AS (SELECT svc AS service, count(*) FILTER (WHERE level = 'error') * 100.0 / count(*) AS pc FROM s WHERE ts_ns BETWEEN {NOW_NS - 3_600_000_000_000} AND {NOW_NS} GROUP BY svc) SELECT service, round(coalesce(pc, 0), 6) + 0.0 AS error_percent, round(coalesce(bad / spans, 0), 6) + 0.0 AS span_error_ratio, round(greatest(0, 100 - least(coalesce(pc, 0), 40) - least(coalesce(bad / spans, 0) * 30, 30)), 6) + 0.0 AS health, CASE WHEN pc > 10 THEN 'High log error rate: ' || printf('%.1f', pc) WHEN bad / spans > 0.1 THEN 'Span error ratio: ' || printf('%.1f', bad / spans * 100) WHEN pc > 0 THEN 'Log error rate: ' || printf('%.1f', pc) WHEN bad > 0 THEN 'Span error ratio: ' || printf('%.1f', bad / spans * 100) ELSE 'No issues detected' END || CASE WHEN pc > 0 OR bad > 0 THEN '%' ELSE '' END AS top_issue FROM n LEFT JOIN er USING (service) LEFT JOIN ps USING (service)")
def report_diagnose_all(spark, sf_dir):
    t = reports(spark, sf_dir).diagnose_all(NOW_NS)
    return t.select("service", *[(F.round(c, 6) + 0.0).alias(c) for c in ("error_percent", "span_error_ratio", "health")], "top_issue")


@register("report_slowest", f"WITH {TREE}, tt AS (SELECT DISTINCT trace_id FROM sp WHERE service = 'supplier-1'), u AS ({SUMMARY.replace('FROM sp', 'FROM sp JOIN tt USING (trace_id)')}) SELECT trace_id, duration_ns, span_count FROM u ORDER BY duration_ns DESC, trace_id LIMIT 5")
def report_slowest(spark, sf_dir):
    return reports(spark, sf_dir).slowest("supplier-1").select("trace_id", "duration_ns", "span_count")


@register("report_latency", f"WITH {TREE}, tt AS (SELECT DISTINCT trace_id FROM sp WHERE service = 'supplier-1'), u AS ({SUMMARY.replace('FROM sp', 'FROM sp JOIN tt USING (trace_id)')}) SELECT count(*) AS traces, sum(span_count)::BIGINT AS spans, sum(error_count)::BIGINT AS error_spans, quantile_disc(duration_ns, 0.99) AS p99_ns FROM u")
def report_latency(spark, sf_dir):
    return reports(spark, sf_dir).latency("supplier-1")


@register("report_recent_errors", f"WITH {LINES} SELECT ts_ns, line, ingest_seq FROM s WHERE svc = 'svc-1' AND level = 'error' ORDER BY ts_ns DESC, ingest_seq DESC LIMIT 20")
def report_recent_errors(spark, sf_dir):
    return reports(spark, sf_dir).recent_errors("svc-1", NOW_NS, 20, None)


@register("report_key_metrics", f"WITH {GAUGE}, r AS (SELECT *, row_number() OVER (PARTITION BY svc, et ORDER BY ts DESC, seq DESC) AS n FROM s WHERE svc = 'svc-1') SELECT {G_SERIES} AS series, string_agg(v::VARCHAR, ',' ORDER BY ts, seq) AS points FROM r WHERE n <= 10 GROUP BY svc, et")
def report_key_metrics(spark, sf_dir):
    t = reports(spark, sf_dir).key_metrics("svc-1")
    return t.select("series", F.array_join(F.transform("points", lambda x: x.cast("string")), ",").alias("points"))


@register("retention_by_age", f"WITH {LINES} SELECT ts_ns, ingest_seq FROM s WHERE ts_ns >= {AT * NS}")
def retention_by_age(spark, sf_dir):
    return retention.by_age(tables.logs(spark, sf_dir), "ts_ns", AT * NS).select("ts_ns", "ingest_seq")


@register("retention_cap_logs", f"WITH {LINES}, per AS (SELECT svc, et, count(*) AS n, min(ts_ns) AS f FROM s GROUP BY svc, et), c AS (SELECT svc, et, least(n, greatest(0, (SELECT count(*) FROM s) - 700 - coalesce(sum(n) OVER (ORDER BY f, et, svc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS gone FROM per), r AS (SELECT *, row_number() OVER (PARTITION BY svc, et ORDER BY ts_ns, ingest_seq) AS i FROM s) SELECT ts_ns, ingest_seq FROM r JOIN c USING (svc, et) WHERE i > gone")
def retention_cap_logs(spark, sf_dir):
    return retention.cap_logs(tables.logs(spark, sf_dir), 700).select("ts_ns", "ingest_seq")


@register("retention_cap_series", f"WITH {GAUGE}, k AS (SELECT svc, et FROM s GROUP BY svc, et ORDER BY min(ts) DESC LIMIT 7) SELECT ts AS ts_ms, seq AS ingest_seq FROM s JOIN k USING (svc, et)")
def retention_cap_series(spark, sf_dir):
    return retention.cap_series(tables.samples(spark, sf_dir), 7).select("ts_ms", "ingest_seq")


@register("retention_cap_spans", f"WITH {TREE}, per AS (SELECT trace_id, count(*) AS n, min(start_ns) AS f FROM sp GROUP BY trace_id), b AS (SELECT trace_id, coalesce(sum(n) OVER (ORDER BY f, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per) SELECT trace_id, span_id FROM sp JOIN b USING (trace_id) WHERE before >= (SELECT count(*) FROM sp) - 5000")
def retention_cap_spans(spark, sf_dir):
    return retention.cap_spans(tables.spans(spark, sf_dir), 5000).select("trace_id", "span_id")


@register("retention_reset_service", f"WITH {LINES} SELECT ts_ns, ingest_seq FROM s WHERE svc <> 'svc-1'")
def retention_reset_service(spark, sf_dir):
    return retention.without_service(tables.logs(spark, sf_dir), "svc-1").select("ts_ns", "ingest_seq")


SUMS_OF = "SELECT count(*) FILTER (WHERE level = 'error') AS errors, count(*) AS entries FROM s WHERE svc = 'svc-1' AND ingest_seq >= {0}"


@register("report_activity", f"WITH {TREE}, {LINES}, l AS ({SUMS_OF.format(100)}) SELECT 'svc-1' AS service, errors, entries, 0::BIGINT AS failing_traces, 0::BIGINT AS traces, 0.0::DOUBLE AS span_error_ratio, 100.0 - least(errors, 40) AS health, errors || ' error log(s), 0 failing trace(s), health ' || (100 - least(errors, 40)) AS summary FROM l")
def report_activity(spark, sf_dir):
    return reports(spark, sf_dir).activity("svc-1", 100)


@register("report_activity_of_spans", f"WITH {TREE}, p AS (SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS bad FROM sp WHERE seq >= 4000 AND trace_id IN (SELECT trace_id FROM sp WHERE service = 'supplier-1') GROUP BY trace_id) SELECT count(*) FILTER (WHERE bad > 0) AS failing_traces, count(*) AS traces, round(sum(bad) / sum(n), 6) AS span_error_ratio, round(100 - least(sum(bad) / sum(n) * 30, 30), 6) AS health FROM p")
def report_activity_of_spans(spark, sf_dir):
    t = reports(spark, sf_dir).activity("supplier-1", 4000)
    return t.select("failing_traces", "traces", F.round("span_error_ratio", 6).alias("span_error_ratio"), F.round("health", 6).alias("health"))


@register("report_describe", f"WITH {LINES}, p AS (SELECT DISTINCT unnest(['event_type', 'level', 'service']) AS label, unnest([et, level, svc]) AS value FROM s WHERE svc = 'svc-1') SELECT label, string_agg(value, ',' ORDER BY value) AS shown, count(*) > 50 AS truncated FROM p GROUP BY label")
def report_describe(spark, sf_dir):
    return reports(spark, sf_dir).describe("svc-1").select("label", F.array_join("values", ",").alias("shown"), "truncated")


KINDS = "SELECT unnest(['event_size_bucket', 'event_size_count', 'event_size_sum', 'event_most', 'event_most_count', 'event_most_sum', 'event_value', 'event_size']) AS metric"


@register("report_metadata", f"WITH m AS ({KINDS}) SELECT metric, CASE metric WHEN 'event_size' THEN 'histogram' WHEN 'event_most' THEN 'summary' WHEN 'event_value' THEN 'gauge' ELSE 'unknown' END AS type, '' AS help, '' AS unit FROM m")
def report_metadata(spark, sf_dir):
    samples, metadata = ingest.export_metrics(requests.export_metrics(spark, sf_dir))
    return Reports(tables.logs(spark, sf_dir), samples, tables.spans(spark, sf_dir)).metadata(metadata)


@register("report_describe_metrics", f"WITH m AS ({KINDS}) SELECT metric, CASE metric WHEN 'event_most' THEN 'summary' WHEN 'event_value' THEN 'gauge' END AS type FROM m WHERE metric <> 'event_size'")
def report_describe_metrics(spark, sf_dir):
    samples, metadata = ingest.export_metrics(requests.export_metrics(spark, sf_dir))
    return Reports(tables.logs(spark, sf_dir), samples, tables.spans(spark, sf_dir)).describe_metrics("svc-1", metadata).select("metric", "type")


@register("retention_metadata", "SELECT unnest(['event_value', 'event_most']) AS metric")
def retention_metadata(spark, sf_dir):
    samples, metadata = ingest.export_metrics(requests.export_metrics(spark, sf_dir))
    return retention.prune_metadata(metadata, samples).select("metric")


@register("report_error_rate", f"WITH {LINES} SELECT svc AS service, count(*) AS total, count(*) FILTER (WHERE level = 'error') AS errors FROM s WHERE ts_ns BETWEEN {NOW_NS - 3_600_000_000_000} AND {NOW_NS} GROUP BY svc")
def report_error_rate(spark, sf_dir):
    return reports(spark, sf_dir).error_rate(NOW_NS).select("service", "total", "errors")


@register("report_error_trend", f"WITH {LINES}, c AS (SELECT count(*) FILTER (WHERE ts_ns BETWEEN {NOW_NS - 300_000_000_000} AND {NOW_NS}) AS recent, count(*) FILTER (WHERE ts_ns BETWEEN {NOW_NS - 600_000_000_000} AND {NOW_NS - 300_000_000_000}) AS before FROM s WHERE svc = 'svc-1' AND level = 'error') SELECT *, CASE WHEN recent > before THEN 'increasing' WHEN recent < before THEN 'decreasing' ELSE 'stable' END AS direction FROM c")
def report_error_trend(spark, sf_dir):
    return reports(spark, sf_dir).error_trend("svc-1", NOW_NS)


@register("report_diagnose", f"WITH {TREE}, tt AS (SELECT DISTINCT trace_id FROM sp WHERE service = 'supplier-1'), u AS ({SUMMARY.replace('FROM sp', 'FROM sp JOIN tt USING (trace_id)')}), a AS (SELECT sum(error_count) / sum(span_count) AS ratio, quantile_disc(duration_ns, 0.99) / 1e6 AS p99 FROM u) SELECT 'supplier-1' AS service, 0.0::DOUBLE AS error_percent, round(ratio, 6) AS span_error_ratio, round(p99, 3) AS p99_ms, 'stable' AS direction, round(greatest(0, 100 - least(ratio * 30, 30) - CASE WHEN p99 > 1000 THEN least((p99 - 1000) / 1000 * 10, 20) ELSE 0 END), 6) AS health FROM a")
def report_diagnose(spark, sf_dir):
    t = reports(spark, sf_dir).diagnose("supplier-1", NOW_NS)
    return t.select("service", "error_percent", F.round("span_error_ratio", 6).alias("span_error_ratio"), F.round("p99_ms", 3).alias("p99_ms"), "direction", F.round("health", 6).alias("health"))


@register("report_failing_traces", f"WITH {TREE}, tt AS (SELECT DISTINCT trace_id FROM sp WHERE service = 'supplier-1' AND status = 'error'), u AS ({SUMMARY.replace('FROM sp', 'FROM sp JOIN tt USING (trace_id)')}) SELECT trace_id, root_name, duration_ns, error_count FROM u ORDER BY duration_ns DESC, trace_id LIMIT 20")
def report_failing_traces(spark, sf_dir):
    return reports(spark, sf_dir).failing_traces("supplier-1").select("trace_id", "root_name", "duration_ns", "error_count")


@register("report_notable_metrics", f"WITH {GAUGE} SELECT '__name__=event_duration,event_type=' || et || ',service=' || svc AS series, max(ts) AS ts_ms, arg_max(v, (ts, seq)) AS value FROM s WHERE svc = 'svc-1' GROUP BY svc, et")
def report_notable_metrics(spark, sf_dir):
    named = tables.samples(spark, sf_dir).withColumns({"metric": F.lit("event_duration"), "key": L.put(F.col("key"), L.NAME, F.lit("event_duration"))})
    return Reports(tables.logs(spark, sf_dir), named, tables.spans(spark, sf_dir)).notable_metrics("svc-1")


@register("report_query_logs", f"WITH {LINES}, m AS (SELECT *, count(*) OVER () AS total FROM s WHERE svc = 'svc-1' AND level = 'error' AND contains(line, '7')) SELECT ts_ns, ingest_seq, total, total > 10 AS truncated FROM m ORDER BY ts_ns DESC, ingest_seq DESC LIMIT 10")
def report_query_logs(spark, sf_dir):
    rows, total, truncated = reports(spark, sf_dir).query_logs("svc-1", "error", "7", limit=10)
    return rows.select("ts_ns", "ingest_seq", F.lit(total).cast("long").alias("total"), F.lit(truncated).alias("truncated"))


@register("report_query_traces", f"WITH {TREE}, m AS (SELECT DISTINCT trace_id FROM sp WHERE service = 'supplier-1' AND status = 'error' AND dur > 30000000 AND name = 'ship'), u AS ({SUMMARY.replace('FROM sp', 'FROM sp JOIN m USING (trace_id)')}) SELECT trace_id, root_name, duration_ns, error_count, (SELECT count(*) FROM m) AS total FROM u ORDER BY trace_id LIMIT 30")
def report_query_traces(spark, sf_dir):
    rows, total, _ = reports(spark, sf_dir).query_traces("supplier-1", "ship", "error", "30ms", limit=30)
    return rows.select("trace_id", "root_name", "duration_ns", "error_count", F.lit(total).cast("long").alias("total"))


@register("trace_levels", f"WITH RECURSIVE {TREE}, d AS (SELECT trace_id, span_id, span_id AS root, 0 AS depth FROM sp WHERE NOT EXISTS (SELECT 1 FROM sp p WHERE p.trace_id = sp.trace_id AND p.span_id = sp.parent) UNION SELECT sp.trace_id, sp.span_id, d.root, d.depth + 1 FROM sp JOIN d ON sp.trace_id = d.trace_id AND sp.parent = d.span_id) SELECT * FROM d")
def trace_levels(spark, sf_dir):
    return Traces(tables.spans(spark, sf_dir)).levels()


A_TRACE = "SELECT * FROM sp WHERE trace_id = lpad('2a', 32, '0')"


@register("trace_waterfall", f"WITH RECURSIVE {TREE}, o AS ({A_TRACE}), d AS (SELECT span_id, 0 AS depth FROM o WHERE parent IS NULL OR parent NOT IN (SELECT span_id FROM o) UNION SELECT o.span_id, d.depth + 1 FROM o JOIN d ON o.parent = d.span_id) SELECT span_id, name, start_ns - (SELECT min(start_ns) FROM o) AS offset_ns, dur AS duration_ns, depth FROM o JOIN d USING (span_id)")
def trace_waterfall(spark, sf_dir):
    return Traces(tables.spans(spark, sf_dir)).waterfall("2a".rjust(32, "0")).select("span_id", "name", "offset_ns", "duration_ns", "depth")


@register("trace_slowest", f"WITH {TREE}, m AS (SELECT trace_id, count(*) AS matched FROM sp WHERE status = 'error' AND qty > 48 GROUP BY trace_id ORDER BY trace_id LIMIT 100), u AS ({SUMMARY}) SELECT trace_id, duration_ns FROM u JOIN m USING (trace_id) ORDER BY duration_ns DESC, trace_id LIMIT 20")
def trace_slowest(spark, sf_dir):
    t = Traces(tables.spans(spark, sf_dir))
    return t.ordered(t.search("{ status = error && span.quantity > 48 }", limit=100), "slowest").select("trace_id", "duration_ns").limit(20)


@register("trace_by_id", f"WITH {TREE} SELECT trace_id, span_id, parent AS parent_span_id, name FROM sp WHERE trace_id = lpad('{{0}}', 32, '0')".replace("{0}", "2a"))
def trace_by_id(spark, sf_dir):
    return Traces(tables.spans(spark, sf_dir)).trace("2A".rjust(32, "0")).select("trace_id", "span_id", "parent_span_id", "name")


# ---- readers ----------------------------------------------------------------------------------------------------------

PUSHED = f"WITH {LINES} SELECT {STREAM} AS stream, ts_ns, line FROM s"
EXPORTED = f"WITH {LINES} SELECT {STREAM} AS stream, ts_ns, line, lpad(lower(to_hex(ingest_seq + 1)), 32, '0') AS trace_id, CASE level WHEN 'error' THEN 17 WHEN 'warn' THEN 13 ELSE 9 END AS severity_number FROM s"


@register("ingest_push", PUSHED)
def ingest_push(spark, sf_dir):
    return ingest.push(requests.push(spark, sf_dir)).select(L.text(F.col("key")).alias("stream"), "ts_ns", "line")


@register("ingest_export_logs", EXPORTED)
def ingest_export_logs(spark, sf_dir):
    return ingest.export_logs(requests.export_logs(spark, sf_dir)).select(L.text(F.col("key")).alias("stream"), "ts_ns", "line", "trace_id", "severity_number")


@register("ingest_export_logs_binary", EXPORTED)
def ingest_export_logs_binary(spark, sf_dir):
    binary = wire.encoded(requests.export_logs(spark, sf_dir), "export_logs", "gzip")
    return ingest.export_logs(wire.decoded(binary, "export_logs")).select(L.text(F.col("key")).alias("stream"), "ts_ns", "line", "trace_id", "severity_number")


POINTS = f"""WITH e AS (SELECT 'svc-' || (user_id % 5) AS svc, event_type AS et, epoch_us(ts) AS us, value, floor(value) AS v FROM events),
d AS (SELECT svc, us // 86400000000 * 86400000 AS ts_ms, unnest([{', '.join(map(str, tables.BOUNDS))}, 'inf'::DOUBLE]) AS le, list(v) AS vs FROM e GROUP BY svc, us // 86400000000),
h AS (SELECT svc, us // 86400000000 * 86400000 AS ts_ms, sum(v) AS total, count(*)::DOUBLE AS n, max(v) AS most FROM e GROUP BY ALL)
SELECT '__name__=event_value,event_type=' || et || ',service=' || svc AS series, us // 1000 AS ts_ms, value FROM e
UNION ALL SELECT '__name__=event_size_bucket,le=' || {BOUND} || ',service=' || svc, ts_ms, len(list_filter(vs, lambda x: x <= le))::DOUBLE FROM d
UNION ALL SELECT '__name__=' || unnest(['event_size_sum', 'event_most_sum']) || ',service=' || svc, ts_ms, total FROM h
UNION ALL SELECT '__name__=' || unnest(['event_size_count', 'event_most_count']) || ',service=' || svc, ts_ms, n FROM h
UNION ALL SELECT '__name__=event_most,quantile=1,service=' || svc, ts_ms, most FROM h"""


@register("ingest_export_metrics", POINTS)
def ingest_export_metrics(spark, sf_dir):
    return ingest.export_metrics(requests.export_metrics(spark, sf_dir))[0].select(L.text(F.col("key")).alias("series"), "ts_ms", "value")


@register("ingest_export_metrics_binary", POINTS)
def ingest_export_metrics_binary(spark, sf_dir):
    binary = wire.encoded(requests.export_metrics(spark, sf_dir), "export_metrics", "gzip")
    return ingest.export_metrics(wire.decoded(binary, "export_metrics"))[0].select(L.text(F.col("key")).alias("series"), "ts_ms", "value")


@register("ingest_metadata", "SELECT unnest(['event_value', 'event_size', 'event_most']) AS metric, unnest(['gauge', 'histogram', 'summary']) AS type, unnest(['event.value', 'event.size', 'event.most']) AS source_name")
def ingest_metadata(spark, sf_dir):
    metadata = ingest.export_metrics(requests.export_metrics(spark, sf_dir))[1]
    return ingest.upsert_metadata(metadata, metadata.withColumn("type", F.lit("unknown"))).select("metric", "type", "source_name")


@register("ingest_name_collisions", "SELECT unnest(['event_value', 'event_size', 'event_most']) AS metric, 2::BIGINT AS n")
def ingest_name_collisions(spark, sf_dir):
    metadata = ingest.export_metrics(requests.export_metrics(spark, sf_dir))[1]
    return ingest.name_collisions(metadata, metadata.withColumn("source_name", F.col("metric")))


SPANNED = f"WITH {TREE} SELECT trace_id, span_id, parent AS parent_span_id, name, service, start_ns, dur AS duration_ns, status, kind, coalesce(qty::VARCHAR, prio) AS attribute FROM sp WHERE trace_id <> repeat('0', 32)"  # zero is no id


def exported_spans(rows: DataFrame) -> DataFrame:
    own = F.get(F.filter("attributes", lambda a: a["key"].isin("span.quantity", "span.priority")), F.lit(0))["value"]["rendered"]
    return rows.select("trace_id", "span_id", "parent_span_id", "name", "service", "start_ns", "duration_ns", "status", "kind", own.alias("attribute"))


@register("ingest_export_traces", SPANNED)
def ingest_export_traces(spark, sf_dir):
    return exported_spans(ingest.export_traces(requests.export_traces(spark, sf_dir)))


@register("ingest_export_traces_binary", SPANNED)
def ingest_export_traces_binary(spark, sf_dir):
    binary = wire.encoded(requests.export_traces(spark, sf_dir), "export_traces")
    return exported_spans(ingest.export_traces(wire.decoded(binary, "export_traces")))


@register("ingest_remote_write", f"WITH {GAUGE} SELECT {G_SERIES} AS series, ts AS ts_ms, v AS value FROM s")
def ingest_remote_write(spark, sf_dir):
    binary = wire.encoded(requests.write_requests(spark, sf_dir), "write_request", "snappy")
    return ingest.remote_write(binary).select(L.text(F.col("key")).alias("series"), "ts_ms", "value")


# ---- stores and streams -----------------------------------------------------------------------------------------------


@register("store_logs", f"WITH {LINES} SELECT {STREAM} AS stream, ts_ns, line, ingest_seq FROM s")
def store_logs(spark, sf_dir):
    root = shared_path(spark, "store")
    store.append(tables.logs(spark, sf_dir), root, "logs")
    return store.load(spark, root, "logs").select(L.text(F.col("key")).alias("stream"), "ts_ns", "line", "ingest_seq")


@register("store_samples", f"WITH {GAUGE} SELECT {G_SERIES} AS series, ts AS ts_ms, v AS value FROM s")
def store_samples(spark, sf_dir):
    root = shared_path(spark, "store")
    store.append(tables.samples(spark, sf_dir), root, "samples")
    return store.load(spark, root, "samples").select(L.text(F.col("key")).alias("series"), "ts_ms", "value")


@register("store_snapshot", f"WITH {TREE} SELECT trace_id, span_id FROM sp WHERE status = 'error'")
def store_snapshot(spark, sf_dir):
    path = shared_path(spark, "snapshot")
    store.save_snapshot({"spans": tables.spans(spark, sf_dir), "logs": tables.logs(spark, sf_dir)}, path)
    return Traces(store.load_snapshot(spark, path)["spans"]).query("{ status = error }").select("trace_id", "span_id")


@register("stream_push", PUSHED)
def stream_push(spark, sf_dir):
    landing, root = shared_path(spark, "landing"), shared_path(spark, "store")
    requests.push(spark, sf_dir).write.text(landing)
    pipelines.follow(spark, landing, "push", root, shared_path(spark, "progress")).awaitTermination()
    return store.load(spark, root, "logs").select(L.text(F.col("key")).alias("stream"), "ts_ns", "line")


@register("stream_recent_activity", f"WITH {LINES} SELECT ts_ns // 3600000000000 AS hour, svc AS service, count(*) AS entries, count(*) FILTER (WHERE level = 'error') AS errors FROM s GROUP BY ALL")
def stream_recent_activity(spark, sf_dir):
    t = pipelines.recent_activity(tables.logs(spark, sf_dir), window="1 hour")
    return t.select(F.expr("unix_micros(window.start) div 3600000000").alias("hour"), "service", "entries", "errors")
