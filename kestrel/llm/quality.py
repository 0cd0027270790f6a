"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame operations only.

A sketch is a log-linear histogram: a value keeps its leading ``SIGNIFICANT`` bits, so every quantile is within 2 % of the
value at that rank, whatever the order of the merges; merging is a sum of counts.  One sketch a metric is kept for every
(language, source), and sums of these serve languages and the corpus where a group has fewer than ``min_rows`` rows.  The
fence of a metric is the third quartile plus ``spread`` times the interquartile range (at least a metric's ``slack``), so it
follows each source's own habits and a corpus without outliers loses nothing.  A metric that is zero in three quarters of a
group has no spread there, and its fence is the slack alone.

Defined results.  A null or empty text has no words and fails the base rule.  Null languages and sources are groups of their
own.  Repeated rows count each.  No rows in, no rows out.  Input columns that carry a result's name give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize

SYMBOLS = "#*$%&|<>"
SIGNIFICANT = 7
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Per metric: the least distance of the fence from the quartile, in the metric's unit.
SLACK = {"symbols": 400, "dup_lines": 4000, "repeats": 3000, "word_len": 300}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "n_lines", "base_failed", "kept", *SLACK)


def features(docs: DataFrame, keep: list[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with the counts, the base rule and the metrics, all within the row.

    The base rule asks for ``min_words`` words and for at most half of them in repeated windows.
    """
    columns = [c for c in (keep or docs.columns) if c.lower() not in ADDED]
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "").alias("__w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("__lines")
    t = docs.select(*{*columns, "text"}, words, lines)
    size = F.size("__w")
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    t = t.select(
        *columns,
        size.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    # windows in the order of their hashes: equal ones are neighbours; most texts have none and skip the sort
    ordered = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    t = t.withColumn("__s", ordered).drop("__h")
    twice = lambda x, k: (F.get("__s", k - 1)["h"] == x["h"]) | (F.get("__s", k + 1)["h"] == x["h"])
    starts = F.sort_array(F.transform(F.filter("__s", twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n"))
    repeats = F.coalesce(F.aggregate(starts, start, step)["n"], F.lit(0)).cast("long")
    t = t.withColumn("n_repeat_words", repeats).drop("__s")
    t = t.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return t.withColumns({
        "symbols": F.expr("10000 * n_symbols div greatest(word_chars, 1L)"),
        "dup_lines": F.expr("10000 * n_dup_lines div greatest(n_lines, 1L)"),
        "repeats": F.expr("10000 * n_repeat_words div greatest(n_words, 1L)"),
        "word_len": F.expr("100 * word_chars div greatest(n_words, 1L)"),
    })


def bucket(v: Column) -> Column:
    """The value of the sketch's bin: ``v`` with all but its leading bits cleared."""
    shift = F.greatest(F.length(F.bin(v)) - SIGNIFICANT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): mergeable by adding ``n``.  Partial sums are made before anything is shuffled."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in SLACK])
    t = rows.filter("not base_failed").select("lang", "source", F.explode(pairs).alias("p"))
    return t.groupBy("lang", "source", F.col("p.metric").alias("metric"), bucket(F.col("p.v")).alias("bin")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """First and third quartile of every merged sketch of ``keys``; a window holds one sketch."""
    t = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "metric")
    t = t.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bin")))
    names = [F.col(k).alias(f"__{k}{suffix}") for k in [*keys, "metric"]]
    return t.groupBy(*names).agg(F.max("all").alias(f"n{suffix}"), q(1).alias(f"lo{suffix}"), q(3).alias(f"hi{suffix}"))


def thresholds(rows: DataFrame, spread: int = 3, min_rows: int = 100) -> DataFrame:
    """(__lang, __source, max_<metric> ..., min_word_len): one row for every language and source that has rows."""
    sketch = materialize(sketches(rows), "quality-sketch")
    fine, mid, all_ = quartiles(sketch, ["lang", "source"], "2"), quartiles(sketch, ["lang"], "1"), quartiles(sketch, [], "0")
    t = fine.join(mid, F.col("__lang2").eqNullSafe(F.col("__lang1")) & (F.col("__metric2") == F.col("__metric1"))).join(all_, F.col("__metric2") == F.col("__metric0"))
    level = lambda c: F.when(F.col("n2") >= min_rows, F.col(f"{c}2")).when(F.col("n1") >= min_rows, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("__metric2"))
    t = t.select("__lang2", "__source2", "__metric2", level("lo").alias("lo"), level("hi").alias("hi"), slack.alias("slack"))
    t = t.withColumn("far", F.greatest((F.col("hi") - F.col("lo")) * spread, F.col("slack")))
    pick = lambda m, c: F.max(F.when(F.col("__metric2") == m, c))
    fences = [pick(m, F.col("hi") + F.col("far")).alias(f"max_{m}") for m in SLACK]
    out = t.groupBy(F.col("__lang2").alias("__lang"), F.col("__source2").alias("__source")).agg(*fences, pick("word_len", F.col("lo") - F.col("far")).alias("min_word_len"))
    return materialize(out, "quality-thresholds")


def judge(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """Joined filtering: ``rows`` with their group's fences and ``kept``.  Groups without a fence have base failures only."""
    t = rows.join(fences, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    within = F.col("word_len") >= F.col("min_word_len")
    for m in SLACK:
        within = within & (F.col(m) <= F.col(f"max_{m}"))
    return t.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


def quality(docs: DataFrame, keep: list[str] | None = None, spread: int = 3, min_rows: int = 100, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (columns ``keep``, which must hold lang and source) with counts, metrics, fences and the verdict ``kept``."""
    rows = materialize(features(docs, keep, min_words), "quality-rows")
    return judge(rows, thresholds(rows, spread, min_rows))


__all__ = ["quality", "features", "sketches", "thresholds", "judge"]
