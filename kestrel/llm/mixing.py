"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of a budget by its weight.  A share above ``max_epochs`` times the source's size is clamped there
and the excess is dealt again by weight until no source is above.  A target is met by whole repetitions of every document
and one fractional repetition: the documents whose keyed hash is lowest, up to the remainder.

Defined results.  A null text has size 0, a null source is a source of its own and is ranked last, a null document id hashes
as an empty string.  Rows that repeat a document id share its hash and are taken or left together.  A source of size 0 gets
nothing.  No rows in, no rows out.  Input columns that carry a result's name give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dense_index, materialize, n_words

#: Hashes have 60 bits.  The cut is found by two passes over 12-bit digits and one over what is left of a single bucket.
HASH_BITS, DIGIT = 60, 12


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, __h): all that mixing needs to know of a document."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("__h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, budget: float = 1.0) -> DataFrame:
    """(source, source_size, target): the water-filling.  Weights repeat over the sources in code-point order, null last.

    Comparisons are exact (decimal); each round clamps at least one more source or ends, and a round is one small aggregate.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = dense_index(per, [F.col("source").asc_nulls_last()], "__rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    per = materialize(per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_epochs).alias("cap")), "mix-weights")
    total = int((per.agg(F.sum("source_size")).first()[0] or 0) * budget)
    rest, shares, clamped = total, None, -1
    while True:
        over = _over(rest, shares)
        row = per.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("w")))).first()
        rest, shares = total - int(row[1] or 0), int(row[2] or 0)
        if row[0] == clamped or not shares:
            break
        clamped = row[0]
    fair = F.col("w").cast("double") * F.lit(float(rest)) / F.lit(float(shares)) if shares else F.col("cap").cast("double")
    # no source is above its cap now, or it is in the clamped set of the last round
    return per.select("source", "source_size", F.when(_over(rest, shares) if shares else F.lit(True), F.col("cap").cast("double")).otherwise(fair).alias("target"))


def _over(rest: int, shares: int | None) -> Column:
    """Is the fair share w * rest / shares above the cap?  Before the first round nothing is."""
    if not shares:
        return F.lit(False)
    big = lambda c: c.cast("decimal(20,0)")
    return big(F.col("w")) * big(F.lit(rest)) > big(F.col("cap")) * big(F.lit(shares))


def plan(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, __whole, __cut): repetitions of all documents, and the hash up to which one more is taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = wanted.withColumn("__whole", whole).withColumn("__quota", F.floor(F.col("target") - F.col("__whole") * F.col("source_size") + 0.5).cast("long"))
    t = materialize(t, "mix-plan")
    at = t.select(F.col("source").alias("__s"), F.lit(0).cast("long").alias("__prefix"), F.col("__quota").alias("__left")).filter("__left > 0")
    spent = 0
    for _ in range(2):
        spent += DIGIT
        here, above = F.shiftright("__h", HASH_BITS - spent), F.shiftright("__h", HASH_BITS - spent + DIGIT)
        inside = sized.join(at, F.col("source").eqNullSafe(F.col("__s")) & (above == F.col("__prefix")))
        digits = inside.groupBy("__s", "__left", here.alias("__digit")).agg(F.sum("size").alias("__n"))
        upto = F.sum("__n").over(W.partitionBy("__s").orderBy("__digit"))  # 4096 rows a source at most
        hit = digits.withColumn("__upto", upto).filter("__upto >= __left and __upto - __n < __left")
        at = materialize(hit.select("__s", F.col("__digit").alias("__prefix"), (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left")), "mix-digit")
    inside = sized.join(at, F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("__h", HASH_BITS - spent) == F.col("__prefix")))
    by_hash = inside.groupBy("__s", "__prefix", "__left", "__h").agg(F.sum("size").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__s").orderBy("__h")) - F.col("__n")
    taken = F.when(2 * before + F.col("__n") <= 2 * F.col("__left"), F.col("__h"))
    cuts = by_hash.withColumn("__take", taken).groupBy("__s", "__prefix").agg(F.max("__take").alias("__take"))
    floor = F.shiftleft("__prefix", HASH_BITS - spent) - 1
    cuts = materialize(cuts.select("__s", F.coalesce("__take", floor).alias("__cut")), "mix-cuts")
    joined = t.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left")
    out = joined.select("source", "source_size", "target", "__whole", F.coalesce("__cut", F.lit(-1).cast("long")).alias("__cut"))
    return materialize(out, "mix-decisions")  # its size is known now: few sources are broadcast to the texts, many are not


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, budget: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): ``taken`` is ``size`` times the repetitions of the document."""
    sized = materialize(sizes(docs, seed), "mix-sizes")
    p = plan(sized, targets(sized, weights, max_epochs, budget)).withColumnRenamed("source", "__s")
    copies = F.col("__whole") + (F.col("__h") <= F.col("__cut")).cast("long")
    out = sized.join(p, F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, budget: float = 1.0) -> DataFrame:
    """The mixed corpus itself: rows of ``docs``, each as often as :func:`mix` takes it.  Texts are not shuffled."""
    sized = materialize(sizes(docs, seed), "mix-sizes")
    p = plan(sized, targets(sized, weights, max_epochs, budget)).select(F.col("source").alias("__s"), "__whole", "__cut")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    hashed = docs.withColumn("__h", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    copies = F.col("__whole") + (F.col("__h") <= F.col("__cut")).cast("long")
    out = hashed.join(p, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("__copies", copies.cast("int"))
    return out.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)

