"""URL filters: explicit rules, and a path-template tree judged by smoothed labelled purity, in DataFrame operations only.

Pages are first summed by (host, shape), the shape being the path with evidently variable segments (numbers, hashes, ids)
already a wildcard.  The tree grows downwards one segment at a time: a branch whose share of bad labels does not differ
significantly from all of its siblings' merges with its like into the wildcard branch, others keep their name.  A template is
rejected where its share of bad labels, smoothed towards its host's and that towards the corpus's, reaches ``reject``.

Defined results.  A url that is null or lacks ``://`` has an empty host and path, fits no rule and shares the template of
such pages.  Pages without a label count only in ``n_pages``.  Repeated pages count each; several labels of a page count as
one, bad if any is.  Without labels all templates are allowed.  No rows in, no rows out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, without


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


ADDED = ("host", "path", "rule", "verdict", "template", "purity")
#: A segment that is a number (perhaps with an extension); with a digit, a hash or UUID; with a digit, a long mixture.
NUMBER, HEX, LONG = r"^[0-9]+([._-](?s:.*))?\z", r"^[0-9a-fA-F-]{8,}\z", 24


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return ascii_lower(host), path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, else null.  Rules are a parameter of the program: at most some hundreds."""
    if len(rules) > 500:
        raise ValueError("give at most 500 rules; larger lists belong in labels")
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later, longer rules win
        out = F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(r.name)).otherwise(out)
    return out


def variable(s: Column) -> Column:
    return s.rlike(NUMBER) | (s.rlike("[0-9]") & (s.rlike(HEX) | (F.length(s) >= LONG)))


def shape(path: Column) -> Column:
    """Path segments with variable ones as ``*``."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.when(variable(s), F.lit("*")).otherwise(s))


def template_tree(pages: DataFrame, z: float = 1.96, strength: float = 4.0, reject: float = 0.8) -> DataFrame:
    """(host, shape, template, n_pages, labelled, bad, purity, rejected) from rows (host, shape, labelled 0/1, bad 0/1).

    A branch whose labelled pages are all bad, all good or none has nothing left to part: what lies below it are wildcards.
    The others grow on, whatever the depth, so there are as many levels as paths of unlike labels run together.
    """
    leaves = materialize(pages.groupBy("host", "shape").agg(F.count("*").alias("n_pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-leaves")
    open_, done, d = leaves.withColumn("template", F.lit("")), [], 1
    counts = [F.sum("labelled").alias("cl"), F.sum("bad").alias("cb")]
    while True:
        t = open_.withColumn("seg", F.get("shape", F.lit(d - 1)))
        child = t.filter("seg is not null").groupBy("host", "template", "seg").agg(*counts)
        mixed = child.groupBy("host", "template").agg(F.sum("cl").alias("pl"), F.sum("cb").alias("pb")).filter("pb > 0 and pb < pl")
        share = F.col("pb") / F.col("pl")
        # distance of the branch's share from the siblings', in standard errors of a sample of the branch's size
        far = F.coalesce(F.when(F.col("cl") > 0, F.abs(F.col("cb") / F.col("cl") - share) > z * F.sqrt(share * (1 - share) / F.col("cl"))), F.lit(False))
        named = child.join(mixed, ["host", "template"]).select("host", "template", "seg", F.when(far & (F.col("seg") != "*"), F.col("seg")).otherwise(F.lit("*")).alias("as"))
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("shape") - (d - 1)))
        grown = F.when(F.col("as").isNotNull(), F.concat_ws("/", "template", "as")).otherwise(rest)
        t = t.join(named, ["host", "template", "seg"], "left").withColumn("template", grown).withColumn("open", F.col("as").isNotNull()).drop("seg", "as")
        t = materialize(t, "url-templates")  # a level's plan holds the one above three times
        done.append(t.filter(~F.col("open")).drop("open"))
        open_ = t.filter("open").drop("open")
        if not open_.head(1):
            break
        d += 1
    t = done[0]
    for more in done[1:]:
        t = t.unionByName(more)
    node = t.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
    host = t.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    total = t.agg(F.sum("labelled"), F.sum("bad")).first()
    base = float(total[1] or 0) / total[0] if total[0] else 0.0
    of_host = (F.col("hb") + strength * base) / (F.col("hl") + strength)
    purity = (F.col("tb") + strength * of_host) / (F.col("tl") + strength)
    judged = node.join(host, "host").select("host", "template", purity.alias("purity"))
    return t.join(judged, ["host", "template"]).withColumn("rejected", F.col("purity") >= reject)


def url_filter(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, reject: float = 0.8) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule, verdict, template and purity.

    Labelled pages are those that a rule decides and those of ``labels`` (page_id, bad 0/1).
    """
    host, path = split_url(F.col("url"))
    t = without(pages, ADDED).withColumns({"host": host, "path": path})
    t = t.withColumns({"rule": matched_rule(F.col("host"), F.col("path"), rules), "__shape": shape(F.col("path"))})
    blocks = [r.name for r in rules if r.verdict == "block"]
    verdict = F.when(F.col("rule").isNull(), None).when(F.col("rule").isin(*blocks) if blocks else F.lit(False), F.lit("block")).otherwise(F.lit("allow"))
    seen = t.select("page_id", "host", F.col("__shape").alias("shape"), verdict.alias("__v"))
    if labels is not None:
        known = labels.groupBy("page_id").agg(F.max("bad").alias("__bad"))
        seen = seen.join(known, "page_id", "left")
    else:
        seen = seen.withColumn("__bad", F.lit(None).cast("int"))
    bad = F.coalesce(F.when(F.col("__v") == "block", 1).when(F.col("__v") == "allow", 0), F.col("__bad"))
    tree = template_tree(seen.select("host", "shape", bad.isNotNull().cast("long").alias("labelled"), F.coalesce(bad, F.lit(0)).cast("long").alias("bad")), reject=reject)
    tree = materialize(tree.select(F.col("host").alias("__host"), F.col("shape").alias("__sh"), "template", "purity", "rejected"), "url-tree")
    out = t.join(tree, (F.col("host") == F.col("__host")) & (F.col("__shape") == F.col("__sh")), "left")
    final = F.coalesce(verdict, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", final).drop("__host", "__sh", "__shape", "rejected")
