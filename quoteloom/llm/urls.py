"""Operator 5: URL filter with a path-template tree per host, in DataFrame functions only.

1. Addresses are parsed to host and path; rules (host and path prefix) decide what they fit, the longest first.
2. Path segments become template segments, depth by depth. A segment's context is its host and the template of what
   stands before it, so values below a ``*`` are pooled. In its context a value stays literal if it is not a number or code by its look and carries at least
   ``literal_share`` of the context's rows; every other value is variable and becomes ``*``.
3. Labels (here: the verdicts of rules) are counted per template. Below one host and parent the branches that
   stand next to each other in their share of blocked labels are merged while a two-proportion test tells no
   difference; a branch without labels joins none and speaks through its parent.
4. A template is rejected if the share of blocked labels of its merged branch, smoothed by its parent's, that by
   its host's, and that by the whole table's, exceeds ``reject_above``.

The tree is kept as rows (host, depth, prefix) of counts. A host that holds a third of all rows is a handful of such
rows after the map-side half of the aggregation; a context whose paths all go on alike is finished at once, so
there are as many rounds as depths at which paths of one context still part; a literal needs its share of a context, so a parent has at
most ``1 / literal_share`` literal branches and the merging window is bounded.

Nulls and edge cases: a null address, or one without ``://``, has an empty host and path, no rule, and the verdict of that
template; repeated rows get equal verdicts; very long paths are cut nowhere; without any label nothing is rejected;
empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.session import durable

# The rules of the production query, (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
LITERAL_SHARE = 0.02
SAME = 1.96
PRIOR = 20.0
REJECT_ABOVE = 0.7
_CODE = r"^(\d+|\d[\d.:_-]*|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,36})(\.[A-Za-z0-9]{1,5})?$"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path in one string) and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame, literal_share: float = LITERAL_SHARE) -> DataFrame:
    """Distinct ``host, path`` with their number of rows and the array ``template`` of their segments."""
    paths = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    rest = F.transform(F.array_remove(F.split("path", "/"), ""), lambda s: F.when(s.rlike(_CODE), F.lit("*")).otherwise(s))
    live = paths.select("host", "path", "n", F.array().cast("array<string>").alias("template"), rest.alias("rest"), F.xxhash64("host").alias("context"))
    live, done = durable(live), None
    while True:
        ended = live.filter(F.size("rest") == 0).select("host", "path", "n", "template")
        done = ended if done is None else done.unionByName(ended)
        open_ = live.filter(F.size("rest") > 0)
        if open_.isEmpty():
            return done
        tails = F.xxhash64("rest")
        flat = open_.groupBy("context", F.get("rest", F.lit(0)).alias("value")).agg(F.sum("n").alias("n"), F.min(tails).alias("lo"), F.max(tails).alias("hi"))
        flat = durable(flat)
        wholes = flat.groupBy("context").agg(F.sum("n").alias("whole"), (F.min("lo") == F.max("hi")).alias("_alone"))
        literal = (F.col("value") != "*") & (F.col("n") >= F.lit(literal_share) * F.col("whole"))
        kept = flat.join(wholes, "context").filter(literal | F.col("_alone")).select("context", "value", "_alone")
        joined = open_.withColumn("value", F.get("rest", F.lit(0))).join(kept, ["context", "value"], "left")
        segment = F.when(F.col("_alone").isNotNull(), F.col("value")).otherwise("*")
        alone = F.coalesce("_alone", F.lit(False))
        live = durable(
            joined.select(
                "host", "path", "n",
                F.when(alone, F.concat("template", "rest")).otherwise(F.array_append("template", segment)).alias("template"),
                F.when(alone, F.array().cast("array<string>")).otherwise(F.slice("rest", 2, F.size("rest"))).alias("rest"),
                F.xxhash64("context", segment).alias("context"),
            )
        )


def purity(labelled: DataFrame, prior: float = PRIOR, same: float = SAME) -> DataFrame:
    """Smoothed share of blocked labels per tree node, from rows of ``host, template, blocked, labels`` (one per leaf).

    Nodes are ``host, depth, prefix``; every leaf counts in all nodes on its way.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.size("template")), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice("template", 1, d), "/").alias("prefix")))
    each = labelled.select("host", "blocked", "labels", "template", F.explode(prefixes).alias("_p"))
    parent = F.when(F.col("_p.depth") > 0, F.array_join(F.slice("template", 1, F.col("_p.depth") - 1), "/"))
    nodes = each.groupBy("host", F.col("_p.depth").alias("depth"), F.col("_p.prefix").alias("prefix"), parent.alias("parent")).agg(
        F.sum("blocked").alias("blocked"), F.sum("labels").alias("labels")
    )
    nodes = durable(nodes)
    total = nodes.filter("depth = 0").agg(F.sum("blocked").alias("b"), F.sum("labels").alias("n")).first()
    overall = total.b / total.n if total.n else 0.0

    # merge branches of one parent that follow each other in their share and do not differ by the test
    order = Window.partitionBy("host", "depth", "parent").orderBy("_rate", "prefix")  # at most 1 / literal_share branches
    rated = nodes.filter("depth > 0 AND labels > 0").withColumn("_rate", F.col("blocked") / F.col("labels"))
    b0, n0 = F.lag("blocked").over(order), F.lag("labels").over(order)
    pooled = (F.col("blocked") + b0) / (F.col("labels") + n0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labels") + 1 / n0))
    differs = F.coalesce(F.abs(F.col("_rate") - b0 / n0) > same * error, F.lit(True))
    run = rated.withColumn("_new", differs.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = Window.partitionBy("host", "depth", "parent", "_run")
    sums = run.select("host", "depth", "prefix", F.sum("blocked").over(merged).alias("mb"), F.sum("labels").over(merged).alias("mn"))
    nodes = nodes.join(sums, ["host", "depth", "prefix"], "left").select(
        "host", "depth", "prefix", "parent", F.coalesce("mb", "blocked").alias("blocked"), F.coalesce("mn", "labels").alias("labels")
    )
    # smooth from the root of each leaf down: its nodes on the way, in order of depth
    way = labelled.select("host", "template", F.explode(prefixes).alias("_p")).select("host", "template", "_p.*")
    met = way.join(nodes.drop("parent"), ["host", "depth", "prefix"]).groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct("depth", "blocked", "labels"))).alias("_way")
    )
    down = F.aggregate("_way", F.lit(float(overall)), lambda up, n: (n["blocked"] + prior * up) / (n["labels"] + prior))
    return met.select("host", "template", down.alias("purity"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, literal_share: float = LITERAL_SHARE, reject_above: float = REJECT_ABOVE
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` per row of ``pages`` (columns page_id, url)."""
    host, path = parse(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    shapes = templates(parsed, literal_share)
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    leaves = durable(shapes.withColumns({"rule": rule, "said": said}))
    labelled = leaves.groupBy("host", "template").agg(
        F.sum(F.when(F.col("said") == "block", F.col("n")).otherwise(0)).alias("blocked"), F.sum(F.when(F.col("said").isNotNull(), F.col("n")).otherwise(0)).alias("labels")
    )
    scores = purity(durable(labelled))
    method = F.when(F.col("purity") > reject_above, "block").otherwise("allow")
    judged = leaves.join(scores, ["host", "template"]).select("host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "purity")
    return parsed.join(judged, ["host", "path"])
