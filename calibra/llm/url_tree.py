"""URL filters (operator 11): rules first, then a path-template tree per host.

Rules (verdict, host, path) fit their host and its subdomains where the URL's path
begins with the rule's; the longest fitting rule decides and labels the URL.  All
other URLs are judged by the tree that the distinct URLs of their host grow, level
by level from the host down (a URL's copies count once):

* variable segments become a wildcard: of a node's m paths that go on, a segment
  stays literal when c >= 2 of them share it and c * c >= m, so a node has at most
  sqrt(m) literal branches;
* literal branches that are statistically similar are merged: in order of their
  share of blocked, then allowed paths, neighbours whose (blocked, allowed,
  unlabelled) counts do not differ by a chi-square test (2 degrees of freedom) form
  one branch, which is named after its least segment;
* a node with fewer than ``GROW`` paths that go on grows no more.

A template is rejected when its smoothed purity, (blocked + 1) / (labelled + 2), reaches
``PURITY``; a template without labels has 0.5 and is allowed.

Only built-in functions are used.  Distinct paths and all counts are combined in
the map tasks; a host or node that holds a third of all paths is met with salted
joins; the window over a node's branches holds at most sqrt(m) rows.  The number of
rounds is the depth to which some node is still shared by ``GROW`` paths.

In templates ``?`` stands for a variable segment, ``??`` for the ungrown rest, and a
segment with ``?`` after it for merged branches (a path itself holds no ``?``).

Defined results: a null URL or one without ``://`` has the empty host and path, which
no rule fits; A-Z of the host are lower-cased, nothing is decoded; repeated rows give
repeated results; other columns are kept, those with a result column's name are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.scratch import free_name, stored

#: a node grows while this many distinct paths go on below it
GROW = 4
#: chi-square at 2 degrees of freedom and 5 %
CRITICAL = 5.991
#: a template is rejected from this smoothed share of blocked paths on
PURITY = 0.8
SALTS = 8

RESULT = ("host", "path", "rule", "template", "purity", "verdict")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    # the longest comes last and so is asked first; equally long rules go by their wording
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def _salted(small: DataFrame) -> DataFrame:
    """Every row once per salt."""
    return small.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def merged_branches(literal: DataFrame) -> DataFrame:
    """``host, node, segment, branch``: literal branches with the name of their merged group."""
    order = Window.partitionBy("host", "node").orderBy(F.col("blocked") / F.col("c"), F.col("allowed") / F.col("c"), "segment")
    counts = F.struct("c", "blocked", "allowed", (F.col("c") - F.col("blocked") - F.col("allowed")).alias("free"))
    chi = F.lit(0.0)
    for kind in ("blocked", "allowed", "free"):
        x, y = (F.col(f"{side}.{kind}").cast("double") for side in ("own", "last"))
        n, m = F.col("own.c").cast("double"), F.col("last.c").cast("double")
        chi += F.when(x + y > 0, (m * x - n * y) * (m * x - n * y) / (n * m * (x + y))).otherwise(0.0)
    steps = literal.withColumn("own", counts).withColumn("last", F.lag("own").over(order)) \
        .withColumn("apart", (F.col("last").isNull() | (chi > CRITICAL)).cast("int")) \
        .withColumn("part", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "node", "part")
    return steps.select("host", "node", "segment", F.concat(
        F.min("segment").over(group), F.when(F.count(F.lit(1)).over(group) > 1, "?").otherwise("")).alias("branch"))


def grow(paths: DataFrame) -> DataFrame:
    """``host, path, label, template`` of distinct ``host, path, label`` rows."""
    counted = paths.select(
        "host", "path", "label", F.lit("").alias("node"), F.slice(F.split("path", "/"), 2, 1 << 30).alias("segments"),
        F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    active, finished, level = stored(counted, "url-paths"), None, 0
    out = ["host", "path", "label", "template"]
    while True:
        ended = active.where(F.size("segments") <= level).withColumn("template", F.col("node")).select(*out)
        finished = ended if finished is None else finished.unionByName(ended)
        going = active.where(F.size("segments") > level).withColumn("segment", F.col("segments")[level])
        if going.isEmpty():
            return finished
        children = stored(going.groupBy("host", "node", "segment").agg(
            F.count(F.lit(1)).alias("c"), F.count_if(F.col("label") == "block").alias("blocked"),
            F.count_if(F.col("label") == "allow").alias("allowed")), "url-children")
        nodes = stored(children.groupBy("host", "node").agg(F.sum("c").alias("m")).where(F.col("m") >= GROW), "url-nodes")
        shared = children.where("c >= 2").withColumn(
            "salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int"))
        literal = shared.join(_salted(nodes), ["host", "node", "salt"]).where("c * c >= m").drop("salt")
        branches = stored(merged_branches(literal), "url-branches")
        grown = going.join(_salted(nodes.select("host", "node", F.lit(True).alias("grows"))), ["host", "node", "salt"], "left")
        finished = finished.unionByName(grown.where("grows IS NULL").withColumn(
            "template", F.concat("node", F.lit("/??"))).select(*out))
        active = stored(grown.where("grows").join(_salted(branches), ["host", "node", "segment", "salt"], "left").select(
            "host", "path", "label", F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("?"))).alias("node"),
            "segments", "salt"), "url-paths")
        level += 1


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", purity: float = PURITY) -> DataFrame:
    """``pages`` with the columns of RESULT."""
    host, path = free_name(pages, "host"), free_name(pages, "path")
    read = pages.withColumn(host, host_of(F.col(url_col))).withColumn(path, path_of(F.col(url_col)))
    pairs = read.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
    label = rule_columns(rules, F.col("host"), F.col("path"))[1]
    tree = stored(grow(pairs.withColumn("label", label)), "url-templates")
    labelled = F.count("label")
    judged = tree.groupBy("host", "template").agg(
        ((F.count_if(F.col("label") == "block") + 1) / (labelled + 2)).alias("purity"))
    by_template = tree.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")) \
        .join(_salted(judged), ["host", "template", "salt"]).select("host", "path", "template", "purity")
    kept = [c for c in pages.columns if c.lower() not in RESULT]
    mine = read.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    return mine.join(by_template, ["host", "path"]).select(
        *kept, "host", "path", rule.alias("rule"), "template", "purity",
        F.coalesce(verdict, F.when(F.col("purity") >= purity, "block").otherwise("allow")).alias("verdict"))
