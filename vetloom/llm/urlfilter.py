"""URL filters: listed rules first, then a tree of path templates for each host.

A host's paths make a tree of segments, judged level by level. Variable segments become the
wildcard *: those made of digits, dates, hex or similar, and those with few of the urls of a
node that has many children. Branches of a node that hold labelled urls and whose share of
blocked urls doesn't differ from the node's (|z| < SIMILAR) are merged into one, written ~.
A template, the path of labels from the host down, is rejected where its smoothed purity, the
share of labelled urls that are allowed with SMOOTHING added to both sides, is below LEAST_PURE.
Urls that a rule fits are the labelled ones. A template without them has purity 1/2 and stays or,
with back_off, as in the query, the purity of the nearest node on its way up to the host that holds
some; 1/2 is then left to hosts without labelled urls.

The tree is as deep as paths of a host share templates: a node of one shape alone takes the rest of it
as it is. Urls are first summed by host and shape of path, so what the levels handle is one row a
shape, however many urls a host has; each level is a sum by branch and a join, and no host meets in one
task. There is a round for each level, so a pair of very long paths that differ at their ends costs many.

Defined results: null urls and urls without :// have an empty host and path, no rule, and are
judged by the template of the empty host; rows that repeat are judged alike; a null page_id is
kept; clashing extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.session import materialise

WIDE = 30
SIMILAR = 2.0
SMOOTHING = 1.0
LEAST_PURE = 0.4

#: Segments of these shapes are variable: numbers, dates, hex, uuids, and words that end in digits, with a file ending or without.
VARIABLE = r"^(?:\d[\d._-]*|[0-9a-f]{8,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|.*[-_]\d+)(?:\.[A-Za-z]{2,5})?$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and the verdict of the longest rule that fits, null without one."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    longest = sorted(rules, key=lambda r: (-len(r.text), r.text))
    tests = [(fits(r, F.col("host"), F.col("path")), r) for r in longest]
    none = F.lit(None).cast("string")
    rule = F.coalesce(none, *[F.when(t, r.text) for t, r in tests])
    verdict = F.coalesce(none, *[F.when(t, r.verdict) for t, r in tests])
    return rows.withColumn("rule", rule).withColumn("labelled", verdict)


def shape(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))


def templates(counts: DataFrame) -> DataFrame:
    """host, shape, template of counts(host, shape array, n, good, bad), one row a shape."""
    rows = materialise(counts.select("*", F.lit("").alias("template"), F.lit(True).alias("open")), "shapes")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    level = 0
    while rows.where("open").limit(1).count():
        here = rows.withColumn("part", F.get("shape", F.lit(level))).where("open AND part IS NOT NULL")
        branches = here.groupBy("host", "template", "part").agg(*sums)
        nodes = branches.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("n").alias("node_n"), F.sum("good").alias("node_good"), F.sum("bad").alias("node_bad")
        )
        both = branches.join(nodes, ["host", "template"])
        rare = (F.col("children") > WIDE) & (F.col("n") * WIDE < F.col("node_n"))
        known, p = F.col("good") + F.col("bad"), F.try_divide("node_bad", F.col("node_good") + F.col("node_bad"))
        z = F.try_divide(F.col("bad") - known * p, F.sqrt(known * p * (1 - p)))
        alike = (known > 0) & (F.coalesce(F.abs(z), F.lit(0.0)) < SIMILAR)
        label = F.when(rare | (F.col("part") == "*"), "*").when(alike & (F.col("children") > 1), "~").otherwise(F.col("part"))
        named = both.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("part").alias("p"), label.alias("label"))
        rows = rows.withColumn("part", F.get("shape", F.lit(level)))
        on = rows["open"] & (rows["host"] == named["h"]) & (rows["template"] == named["t"]) & (rows["part"] == named["p"])
        rows = rows.join(named, on, "left").drop("h", "t", "p", "part")
        rows = rows.withColumn("template", F.concat("template", F.when(F.col("label").isNotNull(), F.concat(F.lit("/"), "label")).otherwise("")))
        level += 1
        # shapes that end here are done, and so is one that is alone: its rest would be labelled as it is
        more = F.col("label").isNotNull() & (F.size("shape") > level)
        rows = materialise(rows.withColumn("open", F.col("open") & more).drop("label"), "shapes")  # read again three times
        crowd = rows.where("open").groupBy("host", "template").agg((F.count("*") == 1).alias("alone"))
        rows = rows.join(crowd, ["host", "template"], "left").withColumn("alone", F.col("open") & F.coalesce("alone", F.lit(False)))
        rest = F.concat(F.lit("/"), F.concat_ws("/", F.slice("shape", F.lit(level + 1), F.size("shape"))))
        rows = rows.withColumn("template", F.concat("template", F.when(F.col("alone"), rest).otherwise(""))).withColumn("open", F.col("open") & ~F.col("alone")).drop("alone")
        rows = materialise(rows, "shapes")
    return rows


def with_nodes(rows: DataFrame) -> DataFrame:
    """rows with a row for each node on the way from the host, at level 0, to the template."""
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.size(F.split("template", "/")) - 1)))
    return rows.withColumn("node", F.expr("substring_index(template, '/', level + 1)"))


def backed_off(own: DataFrame) -> DataFrame:
    """own(host, template, good, bad), where templates without labelled urls have the sums of the nearest node with some."""
    own = materialise(own, "templates")
    known = own.where("good + bad > 0")
    nodes = with_nodes(known).groupBy("host", "node").agg(F.sum("good").alias("node_good"), F.sum("bad").alias("node_bad"))
    near = with_nodes(own.where("good + bad = 0").select("host", "template")).join(nodes, ["host", "node"])
    near = near.groupBy("host", "template").agg(F.max_by(F.struct("node_good", "node_bad"), "level").alias("near"))
    rows = own.join(near, ["host", "template"], "left")
    return rows.select("host", "template", *[F.coalesce(f"near.node_{c}", c).alias(c) for c in ("good", "bad")])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", back_off: bool = False) -> DataFrame:
    """id, host, path, rule, verdict, template and its smoothed purity for every row of pages."""
    rows = by_rules(pages, rules, id_col, url_col).withColumn("shape", shape(F.col("path")))
    good, bad = (F.count_if(F.col("labelled") == v) for v in ("allow", "block"))
    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), good.alias("good"), bad.alias("bad"))
    found = templates(counts)
    own = found.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    if back_off:
        own = backed_off(own)
    purity = (F.col("good") + SMOOTHING) / (F.col("good") + F.col("bad") + 2 * SMOOTHING)
    own = own.select(F.col("host").alias("h"), F.col("template").alias("t"), purity.alias("purity"))
    found = found.join(own, (found["host"] == own["h"]) & (found["template"] == own["t"])).select("h", F.col("shape").alias("s"), "template", "purity")
    judged = rows.join(found, (rows["host"] == found["h"]) & (rows["shape"] == found["s"]))
    verdict = F.coalesce("labelled", F.when(F.col("purity") < LEAST_PURE, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
