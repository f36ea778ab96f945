"""URL filter: explicit rules first, then a tree of path templates for each host.

Paths are read segment by segment, to the last. Below each node of a host's tree a segment stays as
it is if it has ``MIN_ROWS`` there; all others are one wildcard. A branch with as many whose share of
bad labels does not differ from that of its node by more than chance allows is merged into
the wildcard as well. What remains are templates. The share of bad labels of a template is
smoothed by that of its host, and that of the host by all; templates above a limit are
rejected.

Every level is sums by node and joins of compact rows, of the paths that go as far. Levels end
where no node has the rows and labels for a branch; what is left of the paths is wildcards. Null urls and those without ``://`` have an empty host
and path and are judged like any other host; null labels are no labels; repeated rows are
judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.session import cut_lineage, small_side

# Verdict, host and path of the rules asked for.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
MIN_ROWS = 20  # of a segment below its node
MIN_SHARE, MAX_DEPTH = 0.0, math.inf  # no share of the node is asked for, no depth is the last
SIGMAS = 3.0
SMOOTHING = 10.0
LIMIT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for word, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, word).otherwise(verdict)
    return name, verdict


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")]


def templates(pages: DataFrame) -> DataFrame:
    """Adds ``template`` to rows of ``host``, ``path`` and ``bad`` (1.0, 0.0 or null)."""
    rows = cut_lineage(pages.withColumn("parts", F.split("path", "/")).withColumn("template", F.element_at("parts", 1)))
    done, depth = [rows.filter(F.size("parts") < 2)], 2
    while True:
        rows = rows.filter(F.size("parts") >= depth).withColumn("part", F.get("parts", F.lit(depth - 1)))
        seen = cut_lineage(rows.groupBy("host", "template", "part").agg(*_sums()))
        node = cut_lineage(seen.groupBy("host", "template").agg(
            F.sum("n").alias("all"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")))
        if node.filter((F.col("all") >= MIN_ROWS) & (F.col("all_labelled") > 0)).isEmpty():
            break  # no branch of its own here or further down
        share = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        apart = F.abs(F.col("bad") - share * F.col("labelled"))
        kept = seen.filter(F.col("n") >= MIN_ROWS).join(node, ["host", "template"]).filter(
            apart > SIGMAS * F.sqrt(share * (1 - share) * F.col("labelled"))).select(
            "host", "template", "part", F.lit(True).alias("own"))
        kept = small_side(cut_lineage(kept))
        joined = rows.join(kept, ["host", "template", "part"], "left")
        step = F.when(F.col("part") == "", "").when(F.col("own"), F.col("part")).otherwise("*")
        rows = cut_lineage(joined.withColumn("template", F.concat("template", F.lit("/"), step)).drop("part", "own"))
        done.append(rows.filter(F.size("parts") == depth))
        depth += 1
    below = F.transform(F.slice("parts", depth, F.size("parts")), lambda part: F.when(part == "", "").otherwise("*"))
    done.append(rows.withColumn("template", F.concat_ws("/", "template", below)).drop("part"))
    return reduce(DataFrame.unionByName, done).drop("parts")


def judged(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``host``, ``template``, smoothed ``share`` of bad labels, and ``rejected``."""
    leaves = cut_lineage(rows.groupBy("host", "template").agg(*_sums()))
    hosts = cut_lineage(leaves.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad")))
    every = hosts.agg(F.sum("host_labelled"), F.sum("host_bad")).first()
    overall = ((every[1] or 0.0) + 1) / ((every[0] or 0) + 2)
    host_share = (F.col("host_bad") + SMOOTHING * overall) / (F.col("host_labelled") + SMOOTHING)
    share = (F.col("bad") + SMOOTHING * host_share) / (F.col("labelled") + SMOOTHING)
    return leaves.join(hosts, "host").select("host", "template", share.alias("share"), (share >= limit).alias("rejected"))


def report(pages: DataFrame, marks: DataFrame, url: str = "url", key: str = "page_id",
           rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Each page with its host, path, rule, verdict, template and share. ``marks`` holds ``key`` and ``bad``."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    known = marks.filter(F.col("bad").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("bad").cast("double").alias("bad"))
    rows = templates(rows.join(known, "key", "left"))
    found = rows.join(cut_lineage(judged(rows)), ["host", "template"])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return found.select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "share")


def document_marks(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages: those of the document that a path names by its number (bad: quality 0, or toxic)."""
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"([0-9]+)", 1).try_cast("long")
    bad = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("double")).alias("bad"))
    return pages.select("page_id", number.alias("doc_id")).join(bad, "doc_id").select("page_id", "bad")
