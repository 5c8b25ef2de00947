"""URL filters that follow links: rules judge the pages they fit, the link graph judges the rest.

Pages are narrowed to their host and the hosts they link to, and those to one row for each pair of
hosts. A host most of whose pages a rule allows is a trusted seed, one most of whose pages a rule
blocks is a blocked seed. Personalised PageRank walks from the trusted seeds along links; distrust
walks from the blocked seeds against them, to the hosts that lead there. A host is blocked if its
share of distrust in both scores is above a threshold; a host that neither walk reaches is allowed.

A walk restarts at the seeds with probability ``1 - DAMPING``, so after ``ROUNDS`` steps less than
``LEFT_OUT`` of it is left out. Mass is counted in whole units: sums are the same in any order. Each
round is a join of the mass that moved last with the host edges, and a sum by host. The edges of a
host of many are dealt over salts by their number, and its mass is repeated for each salt. Links
within a host, and what a host without links is given, go nowhere.

Defined cases: a null url, or one without ``://``, has an empty host and path; no rule fits it and it
is no host of the graph, so it is allowed. Null or empty pages have no links. Repeated rows count as
pages of their own. Of rules of the same length that both fit, the one with the longer host wins.
Other columns are not read. Without pages, or without links, nothing walks.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.operators.skew import skew_join
from contentloom.session import stage

#: Verdict and ``host/path`` of each rule.
Rule = tuple[str, str]
ALLOW, BLOCK = "allow", "block"

DAMPING, LEFT_OUT = 0.85, 0.01
ROUNDS = math.ceil(math.log(LEFT_OUT) / math.log(DAMPING))
#: All the mass of one kind of seeds.
UNITS = 10**15
#: What the seeds have of it at first, all together.
START = round(UNITS * (1 - DAMPING))
#: Hosts whose share of distrust is above this are blocked.
MOST_DISTRUST = 0.5
EDGES_AT_ONCE = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_HOST = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``STRUCT<rule, verdict>`` of the longest rule that fits, or null."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/")))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(longest_first):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source``, ``target`` and ``n``, the pages of a host that link to another host."""
    linked = F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK_HOST), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER))
    each = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(F.array_distinct(linked)).alias("target"))
    return each.where("source <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def walk_edges(links: DataFrame, edges_at_once: int = EDGES_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """Edges (``walk``, ``host``, ``salt``, ``to``, ``share``), both ways, and ``salts`` by walk and host."""
    both = links.select(F.lit(ALLOW).alias("walk"), F.col("source").alias("host"), F.col("target").alias("to"), "n").unionByName(
        links.select(F.lit(BLOCK).alias("walk"), F.col("target").alias("host"), F.col("source").alias("to"), "n")
    )
    degrees = stage(
        both.groupBy("walk", "host").agg(
            F.sum("n").alias("total"), F.ceil(F.count("*") / edges_at_once).cast("int").alias("salts")
        ),
        "host-degrees",
    )
    salt = F.pmod(F.xxhash64("to"), F.col("salts")).cast("int").alias("salt")
    key = F.struct("walk", "host").alias("key")
    met = skew_join(both.select(key, "to", "n"), degrees.select(key, "total", "salts"), "key")
    edges = met.select("key.walk", "key.host", salt, "to", (F.col("n") / F.col("total")).alias("share"))
    return stage(edges, "host-edges"), degrees.select("walk", "host", "salts")


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, edges_at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of all hosts that a walk from ``seeds`` (``walk``, ``host``) reaches."""
    edges, salts = walk_edges(stage(links, "host-links"), edges_at_once)
    n = seeds.groupBy("walk").agg(F.count("*").alias("seeds"))
    start = F.floor(F.lit(START) / F.col("seeds")).cast("long").alias("mass")
    moved = stage(seeds.join(n, "walk").select("walk", "host", start), "mass")
    reached = [moved]
    # Mass that falls below one unit vanishes, so the walks often end sooner.
    while len(reached) <= rounds and not moved.isEmpty():
        given = moved.join(salts, ["walk", "host"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        part = F.floor(F.col("mass") * DAMPING * F.col("share")).cast("long")
        moved = stage(
            given.join(edges, ["walk", "host", "salt"])
            .groupBy("walk", F.col("to").alias("host"))
            .agg(F.sum(part).alias("mass"))
            .where("mass > 0"),
            "mass",
        )
        reached.append(moved)
    everything = reached[0]
    for one in reached[1:]:
        everything = everything.unionByName(one)

    def score(walk: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("mass"))), F.lit(0))

    return everything.groupBy("host").agg(score(ALLOW).alias("trust"), score(BLOCK).alias("distrust"))


def judge(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    most_distrust: float = MOST_DISTRUST,
    edges_at_once: int = EDGES_AT_ONCE,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every page."""
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn(
        "fit", fitting_rule(F.col("host"), F.col("path"), rules)
    )
    ruled = [F.count_if(F.col("fit.verdict") == v).alias(v) for v in (ALLOW, BLOCK)]
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), *ruled)
    seeds = hosts.select("host", F.when(F.col(ALLOW) * 2 > F.col("pages"), ALLOW).when(F.col(BLOCK) * 2 > F.col("pages"), BLOCK).alias("walk"))
    scores = propagate(stage(seeds.where("walk IS NOT NULL"), "seed-hosts"), host_links(pages, url_col, html_col), edges_at_once=edges_at_once)
    blocked = F.col("distrust") > (F.col("trust") + F.col("distrust")) * most_distrust
    scores = scores.withColumn("by_links", F.when(blocked, BLOCK).otherwise(ALLOW))
    # A host may own any part of the pages.
    met = skew_join(judged, stage(scores, "host-scores"), "host", "left", spread=F.xxhash64("page_id", "path"))
    return met.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "by_links", F.lit(ALLOW)).alias("verdict"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("trust", "distrust")),
    )
