"""URL filters: rules first, then trust and distrust propagated over the graph of hosts.

A rule is a host and a path beginning (`example.net/en/`); it fits the host and its subdomains, the longest fitting
rule decides. Hosts of whose pages the rules allow more than half are trusted seeds, those of whose pages they block
more than half are blocked seeds (a rule for one folder doesn't condemn a host); each weighs as many as these pages.
Personalised PageRank carries trust along links and distrust against them (who links to blocked hosts is distrusted),
until a round changes less than `tolerance` of either's mass. A host is blocked when its distrust exceeds `threshold`
of the sum of both (if they are equal it isn't); hosts that neither reaches are allowed.

Scale: links become host edges with counts before the first shuffle that depends on hosts, so a host that holds a
third of all pages is a few rows. Each round is one join of edges with scores and one partial aggregate; lineage is
cut in the shared folder every third round. Host scores never reach the driver.
Rows: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed by the method;
repeated pages count as often as they occur, whatever their ids; null or empty html has no links, and of any length
it is read whole. An empty table has no verdicts. Columns of the pages named host, path, rule, verdict, trust or
distrust are replaced, others stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


#: The rules of op1.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def judged(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> DataFrame:
    """The pages with host, path, rule and ruled (the rule's verdict); built-in expressions only."""
    out = pages.withColumns({"host": host_of(F.col(f"`{url_col}`")), "path": path_of(F.col(f"`{url_col}`"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, by absolute and protocol-relative addresses."""
    link = r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(link), F.lit(1))))
    pairs = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), found.alias("link"))
    pairs = pairs.select("src", host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return pairs.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches. seeds: (host, allowed, blocked) page counts.

    Both kinds run in one table: trust over the edges, distrust over the turned edges; each kind's seeds sum to 1.
    Mass on hosts without outgoing edges leaves the graph. A round changes at most twice damping to the power of its
    number; the change itself is looked at every third round, when lineage is cut.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    both = both.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all_n"))
    moves = common.cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all_n")).alias("share")))
    masses = F.create_map(F.lit("trust"), F.col("allowed").cast("double"), F.lit("distrust"), F.col("blocked").cast("double"))
    base = seeds.select("host", F.explode(masses).alias("kind", "mass")).where("mass > 0")
    total = base.groupBy("kind").agg(F.sum("mass").alias("total"))  # two rows at most
    base = common.cut(base.join(F.broadcast(total), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass")))
    now = base
    before = None
    for i in range(math.ceil(math.log(tolerance / 2, damping)) if moves.limit(1).count() else 0):
        if i % 3 == 1:
            before = now = common.cut(now)
        sent = now.alias("x").join(moves.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.host") == F.col("y.src")))
        sent = sent.select("x.kind", F.col("y.dst").alias("host"), (F.col("x.mass") * F.col("y.share") * damping).alias("mass"))
        rest = base.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
        now = sent.unionByName(rest).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if i % 3 == 1:
            now = common.cut(now)
            both = now.select("kind", "host", "mass").unionByName(before.select("kind", "host", (-F.col("mass")).alias("mass")))
            change = both.groupBy("kind", "host").agg(F.abs(F.sum("mass")).alias("change")).groupBy("kind").agg(F.sum("change").alias("change"))
            if (change.agg(F.max("change")).first()[0] or 0.0) < tolerance:
                break
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return now.groupBy("host").agg(part("trust"), part("distrust"))


def filtered(
    pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", html_col: str = "html", threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-4, salts: int = 8
) -> DataFrame:
    """The pages without html, with host, path, rule, verdict, trust and distrust.

    salts: a host's score is joined in as many copies, so that the pages of one host are not one task's.
    """
    common.share_code(pages.sparkSession)
    edges = common.cut(host_edges(pages, url_col, html_col))
    named = judged(pages.drop(html_col, *({"host", "path", "rule", "ruled", "verdict", "trust", "distrust"} - {url_col})), rules, url_col)
    tally = lambda verdict: F.count_if(F.col("ruled") == verdict)
    count = named.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), tally("allow").alias("allowed"), tally("block").alias("blocked"))
    seeds = count.select("host", *(F.when(F.col(c) * 2 > F.col("n"), F.col(c)).otherwise(0).alias(c) for c in ("allowed", "blocked")))
    scores = propagated(seeds, edges, damping, tolerance)
    host, salt, own = (common.free_name(named, c) for c in ("host2", "salt2", "salt1"))
    scores = scores.select(F.col("host").alias(host), "trust", "distrust", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt))
    named = named.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    out = named.join(scores, (F.col("host") == F.col(host)) & (F.col(own) == F.col(salt)), "left").drop(host, salt, own)
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return out.withColumn("verdict", F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))).drop("ruled")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filtered(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
