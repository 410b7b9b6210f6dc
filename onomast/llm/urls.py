"""URL filters: rules on hosts and paths, and link-graph propagation for the rest.

Trust flows from hosts with allowed pages along their links (personalised
PageRank); distrust flows from hosts with blocked pages against the links.
Where no rule fits a page, its host's two ranks decide.  Everything is
DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# A link's tag up to its end or the next tag, which takes time in proportion to the page whether tags are closed or not.
TAG = r"(?i)<a\b[^<>]*+"
# In it, the target's host: of an absolute link, or one relative to the scheme.
LINK = r"""(?i)\bhref\s*+=\s*+["']?\s*+(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s>]+)"""
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rules and hosts up to so many rows are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """host, A-Z lower-cased, and path; both empty for null or without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.when(has, ascii_lower(F.regexp_extract(url, URL, 1))).otherwise("")
    return host, F.when(has, F.regexp_extract(url, URL, 2)).otherwise("")


def host_rules(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): the rules that fit each host or a domain above it, longest first, a block before an allow of its length."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, domain string, prefix string")
    table = F.broadcast(table) if len(rules) <= BROADCAST_ROWS else table
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    fit = hosts.where("host <> ''").select("host", F.explode(ends).alias("domain")).join(table, "domain")
    size = F.length("domain") + F.length("prefix")
    own = F.struct((-size).alias("order"), (F.col("verdict") != "block").alias("late"), "domain", "prefix", "verdict")
    return fit.groupBy("host").agg(F.array_sort(F.collect_set(own)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many links lead from pages of one host to another.

    Tags are cut first, then looked through, so a page of any length and of
    unclosed tags takes linear time; a tag that isn't closed ends where the
    next one begins.  Null html has no links.
    """
    host, _ = split_url(F.col("url"))
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TAG), F.lit(0))
    out = pages.select(host.alias("src"), F.explode(F.transform(tags, lambda t: F.regexp_extract(t, LINK, 1))).alias("dst"))
    out = out.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def personalised_rank(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """seeds (host, seed): mass that sums to 1; links (src, dst, w).  Returns (host, rank).
    What reaches a host without links goes back to the seeds.  Each round is a
    join and a sum whose parts are combined before the shuffle.  Rounds go on
    until the ranks change by less than ``tolerance`` in all; each leaves at
    most ``damping`` of the change, which bounds their number, and to miss the
    tolerance within it, or within ``rounds``, is an error."""
    if rounds is None:
        rounds = max(1, math.ceil(math.log(tolerance / 2) / math.log(damping))) + 2
    total = links.groupBy("src").agg(F.sum("w").alias("all"))
    flow = materialize(links.join(total, "src").select(F.col("src").alias("host"), "dst", (F.col("w") / F.col("all")).alias("share")), "flow")
    rank = materialize(seeds.select("host", F.col("seed").alias("rank")), "rank")
    if flow.isEmpty() or rank.isEmpty():
        return rank
    for _ in range(rounds):
        moved = flow.join(rank, "host").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("m"))
        kept = moved.agg(F.coalesce(F.sum("m"), F.lit(0.0))).first()[0]
        back = 1 - damping * kept
        parts = moved.select("host", (F.col("m") * damping).alias("rank")).unionByName(seeds.select("host", (F.col("seed") * back).alias("rank")))
        new = materialize(parts.groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        both = new.unionByName(rank.select("host", (-F.col("rank")).alias("rank"))).groupBy("host").agg(F.abs(F.sum("rank")).alias("d"))
        change = both.agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]
        rank = new
        if change < tolerance:
            return rank
    raise RuntimeError(f"ranks still change by {change} after {rounds} rounds")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, margin: float = 1.0, floor: float = 0.05) -> DataFrame:
    """Rows of pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A rule (verdict, domain, prefix) fits its domain and all below it where the
    path starts with the prefix; the longest wins, and of equally long ones a
    block.  Without a rule a page is blocked if its host's distrust exceeds
    ``margin`` times its trust and ``floor`` of an even share.  A url that is
    null or has no ``://`` has an empty host and path, fits no rule and is
    allowed; null or broken html has no links; repeated rows count each; an
    empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    host, path = split_url(F.col("url"))
    slim = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = materialize(slim.select("host").distinct(), "hosts")
    n_hosts = hosts.count()
    fitting = materialize(host_rules(hosts, rules), "host-rules")
    sized = lambda df: F.broadcast(df) if n_hosts <= BROADCAST_ROWS else df
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    ruled = slim.join(sized(fitting), "host", "left").withColumn("hit", F.try_element_at(first, F.lit(1)))
    share = ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.coalesce(F.col("hit.verdict") == "allow", F.lit(False)).cast("double")).alias("trust"),
        F.avg(F.coalesce(F.col("hit.verdict") == "block", F.lit(False)).cast("double")).alias("distrust"),
    )
    share = materialize(share, "seeds")
    sums = share.agg(F.coalesce(F.sum("trust"), F.lit(0.0)), F.coalesce(F.sum("distrust"), F.lit(0.0))).first()
    links = materialize(host_links(pages), "host-links")
    # What a rank may still lack must not reach the floor.
    tolerance = min(1e-6, 0.01 * floor / max(n_hosts, 1)) if floor > 0 else 1e-6
    trust = personalised_rank(share.where("trust > 0").select("host", (F.col("trust") / (sums[0] or 1.0)).alias("seed")), links, tolerance=tolerance)
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = personalised_rank(share.where("distrust > 0").select("host", (F.col("distrust") / (sums[1] or 1.0)).alias("seed")), turned, tolerance=tolerance)
    ranks = (
        trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust"))
        .unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
        .groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    ranks = materialize(ranks.join(hosts, "host", "left_semi"), "ranks")
    zero = F.lit(0.0)
    out = ruled.join(sized(ranks), "host", "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    bad = (F.col("distrust") > margin * F.col("trust")) & (F.col("distrust") * n_hosts > floor)
    rule = F.when(F.col("hit").isNotNull(), F.concat("hit.domain", "hit.prefix"))
    verdict = F.coalesce("hit.verdict", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "trust", "distrust")
