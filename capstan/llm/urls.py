"""URL filters: fixed rules, and trust and distrust propagated over the graph of hosts.

Rules decide what they fit; the longest wins. For all other pages the link graph decides: personalised PageRank
flows from trusted hosts along links, and distrust flows against links from blocked hosts, so whoever links to
a blocked host shares its distrust. A host is blocked if its distrust is greater than its trust. Edges
are the absolute links between different hosts, weighted by their number. Link counts are combined before
each shuffle, and every few rounds the scores are written to the shared folder. The walk ends when no host's score
changes by more than a small share of itself, so also no new host is reached. Scores are compared as they are, however small,
since they shrink with the number of hosts; distrust must be greater by more than a millionth, so that the order of a sum cannot turn
a verdict. A tie is allowed.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule, takes no part in
the graph and is allowed; null html has no links; repeated rows are judged alike; empty tables give empty
tables; a url of any length is split by one pass; columns named like the outputs are replaced, and no helper has a name of
its own beside the row's.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged, table

#: The rules, host and path as one string, with their verdicts.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
DAMPING, ROUNDS, ROUNDS_BETWEEN_WRITES, PLACES = 0.85, 8, 4, 9
#: By what share of the trust the distrust must be greater.
MARGIN = 1e-6
#: ROUNDS is how many the SQL unrolls; the walk over the tables of sf0.001 and sf0.01 has settled by then.
#: The share of a host's score that may still change between two writes when the walk ends.
TOLERANCE = 1e-4
HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
LINK = r"""(?i:href)[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?((?i:https?:)?//[^"'\x20\x09-\x0D>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, "(?s)" + HOST, 1), _UPPER, _LOWER), F.regexp_extract(url, "(?s)" + PATH, 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits the host, or one of its parents, and begins the path; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # later, longer rules override
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r, verdict in rules.items():
        out = F.when(rule == r, F.lit(verdict)).otherwise(out)
    return out


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path and rule."""
    host, path = split_url(F.col(url))
    return pages.withColumns({"host": host, "path": path}).withColumn("rule", rule_of(F.col("host"), F.col("path")))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """src, dst and how many links join them, between the hosts of ``pages`` (with host)."""
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    target = F.translate(F.regexp_extract("link", r"//([^/?#]*)", 1), _UPPER, _LOWER)
    return links.select("src", target.alias("dst")).filter("dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after ``rounds`` steps, or when they have settled; each sums to one over all hosts. ``seeds`` has
    host, trusted and blocked, each summing to one.

    A host without a way on gives its mass back to the seeds. That has the same solution as letting the mass go and
    scaling what is left to one, which needs no sum over all hosts in every round.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    )
    totals = both.groupBy("kind", "src").agg(F.sum("links").alias("total"))
    steps = staged(both.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("total")).alias("share")), "host-steps")
    start = staged(
        seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trusted"), F.lit("distrust"), F.col("blocked"))).alias("kind", "seed")).filter("seed > 0"),
        "host-seeds",
    )
    scores = written = begun = start.select("kind", "host", F.col("seed").alias("score"))
    for i in count(1) if rounds is None else range(1, rounds + 1):
        moved = scores.withColumnRenamed("host", "src").join(steps, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        scores = moved.unionByName(start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % ROUNDS_BETWEEN_WRITES == 0:
            scores = staged(scores, "host-scores")
            if rounds is None:
                both_times = scores.join(written.withColumnRenamed("score", "was"), ["kind", "host"], "left")
                change = both_times.agg(F.max(F.when(F.col("score") > 0, F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))) / F.col("score")))).first()[0]
                if written is not begun:
                    discard(written)
                written = scores
                if not change or change <= TOLERANCE:
                    break
    scores = staged(scores, "host-scores")
    total = {r["kind"]: r["total"] for r in scores.groupBy("kind").agg(F.sum("score").alias("total")).collect()}
    whole = F.when(F.col("kind") == "trust", total.get("trust") or 1.0).otherwise(total.get("distrust") or 1.0)
    scores = scores.withColumn("score", F.col("score") / whole)
    return scores.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))


def seeds_of(pages: DataFrame) -> DataFrame:
    """Hosts by the share of all allowed, and of all blocked, pages that they hold. ``pages`` has host and rule."""
    judged = pages.filter(F.col("rule").isNotNull()).select("host", verdict_of(F.col("rule")).alias("verdict"))
    counts = judged.groupBy("host").agg(*(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")))
    total = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    return counts.select("host", (F.col("allow") / max(1, total["allow"] or 0)).alias("trusted"), (F.col("block") / max(1, total["block"] or 0)).alias("blocked"))


def judge(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without their html, with host, path, rule, trust, distrust and verdict."""
    out = ("host", "path", "rule", "trust", "distrust", "verdict")
    kept = [c for c in pages.columns if c != html and c not in out]
    known = parsed(pages.select(F.struct(*kept).alias("row"), F.col(url).alias("url"), F.col(html).alias("html")))
    light = staged(known.select("row", "host", "path", "rule"), "pages-parsed")
    scores = staged(propagate(seeds_of(light), host_edges(known)), "host-verdicts")
    done = light.join(scores, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    by_graph = F.when(F.col("distrust") > F.col("trust") * (1 + MARGIN), "block").otherwise("allow")
    return done.withColumn("verdict", F.coalesce(verdict_of(F.col("rule")), by_graph)).select("row.*", *out)


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", *(F.round(k, PLACES).alias(k) for k in ("trust", "distrust")))
