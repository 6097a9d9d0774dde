"""URL filters: explicit rules first, else link-graph propagation per host. DataFrame functions only.

Rules are (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's,
and the longest one wins (of equals the later by code point). Hosts are linked by the absolute links of their pages.
Trust is a personalised PageRank from trusted seeds along the links; distrust is one from blocked seeds against
them, since a page that links to bad hosts earns it. Seeds are the hosts whose pages the rules allow, or block, by
more than half. A host is blocked if its distrust makes up at least `threshold` of its trust and distrust; a host that
neither reaches is allowed.

Ranks are tables of hosts; every iteration joins them with the distinct host edges and writes the next table, so
nothing of the graph is collected and no lineage grows; the table before it is deleted. Hosts with links to very many
others are dealt to parts.

Defined cases: null urls and urls without :// have an empty host and path, which no rule fits and which is allowed;
null html has no links; links of a host to itself don't count, several links between two hosts are one edge with
their number as weight; equal rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import common
from docloom.llm.common import discard, small, stage

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>\\]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct (length, rule, verdict) of the rule that wins, null if none fits."""
    fits = []
    for name, start, verdict in rules:
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits.append(F.when(fit, F.struct(F.lit(len(name) + len(start)).alias("length"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts. pages: host, html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", ascii_uppercase, ascii_lowercase).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """host, kind, rank after so many iterations. edges: kind, src, dst, weight; seeds: kind, host, mass (1 per kind).

    Rank that reaches a host without links, or a seed of one, returns to the seeds of its kind.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"), F.ceil(F.count("*") / common.HOT_ROWS).cast("int").alias("parts"))
    shares = edges.join(out, ["kind", "src"]).withColumn("part", F.pmod(F.xxhash64("dst"), "parts").cast("int"))
    shares = stage(shares.select("kind", F.col("src").alias("host"), "part", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    hot = stage(out.where("parts > 1").select("kind", F.col("src").alias("host"), "parts"), "hot")
    parts = None if hot.isEmpty() else small(hot, 64)
    ranks, before = seeds.select("kind", "host", F.col("mass").alias("rank")), None
    for _ in range(iterations):
        dealt = ranks.withColumn("part", F.lit(0)) if parts is None else ranks.join(parts, ["kind", "host"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        moved = dealt.join(shares, ["kind", "host", "part"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        moved = stage(moved.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "moved")
        discard(before)
        before = moved
        # two rows: what each kind has kept in motion
        left = moved.groupBy("kind").agg(F.sum("rank").alias("moving"))
        back = seeds.join(F.broadcast(left), "kind", "left").select("kind", "host", (F.col("mass") * (1 - F.coalesce("moving", F.lit(0.0)))).alias("rank"))
        ranks = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
    return ranks


def host_verdicts(pages: DataFrame, threshold: float = 0.6, **kwargs) -> DataFrame:
    """host, trust, distrust, blocked for hosts that either reaches. pages: host, html, verdict (of a rule, or null)."""
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
    kind = F.when(2 * F.col("good") > F.col("n"), "trust").when(2 * F.col("bad") > F.col("n"), "distrust")
    seeds = stage(hosts.select("host", kind.alias("kind")).where("kind IS NOT NULL"), "seeds")
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    seeds = seeds.join(F.broadcast(sizes), "kind").select("kind", "host", (1 / F.col("n")).alias("mass"))
    edges = stage(host_edges(pages), "edges")
    if edges.isEmpty():
        ranks = seeds.select("kind", "host", F.col("mass").alias("rank"))
    else:
        directed = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        ranks = propagated(directed, stage(seeds, "mass"), **kwargs)
    rank = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    both = ranks.groupBy("host").agg(rank("trust"), rank("distrust"))
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return both.withColumn("blocked", blocked)


def judged(pages: DataFrame, rules=RULES, **kwargs) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (of the host)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = host_verdicts(rows.select("host", "html", F.col("fit.verdict").alias("verdict")), **kwargs)
    rows = rows.select("page_id", "host", "path", "fit").join(small(stage(hosts, "hosts"), 96), "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
