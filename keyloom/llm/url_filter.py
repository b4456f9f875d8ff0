"""URL filter: listed rules first, then trust and distrust carried over links between hosts.

Pages are read as links between hosts. Trust starts at hosts that allow rules name and follows
links (personalised PageRank); distrust starts at hosts that block rules name and follows links
backwards, as who links to a bad host is suspect: each host takes its linked hosts' distrust by the
share of its own links that go there, so that however many others link to a bad host takes nothing
from it. A host whose distrust outweighs its trust and passes a threshold is blocked. A page's rule, if one fits, decides before its host does.

Iterations are joins of host scores with host links; each round is written to the shared folder
and the rounds end when no score moves. Hub hosts are safe: links are counted before they move,
scores are summed on the map side, and a hot side of a join is split by adaptive execution.

In the graph a host goes without a user's name (``user@host``), in pages and in links alike; the column
``host`` and the rules have the url's host as it is.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null or empty html has no links; html is read whole at any length; of rules of one length the
one later by name wins, and a host whose distrust ties with its trust is allowed; repeated rows are judged
one by one; an empty table gives an empty result; more columns of the input are dropped.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def site_of(host: Column) -> Column:
    """The host without a user's name."""
    return F.regexp_replace(host, r"^.*@", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does.

    Rules are compiled into one expression, so keep the list to some hundreds.
    """
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        test = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fit = F.when(test, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fit)
    return fit


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many links the pages of one host hold to another host."""
    found = F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(F.col("host").alias("src"), found.alias("raw")).where(F.col("src") != "")
    links = links.select("src", F.translate(site_of(F.col("raw")), UPPER, LOWER).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """(host, score): score = (1 - damping) * seed + damping * what its neighbours pass on.

    ``links`` is (src, dst, w), w summing to 1 over each src or over each dst, so that moves shrink by
    ``damping`` a round; ``seeds`` has every host once. Without ``rounds`` they go on until no score
    moves by more than ``tolerance``.
    """
    state = seeds.select("host", "seed", F.col("seed").alias("score"))
    for _ in itertools.count() if rounds is None else range(rounds):  # without rounds, some log(tolerance) / log(damping) of them
        passed = links.join(state.where("score > 0").select(F.col("host").alias("src"), "score"), "src")
        gained = passed.groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("w")).alias("gained"))
        new = state.join(gained, "host", "left").select(
            "host", "seed", ((1 - damping) * F.col("seed") + damping * F.coalesce("gained", F.lit(0.0))).alias("score"), F.col("score").alias("old")
        )
        new = cut(new)
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        state = new.drop("old")
        if moved is None or moved <= tolerance:
            break
    return state.select("host", "score")


def host_scores(pages: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(host, pages, trust, distrust) of every host that is read or linked.

    ``pages`` has host, html and the verdict of its rule (null: none). A host's seed is the share of
    its pages that allow, or block, rules decide.
    """
    own = pages.where(F.col("host") != "").groupBy("host").agg(
        F.count("*").alias("pages"),
        F.avg(F.when(F.col("rule_verdict") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.avg(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("bad"),
    )
    links = cut(host_links(pages))
    if links.isEmpty():
        return cut(own.select("host", "pages", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust")))
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = cut(
        linked.join(own, "host", "full_outer").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("good", "bad")], F.coalesce("pages", F.lit(0)).alias("pages"))
    )
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    ahead = cut(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w")))
    reverse = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    trust = spread(hosts.select("host", F.col("good").alias("seed")), ahead, damping, rounds, tolerance)
    distrust = spread(hosts.select("host", F.col("bad").alias("seed")), reverse, damping, rounds, tolerance)
    return (
        hosts.select("host", "pages")
        .join(trust.withColumnRenamed("score", "trust"), "host")
        .join(distrust.withColumnRenamed("score", "distrust"), "host")
    )


def judge(pages: DataFrame, rules: tuple[UrlRule, ...], least_distrust: float = 0.075, margin: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    step = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    step = step.withColumn("__fit", rule_of(F.col("host"), F.col("path"), rules))
    step = step.withColumn("__site", site_of(F.col("host")))
    scores = host_scores(step.select(F.col("__site").alias("host"), "html", F.col("__fit.verdict").alias("rule_verdict")))
    blocked = (F.col("distrust") >= least_distrust) & (F.col("distrust") > margin * F.col("trust"))
    verdict = scores.select(F.col("host").alias("__site"), "trust", "distrust", F.when(blocked, "block").otherwise("allow").alias("__host_verdict"))
    return step.drop("html").join(verdict, "__site", "left").select(
        "page_id", "host", "path", F.col("__fit.rule").alias("rule"),
        F.coalesce(F.col("__fit.verdict"), F.col("__host_verdict"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
