"""URL filter: rules, and link-graph propagation of trust and distrust over hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import broadcast_if, staged

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A score has settled when a round moves it by at most SETTLED of itself.
DAMPING, SETTLED = 0.85, 1e-5
#: After so many rounds, less than SETTLED of the mass is still on its way.
ROUNDS = math.ceil(math.log(SETTLED) / math.log(DAMPING))
#: A host is blocked if distrust is more than this share of its trust and distrust together.
THRESHOLD = 0.5
BROADCAST_HOSTS = 500_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return _lower(F.coalesce(F.regexp_extract(url.cast("string"), _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), _PARTS, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share) from links of (host, html) to other hosts; share is that of src's links."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    edges = links.select(F.col("host").alias("src"), _lower(F.col("to")).alias("dst")).filter("src <> dst and src <> ''")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from the trust seeds along links, and from the distrust seeds against them.

    `seeds` has host, good and bad (shares that add up to 1 or 0). What a host without links would pass on goes back
    to the seeds. Rounds stop when no host's score moves by more than SETTLED of itself, however small its share and
    however many hosts there are: about ROUNDS, and as many more as the longest chain of links from a seed needs. Each
    is written to the shared folder.
    """
    edges = staged(edges, "edges")
    outs, ins = edges.groupBy("src").agg(F.sum("n").alias("all")), edges.groupBy("dst").agg(F.sum("n").alias("all"))
    ahead = edges.join(outs, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"), F.lit(True).alias("forward"))
    back = edges.join(ins, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"), F.lit(False).alias("forward"))
    ways = staged(ahead.union(back), "ways")
    hosts = seeds.select("host").union(ways.select(F.col("src"))).distinct().join(seeds, "host", "left").na.fill(0.0)
    rank = staged(hosts.withColumn("trust", F.col("good")).withColumn("distrust", F.col("bad")), "ranks")
    if ways.isEmpty():
        return rank.select("host", "trust", "distrust")
    while True:
        worth = F.when(F.col("forward"), F.col("trust")).otherwise(F.col("distrust")) * F.col("share")
        sent = ways.join(rank, ways["src"] == rank["host"]).select("dst", "forward", worth.alias("x"))
        got = sent.groupBy("dst").agg(F.sum(F.when(F.col("forward"), F.col("x")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("forward"), 0.0).otherwise(F.col("x"))).alias("d"))
        rest = got.agg(F.sum("t"), F.sum("d")).first()
        kept_t, kept_d = (1.0 - (x or 0.0) for x in rest)
        step = lambda seed, x, kept: (1 - DAMPING) * F.col(seed) + DAMPING * (F.coalesce(x, F.lit(0.0)) + kept * F.col(seed))
        after = rank.join(got, rank["host"] == got["dst"], "left").select(
            "host", "good", "bad", step("good", F.col("t"), kept_t).alias("trust"), step("bad", F.col("d"), kept_d).alias("distrust"),
            (F.col("trust")).alias("t0"), F.col("distrust").alias("d0"),
        )
        after = staged(after, "ranks")
        moves = lambda x, x0: F.abs(F.col(x) - F.col(x0)) > SETTLED * F.greatest(x, x0)
        moving = after.filter(moves("trust", "t0") | moves("distrust", "d0"))
        rank = after.drop("t0", "d0")
        if moving.isEmpty():
            break
    return rank.select("host", "trust", "distrust")


def judged(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    Pages that a rule fits get its verdict; they also are the seeds: trust starts at hosts by their allowed pages,
    distrust by their blocked ones. Other pages get the verdict of their host: block if distrust outweighs trust beyond
    `threshold`, else allow, so a host that nothing is known of is allowed. Without `://`, or if the url is null, host
    and path are empty and there is no evidence. Null html has no links. Repeated rows count and give a row each.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    known = staged(rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "judged")
    sums = known.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    allow, block = sums.agg(F.sum("a"), F.sum("b")).first()
    seeds = sums.select("host", (F.col("a") / float(allow or 1)).alias("good"), (F.col("b") / float(block or 1)).alias("bad"))
    ranks = propagate(seeds, host_edges(rows.select("host", "html")))
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    ranks = ranks.select("host", F.when(bad, "block").otherwise("allow").alias("other"))
    found = known.join(broadcast_if(staged(ranks, "hosts"), BROADCAST_HOSTS), "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "other", F.lit("allow")).alias("verdict"))
