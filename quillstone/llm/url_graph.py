"""URL filter: rules first, then trust and distrust that spread over links between hosts.

Hosts with a page that a rule allows or blocks are seeds, by the share of their pages. Trust is a personalised PageRank from the
allowed seeds along links, distrust one from the blocked seeds against them; both restart with ``RESTART`` and follow
distinct host edges, weighed by their links. A host is blocked if its distrust is over ``LEAST`` and over its
trust. Only built-in functions are used; each few steps the vectors are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
RESTART = 0.15
STEPS, CUT_EVERY = 12, 4
#: Share of a host's weight that must be distrusted.
LEAST = 0.5
#: Absolute links in a page's markup.
LINK = r"""(?i)\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first :// up to the next / ? # or the end, A-Z lower-cased; without ://, or null: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule for the host or a domain above it whose path the url's begins with, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(domain + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, steps: int = STEPS, restart: float = RESTART) -> DataFrame:
    """host, trust, distrust from ``seeds`` (host, trust, distrust) over ``edges`` (src, dst, n).

    A host's vector is its seed's share plus what its neighbours pass on; what a host without links would pass on is lost.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    flows = edges.join(out, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("w"), F.lit(True).alias("forth"))
    back = edges.join(into, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("w"), F.lit(False).alias("forth"))
    flows = written(flows.unionByName(back), "url-flows")
    start = written(seeds.select("host", "trust", "distrust"), "url-seeds")
    now = start
    for step in range(steps):
        moved = now.join(flows, now["host"] == flows["from"]).groupBy("to").agg(
            F.sum(F.when(F.col("forth"), F.col("trust") * F.col("w")).otherwise(0.0)).alias("a"),
            F.sum(F.when(~F.col("forth"), F.col("distrust") * F.col("w")).otherwise(0.0)).alias("b"),
        )
        rest = start.join(moved, start["host"] == moved["to"], "full_outer")
        mix = lambda seed, come: F.coalesce(F.col(seed), F.lit(0.0)) + (1 - restart) * F.coalesce(F.col(come), F.lit(0.0))
        now = rest.select(F.coalesce("host", "to").alias("host"), mix("trust", "a").alias("trust"), mix("distrust", "b").alias("distrust"))
        if (step + 1) % CUT_EVERY == 0:
            now = written(now, "url-spread")
    return now


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url, html).

    A null url, or one without ://, has empty host and path, fits no rule and is allowed; null markup has no links;
    repeated rows stay and count; no rows give no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    known = known.withColumn("rule", rule).withColumn("own", verdict)
    share = lambda kind: F.avg((F.coalesce("own", F.lit("")) == kind).cast("double"))
    seeds = known.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    found = spread(seeds, written(host_edges(known), "url-edges"))
    hosts = found.select("host", ((F.col("distrust") > LEAST) & (F.col("distrust") > F.col("trust"))).alias("bad")).where("bad")
    verdicts = known.select("page_id", "host", "path", "rule", "own").join(hosts, "host", "left")
    return verdicts.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op7_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
