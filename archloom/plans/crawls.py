"""Crawls over the pages given: a site of their own and of what they link to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archloom.functions.url import host, normalize, path
from archloom.operators import links as L
from archloom.operators.crawl import Options, closure, counters, crawl, named_by
from archloom.sources.shared import removed, stored

from .extraction import ALL, LINKS
from .kit import d_base_domain, d_parts, query, table

#: The documents of the site: each page at its own URL, and a page of the host at each linked URL with an e in its path.
_AT = "regexp_extract({}, '^[a-z]+://[^/]*', 0)"
DOCS = f"""{LINKS.replace(ALL, 'd AS (SELECT page_id, url, html FROM pages)').replace('WITH ', 'WITH RECURSIVE ', 1)}, {d_parts('d', 'url', 'o')},
rk AS (SELECT page_id, o_url AS url, o_host AS host, row_number() OVER (PARTITION BY o_host ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY o_host) AS n FROM o),
ex AS (SELECT target AS url, rk.page_id FROM (SELECT DISTINCT target, g_host FROM links) AS t JOIN rk ON rk.host = t.g_host AND rk.k = length(t.target) % rk.n
  WHERE regexp_extract(target, '^[a-z]+://[^/]*([^?]*)', 1) LIKE '%e%' AND target NOT IN (SELECT url FROM rk)),
docs AS (SELECT url, page_id FROM rk UNION ALL SELECT url, page_id FROM ex),
edges AS (SELECT DISTINCT docs.url AS src, CASE WHEN {_AT.format('l.target')} = {_AT.format('rk.url')} THEN {_AT.format('docs.url')} || substr(l.target, length({_AT.format('l.target')}) + 1) ELSE l.target END AS dst, l.kind FROM docs JOIN rk USING (page_id) JOIN links AS l USING (page_id)),
seeds AS (SELECT host, min(url) AS url FROM rk WHERE {d_base_domain('host')} = 'example.com' GROUP BY host)"""
_HOST = "regexp_extract(dst, '^[a-z]+://([^/:]*)', 1)"
_INSIDE = f"{d_base_domain(_HOST)} = 'example.com'"


def _reach(max_depth: int, inside: str = _INSIDE) -> str:
    return f"reach(url, depth) AS (SELECT url, 0 FROM seeds UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = url WHERE depth < {max_depth} AND {inside})"


_STATES = "SELECT url, min(depth)::INT AS depth, CASE WHEN url IN (SELECT url FROM docs) THEN 'ok' ELSE 'fail' END AS state FROM reach GROUP BY url"


def documents(spark, sf_dir):
    """The site's documents (url, html), the links of all (page_id: their URL), its pages by name, and what is stored for them.

    A page is parsed once. The documents beside the pages are as many as the URLs named, each with a page's body.
    """
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    own = p.select("page_id", F.explode(F.array(normalize(F.col("url")))).alias("own"), "html")
    found = stored(L.links(own.select(F.col("own").alias("page_id"), F.col("own").alias("url"), "html")), "links")
    # Pages of a host by number, which a query's SQL can say; the counts are one row a host.
    names = own.select("page_id", "own").withColumn("host", host(F.col("own")))
    number = names.select("host", "page_id", (F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1).alias("k"))
    to = found.select("target").distinct().withColumns({"host": host(F.col("target")), "at": path(F.col("target"))}).where(F.col("at").contains("e"))
    to = to.join(names.select(F.col("own").alias("target")), "target", "left_anti").join(names.groupBy("host").agg(F.count("*").alias("n")), "host")
    extra = stored(to.withColumn("k", (F.length("target") % F.col("n")).cast("int")).join(number, ["host", "k"]).select(F.col("target").alias("url"), "page_id"), "extra")
    # Only bodies that are taken meet the URLs; these pages are told by a list of their numbers.
    taken = stored(extra.select("page_id").distinct(), "taken")
    more = extra.join(p.select("page_id", "html").join(taken, "page_id", "left_semi"), "page_id").select("url", "html")
    every = found.unionByName(L.links(more.select(F.col("url").alias("page_id"), "url", "html")))
    return own.select(F.col("own").alias("url"), "html").unionByName(more), every, names, [found, extra, taken]


def _crawl(spark, sf_dir, **options):
    docs, found, names, made = documents(spark, sf_dir)
    one = lambda v, t: F.lit(v).cast(t)
    site = docs.select("url", F.col("url").alias("final_url"), one(200, "int").alias("status"), F.lit("text/html").alias("ctype"), F.col("html").alias("body"), F.octet_length("html").cast("long").alias("size"), F.lit("").alias("error"))
    robots = spark.createDataFrame([], "host string, body string")
    o = Options("example.com", subdomains=True, **({"max_pages": 10**9, "max_bytes": 1 << 60} | options))
    out = crawl(_seeds(names).withColumn("depth", F.lit(0)), site, robots, o, named_by(o, found))
    for x in made:
        removed(x)
    return out


def _seeds(names):
    """The least URL of each host in scope."""
    return names.where(in_scope(F.col("own"))).groupBy("host").agg(F.min("own").alias("url")).select("url")


def in_scope(url):
    return Options("example.com", subdomains=True).in_scope(url)


query("crawl_site", f"{DOCS}, {_reach(3)} {_STATES}")(lambda s, d: _crawl(s, d, max_depth=3).select("url", "depth", "state"))
query("crawl_site_max_depth", f"{DOCS}, {_reach(1)} {_STATES}")(lambda s, d: _crawl(s, d, max_depth=1).select("url", "depth", "state"))
# Seeds come first in order of URL, and all have a page; so three are taken, and what they link to is left.
query("crawl_site_max_pages", f"{DOCS}, taken AS (SELECT url FROM seeds ORDER BY url LIMIT 3) SELECT url, 0 AS depth, CASE WHEN url IN (SELECT url FROM taken) THEN 'ok' ELSE 'queued' END AS state FROM seeds UNION ALL SELECT DISTINCT dst, 1, 'queued' FROM edges JOIN taken ON url = src WHERE {_INSIDE} AND dst NOT IN (SELECT url FROM seeds)")(
    lambda s, d: _crawl(s, d, max_pages=3).select("url", "depth", "state")
)
query("crawl_counters", f"{DOCS}, {_reach(2)}, st AS ({_STATES}) SELECT count(*) FILTER (state = 'ok') AS pages_done, count(*) FILTER (state = 'fail') AS pages_failed, 0::BIGINT AS assets_done, 0::BIGINT AS assets_failed, 0::BIGINT AS skipped, sum((SELECT strlen(html) FROM docs JOIN pages USING (page_id) WHERE docs.url = st.url))::BIGINT AS bytes FROM st")(
    lambda s, d: counters(_crawl(s, d, max_depth=2))
)


@query("crawl_bfs", f"{DOCS}, {_reach(4, 'true')} SELECT url, min(depth)::INT AS depth FROM reach GROUP BY url")
def crawl_bfs(spark, sf_dir):
    _, found, names, made = documents(spark, sf_dir)
    out = closure(_seeds(names), found.select(F.col("page_id").alias("src"), F.col("target").alias("dst"), "kind"), max_depth=4)
    for x in made:
        removed(x)
    return out


@query("discover", f"{DOCS} SELECT page_id, target AS dst, arg_max(kind, pos * 1000000 + apos * 1000 + ipos) AS kind, 1 AS depth, min(pos)::INT AS pos FROM links WHERE target NOT IN (SELECT url FROM rk) GROUP BY page_id, target")
def discover(spark, sf_dir):
    """What pages of depth 0 name that is not known yet; assets would stay at their depth."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = L.dedup(L.links(p)).join(p.select(normalize(F.col("url")).alias("target")), "target", "left_anti")
    return found.select("page_id", F.col("target").alias("dst"), "kind", F.when(F.col("kind") == "page", 1).otherwise(0).alias("depth"), "pos")
