"""Breadth-first crawls over tables of pages, as DataFrame steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archloom.functions.url import extension, host, html_decode, is_http, local_path, same_site, trim, type_from_mime, type_from_url
from archloom.operators import robots as R
from archloom.operators.links import css_links, dedup, js_links, links
from archloom.operators.paths import assign
from archloom.operators.ranking import running
from archloom.sources.shared import Bucketed, kept, removed, stored


def closure(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Columns url, depth: everything that edges (src, dst, kind) reach within max_depth.

    A page lies one deeper than the page that links to it, an asset as deep. Each step joins what the
    last one found with the edges and drops what was seen, which is final, as depths rise: assets of
    a depth are followed to their end before pages of the next. The seen-set and the edges are dealt by
    URL once; steps are added to the former, and neither is shuffled again.
    """
    spark = seeds.sparkSession
    found = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    seen = Bucketed(spark, "url", found.schema)
    graph = Bucketed(spark, "src", edges.select("src", "dst", "kind").schema)
    graph.add(edges)

    def step(rows: DataFrame, kind: str, deeper: int) -> DataFrame:
        to = graph.read().where(F.col("kind") == kind).select(F.col("src").alias("url"), "dst")
        new = rows.join(to, "url").select(F.col("dst").alias("url"), (F.col("depth") + deeper).alias("depth")).distinct()
        return stored(new.join(seen.read().select("url"), "url", "left_anti"), "level")

    level = stored(found, "level")
    for depth in range(max_depth + 1):
        new = level
        while not new.isEmpty():
            seen.add(new)
            new, old = step(new, "asset", 0), new
            if old is not level:
                removed(old)
        removed(new)
        if depth == max_depth:
            break
        level, old = step(seen.read().where(F.col("depth") == depth), "page", 1), level
        if old is not new:
            removed(old)
        if level.isEmpty():
            break
    graph.drop()
    return seen.read()


def locations(files: DataFrame) -> DataFrame:
    """Columns src, loc of sitemap files (url, body)."""
    return files.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("body", F.lit("<loc>([^<]*)</loc>"), 1)).alias("loc")).withColumn("loc", html_decode(trim(F.col("loc"))))


def sitemap_urls(files: DataFrame, start: str, root_host: str, most_files: int = 12, most_urls: int = 3000) -> DataFrame:
    """Columns url, depth: pages that the sitemaps reachable from start list, at most most_urls in order."""
    locs = kept(locations(files).join(files.select(F.col("url").alias("loc"), F.lit(True).alias("is_file")), "loc", "left"))
    level = files.where(F.col("url") == start).select("url")
    read = level
    for _ in range(most_files):
        level = locs.join(level, locs["src"] == level["url"]).where("is_file").select(F.col("loc").alias("url")).distinct().join(read, "url", "left_anti")
        level = kept(level)
        if level.isEmpty():
            break
        read = kept(read.unionByName(level).distinct())
    pages = locs.join(read, locs["src"] == read["url"]).where("is_file is null").select(F.col("loc").alias("url")).distinct()
    return pages.where(same_site(F.col("url"), F.lit(root_host), F.lit(False))).orderBy("url").limit(most_urls).withColumn("depth", F.lit(1))


@dataclass
class Options:
    """What a crawl may do; limits of zero hold nothing back but pages, assets, depth and bytes."""

    root_host: str
    max_pages: int = 150
    max_assets: int = 1500
    max_depth: int = 6
    max_bytes: int = 600 << 20
    most_file_bytes: int = 25 << 20
    respect_robots: bool = True
    external_assets: bool = True
    subdomains: bool = False
    scripts: bool = False
    types: dict[str, bool] = field(default_factory=dict)
    skip_ext: tuple[str, ...] = ()

    def in_scope(self, url: Column) -> Column:
        return same_site(url, F.lit(self.root_host), F.lit(self.subdomains))

    def off(self, kind: Column) -> Column:
        return kind.isin(*[k for k, on in self.types.items() if not on])


def reject_reason(o: Options, url: Column, kind: Column, type_: Column, robots: Column) -> Column:
    """Why a queued URL is not fetched; null to go ahead. robots: whether its host's rules allow it."""
    scope = o.in_scope(url)
    ext = extension(url)
    return (
        F.when(~is_http(url), "not an http(s) URL")
        .when(F.lit(o.respect_robots) & scope & ~F.coalesce(robots, F.lit(True)), "blocked by robots.txt")
        .when((kind == "page") & ~scope, "outside the site")
        .when((kind == "asset") & ~scope & F.lit(not o.external_assets), "external file (option off)")
        .when((type_ != "") & (type_ != "html") & o.off(type_), F.concat(type_, F.lit(" files are turned off")))
        .when((ext != "") & ext.isin(*o.skip_ext), F.concat(F.lit("."), ext, F.lit(" is on your skip list")))
    )


def effective_type(ctype: Column, guess: Column) -> Column:
    """The type that the response header says, or else the one guessed, or a document."""
    return F.coalesce(F.nullif(type_from_mime(F.coalesce(ctype, F.lit(""))), F.lit("")), F.nullif(guess, F.lit("")), F.lit("doc"))


def handled(o: Options, d: DataFrame) -> DataFrame:
    """Rows of queued URLs joined with their responses: kind, type, state and note as the response has them.

    d: url, kind, type, and final_url, status, ctype, size, error of the response (null for none).
    """
    problem = (
        F.when(F.coalesce("size", F.lit(0)) > o.most_file_bytes, "skipped: larger than the per-file limit").when(F.coalesce("error", F.lit("")) != "", F.col("error"))
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(F.coalesce("status", F.lit(0)) == 0, "no response")
    )
    d = d.withColumns({"problem": problem, "real": effective_type(F.col("ctype"), F.col("type")), "final_url": F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))})
    kind = F.when((F.col("kind") == "page") & (F.col("real") != "html"), "asset").otherwise(F.col("kind"))
    off = (F.col("real") != "html") & o.off(F.col("real"))
    away = (kind == "page") & (F.col("final_url") != F.col("url")) & ~o.in_scope(F.col("final_url"))
    fine = F.col("problem").isNull()
    return d.withColumns({
        "state": F.when(~fine, "fail").when(off | away, "skip").otherwise("ok"),
        "note": F.when(~fine, F.col("problem")).when(off, F.concat("real", F.lit(" files are turned off"))).when(away, "redirected off-site").otherwise(""),
        "kind": F.when(fine, kind).otherwise(F.col("kind")),
        "type": F.when(fine, F.col("real")).otherwise(F.col("type")),
    }).drop("problem", "real")


def named(o: Options, site: DataFrame) -> DataFrame:
    """Rows src, first (its place), url, kind, type: what each fetched document (final_url, ctype, body) names.

    All documents are read at once; a crawl then follows the rows. Documents without a type in
    their response are taken for what their name says, or else for HTML. Of URLs that lead to one
    final URL the first counts; which that is, their heads tell, so no body is shuffled.
    """
    src = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    guess = F.coalesce(F.nullif(type_from_url(src), F.lit("")), F.lit("html"))
    fine = site.where("status between 1 and 399")
    chosen = fine.groupBy(src.alias("src")).agg(F.min("url").alias("page_id"))
    d = fine.select("url", src.alias("src"), effective_type(F.col("ctype"), guess).alias("type"), F.col("body").cast("string").alias("text"))
    pages = d.where("type = 'html'").select(F.col("url").alias("page_id"), F.col("src").alias("url"), F.col("text").alias("html"))
    out = named_by(o, links(pages, o.scripts))
    at = F.struct("pos", F.lit(0).alias("apos"), F.lit(0).alias("ipos")).alias("first")
    one = lambda t, name: d.where(F.col("type") == t).select(F.col("url").alias("id"), F.col("src").alias("base"), F.col("text").alias(name))
    for more in (css_links(one("css", "css")), *([js_links(one("js", "js"))] if o.scripts else [])):
        more = more.select(F.col("id").alias("src"), at, F.col("target").alias("url"), F.lit("asset").alias("kind"), "type")
        out = out.unionByName(more.withColumn("inside", o.in_scope(F.col("url"))))
    return out.withColumnRenamed("src", "page_id").join(chosen, "page_id").select(out.columns)


def named_by(o: Options, found: DataFrame) -> DataFrame:
    """Rows of named() from the links of pages, whose page_id is their URL."""
    out = dedup(found).select(F.col("page_id").alias("src"), "first", F.col("target").alias("url"), "kind", "type")
    return out.withColumn("type", F.when(F.col("kind") == "page", "html").otherwise(F.col("type"))).withColumn("inside", o.in_scope(F.col("url")))


_FOUND = "seq long, url string, kind string, type string, depth int"
_TOLD = ["seq", "kind", "type", "state", "note", "code", "bytes", "final_url", "hash"]


def crawl(seeds: DataFrame, site: DataFrame, robots: DataFrame, o: Options, edges: DataFrame | None = None) -> DataFrame:
    """Resources of a crawl: seq, url, kind, type, depth, state, note, code, bytes, final_url, hash, path.

    seeds: url, depth. site: the responses that a fetch gives (url, final_url, status, ctype, body,
    size, error); of several of one url the least head counts. robots: host, body. edges: the rows of
    named(), where they are known already; else they are read from the bodies. Pages are taken level by level, in the order of
    their discovery (parent, place), then assets; what a level finds is queued after all before it.
    Budgets are global running sums over that order, so they cut exactly: what they leave stays queued.

    Bodies are read in one pass over the responses, which gives their links and hashes and shuffles no
    body. What was found is the seen-set: dealt by URL, added to level by level, never written anew.
    A level joins what the last one found with the responses' heads and the links, which lie dealt too.
    """
    spark = seeds.sparkSession
    rows = R.rules(robots)
    chosen = kept(rows.join(R.group(rows), ["host", "agent"]))
    heads = site.select(F.col("url").alias("at"), "final_url", F.col("status").cast("int").alias("status"), "ctype", F.col("size").cast("long").alias("size"), "error", F.sha1("body").alias("sha"))
    heads = heads.groupBy("at").agg(F.min(F.struct(*heads.columns[1:])).alias("x")).select("at", "x.*")
    edges = named(o, site) if edges is None else edges
    responses, links_of = Bucketed(spark, "at", heads.schema), Bucketed(spark, "src", edges.schema)
    responses.add(heads)
    links_of.add(edges)
    first = Window.orderBy("depth", "url")  # seeds are the few URLs that a person or a sitemap names
    queue = stored(seeds.select("url", F.col("depth").cast("int").alias("depth")).withColumns({"seq": (F.row_number().over(first) - 1).cast("long"), "kind": F.lit("page"), "type": F.lit("html")}).select("seq", "url", "kind", "type", "depth"), "queue")
    found = Bucketed(spark, "url", spark.createDataFrame([], _FOUND).schema)
    found.add(queue)
    n, told = queue.count(), None
    done = {"page": 0, "asset": 0, "bytes": 0}
    for turn, most in (("page", o.max_pages), ("asset", o.max_assets)):
        if turn == "asset":
            waiting = found.read().where("kind = 'asset'")
            queue = stored(waiting.select("seq", "url", "kind", "type", "depth"), "queue")
        while done[turn] < most and done["bytes"] < o.max_bytes and not queue.isEmpty():
            taken = _taken(o, queue, turn, most, done, responses, chosen)
            removed(queue)
            if taken.isEmpty():
                queue = taken
                break
            fine = F.col("state") == "ok"
            for kind, k, used in taken.where(fine).groupBy("kind").agg(F.count("*"), F.sum("bytes")).collect():  # one row a kind
                done[kind] += k
                done["bytes"] += used
            told = taken if told is None else told.unionByName(taken)
            ok = taken.where(fine).select(F.col("seq").alias("parent"), F.col("final_url").alias("src"), F.col("depth").alias("above"))
            new = ok.join(links_of.read(), "src").withColumn("depth", F.when(F.col("kind") == "page", F.col("above") + 1).otherwise(F.col("above")))
            new = new.where((F.col("kind") == "asset") | ((F.col("depth") <= o.max_depth) & F.col("inside")))
            new = new.groupBy("url").agg(F.min(F.struct("parent", "first", "kind", "type", "depth")).alias("x")).select("url", "x.*")
            new = new.join(found.read().select("url"), "url", "left_anti")
            new = running(new.withColumn("order", F.struct("parent", "first")), "order", place=F.lit(1)).withColumn("seq", F.col("place") + n)
            new = stored(new.select("seq", "url", "kind", "type", "depth"), "queue")
            found.add(new)
            n += new.count()
            queue = stored(new.where(F.col("kind") == turn), "queue")
            removed(new)
    empty = spark.createDataFrame([], "seq long, kind string, type string, state string, note string, code int, bytes long, final_url string, hash string")
    told = empty if told is None else told.select(_TOLD)
    res = found.read().join(told.withColumnsRenamed({"kind": "k", "type": "t"}), "seq", "left")
    res = res.select("seq", "url", F.coalesce("k", "kind").alias("kind"), F.coalesce("t", "type").alias("type"), "depth", F.coalesce("state", F.lit("queued")).alias("state"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("final_url", F.lit("")).alias("final_url"), F.coalesce("hash", F.lit("")).alias("hash"))
    res = stored(res, "resources")
    for x in (responses, links_of, found):
        x.drop()
    ok = res.where("state = 'ok'").select("seq", F.col("final_url").alias("url"), local_path(F.col("final_url"), F.col("type"), F.lit(o.root_host)).alias("path"), "hash")
    files = assign(ok)
    return res.join(files.select("seq", F.col("file").alias("path")), "seq", "left").withColumn("path", F.coalesce("path", F.lit("")))


def _taken(o: Options, queue: DataFrame, turn: str, most: int, done: dict[str, int], responses: Bucketed, chosen: DataFrame) -> DataFrame:
    """What the budgets take of a queue, with what became of it."""
    verdict = R.allowed(queue.select("url", host(F.col("url")).alias("host")), chosen)
    judged = queue.join(verdict, "url", "left")
    judged = judged.withColumn("reason", reject_reason(o, F.col("url"), F.col("kind"), F.col("type"), F.col("allowed")))
    got = handled(o, judged.join(responses.read(), (F.col("url") == F.col("at")) & F.col("reason").isNull(), "left"))
    refused = F.col("reason").isNotNull()
    got = got.withColumns({"state": F.when(refused, "skip").otherwise(F.col("state")), "note": F.coalesce("reason", "note"), "kind": F.when(refused, F.lit(turn)).otherwise(F.col("kind"))})
    fine = F.col("state") == "ok"
    got = got.withColumns({"code": F.coalesce("status", F.lit(0)).cast("int"), "bytes": F.when(fine, F.coalesce("size", F.lit(0))).otherwise(0).cast("long"), "hash": F.when(fine, F.col("sha")).otherwise(""), "final_url": F.when(refused, "").otherwise(F.col("final_url"))})
    got = running(got.select(*_TOLD, "depth"), "seq", spent=(fine & (F.col("kind") == turn)).cast("long"), used=F.col("bytes"))
    return stored(got.where((F.col("spent") + done[turn] < most) & (F.col("used") + done["bytes"] < o.max_bytes)), "told")


def counters(res: DataFrame) -> DataFrame:
    """One row: pages_done, pages_failed, assets_done, assets_failed, skipped, bytes."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return res.agg(
        n("kind = 'page' and state = 'ok'").alias("pages_done"), n("kind = 'page' and state = 'fail'").alias("pages_failed"), n("kind = 'asset' and state = 'ok'").alias("assets_done"),
        n("kind = 'asset' and state = 'fail'").alias("assets_failed"), n("state = 'skip'").alias("skipped"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )
