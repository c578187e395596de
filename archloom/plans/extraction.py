"""Link extraction, robots and rewriting over the pages table and literal documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from archloom.functions.url import host
from archloom.operators import links as L
from archloom.operators import rewriting as W
from archloom.operators import robots as R

from .kit import PAGE_HOST, PAGE_PATH, both, given, d_decode, d_parts, d_ref, d_trim, d_type, fixture, literal, query, table, values

DOCS = [
    (-1, "https://site.test/dir/p", '<html><head><base href="/base/"><link rel="stylesheet" href="a.css"><link rel=icon href=f.ico><link rel="preload" as="font" href="x.woff2"><link rel="canonical" href="/c"></head><body background="bg.png"><a href="b.pdf">b</a><a href=\'q?x=1&amp;y=2\'>q</a><img src="i.png" data-src="big.webp"><script src="/s.js">var a="<a href=no>";</script><!-- <a href="no"> --><iframe src="f.html"></iframe><form action="/go"></form><a href="mailto:x@y">m</a><a href="b.pdf#2">again</a><video src="v" poster="p.jpg"></video></body></html>'),
    (-2, "https://site.test/e", '<base href=""><a href="x">x</a><textarea><a href="no"></textarea><style>.a{background:url(z.png)}</style><object data="o.swf"></object><input src="b.gif"><embed src="e"><track src="t.vtt"><area href="m.zip"><a name="none">n</a>'),
    (-3, "https://site.test/f/", '<meta http-equiv="refresh" content="5; url=\'/next\'"><meta property="og:image" content="https://site.test/og.png"><meta name="twitter:image" content="/no.png"><meta name="keywords" content="https://no/"><meta property="og:video" content="http://cdn.t/v"><style>@import "b.css"; a{b:url(bg.png)} c{d:url(data:x)}</style><style>e{f:URL( \'f.woff2\' )}</style><img srcset="a.png 1x,b.webp 2x, c" src="d.png"><source data-srcset="data:x, y 2x"><div style="background:url(&quot;in line.jpg&quot;), url(z)">x</div><link imagesrcset="l.png 2x" rel="preload" as="image"><script>load("js/x.json"); y = \'p/q.css\';</script><!-- <style>a{b:url(no.png)}</style> -->'),
]
ALL = f"d AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {values(DOCS, 'page_id, url, html')})"

_body = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("script", "style", "textarea"):
    _body = f"regexp_replace({_body}, '(?is)(<{_t}\\b[^>]*>).*?</{_t}\\s*>', '\\1</{_t}>', 'g')"
_TAG = literal(L.TAG.replace("++", "+").replace("*+", "*"))
_ATTR = literal(L.ATTR)
_unq = lambda e: f"""regexp_replace({e}, '^["'']|["'']$', '', 'g')"""
TAGS = f"tg AS (SELECT page_id, url, i - 1 AS pos, raws[i] AS raw, lower(regexp_extract(raws[i], '^<([a-zA-Z][-a-zA-Z0-9:_]*)', 1)) AS tag FROM (SELECT page_id, url, regexp_extract_all({_body}, {_TAG}, 0) AS raws FROM d) AS x, unnest(range(1, len(raws) + 1)) AS u(i))"
ATTRS = f"""att AS (SELECT page_id, url, pos, tag, raw, i - 1 AS apos, lower(regexp_extract(pairs[i], '^([^\\s=]+)', 1)) AS attr, {_unq("regexp_extract(pairs[i], '(?s)=" + chr(92) + "s*(.*)$', 1)")} AS value
  FROM (SELECT *, regexp_extract_all(raw, {_ATTR}, 0) AS pairs FROM tg) AS x, unnest(range(1, len(pairs) + 1)) AS u(i))"""


def d_attribute(tag: str, name: str) -> str:
    return d_trim(_unq(f"""regexp_extract({tag}, '(?i)\\s{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)"""))


def d_skippable(ref: str) -> str:
    r = f"lower({d_trim(ref)})"
    return "(" + " OR ".join([f"{r} = ''", *(f"starts_with({r}, '{p}')" for p in L.SKIP_PREFIXES), *(f"contains({r}, '{m}')" for m in L.SKIP_MARKS)]) + ")"


_baseref = d_attribute("regexp_extract(html, '(?i)<base\\s[^>]*>', 0)", "href")
BASES = f"""{d_parts('d', 'url', 'b')}, bx AS (SELECT page_id, url, html, CASE WHEN {_baseref} <> '' THEN {d_ref('b', _baseref)} END AS bref FROM b),
{d_parts('bx', 'bref', 'c')}, bases AS (SELECT page_id, coalesce(nullif(c_url, ''), url) AS base FROM c)"""
_attrs, _sets = (", ".join(f"'{a}'" for a in x) for x in (L.URL_ATTRS, L.SRCSET_ATTRS))
_mi = ", ".join(f"'{m}'" for m in L.META_IMAGES)
_refresh = _unq(d_trim("regexp_extract(value, '(?i)^\\s*[0-9.]+\\s*;\\s*url\\s*=\\s*(.+)$', 1)"))
_prop = f"coalesce(nullif({d_attribute('raw', 'property')}, ''), {d_attribute('raw', 'name')})"
_meta = f"CASE WHEN lower({d_attribute('raw', 'http-equiv')}) = 'refresh' THEN nullif({_refresh}, '') WHEN lower({_prop}) IN ({_mi}) AND regexp_matches(value, '(?i)^https?://') THEN value END"
_nocomment = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"


def _css_in(source: str, css: str) -> str:
    """DuckDB: rows of a source with css, as columns ipos, ref, via."""
    found = f"list_concat(regexp_extract_all({css}, {literal(L.CSS_URL)}, 0), regexp_extract_all({css}, {literal(L.CSS_IMPORT)}, 0))"
    inner = _unq(d_trim("CASE WHEN starts_with(f[j], '@') THEN regexp_extract(f[j], '(?i)^@import" + chr(92) + "s+(.*)$', 1) ELSE regexp_extract(f[j], '(?i)^url" + chr(92) + "((.*)" + chr(92) + ")$', 1) END"))
    return f"(SELECT y.*, j - 1 AS ipos, {inner} AS ref, CASE WHEN starts_with(f[j], '@') THEN 'import' ELSE 'css' END AS via FROM (SELECT *, {found} AS f FROM {source}) AS y, unnest(range(1, len(f) + 1)) AS v(j))"


_style = f"(SELECT page_id, url, i - 1 AS apos, bs[i] AS body FROM (SELECT page_id, url, regexp_extract_all({_nocomment}, '(?is)<style\\b[^>]*>(.*?)</style\\s*>', 1) AS bs FROM d) AS x, unnest(range(1, len(bs) + 1)) AS u(i))"
LINKS = f"""WITH {ALL}, {TAGS}, {ATTRS}, {BASES},
rs AS (SELECT page_id, url, pos, apos, 0 AS ipos, tag, attr, raw, value AS ref, 'attr' AS via FROM att WHERE attr IN ({_attrs})
 UNION ALL SELECT page_id, url, pos, apos, k - 1, tag, attr, raw, regexp_extract(it[k], '^(\\S+)', 1), 'srcset' FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(value, '\\s*,\\s*'), lambda x: {d_trim('x')}), lambda x: x <> '') AS it FROM att WHERE attr IN ({_sets}) AND NOT contains(lower(value), 'data:')) AS z, unnest(range(1, len(it) + 1)) AS w(k)
 UNION ALL SELECT page_id, url, pos, apos, ipos, tag, attr, raw, ref, via FROM {_css_in("(SELECT * FROM att WHERE attr = 'style') AS q", d_decode('value'))} AS y
 UNION ALL SELECT page_id, url, pos, apos, 0, tag, attr, raw, m, 'meta' FROM (SELECT *, {_meta} AS m FROM att WHERE tag = 'meta' AND attr = 'content') AS z WHERE m IS NOT NULL
 UNION ALL SELECT page_id, url, -1, apos, ipos, 'style', '', '', ref, via FROM {_css_in(_style + ' AS q', 'body')} AS y),
lk AS (SELECT rs.*, bases.base FROM rs JOIN bases USING (page_id) WHERE NOT {d_skippable('ref')}),
{d_parts('lk', 'base', 'e')}, lr AS (SELECT page_id, url, pos, apos, ipos, tag, attr, raw, via, {d_ref('e', 'ref')} AS x FROM e),
{d_parts('lr', 'x', 'g')}, lt AS (SELECT *, g_url AS target, {d_type('g_ext')} AS ext_type, lower({d_attribute('raw', 'rel')}) AS rel, lower({d_attribute('raw', 'as')}) AS as_ FROM g WHERE g_url <> ''),
lc AS (SELECT *, coalesce({L.CLASSIFY_VIA}, CASE WHEN via = 'attr' THEN {L.CLASSIFY} END) AS class FROM lt),
links AS (SELECT page_id, url, pos, apos, ipos, target, split_part(class, ':', 1) AS kind, split_part(class, ':', 2) AS type, g_host FROM lc WHERE class IS NOT NULL)"""


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(fixture(spark, DOCS, "page_id long, url string, html string"))


query("html_protect", f"WITH {ALL} SELECT page_id, sha1({_body}) AS body FROM d")(lambda s, d: pages(s, d).select("page_id", F.sha1(L.protect(F.col("html"))).alias("body")))
query("extract_tags", f"WITH {ALL}, {TAGS} SELECT page_id, pos::INT AS pos, tag FROM tg")(lambda s, d: L.tags(pages(s, d)).select("page_id", "pos", "tag"))
query("extract_attrs", f"WITH {ALL}, {TAGS}, {ATTRS} SELECT page_id, pos::INT AS pos, apos::INT AS apos, attr, value FROM att")(lambda s, d: L.attributes(pages(s, d)).select("page_id", "pos", "apos", "attr", "value"))
query("base_href", f"WITH {ALL}, {BASES} SELECT page_id, base FROM bases")(lambda s, d: pages(s, d).select("page_id", L.base_href(F.col("html"), F.col("url")).alias("base")))
query("filter_skippable", f"WITH {ALL}, {TAGS}, {ATTRS} SELECT page_id, value FROM att WHERE {d_skippable('value')}")(lambda s, d: L.attributes(pages(s, d)).where(L.skippable(F.col("value"))).select("page_id", "value"))
query("extract_links", f"{LINKS} SELECT page_id, pos::INT AS pos, apos::INT AS apos, ipos::INT AS ipos, target, kind, type FROM links")(lambda s, d: L.links(pages(s, d)).select("page_id", "pos", "apos", "ipos", "target", "kind", "type"))
query("link_kind", f"{LINKS} SELECT kind, type, count(*)::BIGINT AS n FROM links GROUP BY kind, type")(lambda s, d: L.links(pages(s, d)).groupBy("kind", "type").agg(F.count("*").alias("n")))
query("link_dedup", f"{LINKS} SELECT page_id, target, min(pos)::INT AS pos, arg_max(kind, pos * 1000000 + apos * 1000 + ipos) AS kind, arg_max(type, pos * 1000000 + apos * 1000 + ipos) AS type FROM links GROUP BY page_id, target")(lambda s, d: L.dedup(L.links(pages(s, d))).drop("first"))
query("host_links", f"{LINKS} SELECT g_host AS host, kind, type, count(*)::BIGINT AS n, count(DISTINCT page_id)::BIGINT AS pages FROM links GROUP BY g_host, kind, type")(
    lambda s, d: L.links(pages(s, d)).groupBy(host(F.col("target")).alias("host"), "kind", "type").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))
)

SHEETS = [(1, "https://site.test/css/app.css", "a{b:url(../font/a.woff2)} c{d:url( 'x.png' )} e{f:url(\"y\")} @import \"b.css\"; @import 'c'; g{h:url(data:x)}"), (2, "https://h/", "none")]
_BODY = "regexp_extract(html, '<style[^>]*>([^<]*)<', 1)"
_SHEETS = both(SHEETS, "id, base, css", f"SELECT 1000 + page_id, url, concat({_BODY}, ' x{{y:url(../', CAST(page_id AS VARCHAR(20)), '.png)}} @import \"', CAST(page_id AS VARCHAR(20)), '\";') FROM pages")
_css = f"""WITH s AS (SELECT * FROM {_SHEETS}), {d_parts('s', 'base', 'b')},
r AS (SELECT *, i - 1 AS pos, raws[i] AS raw FROM (SELECT *, list_concat(regexp_extract_all(css, {literal(L.CSS_URL)}, 0), regexp_extract_all(css, {literal(L.CSS_IMPORT)}, 0)) AS raws FROM b) AS x, unnest(range(1, len(raws) + 1)) AS u(i)),
i AS (SELECT *, {_unq(d_trim("CASE WHEN starts_with(raw, '@') THEN regexp_extract(raw, '(?i)^@import" + chr(92) + "s+(.*)$', 1) ELSE regexp_extract(raw, '(?i)^url" + chr(92) + "((.*)" + chr(92) + ")$', 1) END"))} AS ref FROM r),
t AS (SELECT id, pos, raw, {d_ref('b', 'ref')} AS x FROM i WHERE NOT {d_skippable('ref')}), {d_parts('t', 'x', 'n')}
SELECT id, pos::INT AS pos, n_url AS target, CASE WHEN {d_type('n_ext')} IN ('', 'html') THEN CASE WHEN starts_with(raw, '@') OR contains(n_url, '.css') THEN 'css' ELSE 'img' END ELSE {d_type('n_ext')} END AS type FROM n WHERE n_url <> ''"""
query("extract_css", _css)(lambda s, d: L.css_links(given(s, d, _SHEETS, "pages")))
SCRIPTS = [(1, "https://site.test/js/", "load('img/a.png'); x=\"/b.css?v=2\"; y='not a file'; z=\"lib.min.js\"; u='https://cdn.t/v.mp4'")]
_SCRIPTS = both(SCRIPTS, "id, base, js", "SELECT 1000 + page_id, url, concat(regexp_extract(html, '<script[^>]*>([^<]*)<', 1), ' load(\"p/', CAST(page_id AS VARCHAR(20)), '.js\");') FROM pages")
_js = f"""WITH s AS (SELECT * FROM {_SCRIPTS}), {d_parts('s', 'base', 'b')},
r AS (SELECT *, i - 1 AS pos, raws[i] AS raw FROM (SELECT *, regexp_extract_all(js, {literal(L.JS_LITERAL)}, 0) AS raws FROM b) AS x, unnest(range(1, len(raws) + 1)) AS u(i)),
t AS (SELECT id, pos, {d_ref('b', _unq('raw'))} AS x FROM r), {d_parts('t', 'x', 'n')} SELECT id, pos::INT AS pos, n_url AS target, {d_type('n_ext')} AS type FROM n WHERE n_url <> ''"""
query("script_links", f"""WITH {ALL}, sb AS (SELECT page_id, url, i - 1 AS apos, bs[i] AS body FROM (SELECT page_id, url, regexp_extract_all({_nocomment}, '(?is)<script\\b[^>]*>(.*?)</script\\s*>', 1) AS bs FROM d) AS x, unnest(range(1, len(bs) + 1)) AS u(i)), {BASES},
sl AS (SELECT page_id, apos, j - 1 AS ipos, {_unq('ls[j]')} AS ref, base FROM (SELECT *, regexp_extract_all(body, {literal(L.JS_LITERAL)}, 0) AS ls FROM sb JOIN bases USING (page_id)) AS y, unnest(range(1, len(ls) + 1)) AS v(j)),
{d_parts('sl', 'base', 'k')}, sr AS (SELECT page_id, apos, ipos, {d_ref('k', 'ref')} AS x FROM k WHERE NOT {d_skippable('ref')}), {d_parts('sr', 'x', 'n')}
SELECT page_id, apos::INT AS apos, ipos::INT AS ipos, n_url AS target, 'asset' AS kind, {d_type('n_ext')} AS type FROM n WHERE n_url <> ''""")(lambda s, d: L.links(pages(s, d), scripts=True).where("pos = -2").select("page_id", "apos", "ipos", "target", "kind", "type"))
query("extract_js", _js)(lambda s, d: L.js_links(given(s, d, _SCRIPTS, "pages")))
SETS = [(1, "a.png 1x, b.png 2x"), (2, "c.webp"), (3, "d,e.png 100w,  f.png 50w,"), (4, "")]
_SETS = both(SETS, "id, value", "SELECT 1000 + page_id, concat(url, ' 1x,  ', CAST(page_id AS VARCHAR(20)), '.png 2x, ') FROM pages")
query("extract_srcset", f"SELECT id, regexp_extract(p, '^(\\S+)', 1) AS ref, {d_trim('regexp_extract(p, ' + literal('^' + chr(92) + 'S+' + chr(92) + 's+(.*)$') + ', 1)')} AS descriptor FROM (SELECT id, {d_trim('x')} AS p FROM {_SETS}, unnest(regexp_split_to_array(value, '\\s*,\\s*')) AS u(x)) AS s WHERE p <> ''")(
    lambda s, d: given(s, d, _SETS, "pages").select("id", F.inline(L.srcset(F.col("value"))))
)
METAS = [("refresh", "5; url='/next'"), ("Refresh", "0"), ("og:image", "https://site.test/i.png"), ("og:image", "/rel.png"), ("twitter:image", "http://h/x"), ("keywords", "https://no")]
_METAS = both(METAS, "name, content", "SELECT CASE page_id % 3 WHEN 0 THEN 'og:image' WHEN 1 THEN 'refresh' ELSE 'Twitter:Image' END, CASE page_id % 3 WHEN 1 THEN concat('3; url=', url) ELSE url END FROM pages")
query("extract_meta", f"SELECT name, content, CASE WHEN lower(name) = 'refresh' THEN nullif({_refresh.replace('value', 'content')}, '') WHEN lower(name) IN ({_mi}) AND regexp_matches(content, '(?i)^https?://') THEN content END AS target FROM {_METAS}")(
    lambda s, d: given(s, d, _METAS, "pages").select("name", "content", L.meta_target(F.col("name"), F.col("content")).alias("target"))
)

# Robots.
ROBOTS = [("site.test", "# hello\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private/\nDisallow:\nAllow: /private/ok\nSitemap: https://site.test/s.xml\nCrawl-delay: 2"), ("b.test", "User-agent: loom\nUser-agent: x\nDisallow: /a/*\nAllow: /a/b\nDisallow: /*.pdf$\nUser-agent: *\nDisallow: /")]
_line = d_trim("regexp_replace(x, '#.*$', '')")
_FIRST = f"max(regexp_extract({PAGE_PATH}, '^(/[^/]*)', 1))"
_ROBOTS = both(ROBOTS, "host, body", f"SELECT {PAGE_HOST}, concat('User-agent: *', chr(10), 'Disallow: ', {_FIRST}, '/*1', chr(10), 'Allow: ', max({PAGE_PATH}), '$', chr(10), 'Crawl-delay: ', CAST(count(*) AS VARCHAR(20)), chr(10), 'User-agent: loom', chr(10), 'Disallow: ', min({PAGE_PATH})) FROM pages GROUP BY {PAGE_HOST}")
DIRS = f"""rf AS (SELECT * FROM {_ROBOTS}),
rl AS (SELECT host, i - 1 AS pos, {_line.replace('x,', 'ls[i],')} AS line FROM (SELECT host, string_split(body, chr(10)) AS ls FROM rf) AS q, unnest(range(1, len(ls) + 1)) AS u(i)),
rd AS (SELECT host, pos, lower({d_trim("regexp_extract(line, '^([^:]*):', 1)")}) AS field, {d_trim("regexp_extract(line, '^[^:]*:(.*)$', 1)")} AS value FROM rl WHERE contains(line, ':')),
rb AS (SELECT *, sum(opens) OVER (PARTITION BY host ORDER BY pos) AS block FROM (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY host ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM rd WHERE field IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'sitemap')) AS o),
rr AS (SELECT a.host, a.agent, r.pos::INT AS pos, r.field = 'allow' AS allow, r.value AS pattern, strlen(r.value)::INT AS len FROM (SELECT DISTINCT host, block, lower(value) AS agent FROM rb WHERE field = 'user-agent') AS a JOIN rb AS r ON r.host = a.host AND r.block = a.block AND r.field IN ('allow', 'disallow') AND NOT (r.field = 'disallow' AND r.value = '')),
rg AS (SELECT host, arg_min(agent, CASE WHEN agent = '*' THEN 1000 ELSE 0 END + pos) AS agent FROM rr WHERE agent = '*' OR contains('{R.AGENT}', agent) GROUP BY host)"""
files = lambda s, d: given(s, d, _ROBOTS, "pages")
query("robots_rules", f"WITH {DIRS} SELECT * FROM rr")(lambda s, d: R.rules(files(s, d)))
query("robots_group", f"WITH {DIRS} SELECT * FROM rg")(lambda s, d: R.group(R.rules(files(s, d))))
PATTERNS = [("/a/*",), ("/*.pdf$",), ("/x?y=(1)",), ("",), ("/a.b+c",)]
_pr = "'^' || replace(regexp_replace(CASE WHEN pattern LIKE '%$' THEN left(pattern, -1) ELSE pattern END, '([\\\\.^$|?+()\\[\\]{}])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END"
_PATTERNS = both(PATTERNS, "pattern", f"SELECT concat({PAGE_PATH}, CASE page_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '$' ELSE '?(a+b)' END) FROM pages")
query("robots_regex", f"SELECT pattern, {_pr} AS re FROM {_PATTERNS}")(lambda s, d: given(s, d, _PATTERNS, "pages").select("pattern", R.pattern_regex(F.col("pattern")).alias("re")))
VISITS = [("https://site.test/",), ("https://site.test/private/x",), ("https://site.test/private/ok?z",), ("https://b.test/a/b/c",), ("https://b.test/x.pdf",), ("https://b.test/x.pdfz",), ("https://b.test/a/q",), ("https://c.test/any",)]
_VISITS = both(VISITS, "url", "SELECT url FROM pages")
ALLOW = f"""WITH {DIRS}, v AS (SELECT * FROM {_VISITS}), {d_parts('v', 'url', 'n')},
vt AS (SELECT url, n_host AS host, n_p || CASE WHEN n_query = '' THEN '' ELSE '?' || n_query END AS target FROM n),
vr AS (SELECT vt.url, r.allow, r.len FROM vt LEFT JOIN (SELECT rr.*, {_pr} AS re FROM rr JOIN rg USING (host, agent)) AS r ON r.host = vt.host AND regexp_matches(vt.target, r.re)),
al AS (SELECT url, coalesce(arg_max(allow, len * 2 + allow::INT), true) AS allowed FROM vr GROUP BY url)"""


def verdicts(s, d):
    rows = R.rules(files(s, d))
    return R.allowed(given(s, d, _VISITS, "pages").withColumn("host", host(F.col("url"))), rows.join(R.group(rows), ["host", "agent"]))


query("robots_allow", f"{ALLOW} SELECT url, allowed FROM al")(lambda s, d: verdicts(s, d))
query("filter_robots", f"{ALLOW} SELECT url FROM al WHERE allowed")(lambda s, d: verdicts(s, d).where("allowed").select("url"))
DELAYS = """dl AS (SELECT a.host, a.agent, min(r.pos) AS pos, arg_min(try_cast(r.value AS DOUBLE), r.pos) AS delay FROM (SELECT DISTINCT host, block, lower(value) AS agent FROM rb WHERE field = 'user-agent') AS a JOIN rb AS r ON r.host = a.host AND r.block = a.block AND r.field = 'crawl-delay' GROUP BY a.host, a.agent),
hs AS (SELECT DISTINCT host FROM rf)"""
query("crawl_delay", f"WITH {DIRS}, {DELAYS} SELECT hs.host, greatest(0.15, least(30.0, greatest(0.0, coalesce(own.delay, anyone.delay, 0.0))))::DOUBLE AS delay FROM hs LEFT JOIN rg USING (host) LEFT JOIN dl AS own ON own.host = hs.host AND own.agent = rg.agent LEFT JOIN dl AS anyone ON anyone.host = hs.host AND anyone.agent = '*'")(
    lambda s, d: R.delays(files(s, d)).select("host", R.crawl_delay(F.col("delay"), F.lit(0.15)).alias("delay"))
)

# Rewriting.
FORMS = [
    (-11, "https://site.test/f/", "<a href=\"e\">1</a><img src=\"c\"><a href='it&#39;s.pdf'>2</a><a href='it&#39;s/here.pdf#a&amp;b'>3</a><a href=plain.htm>4</a><a href=it&#39;s.htm>5</a><a href = ' spaced/e?x=1&amp;y=2 '>6</a>"),
    (-12, "https://site.test/f/", '<img srcset="s 1x"><img srcset=" /e/s.png 1x ,t.png&amp;v 2x,, e.webp"><source data-srcset=\'data:x, y 2x\'><link imagesrcset=l.png rel=preload as=image>'),
    (-13, "https://site.test/f/", '<p style="content:&quot;a&quot;;background:url(x.png)">1</p><p style="a:b&amp;c">2</p><p style="b:url(u)">3</p><p style=\'b:url("e q.png"), URL( &#39;e.gif&#39; )\'>4</p><p style="b:url(&quot;see.png&quot;);c:url(e)">5</p>'),
    (-14, "https://site.test/f/", '<style>u{b:url(u)} v{c:url( "e.png" )} @import "i"; @IMPORT \'he.css\'; w{d:url("it\'s.png")} x{y:url(data:z)}</style><style>l{m:url(l)}</style>'),
    (-15, "https://site.test/f/", '<meta http-equiv=refresh content="5; url=\'/e/next\'"><meta property="og:image" content="https://site.test/og.png?a=1&amp;b=2"><meta name="twitter:image" content="/no.png"><meta content="0;URL=e" http-equiv="Refresh">'),
    (-16, "https://site.test/f/", '<base href="/e/"><base target=_top href=x><script src="s.js" integrity="sha" crossorigin>var a = "<a href=no>";</script><!-- <a href="no"> --><textarea><a href="no"></textarea><my-link href="k.png"><a data-href="é/e.zip" title="href=e">é</a><a href="#top">t</a><a href="mailto:e@x">m</a>'),
]
_TOK = literal("(?is)" + W.TOKEN.replace("++", "+").replace("*+", "*"))
_HEAD = literal("^" + L.TAG.replace("++", "+").replace("*+", "*"))
_CSSE = literal(r"""(?is)url\(\s*(?:&quot;.*?&quot;|&#39;.*?&#39;|"[^"]*"|'[^']*'|[^"'()\s]+)\s*\)|@import\s+(?:&quot;.*?&quot;|"[^"]*"|'[^']*')""")
_OPEN = literal(r"""(?i)^(?:url\(\s*|@import\s+)(?:&quot;|&#39;|"|')?""")
_CLOSED = literal(r"\s*\)$")
_INNER = literal(r"""(&quot;|&#39;|"|')$""")
_QUOTE = "CASE WHEN left(rest, 1) IN ('\"', '''') THEN left(rest, 1) ELSE '' END"


def _css_units(source: str, columns: str) -> str:
    """DuckDB: the column body of source, cut around the references of a style sheet; columns are carried along."""
    opened = f"regexp_extract(m, {_OPEN}, 0)"
    inner = f"regexp_extract({opened}, {_INNER}, 1)"
    raw = f"regexp_replace(substr(m, length({opened}) + 1), {_CLOSED}, '')"
    return f"""(SELECT {columns}, j, between, m, {opened} AS opened, CASE WHEN m = '' THEN '' ELSE {inner} END AS inq, CASE WHEN m = '' THEN '' ELSE left({raw}, length({raw}) - length({inner})) END AS ref
  FROM (SELECT {columns}, j, ts[j] AS between, coalesce(ms[j], '') AS m FROM (SELECT *, string_split_regex(body, {_CSSE}) AS ts, regexp_extract_all(body, {_CSSE}, 0) AS ms FROM {source}) AS c, unnest(range(1, len(ts) + 1)) AS u(j)) AS w)"""


def _new(value: str) -> str:
    """DuckDB: a value as its slot writes it."""
    css = f"replace(replace(replace(replace({value}, '\"', '%22'), '''', '%27'), '(', '%28'), ')', '%29')"
    v = f"CASE WHEN form IN ('css', 'sheet') AND inq = '' THEN '\"' || {css} || '\"' WHEN form IN ('css', 'sheet') THEN {css} ELSE {value} END"
    amp = f"replace({v}, '&', '&amp;')"
    double = f"replace({amp}, '\"', '&quot;')"
    odd, blank = literal(r"""[\s>"']"""), literal(r"\s")
    return f"""CASE WHEN form = 'sheet' THEN {v} WHEN q = '"' THEN {double} WHEN q = '''' THEN replace({amp}, '''', '&#39;')
 WHEN form IN ('attr', 'meta') THEN CASE WHEN regexp_matches({amp}, {odd}) THEN '"' || {double} || '"' ELSE {amp} END ELSE regexp_replace(replace(replace({double}, '''', '&#39;'), '>', '&gt;'), {blank}, '%20', 'g') END"""


_fresh = "(CASE WHEN regexp_extract(n_url, '^[a-z]+://[^/]*([^?]*)', 1) LIKE '%e%' THEN 'local' || regexp_extract(n_url, '^[a-z]+://[^/]*([^?]*)', 1) ELSE n_url END || regexp_extract(" + d_decode("ref") + ", '(?s)^[^#]+(#.*)$', 1))"
_same = "CASE WHEN form IN ('css', 'sheet') THEN substr(m, length(opened) + 1, rawlen) ELSE ref END"
_none = "'' AS q, '' AS inq, '' AS tag, '' AS attr, '' AS rel, '' AS as_, '' AS raw, '' AS m, '' AS opened, 0 AS rawlen"
#: Pages are cut into units (k, i, j) of a fixed text before, a reference or none, and a fixed text after.
REWRITE = f"""WITH {ALL.replace('UNION ALL', 'UNION ALL SELECT * FROM ' + values(FORMS, 'page_id, url, html') + ' UNION ALL')}, {BASES},
tok AS (SELECT page_id, k, ts[k] AS text, coalesce(ms[k], '') AS token FROM (SELECT page_id, string_split_regex(html, {_TOK}) AS ts, regexp_extract_all(html, {_TOK}, 0) AS ms FROM d) AS x, unnest(range(1, len(ts) + 1)) AS u(k)),
hd AS (SELECT *, CASE WHEN starts_with(token, '<!--') THEN '' ELSE regexp_extract(token, {_HEAD}, 0) END AS raw FROM tok),
tg AS (SELECT *, lower(regexp_extract(raw, '^<([a-zA-Z][-a-zA-Z0-9:_]*)', 1)) AS tag, lower({d_attribute('raw', 'rel')}) AS rel, lower({d_attribute('raw', 'as')}) AS as_ FROM hd),
pr AS (SELECT page_id, k, raw, tag, rel, as_, i, ts[i] AS between, coalesce(ms[i], '') AS pair FROM (SELECT *, string_split_regex(raw, {_ATTR}) AS ts, regexp_extract_all(raw, {_ATTR}, 0) AS ms FROM tg) AS x, unnest(range(1, len(ts) + 1)) AS u(i)),
pn AS (SELECT *, lower(regexp_extract(pair, '^([^\\s=]+)', 1)) AS attr, regexp_extract(pair, '^[^\\s=]+\\s*=\\s*', 0) AS eq FROM pr WHERE pair <> ''),
pv AS (SELECT *, {_QUOTE} AS q, CASE WHEN {_QUOTE} = '' THEN rest ELSE substr(rest, 2, length(rest) - 2) END AS value FROM (SELECT *, substr(pair, length(eq) + 1) AS rest FROM pn) AS x),
pf AS (SELECT *, {_meta} AS meta, CASE WHEN attr IN ('integrity', 'crossorigin') THEN 'gone' WHEN tag = 'base' AND attr = 'href' THEN 'base' WHEN attr IN ({_sets}) THEN CASE WHEN contains(lower(value), 'data:') THEN 'text' ELSE 'srcset' END
   WHEN attr = 'style' THEN 'css' WHEN tag = 'meta' AND attr = 'content' THEN 'meta' WHEN attr IN ({_attrs}) THEN 'attr' ELSE 'text' END AS form FROM pv),
un AS (
 SELECT page_id, k, 0 AS i, 0 AS j, text AS pre, NULL AS ref, '' AS post, 'text' AS form, {_none} FROM tg
 UNION ALL SELECT page_id, k, i, 0, between, NULL, '', 'text', {_none} FROM pr
 UNION ALL SELECT page_id, k, i, 1, CASE form WHEN 'gone' THEN '' WHEN 'base' THEN eq || CASE WHEN q = '' THEN '"./"' ELSE q || './' || q END ELSE pair END, NULL, '', 'text', {_none} FROM pf WHERE form IN ('gone', 'base', 'text') OR (form = 'meta' AND meta IS NULL)
 UNION ALL SELECT page_id, k, i, 1, eq || q, value, q, form, q, '', tag, attr, rel, as_, raw, '', '', 0 FROM pf WHERE form = 'attr'
 UNION ALL SELECT page_id, k, i, 1, eq || q || CASE WHEN lower({d_attribute('raw', 'http-equiv')}) = 'refresh' THEN regexp_extract(value, '(?i)^\\s*[0-9.]+\\s*;\\s*url\\s*=\\s*', 0) ELSE '' END, meta, q, form, q, '', tag, attr, rel, as_, raw, '', '', 0 FROM pf WHERE form = 'meta' AND meta IS NOT NULL
 UNION ALL SELECT page_id, k, i, n, CASE WHEN n = 1 THEN eq || q ELSE ',' END || regexp_extract(its[n], '^\\s*', 0), nullif(regexp_extract(its[n], '^\\s*(\\S+)', 1), ''), regexp_extract(its[n], '(?s)^\\s*\\S+(.*)$', 1) || CASE WHEN n = len(its) THEN q ELSE '' END, form, q, '', tag, attr, rel, as_, raw, '', '', 0
   FROM (SELECT *, string_split(value, ',') AS its FROM pf WHERE form = 'srcset') AS x, unnest(range(1, len(its) + 1)) AS u(n)
 UNION ALL SELECT page_id, k, i, j, CASE WHEN j = 1 THEN eq || q ELSE '' END || between || opened, CASE WHEN m <> '' THEN {d_decode('ref')} END, CASE WHEN m = '' THEN q ELSE substr(m, length(opened) + length(ref) + 1) END, 'css', q, inq, tag, attr, rel, as_, raw, m, opened, length(ref)
   FROM {_css_units("(SELECT *, value AS body FROM pf WHERE form = 'css') AS s", 'page_id, k, i, eq, q, tag, attr, rel, as_, raw')} AS y
 UNION ALL SELECT page_id, k, 1000000, j, between || opened, CASE WHEN m <> '' THEN ref END, CASE WHEN m = '' THEN '' ELSE substr(m, length(opened) + length(ref) + 1) END, 'sheet', '', inq, tag, '', rel, as_, raw, m, opened, length(ref)
   FROM {_css_units("(SELECT *, substr(token, length(raw) + 1) AS body FROM tg WHERE tag = 'style') AS s", 'page_id, k, tag, rel, as_, raw')} AS y
 UNION ALL SELECT page_id, k, 1000000, 0, substr(token, length(raw) + 1), NULL, '', 'text', {_none} FROM tg WHERE tag <> 'style'),
ub AS (SELECT un.*, base FROM un JOIN bases USING (page_id)), {d_parts('ub', 'base', 'e')},
ur AS (SELECT page_id, k, i, j, pre, ref, post, form, q, inq, tag, attr, rel, as_, raw, m, opened, rawlen, CASE WHEN ref IS NULL OR {d_skippable(d_decode('ref'))} THEN NULL ELSE {d_ref('e', 'ref')} END AS x FROM e),
{d_parts('ur', 'x', 'n')}, nt AS (SELECT *, {d_type('n_ext')} AS ext_type FROM n),
nw AS (SELECT page_id, k, i, j, pre || CASE WHEN ref IS NULL THEN '' WHEN x IS NULL OR n_url = '' OR (form = 'attr' AND {L.CLASSIFY} IS NULL) THEN {_same} ELSE {_new(_fresh)} END || post AS piece FROM nt)
SELECT page_id, sha1(string_agg(piece, '' ORDER BY k, i, j)) AS html FROM nw GROUP BY page_id"""


@query("rewrite_html", REWRITE)
def rewrite_html(spark, sf_dir):
    """Targets with an e in their path are in the copy."""
    from archloom.functions.url import path

    p = pages(spark, sf_dir).unionByName(fixture(spark, FORMS, "page_id long, url string, html string"))
    index = L.links(p).select(F.col("target").alias("url")).distinct().select("url", F.explode(F.array(path(F.col("url")))).alias("path"))
    index = index.where(F.col("path").contains("e")).withColumn("path", F.concat(F.lit("local"), "path"))
    return W.rewrite(p, index).select("page_id", F.sha1("html").alias("html"))


CSS = [
    (1, "a{b:url(../font/a.woff2)} c{d:url('x.png')}", {"../font/a.woff2": "../font/a.woff2", "x.png": "img/x.png"}),
    (2, "a{b:url( \"p$1\\E.png\" )} c{d:url(none.png)} @import 'x.png';", {"p$1\\E.png": "q$2.png"}), (3, "", {}),
]
_map = "MAP {" + ", ".join(f"{i}: MAP {{{', '.join(f'{literal(k)}: {literal(v)}' for k, v in m.items())}}}" for i, _, m in CSS if m) + "}"
_inner = _unq(d_trim("regexp_replace(regexp_replace(f[i], '(?i)^url\\(', ''), '\\)$', '')"))
_PLAIN = f"(SELECT 1000 + page_id AS id, concat({_BODY}, ' a{{b:url(x.png)}}') AS css FROM pages) AS p"
_CSS = f"(SELECT id, css FROM {values([r[:2] for r in CSS], 'id, css')} UNION ALL SELECT * FROM {_PLAIN})"
query("rewrite_css", f"""WITH s AS (SELECT id, string_split_regex(css, {literal(L.CSS_URL)}) AS t, regexp_extract_all(css, {literal(L.CSS_URL)}, 0) AS f FROM {_CSS}),
r AS (SELECT id, i, coalesce('url("' || {_map}[id][{_inner}] || '")', f[i]) AS new, t[i + 1] AS text FROM s, unnest(range(1, len(f) + 1)) AS u(i))
SELECT s.id AS id, t[1] || coalesce((SELECT string_agg(new || text, '' ORDER BY i) FROM r WHERE r.id = s.id), '') AS css FROM s""")(
    lambda s, d: given(s, d, _PLAIN, "pages").withColumn("m", F.lit(None).cast("map<string,string>")).unionByName(fixture(s, CSS, "id long, css string, m map<string,string>")).select("id", L.rewrite_css(F.col("css"), F.col("m")).alias("css"))
)
# Copies: paths relative to a page's own file, and links to what is not in the copy marked; style sheets on their own.
_PATH = "regexp_extract(n_url, '^[a-z]+://[^/]*([^?]*)', 1)"
_FRAGMENT = "regexp_extract(" + d_decode("ref") + ", '(?s)^[^#]+(#.*)$', 1)"


def _variant(fresh: str) -> str:
    return REWRITE.replace(_new(_fresh), _new(fresh))


def _copy(spark, sf_dir):
    from archloom.functions.url import path

    p = pages(spark, sf_dir).unionByName(fixture(spark, FORMS, "page_id long, url string, html string"))
    index = L.links(p).select(F.col("target").alias("url")).distinct().select("url", F.explode(F.array(path(F.col("url")))).alias("path"))
    return p, index.where(F.col("path").contains("e")).withColumn("path", F.concat(F.lit("local"), "path"))


@query("rewrite_site", _variant(f"(CASE WHEN {_PATH} LIKE '%e%' THEN '../local' || {_PATH} ELSE n_url END || {_FRAGMENT})"))
def rewrite_site(spark, sf_dir):
    p, index = _copy(spark, sf_dir)
    return W.rewrite(p.withColumn("file", F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))), index).select("page_id", F.sha1("html").alias("html"))


@query("rewrite_site_offline", _variant(f"(CASE WHEN {_PATH} LIKE '%e%' THEN 'local' || {_PATH} || {_FRAGMENT} ELSE '#not-downloaded' END)"))
def rewrite_site_offline(spark, sf_dir):
    p, index = _copy(spark, sf_dir)
    return W.rewrite(p, index, "#not-downloaded").select("page_id", F.sha1("html").alias("html"))


_STYLES = both([(r[0], r[1], r[2]) for r in SHEETS] + [(3, "https://site.test/f/", FORMS[3][2])], "id, base, css", f"SELECT 1000 + page_id, url, concat({_BODY}, ' x{{y:url(../e', CAST(page_id AS VARCHAR(20)), '.png)}} @import \"', CAST(page_id AS VARCHAR(20)), '\";') FROM pages")
query("rewrite_sheets", f"""WITH st AS (SELECT * FROM {_STYLES}), un AS (SELECT id, base, j, between || opened AS pre, CASE WHEN m <> '' THEN ref END AS ref, CASE WHEN m = '' THEN '' ELSE substr(m, length(opened) + length(ref) + 1) END AS post, 'sheet' AS form, '' AS q, inq, m, opened, length(ref) AS rawlen
  FROM {_css_units("(SELECT *, css AS body FROM st) AS s", 'id, base')} AS y), {d_parts('un', 'base', 'e')},
ur AS (SELECT id, j, pre, ref, post, form, q, inq, m, opened, rawlen, CASE WHEN ref IS NULL OR {d_skippable(d_decode('ref'))} THEN NULL ELSE {d_ref('e', 'ref')} END AS x FROM e), {d_parts('ur', 'x', 'n')}
SELECT id, string_agg(pre || CASE WHEN ref IS NULL THEN '' WHEN x IS NULL OR n_url = '' THEN {_same} ELSE {_new(f"(CASE WHEN {_PATH} LIKE '%e%' THEN '../local' || {_PATH} ELSE n_url END || {_FRAGMENT})")} END || post, '' ORDER BY j) AS css FROM n GROUP BY id""")(lambda s, d: sheets_in_place(s, d))


def sheets_in_place(spark, sf_dir):
    """Targets with an e in their path are in the copy."""
    from archloom.functions.url import path

    d = given(spark, sf_dir, _STYLES, "pages")
    index = L.css_links(d).select(F.col("target").alias("url")).distinct().select("url", F.explode(F.array(path(F.col("url")))).alias("path"))
    index = index.where(F.col("path").contains("e")).withColumn("path", F.concat(F.lit("local"), "path"))
    return W.rewrite_sheets(d.withColumn("file", F.lit("css/a.css")), index)


MARKUP = [('<script src="a.js" integrity="sha384-x" crossorigin=\'anonymous\'></script>',), ('<BASE target=_top href="https://x/">',), ("<p>plain</p>",)]
_MARKUP = both(MARKUP, "html", """SELECT concat(substr(html, 1, 300), '<script integrity="', CAST(page_id AS VARCHAR(20)), '" src=a></script><base href="', url, '">') FROM pages""")
query("strip_integrity", f"""SELECT html, regexp_replace(html, '(?i)\\s(?:integrity|crossorigin)\\s*=\\s*(?:"[^"]*"|''[^'']*'')', '', 'g') AS plain FROM {_MARKUP}""")(lambda s, d: given(s, d, _MARKUP, "pages").select("html", L.strip_integrity(F.col("html")).alias("plain")))
query("neutral_base", f"""SELECT html, regexp_replace(html, '(?i)(<base\\s[^>]*href\\s*=\\s*)(?:"[^"]*"|''[^'']*'')', '\\1"./"', 'g') AS plain FROM {_MARKUP}""")(lambda s, d: given(s, d, _MARKUP, "pages").select("html", L.neutral_base(F.col("html")).alias("plain")))
