"""URL and text functions over the pages table and literal cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from archloom.functions import text as T
from archloom.functions import url as U

from .kit import PAGE_HOST, PAGE_PATH, both, given, d_bare, d_base_domain, d_decode, d_parts, d_ref, d_trim, d_type, fixture, literal, query, shared, table, values

CASES = [
    "HTTP://User:pw@Example.COM:80/a/./b/../c?x=1#f", "https://h:443", "https://h:8443//a//b/", "http://h/a/b/..", "http://h/a/.", "http://h/../../x", "http://h/a b{c}", "//h/p", "https://h/?", "/no/host",
    "https://www.example.co.uk/x/y.PHP?q=1", "http://cdn.example.com/lib.min.js", "http://a.b.example.com/img/logo.PNG", "mailto:a@b", "ftp://h/x.zip", " https://trim.test/p ", "https://h/x.tar.gz", "https://localhost/d.do", "",
]
SOURCE = f"u AS (SELECT url FROM pages UNION ALL SELECT url FROM {values([(c,) for c in CASES], 'url')})"
WITH = f"WITH {SOURCE}, {d_parts('u', 'url', 'n')}"


def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").unionByName(fixture(spark, [(c,) for c in CASES], "url string"))


def over_urls(name: str, sql: str, **columns):
    """A query with the URL and columns of it."""
    query(name, f"{WITH} SELECT url, {sql} FROM n")(lambda spark, sf_dir: urls(spark, sf_dir).select("url", *(f(F.col("url")).alias(c) for c, f in columns.items())))


over_urls("url_is_http", "regexp_matches(url, '(?i)^https?://') AS is_http", is_http=U.is_http)
over_urls("url_normalize", "n_url AS normal", normal=U.normalize)
over_urls("url_parts", "n_host AS host, n_p AS path, n_ext AS ext", host=U.host, path=U.path, ext=U.extension)
over_urls("url_base_domain", f"{d_base_domain('n_host')} AS base_domain", base_domain=lambda u: U.base_domain(U.host(u)))
over_urls("type_from_url", f"{d_type('n_ext')} AS type", type=U.type_from_url)
over_urls("url_dynamic", "n_ext IN (" + ", ".join(map(repr, U.DYNAMIC)) + ") AS dynamic", dynamic=U.is_dynamic)
_show = "CASE WHEN n_host = 'h' THEN '' ELSE n_host END || n_p || CASE WHEN n_query = '' THEN '' ELSE '?' || n_query END"
over_urls("short_url", f"CASE WHEN strlen({_show}) > 95 THEN substr({_show}, 1, 92) || '...' ELSE {_show} END AS shown", shown=lambda u: U.short_url(u, F.lit("h")))

_same = f"n_host <> '' AND (n_host = 'www.example.com' OR {d_bare('n_host')} = 'example.com' OR {d_base_domain('n_host')} = 'example.com')"
over_urls("same_site", f"{_same} AS same", same=lambda u: U.same_site(u, F.lit("www.example.com"), F.lit(True)))
_scope = f"n_host <> '' AND (n_host = 'example.com' OR {d_bare('n_host')} = 'example.com')"
query("filter_scope", f"{WITH} SELECT url FROM n WHERE {_scope}")(lambda s, d: urls(s, d).where(U.same_site(F.col("url"), F.lit("example.com"), F.lit(False))))

PATHS = [("/a/b/../c",), ("/../../x",), ("//a//b/",), ("/a/.",), ("/",), ("",), ("/a b/{c}|d",), ("/a/../",), ("/x/./y/../../z/",), ("/q\"<>^`",)]
from .kit import d_canon  # noqa: E402

_PATHS = both(PATHS, "path", f"SELECT concat({PAGE_PATH}, '/./x/../', CAST(page_id AS VARCHAR(20)), '//') FROM pages")
query("url_canon_path", f"SELECT path, {d_canon('path')} AS canon FROM {_PATHS}")(lambda s, d: given(s, d, _PATHS, "pages").select("path", U.canon_path(F.col("path")).alias("canon")))

BASE = "https://site.test/dir/page?z=1"
REFS = [(b, r) for b in (BASE, "http://h", "nohost/x") for r in ("x.html", "../img/l.png", "/r", "?q=1", "//cdn.t/l.js", "HTTPS://O/p", "a&amp;b", " x\n.css ", "#f", "mailto:a@b", "host:8080/x", "", "./.././y/", "z#top")]
_REFS = both(REFS, "base, ref", "SELECT url, regexp_extract(html, 'href=.([^ >]*?)[^a-z/.0-9]', 1) FROM pages UNION ALL SELECT url, concat('../', CAST(page_id AS VARCHAR(20)), '?a=1&amp;b=2#c') FROM pages")
query("url_resolve", f"WITH u AS (SELECT * FROM {_REFS}), {d_parts('u', 'base', 'b')}, r AS (SELECT base, ref, {d_ref('b', 'ref')} AS x FROM b), {d_parts('r', 'x', 'n')} SELECT base, ref, nullif(n_url, '') AS url FROM n")(
    lambda s, d: given(s, d, _REFS, "pages").select("base", "ref", U.resolve(F.col("base"), F.col("ref")).alias("url"))
)

TYPED = [("example.com",), (" HTTP://Example.com/x ",), ("not a url",), ("",), ("https://h.test:8443/p?q",), ("ftp://x.test",), ("-bad-.test",)]
_TYPED = both(TYPED, "typed", "SELECT CASE WHEN page_id % 2 = 0 THEN replace(replace(url, 'https://', ' '), 'http://', '') ELSE url END FROM pages")
query("admit_url", f"WITH u AS (SELECT typed, CASE WHEN {d_trim('typed')} <> '' AND NOT regexp_matches({d_trim('typed')}, '(?i)^https?://') THEN 'https://' || {d_trim('typed')} ELSE {d_trim('typed')} END AS x FROM {_TYPED}), {d_parts('u', 'x', 'n')} SELECT typed, CASE WHEN regexp_matches(n_host, '^[a-z0-9]([a-z0-9.\\-]*[a-z0-9])?$') THEN n_url ELSE '' END AS url FROM n")(
    lambda s, d: given(s, d, _TYPED, "pages").select("typed", U.admit_url(F.col("typed")).alias("url"))
)

MIMES = [("text/html; charset=x",), ("application/xhtml+xml",), ("TEXT/CSS",), ("text/javascript",), ("application/ecmascript",), ("image/svg+xml",), ("font/woff2",), ("application/font-woff",), ("application/vnd.ms-fontobject",), ("audio/ogg",), ("video/mp4",), ("application/octet-stream",), ("",)]
_m = f"lower({d_trim(chr(115) + 'plit_part(mime, ' + repr(';') + ', 1)')})"
_MIMES = both(MIMES, "mime", """SELECT concat(CASE p_partkey % 6 WHEN 0 THEN 'image/' WHEN 1 THEN 'text/' WHEN 2 THEN 'FONT/' WHEN 3 THEN 'video/' WHEN 4 THEN 'application/' ELSE 'audio/' END, CASE p_size % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'css; x=' WHEN 2 THEN 'png;' ELSE '' END, lower(p_type)) FROM part""")
query("type_from_mime", f"SELECT mime, CASE WHEN {_m} = '' THEN '' WHEN {_m} LIKE '%html%' THEN 'html' WHEN {_m} = 'text/css' THEN 'css' WHEN {_m} LIKE '%javascript%' OR {_m} LIKE '%ecmascript%' THEN 'js' WHEN {_m} LIKE 'image/%' THEN 'img' WHEN {_m} LIKE 'font/%' OR regexp_matches({_m}, 'font-woff|woff|opentype|truetype|font-sfnt') THEN 'font' WHEN {_m} LIKE 'video/%' OR {_m} LIKE 'audio/%' THEN 'media' ELSE 'doc' END AS type FROM {_MIMES}")(
    lambda s, d: given(s, d, _MIMES, "part").select("mime", U.type_from_mime(F.col("mime")).alias("type"))
)
_x = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.MIME_EXT.items())
query("ext_for_mime", f"SELECT mime, CASE {_m} {_x} ELSE '' END AS ext FROM {_MIMES}")(lambda s, d: given(s, d, _MIMES, "part").select("mime", U.ext_for_mime(F.col("mime")).alias("ext")))

SEGMENTS = [("a%20b",), ("c/d",), ("CON.txt",), ("..",), (".htaccess",), ("x<y>z",), (" pad ",), ("a+b",), ("q" * 120 + ".html",), ("",), ("tab\there",), ("nul",), ("name.tar.gz",)]


def d_segment(source: str, column: str, pre: str) -> str:
    """DuckDB CTEs that end in {pre}: source with {pre}_safe. Escapes must be well formed."""
    return f"""
{pre}a AS (SELECT *, regexp_replace(translate(url_decode({column}), chr(92), '/'), '[\\x00-\\x1F\\x7F]', '', 'g') AS {pre}_1 FROM {source}),
{pre}b AS (SELECT *, trim(regexp_replace({d_trim(f"regexp_replace({pre}_1, '[<>:" + chr(34) + f"|?*/]+', '-', 'g')")}, '\\s+', '-', 'g'), '.-') AS {pre}_2 FROM {pre}a),
{pre}c AS (SELECT *, CASE WHEN {pre}_2 = '' THEN '_' ELSE {pre}_2 END AS {pre}_3 FROM {pre}b),
{pre}d AS (SELECT *, CASE WHEN regexp_matches(lower(regexp_replace({pre}_3, '\\.[^.]*$', '')), '{U.RESERVED}') THEN '_' ELSE '' END || {pre}_3 AS {pre}_4 FROM {pre}c),
{pre} AS (SELECT *, CASE WHEN strlen({pre}_4) > 90 THEN substr(regexp_replace({pre}_4, '\\.[^.]*$', ''), 1, 70) || '-' || substr(sha1({pre}_4), 1, 8) || regexp_extract({pre}_4, '(\\.[^.]+)$', 1) ELSE {pre}_4 END AS {pre}_safe FROM {pre}d)"""


_SEGMENTS = both(SEGMENTS, "seg", f"SELECT {PAGE_PATH} FROM pages UNION ALL SELECT concat(' ', p_name, '%20<', p_brand, '> ', p_type, '.') FROM part")
query("safe_segment", f"WITH u AS (SELECT seg FROM {_SEGMENTS}), {d_segment('u', 'seg', 'x')} SELECT seg, x_safe AS safe FROM x")(
    lambda s, d: given(s, d, _SEGMENTS, "pages", "part").select("seg", U.safe_segment(F.col("seg")).alias("safe"))
)

# Page paths have plain segments, so the SQL needs no escapes undone.
_ext = "lower(regexp_extract(n_last, '\\.([^.]*)$', 1))"
LOCAL_SQL = f"""WITH u AS (SELECT url FROM pages), {d_parts('u', 'url', 'n')},
s AS (SELECT *, list_filter(string_split(n_p, '/'), lambda x: x <> '') AS n_segs, n_p LIKE '%/' AS n_folder FROM n),
l AS (SELECT *, CASE WHEN n_folder OR len(n_segs) = 0 THEN '' ELSE n_segs[-1] END AS n_last, CASE WHEN n_folder THEN n_segs ELSE n_segs[1:len(n_segs)-1] END AS n_dirs FROM s),
m AS (SELECT *, CASE WHEN n_last = '' OR {_ext} = '' THEN 'index.html' WHEN {_ext} IN ('html', 'htm') THEN n_last ELSE n_last || '.html' END AS n_name,
  CASE WHEN n_last <> '' AND {_ext} = '' THEN list_append(n_dirs, n_last) ELSE n_dirs END AS n_dirs2 FROM l),
o AS (SELECT *, CASE WHEN n_query = '' THEN n_name ELSE regexp_replace(n_name, '\\.[^.]*$', '') || '__' || substr(sha1(n_query), 1, 7) || regexp_extract(n_name, '(\\.[^.]*)$', 1) END AS n_file FROM m)
SELECT url, array_to_string(list_concat(list_concat(CASE WHEN {d_bare('n_host')} = 'example.com' THEN []::VARCHAR[] ELSE ['_external', n_host] END, n_dirs2), [n_file]), '/') AS path FROM o"""
query("local_path", LOCAL_SQL)(lambda s, d: table(s, d, "pages").select("url", U.local_path(F.col("url"), F.lit("html"), F.lit("example.com")).alias("path")))

LINKS = [("about/index.html", "assets/app.css"), ("index.html", "index.html"), ("a/b/c.html", "a/b/d.html"), ("a/b/c.html", "a/x.html"), ("index.html", "a/b.html"), ("a/b.html", "a"), ("a/b/c.html", "a/b")]
_LINKS = both(LINKS, "source, target", f"SELECT concat(replace({PAGE_HOST}, '.', '/'), {PAGE_PATH}, '/index.html'), concat(replace({PAGE_HOST}, '.', '/'), CASE WHEN page_id % 2 = 0 THEN '/en/' ELSE '/' END, CAST(page_id AS VARCHAR(20)), '.css') FROM pages")
query("relative_path", f"""WITH f AS (SELECT source, target, string_split(source, '/') AS a, string_split(target, '/') AS b FROM {_LINKS}),
g AS (SELECT *, least(len(a), len(b)) - 1 AS most FROM f),
h AS (SELECT *, coalesce(list_min(list_filter(range(most), lambda i: a[i + 1] <> b[i + 1])), most) AS same FROM g)
SELECT source, target, repeat('../', (len(a) - 1 - same)::INT) || array_to_string(b[same + 1:], '/') AS rel FROM h""")(
    lambda s, d: given(s, d, _LINKS, "pages").select("source", "target", U.relative_path(F.col("source"), F.col("target")).alias("rel"))
)
query("same_dir", f"{WITH} SELECT url, n_host || regexp_extract(n_p, '^(.*/)', 1) = 'h/a/' AS same FROM n")(lambda s, d: urls(s, d).select("url", U.same_dir(F.col("url"), F.lit("http://h/a/x")).alias("same")))

# Text and format.
query("bytes_human", """SELECT doc_id, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CASE WHEN n < 10240 THEN printf('%.2f', round((n / 1024.0)::DECIMAL(30,10), 2)) ELSE printf('%.1f', round((n / 1024.0)::DECIMAL(30,10), 1)) END || ' KB'
ELSE printf('%.2f', round((n / 1048576.0)::DECIMAL(30,10), 2)) || ' MB' END AS human FROM (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents)""")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n")).withColumn("human", T.bytes_human(F.col("n"), "MB", grouped=False))
)
query("html_escape", """SELECT page_id, sha1(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS escaped FROM pages""")(
    lambda s, d: table(s, d, "pages").select("page_id", F.sha1(T.html_escape(F.col("html"))).alias("escaped"))
)
query("html_decode", f"SELECT page_id, sha1({d_decode('html')}) AS decoded FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.sha1(T.html_decode(F.col("html"))).alias("decoded")))
query("content_hash", "SELECT page_id, sha1(html) AS sha1, strlen(html)::BIGINT AS bytes, to_base64(substr(html, 1, 15)::BLOB) AS head64 FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("bytes"), F.base64(F.substring("html", 1, 15)).alias("head64"))
)
query("raw_name", f"{WITH} SELECT url, 'raw/' || sha1(n_url) || '.dat' AS file FROM n")(lambda s, d: urls(s, d).select("url", F.concat(F.lit("raw/"), F.sha1(U.normalize(F.col("url"))), F.lit(".dat")).alias("file")))
query("hms", "SELECT event_id, CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN (event_id // 60) || 'm ' || lpad((event_id % 60)::VARCHAR, 2, '0') || 's' ELSE (event_id // 3600) || 'h ' || lpad(((event_id % 3600) // 60)::VARCHAR, 2, '0') || 'm' END AS elapsed FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", T.hms(F.col("event_id")).alias("elapsed"))
)
shared("clamp", "SELECT event_id, greatest(10.0D, least(value, 90.0D)) AS clamped FROM events".replace("10.0D", "CAST(10 AS DOUBLE)").replace("90.0D", "CAST(90 AS DOUBLE)"), "events")
WORDS = [("1",), ("true",), (" ON ",), ("yes",), ("0",), ("off",), ("",), ("12abc",), ("-7",), ("x",)]
_WORDS = both(WORDS, "raw", "SELECT CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS VARCHAR(20)) WHEN event_id % 5 = 1 THEN ' TRUE ' WHEN event_id % 5 = 2 THEN concat(CAST(event_id AS VARCHAR(20)), event_type) ELSE event_type END FROM events")
query("coerce_bool", f"SELECT raw, lower({d_trim('raw')}) IN ('1', 'true', 'on', 'yes') AS flag, coalesce(try_cast(regexp_extract(raw, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 5) AS number FROM {_WORDS}")(
    lambda s, d: given(s, d, _WORDS, "events").select("raw", T.to_bool(F.col("raw")).alias("flag"), T.to_int(F.col("raw"), 5).alias("number"))
)
IDS = [("20260101-120000-0a1b2c",), ("20260101-120000-0A1B2C",), ("x",), ("20260101-1200-0a1b2c",), ("",)]
_IDS = both(IDS, "id", "SELECT concat('20260101-', lpad(CAST(event_id % 240000 AS VARCHAR(20)), CASE WHEN event_id % 3 = 0 THEN 5 ELSE 6 END, '0'), '-', substr(md5(CAST(event_id AS VARCHAR(20))), 1, 6)) FROM events")
query("job_id_valid", f"SELECT id, regexp_matches(id, '^[0-9]{{8}}-[0-9]{{6}}-[0-9a-f]{{6}}$') AS valid FROM {_IDS}")(lambda s, d: given(s, d, _IDS, "events").select("id", T.job_id_valid(F.col("id")).alias("valid")))
HEADS = [('<meta name="generator" content="Loom 1.2">',), ("<META content='X' NAME=generator>",), ("<meta name='viewport' content='w'>",), ("",)]
_gen = "regexp_extract(html, '(?i)<meta\\s[^>]*name\\s*=\\s*[\"'']?generator[\"'']?[^>]*>', 0)"
_HEADS = both(HEADS, "html", """SELECT concat(substr(html, 1, 400), CASE WHEN page_id % 2 = 0 THEN concat('<meta content="loom ', CAST(page_id AS VARCHAR(20)), '" name=generator>') ELSE '' END) FROM pages""")
query("meta_generator", f"SELECT html, {d_trim('regexp_extract(' + _gen + ', ' + literal('(?i)content' + chr(92) + 's*=' + chr(92) + 's*[' + chr(34) + chr(39) + ']([^' + chr(34) + chr(39) + ']*)') + ', 1)')} AS generator FROM {_HEADS}")(
    lambda s, d: given(s, d, _HEADS, "pages").select("html", T.meta_generator(F.col("html")).alias("generator"))
)
SERVERS = [("a", "nginx", "PHP/8", ""), ("b", "", None, "text/html"), ("c", None, None, None)]
_SERVERS = both(SERVERS, "job, server, powered, ctype", "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))), CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, CASE WHEN s_suppkey % 2 = 0 THEN concat('PHP/', CAST(s_nationkey AS VARCHAR(20))) END, 'text/html' FROM supplier")
query("fingerprint", f"SELECT job, key, value FROM (SELECT job, 'server' AS key, server AS value FROM {_SERVERS} UNION ALL SELECT job, 'powered_by', powered FROM {_SERVERS} UNION ALL SELECT job, 'content_type', ctype FROM {_SERVERS}) WHERE value <> ''")(
    lambda s, d: given(s, d, _SERVERS, "supplier").select("job", F.explode(T.fingerprint(F.create_map(F.lit("server"), "server", F.lit("powered_by"), "powered", F.lit("content_type"), "ctype"))).alias("key", "value"))
)
query("dos_time", "SELECT event_id, ((hour(ts) << 11) | (minute(ts) << 5) | (second(ts) // 2))::INT AS dos_time, (((year(ts) - 1980) << 9) | (month(ts) << 5) | day(ts))::INT AS dos_date FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", *(x.cast("int").alias(n) for x, n in zip(T.dos_time(F.unix_timestamp(F.col("ts").cast("timestamp"))), ("dos_time", "dos_date"))))
)
VIEWS = [("CREATE ALGORITHM=UNDEFINED DEFINER=`root`@`localhost` SQL SECURITY DEFINER VIEW v AS SELECT 1",), ("CREATE DEFINER=app@db VIEW w AS SELECT 2",), ("CREATE TABLE t (a int)",)]
_VIEWS = both(VIEWS, "ddl", "SELECT concat('CREATE DEFINER=`', s_name, '`@`localhost` SQL SECURITY INVOKER VIEW v', CAST(s_suppkey AS VARCHAR(20)), ' AS SELECT 1') FROM supplier")
query("strip_definer", f"SELECT ddl, regexp_replace(regexp_replace(ddl, '(?i)\\sDEFINER\\s*=\\s*(?:`[^`]*`@`[^`]*`|\\S+)', '', 'g'), '(?i)\\sSQL\\s+SECURITY\\s+(?:DEFINER|INVOKER)', '', 'g') AS plain FROM {_VIEWS}")(
    lambda s, d: given(s, d, _VIEWS, "supplier").select("ddl", T.strip_definer(F.col("ddl")).alias("plain"))
)
query("sql_literal", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NULL' ELSE '''' || replace(replace(c_name, chr(92), chr(92) || chr(92)), '''', chr(92) || '''') || '''' END AS name, c_nationkey::VARCHAR AS nation, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS positive, '0x' || lower(hex(c_mktsegment)) AS segment FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", T.sql_literal(F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")), "string").alias("name"), T.sql_literal(F.col("c_nationkey"), "int").alias("nation"), T.sql_literal(F.col("c_acctbal") > 0, "boolean").alias("positive"), T.sql_literal(F.col("c_mktsegment").cast("binary"), "binary").alias("segment"))
)
SKIPS = "PDF, zip ,, .x"
query("filter_skip_ext", f"{WITH} SELECT url FROM n WHERE n_ext NOT IN ('pdf', 'zip', '.x')")(lambda s, d: urls(s, d).where(~F.array_contains(T.skip_list(F.lit(SKIPS)), U.extension(F.col("url")))))
