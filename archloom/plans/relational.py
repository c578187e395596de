"""State, policy, crawl and report queries that are plain relational algebra.

Both engines read the same SQL; Catalyst picks the physical plan. Fixtures are literal tables, so
rows, order numbers and options are data. Order is always a column (seq), never row order.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archloom.functions.text import bytes_human, sql_literal
from archloom.functions.url import folder
from archloom.operators.archive import MOST_BYTES, MOST_ENTRIES, STORED
from archloom.operators.crawl import Options, effective_type, handled, reject_reason
from archloom.operators import report as P
from archloom.operators.ranking import running, running_by
from archloom.sources.files import in_roots, projects, skipped

from .kit import PAGE_HOST, PAGE_PATH, both, d_parts, given, query, shared, table, values

#: A resource table: seq, url, kind, type, state, depth, path, code, bytes, note.
RESOURCES = [
    (0, "https://site.test/", "page", "html", "ok", 0, "index.html", 200, 900, ""),
    (1, "https://site.test/about", "page", "html", "ok", 1, "about/index.html", 200, 700, ""),
    (2, "https://site.test/shop.php?id=7", "page", "html", "ok", 1, "shop.php__c53d0f0.html", 200, 650, ""),
    (3, "https://site.test/css/app.css", "asset", "css", "ok", 0, "css/app.css", 200, 3000, ""),
    (4, "https://cdn.test/lib.js", "asset", "js", "ok", 0, "_external/cdn.test/lib.js", 200, 5000, ""),
    (5, "https://site.test/private/x", "page", "html", "skip", 1, "", 0, 0, "blocked by robots.txt"),
    (6, "https://site.test/index.html", "page", "html", "ok", 2, "index.html", 200, 900, ""),
    (7, "https://site.test/img/logo.png", "asset", "img", "ok", 1, "img/logo.png", 200, 1200, ""),
    (8, "https://site.test/team/", "page", "html", "ok", 2, "team/index.html", 200, 400, ""),
    (9, "https://site.test/shop.php?id=8", "page", "html", "fail", 2, "", 404, 0, "HTTP 404"),
    (10, "https://site.test/late", "page", "html", "queued", 3, "", 0, 0, ""),
]
_COLUMNS = "seq, url, kind, type, state, depth, path, code, bytes, note"
#: What a crawl might have made of the pages and documents given.
_MADE = """SELECT 1000 + page_id, url, 'page', 'html', CASE page_id % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'skip' WHEN 2 THEN 'queued' ELSE 'ok' END, page_id % 4,
 CASE WHEN page_id % 7 > 2 THEN concat('pages/', CAST(page_id AS VARCHAR(20)), '.html') ELSE '' END, CASE WHEN page_id % 7 > 2 THEN 200 WHEN page_id % 7 = 0 THEN 404 ELSE 0 END, CASE WHEN page_id % 7 > 2 THEN length(html) ELSE 0 END,
 CASE page_id % 7 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'off & <"out">' ELSE '' END FROM pages
 UNION ALL SELECT 100000000 + doc_id, concat('https://site.test/docs/', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN '.php' ELSE '.pdf' END), 'asset', 'doc', CASE WHEN doc_id % 9 = 0 THEN 'fail' ELSE 'ok' END, 1,
 CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('docs/', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN '.php' ELSE '.pdf' END) END, CASE WHEN doc_id % 9 = 0 THEN 500 ELSE 200 END, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE coalesce(n_chars, 0) END, CASE WHEN doc_id % 9 = 0 THEN 'HTTP 500' ELSE '' END FROM documents"""
_RESOURCES = both(RESOURCES, _COLUMNS, _MADE)
RES = f"res AS (SELECT * FROM {_RESOURCES})"
W = f"WITH {RES} "


def resources(spark, sf_dir):
    return given(spark, sf_dir, _RESOURCES, "pages", "documents")


def reported(name: str, sql: str, of):
    """A query of the resources by an operator, and its SQL."""
    query(name, W + sql)(lambda s, d: of(resources(s, d)))

# Counters, progress, notes.
reported("counters", """SELECT kind, state, count(*)::BIGINT AS n, sum(bytes)::BIGINT AS bytes,
  sum(CASE WHEN regexp_matches(url, '\\.php(\\?|$)') AND state = 'ok' AND kind = 'page' THEN 1 ELSE 0 END)::BIGINT AS dynamic FROM res GROUP BY kind, state""", P.by_state)
shared("event_counters", "SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM events GROUP BY event_type, user_id", "events")
PHASES = [("init", 0, 0), ("crawl", 5, 20), ("crawl", 20, 20), ("crawl", 0, 0), ("rewrite", 3, 12), ("package", 1, 2), ("db", 1, 4), ("done", 1, 1)]
shared("phase_progress", f"""SELECT phase, done, total, CAST(CASE phase WHEN 'init' THEN 2
  WHEN 'crawl' THEN least(78, 3 + round(75.0 * done / greatest(total, 1), 0)) WHEN 'rewrite' THEN 80 + round(12.0 * done / greatest(total, 1), 0)
  WHEN 'package' THEN 93 + round(6.0 * done / greatest(total, 1), 0) WHEN 'db' THEN 3 + round(75.0 * done / greatest(total, 1), 0) ELSE 100 END AS BIGINT) AS percent FROM {both(PHASES, 'phase, done, total', "SELECT CASE o_orderkey % 6 WHEN 0 THEN 'init' WHEN 1 THEN 'crawl' WHEN 2 THEN 'rewrite' WHEN 3 THEN 'package' WHEN 4 THEN 'db' ELSE 'done' END, o_orderkey % 50, 50 FROM orders")}""", "orders")
reported("notes_distinct", "SELECT DISTINCT note FROM res WHERE note <> ''", P.notes)
reported("snapshot", """SELECT count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'ok' AND kind = 'page') AS pages_done, count(*) FILTER (state = 'fail') AS failed,
  sum(bytes)::BIGINT AS bytes, max(CASE WHEN note <> '' THEN note END) AS last_note FROM res""", P.snapshot)
reported("manifest", "SELECT seq, url, path AS file, type, kind, code AS status, bytes, state, note FROM res", P.manifest)
reported("report_rows", "SELECT seq, state, CASE WHEN state = 'ok' THEN path ELSE note END AS shown, bytes FROM res WHERE state <> 'queued' ORDER BY seq LIMIT 4000", P.first_rows)
# The SQL stops at a unit and has no commas.
_plain = lambda most: lambda n: bytes_human(n, most, grouped=False)
_esc = lambda c: f"replace(replace(replace(replace(replace(coalesce({c}::VARCHAR, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#039;')"
_human = "CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 10240 THEN printf('%.2f KB', round((bytes / 1024.0)::DECIMAL(30,10), 2)) ELSE printf('%.1f KB', round((bytes / 1024.0)::DECIMAL(30,10), 1)) END"
reported("report_lines", f"""SELECT seq, '<tr data-state="' || {_esc('state')} || '"><td>' || {_esc('state')} || '</td><td>' || {_esc('code')} || '</td><td>' || {_esc('type')} || '</td><td>' || {_human} || '</td><td>' || {_esc('url')} || '</td><td>'
  || CASE WHEN path <> '' AND state = 'ok' THEN '<a href="../' || {_esc('path')} || '">' || {_esc('path')} || '</a>' ELSE {_esc('note')} END || '</td></tr>' AS line FROM (SELECT * FROM res ORDER BY seq LIMIT 4000) AS r""", lambda r: P.report_lines(r, size=_plain("KB")))
reported("readme_stats", "SELECT count(*) FILTER (state = 'ok' AND kind = 'page') || ' pages, ' || count(*) FILTER (state = 'ok' AND kind = 'asset') || ' files' AS line FROM res", lambda r: summary(r).where("place = 1").select("line"))
_total = "CASE WHEN b < 1048576 THEN printf('%.1f KB', round((b / 1024.0)::DECIMAL(30,10), 1)) WHEN b < 10485760 THEN printf('%.2f MB', round((b / 1048576.0)::DECIMAL(30,10), 2)) ELSE printf('%.1f MB', round((b / 1048576.0)::DECIMAL(30,10), 1)) END"
reported("readme_text", f"""SELECT array_to_string(['OFFLINE COPY OF SITE.TEST', '', 'Pages (HTML)      : ' || p, 'Other files       : ' || f, 'Failed            : ' || x, 'Skipped           : ' || k, 'Total size        : ' || {_total},
  '', made || ' page(s) came from scripts on the server and are kept as the HTML they gave.', '', 'NOTES', ns], chr(13) || chr(10)) || chr(13) || chr(10) AS text
  FROM (SELECT count(*) FILTER (kind = 'page' AND state = 'ok') AS p, count(*) FILTER (kind = 'asset' AND state = 'ok') AS f, count(*) FILTER (state = 'fail') AS x, count(*) FILTER (state = 'skip') AS k, sum(bytes) FILTER (state = 'ok') AS b,
  count(*) FILTER (regexp_matches(url, '\\.php(\\?|$)') AND state = 'ok' AND kind = 'page') AS made, (SELECT string_agg(' - ' || note, chr(13) || chr(10) ORDER BY note) FROM (SELECT DISTINCT note FROM res WHERE note <> '') AS d) AS ns FROM res) AS t""", lambda r: P.readme(r, "site.test", size=_plain("MB")))
reported("rewrite_index", "SELECT url, path FROM res WHERE state = 'ok' AND path <> ''", P.copied)
reported("entry_file", "SELECT coalesce(max(CASE WHEN url = 'https://site.test/' AND state = 'ok' THEN path END), min_by(path, CASE WHEN state = 'ok' AND type = 'html' THEN seq END)) AS entry FROM res", lambda r: P.entry_file(r, "https://site.test/"))

# Queue: order, budgets.
@query("budget_pages", """SELECT o_orderkey, kind FROM (SELECT o_orderkey, kind, coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority AS kind FROM orders) AS k) AS b WHERE done < 150""")
def budget_pages(spark, sf_dir):
    """A budget for each kind: the sums run over ranges of (kind, order), so a kind is not a task."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("kind"))
    return running_by(o, "kind", "o_orderkey", done=(F.col("o_orderstatus") != "F").cast("long")).where("done < 150").select("o_orderkey", "kind")


@query("archive_deal", """WITH f AS (SELECT 'p/' || lpad(page_id::VARCHAR, 9, '0') || '.html' AS path, strlen(html) + 2 * 16 + 76 AS size FROM pages),
r AS (SELECT path, size, coalesce(sum(size) OVER w, 0) // (300000 - max(size) OVER ()) AS b, (row_number() OVER (ORDER BY path) - 1) // 40 AS e FROM f WINDOW w AS (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT path, dense_rank() OVER (ORDER BY b, e)::INT AS archive FROM r""")
def archive_deal(spark, sf_dir):
    """Pages dealt over archives of at most 40 entries and 300,000 bytes, in order of name."""
    from archloom.sources.site_writer import archives

    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("body"))
    return archives(files, most_entries=40, most_bytes=300_000).select("path", "archive")


JOBS = [("j%02d" % k, 1_700_000_000 + (k * 7919) % 1000, "done" if k % 3 else "error") for k in range(60)]
shared("jobs_recent", f"SELECT id, created, status FROM {both(JOBS, 'id, created, status', "SELECT concat('o', CAST(o_orderkey AS VARCHAR(20))), 1600000000 + (o_orderkey * 7919) % 200000000, o_orderstatus FROM orders")} ORDER BY created DESC, id LIMIT 40", "orders")

# Archive plan: method by extension and size, running offsets, and the limits of the format.
FILES = f"f AS (SELECT path, max(bytes) AS bytes FROM res WHERE path <> '' AND state = 'ok' GROUP BY path), e AS (SELECT path, bytes, CASE WHEN bytes > 1024 AND NOT (lower(regexp_extract(path, '[.]([^.]*)$', 1)) IN ({', '.join(repr(x) for x in STORED)})) THEN 8 ELSE 0 END AS method FROM f) "
for _name, _sql, _of in (
    ("zip_plan", "SELECT path, bytes::BIGINT AS bytes, method, coalesce(sum(30 + strlen(path) + bytes) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM e", P.offsets),
    ("pack_list", "SELECT path, bytes::BIGINT AS bytes FROM e", lambda r: P.files(r).select("path", "bytes").orderBy("path")),
    ("dir_stats", "SELECT count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM e", lambda r: P.files(r).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))),
):
    query(_name, f"WITH {RES}, {FILES} {_sql}")(lambda s, d, of=_of: of(resources(s, d)))

# Joins.
shared("fetch_lookup", f"SELECT q.url, p.page_id, CASE WHEN p.page_id IS NULL THEN 'no response' ELSE '' END AS error FROM (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT url FROM {values([('https://missing.test/',), ('https://missing.test/',)], 'url')}) AS a WHERE url <> '') AS q LEFT JOIN pages AS p ON p.url = q.url", "pages")
FOUND = [(0, "https://site.test/about"), (1, "https://site.test/new"), (2, "https://site.test/new"), (3, "https://site.test/css/x.css"), (4, "https://site.test/")]
_FOUND = both(FOUND, "pos, url", "SELECT 100 + page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE concat(url, '&new') END FROM pages", "found")
query("seen_antijoin", f"WITH {RES} SELECT url, min(pos) AS pos FROM {_FOUND} WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.url = found.url) GROUP BY url")(
    lambda s, d: given(s, d, _FOUND, "pages").join(resources(s, d).select("url"), "url", "left_anti").groupBy("url").agg(F.min("pos").alias("pos"))
)
shared("user_antijoin", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", "orders")
TARGETS = [("https://site.test/about",), ("https://site.test/private/x",), ("http://other.test/",)]
_TARGETS = both(TARGETS, "url", "SELECT url FROM pages", "t")
for _name, _miss, _mark in (("rewrite_targets", "t.url", None), ("rewrite_targets_offline", "'#not-downloaded'", "#not-downloaded")):
    query(_name, f"WITH {RES} SELECT t.url, coalesce(i.path, {_miss}) AS target FROM {_TARGETS} LEFT JOIN (SELECT url, path FROM res WHERE state = 'ok' AND path <> '') AS i ON i.url = t.url")(
        lambda s, d, mark=_mark: P.targets(given(s, d, _TARGETS, "pages"), resources(s, d), mark)
    )
MOVED = [("https://site.test/old", "https://site.test/about", "about/index.html"), ("https://site.test/a", "https://site.test/b", "b/index.html")]
_MOVED = both(MOVED, "url, final_url, path", "SELECT concat(url, '/old'), CASE WHEN page_id % 2 = 0 THEN url ELSE concat(url, '/to') END, concat('to/', CAST(page_id AS VARCHAR(20)), '.html') FROM pages", "m")
query("redirect_alias", f"WITH {RES} SELECT url, path FROM {_MOVED} UNION ALL SELECT final_url, path FROM {_MOVED} WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.url = m.final_url)")(
    lambda s, d: P.aliases(given(s, d, _MOVED, "pages"), resources(s, d))
)

# Fetch results and policy.
FETCHES = [
    ("https://site.test/", "https://site.test/", 200, 900, "", "text/html", "page", "html"), ("https://site.test/x.pdf", "https://site.test/x.pdf", 200, 99999999, "", "application/pdf", "asset", "doc"),
    ("https://site.test/e", "https://site.test/e", 0, 0, "timeout", "", "page", "html"), ("https://site.test/404", "https://site.test/404", 404, 10, "", "text/html", "page", "html"),
    ("https://site.test/go", "https://else.test/", 200, 10, "", "text/html", "page", "html"), ("https://site.test/f", "https://site.test/f", 200, 10, "", "image/png", "page", "html"),
    ("https://site.test/v", "https://site.test/v", 200, 10, "", "video/mp4", "asset", ""), ("https://site.test/n", "https://site.test/n", 200, 10, "", "", "asset", ""), ("https://site.test/z", "https://site.test/z", 0, 0, "", "", "asset", "css"),
]
_FETCHED = both(FETCHES, "url, final_url, status, size, error, ctype, kind, guess", """SELECT url, CASE WHEN page_id % 5 = 0 THEN 'https://else.test/' WHEN page_id % 5 = 1 THEN 'https://site.test/in' ELSE url END, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 0 ELSE 200 END,
 CASE WHEN page_id % 13 = 0 THEN 99999999 ELSE length(html) END, CASE WHEN page_id % 11 = 0 THEN 'timeout' ELSE '' END, CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN '' WHEN 2 THEN 'video/mp4' WHEN 3 THEN 'text/css' ELSE 'text/html' END, CASE WHEN page_id % 3 = 0 THEN 'asset' ELSE 'page' END, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE '' END FROM pages""")
FET = f"f AS (SELECT * FROM {_FETCHED})"
_AWAY = "real = 'page' AND final_url <> url AND NOT (final_url LIKE 'https://site.test/%')"
CANDIDATES = [
    (0, "mailto:x@y", "page", ""), (1, "https://site.test/private/a", "page", "html"), (2, "https://other.test/p", "page", "html"), (3, "https://cdn.test/a.js", "asset", "js"),
    (4, "https://site.test/v.mp4", "asset", "media"), (5, "https://site.test/big.iso", "asset", "doc"), (6, "https://site.test/ok", "page", "html"), (7, "https://site.test/app.css", "asset", "css"),
]
_CANDIDATES = both(CANDIDATES, "seq, url, kind, type", "SELECT 100 + page_id, CASE WHEN page_id % 4 = 0 THEN concat('https://site.test/private/', CAST(page_id AS VARCHAR(20))) WHEN page_id % 4 = 1 THEN concat('https://site.test/', CAST(page_id AS VARCHAR(20)), '.iso') ELSE url END, CASE WHEN page_id % 3 = 0 THEN 'asset' ELSE 'page' END, CASE WHEN page_id % 5 = 0 THEN 'media' ELSE '' END FROM pages")
PATHS = [("/srv/www/site",), ("/srv/www",), ("/srv/wwwx",), ("/etc/passwd",), ("/home/a/p",)]
_PATHS = both(PATHS, "path", f"SELECT concat(CASE WHEN page_id % 2 = 0 THEN '/srv/www' ELSE '/srv/other' END, {PAGE_PATH}) FROM pages", "p")
query("path_in_roots", f"SELECT path, bool_or(path = root OR starts_with(path, root || '/')) AS allowed FROM {_PATHS}, (VALUES ('/srv/www'), ('/home')) AS r(root) GROUP BY path")(
    lambda s, d: given(s, d, _PATHS, "pages").distinct().select("path", in_roots(F.col("path"), ["/srv/www", "/home"]).alias("allowed"))
)
TREE = [("a.php", 100), ("vendor/x.php", 50), ("node_modules/m/i.js", 70), ("src/node_modules/z.js", 10), ("src/b.PHP", 300), ("img/big.bin", 99999999), ("readme.md", 5)]
_FILES = both(TREE, "path, size", f"SELECT concat(CASE page_id % 5 WHEN 0 THEN 'node_modules' WHEN 1 THEN 'a/.git' ELSE 'src' END, {PAGE_PATH}, CASE WHEN page_id % 2 = 0 THEN '.php' ELSE '' END), length(html) * (CASE WHEN page_id % 7 = 0 THEN 10000 ELSE 1 END) FROM pages")
_TREE = f"SELECT path, size FROM {_FILES} WHERE NOT regexp_matches('/' || path, '/(?:node_modules|\\.git)/') AND size <= 52428800"


def project(spark, sf_dir):
    return given(spark, sf_dir, _FILES, "pages").where(~skipped(F.col("path")) & (F.col("size") <= 50 << 20))


query("project_files", _TREE)(project)
query("project_stats", f"SELECT count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (lower(path) LIKE '%.php')::BIGINT AS php FROM ({_TREE}) AS t")(
    lambda s, d: project(s, d).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.count(F.when(F.lower("path").endswith(".php"), 1)).alias("php"))
)
SITES = [("Blog", "index.html"), ("Blog", "a.php"), (".git", "x.php"), ("shop", None), ("alpha", "z.htm"), ("alpha", "b.txt")]
_SITES = both(SITES, "name, entry", f"SELECT {PAGE_HOST}, regexp_extract(url, '([^/?#]*)[^/]*$', 1) FROM pages")
query("list_projects", f"SELECT name, min(CASE WHEN entry LIKE '%.php' OR entry LIKE '%.html' OR entry LIKE '%.htm' THEN entry END) AS entry, row_number() OVER (ORDER BY lower(name), name) AS place FROM {_SITES} WHERE NOT (name LIKE '.%') GROUP BY name")(
    lambda s, d: projects(given(s, d, _SITES, "pages"))
)
SCHEMAS = [("mysql", "user"), ("shop", "item"), ("shop", "sale"), ("sys", "x"), ("blog", "post")]
_SCHEMAS = both(SCHEMAS, "name, tbl", "SELECT lower(replace(r_name, ' ', '_')), n_name FROM nation JOIN region ON r_regionkey = n_regionkey")
shared("list_databases", f"SELECT name, CAST(count(*) AS BIGINT) AS n_tables FROM {_SCHEMAS} WHERE name NOT IN ('information_schema', 'performance_schema', 'mysql', 'sys') GROUP BY name", "nation", "region")
TABLES = [("v_sales", "VIEW"), ("item", "BASE TABLE"), ("sale", "BASE TABLE"), ("v_all", "VIEW")]
_TABLES = both(TABLES, "name, kind", "SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END FROM nation")
shared("dump_table_order", f"SELECT name, row_number() OVER (ORDER BY CASE WHEN kind = 'VIEW' THEN 1 ELSE 0 END, name) AS place FROM {_TABLES}", "nation")
shared("sql_dump_header", f"SELECT concat('-- Database: ', name, chr(10), '-- Tables: ', CAST(count(*) AS VARCHAR(9)), chr(10), 'SET NAMES utf8mb4;', chr(10), 'SET FOREIGN_KEY_CHECKS=0;') AS header FROM {_SCHEMAS} GROUP BY name", "nation", "region")

# Seeds of a crawl.
_STARTS = both([("https://site.test/", 0), ("https://www.site.test/", 0), ("https://site.test/", 0)], "url, depth", "SELECT url, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END FROM pages", "s")
query("crawl_seed", f"SELECT url, min(depth) AS depth FROM {_STARTS} GROUP BY url")(lambda s, d: given(s, d, _STARTS, "pages").groupBy("url").agg(F.min("depth").alias("depth")))
# Log: format, tail.
shared("log_format", "SELECT event_id, concat('{\"t\":', CAST(user_id AS VARCHAR(20)), ',\"l\":\"', CASE WHEN value > 90 THEN 'warn' ELSE 'info' END, '\",\"m\":\"', event_type, '\"}') AS line FROM events", "events")
# SQL dump: multi-row INSERTs of 400 rows, in key order.
@query("sql_dump_insert", """WITH r AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 400 AS chunk, '(' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ')' AS t FROM customer)
SELECT chunk::BIGINT AS chunk, 'INSERT INTO `customer` VALUES' || chr(10) || string_agg(t, ',' || chr(10) ORDER BY c_custkey) || ';' AS sql FROM r GROUP BY chunk""")
def sql_dump_insert(spark, sf_dir):
    """Keys are dealt to chunks by their rank: counts of key ranges first, so that no task ranks all rows."""
    from archloom.operators.ranking import ranked

    c = ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", "rank")
    row = F.concat(F.lit("("), sql_literal(F.col("c_custkey"), "bigint"), F.lit(", "), sql_literal(F.col("c_name"), "string"), F.lit(", "), sql_literal(F.col("c_nationkey"), "int"), F.lit(")"))
    c = c.select(F.floor((F.col("rank") - 1) / 400).cast("long").alias("chunk"), F.struct("c_custkey", row.alias("t")).alias("s"))
    rows = F.transform(F.array_sort(F.collect_list("s")), lambda x: x.getField("t"))
    return c.groupBy("chunk").agg(F.concat(F.lit("INSERT INTO `customer` VALUES\n"), F.array_join(rows, ",\n"), F.lit(";")).alias("sql"))


_DUMPED = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey"}
_VIEW = "CREATE DEFINER=`root`@`localhost` SQL SECURITY DEFINER VIEW `v_nations` AS SELECT n_name FROM nation"
_TYPED = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'longtext' END"


def _d_rows(place: int, name: str, key: str, columns: list[tuple[str, bool]]) -> str:
    """DuckDB: the chunks of a table; columns with whether they are text."""
    text = lambda c: f"chr(39) || replace(replace({c}, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || chr(39)"
    row = " || ', ' || ".join(f"coalesce({text(c) if is_text else c + '::VARCHAR'}, 'NULL')" for c, is_text in columns)
    return f"SELECT {place} AS place, '{name}' AS name, chunk, 'INSERT INTO `{name}` VALUES' || chr(10) || string_agg(r, ',' || chr(10) ORDER BY {key}) || ';' AS sql FROM (SELECT {key}, (row_number() OVER (ORDER BY {key}) - 1) // 400 AS chunk, '(' || {row} || ')' AS r FROM {name}) AS t GROUP BY chunk"


_dump_rows = " UNION ALL ".join(_d_rows(k, n, _DUMPED[n], c) for k, (n, c) in enumerate({
    "customer": [("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_acctbal", False), ("c_mktsegment", True)], "nation": [("n_nationkey", False), ("n_name", True), ("n_regionkey", False)],
    "region": [("r_regionkey", False), ("r_name", True)], "supplier": [("s_suppkey", False), ("s_name", True), ("s_nationkey", False), ("s_acctbal", False)],
}.items(), 1))


@query("database_dump", f"""SELECT 0 AS place, '' AS name, -1::BIGINT AS chunk, '-- Database: shop' || chr(10) || '-- Tables: 4, views: 1' || chr(10) || 'SET NAMES utf8mb4;' || chr(10) || 'SET FOREIGN_KEY_CHECKS=0;' AS sql
UNION ALL SELECT dense_rank() OVER (ORDER BY table_name), table_name, -1, 'DROP TABLE IF EXISTS `' || table_name || '`;' || chr(10) || 'CREATE TABLE `' || table_name || '` (' || chr(10) || string_agg('  `' || column_name || '` ' || {_TYPED}, ',' || chr(10) ORDER BY ordinal_position) || chr(10) || ');' FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'region', 'supplier') GROUP BY table_name
UNION ALL {_dump_rows}
UNION ALL SELECT 5, 'v_nations', -1, 'DROP VIEW IF EXISTS `v_nations`;' || chr(10) || 'CREATE VIEW `v_nations` AS SELECT n_name FROM nation;'
UNION ALL SELECT 6, '', -1, 'SET FOREIGN_KEY_CHECKS=1;' || chr(10) || '-- End of dump'""")
def database_dump(spark, sf_dir):
    from archloom.operators.dump import dump

    return dump(spark, "shop", {n: (table(spark, sf_dir, n), [k]) for n, k in _DUMPED.items()}, {"v_nations": _VIEW})


@query("json_permissive", "SELECT event_id, coalesce(try_cast(props AS JSON)->>'$.k', '') AS k FROM events")
def json_permissive(spark, sf_dir):
    """A default where the JSON is missing, empty or broken."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


# Path assignment: content twins in one directory share a file, others get -2, -3, ...
ARRIVALS = [(0, "/a", "a/index.html", "h1"), (1, "/a/", "a/index.html", "h2"), (2, "/a/index.html", "a/index.html", "h2"), (3, "/b", "b/index.html", "h1"), (4, "/a/x", "a/index-2.html", "h9"), (5, "/a?", "a/index.html", "h1")]


_ARRIVALS = both(ARRIVALS, "seq, url, path, hash", "SELECT 100 + page_id, url, concat('d', CAST(page_id % 3 AS VARCHAR(20)), '/page', CASE page_id % 11 WHEN 0 THEN '-2' WHEN 1 THEN '-4' WHEN 2 THEN '-04' ELSE '' END, CASE WHEN page_id % 5 = 0 THEN '' ELSE '.html' END), CAST(page_id % 97 AS VARCHAR(20)) FROM pages")


@query("assign_path", f"""WITH a0 AS (SELECT * FROM {_ARRIVALS}), {d_parts('a0', 'url', 'n')}, ar AS (SELECT seq, url, path, hash, n_host || regexp_extract(n_p, '^(.*/)', 1) AS dir FROM n),
ow AS (SELECT *, first_value(seq) OVER (PARTITION BY path, hash, dir ORDER BY seq) AS owner FROM ar), nu AS (SELECT seq, path, row_number() OVER (PARTITION BY path ORDER BY seq) AS n FROM ow WHERE seq = owner),
st AS (SELECT DISTINCT path, regexp_replace(path, '\\.[^./]*$', '') AS stem, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM ar),
ta AS (SELECT p.path, list(m) AS taken FROM st p, (SELECT unnest(range(2, 3 + (SELECT count(*) FROM ar))) AS m) AS k JOIN st q ON q.path = p.stem || '-' || m || p.ext GROUP BY p.path),
fi AS (SELECT nu.seq, CASE WHEN n = 1 THEN nu.path ELSE stem || '-' || list_filter(range(2, n + 2 + coalesce(len(taken), 0)), lambda x: NOT list_contains(coalesce(taken, []), x))[n - 1] || ext END AS file FROM nu JOIN st ON st.path = nu.path LEFT JOIN ta ON ta.path = nu.path)
SELECT ow.seq, url, file FROM ow JOIN fi ON fi.seq = ow.owner""")
def assign_path(spark, sf_dir):
    from archloom.operators.paths import assign

    return assign(given(spark, sf_dir, _ARRIVALS, "pages"))


SITEMAPS = [("https://site.test/sitemap.xml", "<sitemapindex><sitemap><loc>https://site.test/s1.xml</loc></sitemap><sitemap><loc>https://site.test/s2.xml</loc></sitemap></sitemapindex>"), ("https://site.test/s1.xml", "<urlset><url><loc>https://site.test/a</loc></url><url><loc> https://site.test/b&amp;c </loc></url><url><loc>https://else.test/z</loc></url></urlset>"), ("https://site.test/s9.xml", "<urlset><url><loc>https://site.test/never</loc></url></urlset>")]


_SITEMAPS = both(SITEMAPS, "url, body", f"SELECT 'https://site.test/s2.xml', concat('<urlset>', string_agg(concat('<url><loc>https://site.test', {PAGE_PATH}, '</loc></url>'), ''), '</urlset>') FROM pages")


@query("sitemap_seed", f"WITH m AS (SELECT * FROM {_SITEMAPS}), l AS (SELECT m.url AS src, replace(trim(x), '&amp;', '&') AS loc FROM m, unnest(regexp_extract_all(body, '<loc>([^<]*)</loc>', 1)) AS u(x)) SELECT DISTINCT b.loc AS url, 1 AS depth FROM l a JOIN l b ON b.src = a.loc WHERE a.src = 'https://site.test/sitemap.xml' AND b.loc LIKE 'https://site.test/%' ORDER BY url LIMIT 3000")
def sitemap_seed(spark, sf_dir):
    from archloom.operators.crawl import sitemap_urls

    files = given(spark, sf_dir, _SITEMAPS, "pages")
    return sitemap_urls(files, "https://site.test/sitemap.xml", "site.test")


# Order and budgets over whole tables: running sums by ranges, and the first rows of an order.
@query("frontier_batch", "SELECT event_id, kind FROM (SELECT event_id, kind, row_number() OVER (ORDER BY CASE WHEN kind = 'page' THEN 0 ELSE 1 END, event_id) AS r FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'page' ELSE 'asset' END AS kind FROM events) AS k) AS o WHERE r <= 50")
def frontier_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "page").otherwise("asset").alias("kind"))
    return e.orderBy(F.when(F.col("kind") == "page", 0).otherwise(1), "event_id").limit(50)


@query("budget_bytes", "SELECT event_id FROM (SELECT event_id, coalesce(sum(size) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (SELECT event_id, floor(value)::BIGINT AS size FROM events) AS k) AS b WHERE used < 150000")
def budget_bytes(spark, sf_dir):
    """One budget for all: what lies before it in the order of the queue is taken."""
    return running(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", used=F.floor("value")).where("used < 150000").select("event_id")


@query("zip_limits", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, sum(CAST(o_totalprice * 10000 AS BIGINT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size FROM orders) AS z WHERE n <= 65000 AND size <= 4294901760")
def zip_limits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 10000).cast("decimal(38,4)").alias("x")).select("o_orderkey", F.round("x").cast("long").alias("size"))
    return running(o, "o_orderkey", n=F.lit(1), used=F.col("size")).where((F.col("n") < MOST_ENTRIES) & (F.col("used") + F.col("size") <= MOST_BYTES)).select("o_orderkey")


@query("log_tail", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS r, sum(length(event_type) + 1) OVER (ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM events) AS t WHERE r <= 400 AND back <= 400000")
def log_tail(spark, sf_dir):
    """The last rows first: at most 400 of them meet in the window."""
    last = table(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(400)
    back = F.sum(F.length("event_type") + 1).over(Window.orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return last.withColumn("back", back).where("back <= 400000").select("event_id")


TWINS = [(-1, "https://site.test/a/", "same"), (-2, "https://site.test/a/index.html", "same"), (-3, "https://site.test/b/", "same"), (-4, "https://www.site.test/a/x", "same")]


@query("content_twins", f"WITH p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {values(TWINS, 'page_id, url, html')}), {d_parts('p', 'url', 'n')} SELECT page_id, min(page_id) OVER (PARTITION BY html, n_host || regexp_extract(n_p, '^(.*/)', 1)) AS owner FROM n")
def content_twins(spark, sf_dir):
    """Pages of one directory with the same content, by the first of them."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(TWINS, "page_id long, url string, html string"))
    return p.select("page_id", F.sha1("html").alias("h"), folder(F.col("url")).alias("dir")).withColumn("owner", F.min("page_id").over(Window.partitionBy("h", "dir"))).select("page_id", "owner")


# Fetch results and policy, by the operators of the crawl.
def _fetches(spark, sf_dir):
    return handled(POLICY, given(spark, sf_dir, _FETCHED, "pages").withColumnRenamed("guess", "type"))


POLICY = Options("site.test", external_assets=False, types={"media": False}, skip_ext=("iso",))
_MIME = "CASE WHEN ctype = '' THEN '' WHEN ctype LIKE '%html%' THEN 'html' WHEN ctype = 'text/css' THEN 'css' WHEN ctype LIKE '%javascript%' OR ctype LIKE '%ecmascript%' THEN 'js' WHEN ctype LIKE 'image/%' THEN 'img' WHEN ctype LIKE 'font/%' OR ctype LIKE '%woff%' THEN 'font' WHEN ctype LIKE 'video/%' OR ctype LIKE 'audio/%' THEN 'media' ELSE 'doc' END"
HANDLED = f"""{FET}, t AS (SELECT *, coalesce(nullif({_MIME}, ''), nullif(guess, ''), 'doc') AS type, CASE WHEN size > 26214400 THEN 'skipped: larger than the per-file limit' WHEN error <> '' THEN error WHEN status >= 400 THEN 'HTTP ' || status WHEN status = 0 THEN 'no response' ELSE '' END AS problem FROM f),
h AS (SELECT *, CASE WHEN kind = 'page' AND type <> 'html' THEN 'asset' ELSE kind END AS real FROM t)"""
query("fetch_status", f"WITH {HANDLED} SELECT url, problem AS error FROM h")(lambda s, d: _fetches(s, d).select("url", F.when(F.col("state") == "fail", F.col("note")).otherwise("").alias("error")))
query("effective_type", f"WITH {HANDLED} SELECT url, ctype, guess, type FROM h")(
    lambda s, d: given(s, d, _FETCHED, "pages").select("url", "ctype", "guess", effective_type(F.col("ctype"), F.col("guess")).alias("type"))
)
query("filter_type", f"WITH {HANDLED} SELECT url, type FROM h WHERE problem = '' AND type <> 'media'")(lambda s, d: _fetches(s, d).where("state <> 'fail'").where(~POLICY.off(F.col("type"))).select("url", "type"))
query("crawl_handle", f"""WITH {HANDLED} SELECT url, CASE WHEN problem <> '' THEN guess ELSE type END AS type, CASE WHEN problem <> '' THEN kind ELSE real END AS kind,
 CASE WHEN problem <> '' THEN 'fail' WHEN type = 'media' OR ({_AWAY}) THEN 'skip' ELSE 'ok' END AS state,
 CASE WHEN problem <> '' THEN problem WHEN type = 'media' THEN 'media files are turned off' WHEN {_AWAY} THEN 'redirected off-site' ELSE '' END AS note FROM h""")(
    lambda s, d: _fetches(s, d).select("url", "type", "kind", "state", "note")
)
query("redirect_offsite", f"WITH {HANDLED} SELECT url, final_url FROM h WHERE problem = '' AND type <> 'media' AND {_AWAY}")(lambda s, d: _fetches(s, d).where("note = 'redirected off-site'").select("url", "final_url"))
query("reject_reason", f"""SELECT seq, url, CASE WHEN NOT (url LIKE 'http://%' OR url LIKE 'https://%') THEN 'not an http(s) URL' WHEN url LIKE 'https://site.test/private/%' THEN 'blocked by robots.txt'
 WHEN kind = 'page' AND NOT (url LIKE 'https://site.test/%') THEN 'outside the site' WHEN kind = 'asset' AND NOT (url LIKE 'https://site.test/%') THEN 'external file (option off)'
 WHEN type = 'media' THEN 'media files are turned off' WHEN url LIKE '%.iso' THEN '.iso is on your skip list' END AS reason FROM {_CANDIDATES}""")(lambda s, d: rejected(s, d))


def rejected(spark, sf_dir):
    """Candidates judged by scope, options and the rules of their host's robots file."""
    from archloom.functions.url import host
    from archloom.operators import robots as R

    c = given(spark, sf_dir, _CANDIDATES, "pages")
    rows = R.rules(spark.createDataFrame([("site.test", "User-agent: *\nDisallow: /private/")], "host string, body string"))
    verdict = R.allowed(c.select("url", host(F.col("url")).alias("host")).distinct(), rows.join(R.group(rows), ["host", "agent"]))
    return c.join(verdict, "url", "left").select("seq", "url", reject_reason(POLICY, F.col("url"), F.col("kind"), F.col("type"), F.col("allowed")).alias("reason"))


# The end of a job: counts by kind, one line each.
query("summary_lines", W + """SELECT 1 AS place, count(*) FILTER (kind = 'page' AND state = 'ok') || ' pages, ' || count(*) FILTER (kind = 'asset' AND state = 'ok') || ' files' AS line FROM res
 UNION ALL SELECT 2, count(*) FILTER (state = 'fail') || ' failed, ' || count(*) FILTER (state = 'skip') || ' skipped, ' || count(*) FILTER (state = 'queued') || ' left' FROM res
 UNION ALL SELECT 3, sum(bytes) FILTER (state = 'ok') || ' bytes' FROM res""")(lambda s, d: summary(resources(s, d)))
_js = lambda c: f"replace(replace({c}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
reported("manifest_json", f"""SELECT seq, '{{"url":"' || url || '","file":"' || path || '","type":"' || type || '","kind":"' || kind || '","status":' || code || ',"bytes":' || bytes || ',"state":"' || state || '","note":"' || {_js('note')} || '"}}' AS entry FROM res""", P.manifest_entries)


def summary(res):
    n = lambda c: F.count(F.when(F.expr(c), 1)).cast("string")
    lines = res.agg(
        F.array(
            F.concat(n("kind = 'page' and state = 'ok'"), F.lit(" pages, "), n("kind = 'asset' and state = 'ok'"), F.lit(" files")),
            F.concat(n("state = 'fail'"), F.lit(" failed, "), n("state = 'skip'"), F.lit(" skipped, "), n("state = 'queued'"), F.lit(" left")),
            F.concat(F.sum(F.when(F.col("state") == "ok", F.col("bytes"))).cast("string"), F.lit(" bytes")),
        ).alias("lines")
    )
    return lines.select(F.posexplode("lines").alias("place", "line")).select((F.col("place") + 1).alias("place"), "line")
