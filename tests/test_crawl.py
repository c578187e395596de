"""A whole crawl over a small site, with its budgets, robots rules, twins and failures, by hand."""

import pytest

from archloom.operators.crawl import Options, crawl

_AT = "https://site.test"
_HOME = '<a href="/about">a</a><a href="/shop.php?id=7">s</a><link rel="stylesheet" href="/css/app.css"><script src="https://cdn.test/lib.js"></script><a href="/private/x">p</a><a href="mailto:x@y">m</a><a href="http://other.test/">o</a>'
SITE = [
    (f"{_AT}/", "text/html", _HOME), (f"{_AT}/index.html", "text/html", _HOME),
    (f"{_AT}/about", "text/html; charset=utf-8", '<a href="/">h</a><a href="/index.html">i</a><img src="../img/logo.png"><a href="team/">t</a>'),
    (f"{_AT}/shop.php?id=7", "text/html", '<a href="?id=8">next</a>'), (f"{_AT}/team/", "text/html", '<a href="deep#s">d</a>'), (f"{_AT}/team/deep", "text/html", '<a href="/team/deeper">d</a>'),
    (f"{_AT}/team/deeper", "text/html", "end"), (f"{_AT}/css/app.css", "text/css", 'a{b:url(../font/a.woff2)} @import "b.css";'), (f"{_AT}/css/b.css", "text/css", "c{}"),
    (f"{_AT}/font/a.woff2", "font/woff2", "w"), (f"{_AT}/img/logo.png", "image/png", "p"), ("https://cdn.test/lib.js", "text/javascript", "j()"), (f"{_AT}/private/x", "text/html", "no"),
]
ROBOTS = [("site.test", "User-agent: *\nDisallow: /private/\n")]

_P, _S = f"{_AT}/", "blocked by robots.txt"
#: Expected resources: seq, url, kind, type, depth, state, path.
WHOLE = [
    (0, _P, "page", "html", 0, "ok", "index.html"), (1, f"{_P}about", "page", "html", 1, "ok", "about/index.html"), (2, f"{_P}shop.php?id=7", "page", "html", 1, "ok", "shop.php__c53d0f0.html"),
    (3, f"{_P}css/app.css", "asset", "css", 0, "ok", "css/app.css"), (4, "https://cdn.test/lib.js", "asset", "js", 0, "ok", "_external/cdn.test/lib.js"), (5, f"{_P}private/x", "page", "html", 1, "skip", ""),
    (6, f"{_P}index.html", "page", "html", 2, "ok", "index.html"), (7, f"{_P}img/logo.png", "asset", "img", 1, "ok", "img/logo.png"), (8, f"{_P}team/", "page", "html", 2, "ok", "team/index.html"),
    (9, f"{_P}shop.php?id=8", "page", "html", 2, "fail", ""), (10, f"{_P}team/deep", "page", "html", 3, "ok", "team/deep/index.html"), (11, f"{_P}team/deeper", "page", "html", 4, "ok", "team/deeper/index.html"),
    (12, f"{_P}font/a.woff2", "asset", "font", 0, "ok", "font/a.woff2"), (13, f"{_P}css/b.css", "asset", "css", 0, "ok", "css/b.css"),
]
_LEFT = {f"{_P}private/x", f"{_P}index.html", f"{_P}team/", f"{_P}shop.php?id=8"}
FEW_PAGES = [(k, u, a, t, d, "queued" if u in _LEFT else s, "" if u in _LEFT else p) for k, (u, a, t, d, s, p) in enumerate(r[1:] for r in WHOLE if "deep" not in r[1])]
SHALLOW = [(k, *r[1:]) for k, r in enumerate(r for r in WHOLE if r[2] == "asset" or r[4] <= 1)]


def _crawl(spark, **options):
    site = spark.createDataFrame([(u, u, 200, c, b, len(b), "") for u, c, b in SITE] + [(f"{_AT}/shop.php?id=8", f"{_AT}/shop.php?id=8", 404, "text/html", "", 0, "")], "url string, final_url string, status int, ctype string, body string, size long, error string")
    return crawl(spark.createDataFrame([(f"{_AT}/", 0)], "url string, depth int"), site, spark.createDataFrame(ROBOTS, "host string, body string"), Options("site.test", **options))


@pytest.mark.parametrize("rows, options", [(WHOLE, {}), (FEW_PAGES, {"max_pages": 3}), (SHALLOW, {"max_depth": 1})])
def test_crawl(spark, rows, options):
    got = _crawl(spark, **options).select("seq", "url", "kind", "type", "depth", "state", "path")
    assert sorted(map(tuple, got.collect())) == rows


def test_no_body_is_shuffled_or_written(spark):
    """Bodies are read by narrow steps alone: no exchange or file of the crawl has them."""
    from archloom.operators.crawl import named
    from archloom.sources.shared import Bucketed

    site = spark.createDataFrame([(f"{_AT}/", f"{_AT}/", 200, "text/html", _HOME, 1, "")], "url string, final_url string, status int, ctype string, body string, size long, error string")
    seen = Bucketed(spark, "src", named(Options("site.test"), site).schema)
    assert "body" not in seen.schema.names
    plan = named(Options("site.test"), site)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "html" in line for line in plan.splitlines())
    seen.drop()


def test_seen_set_is_not_shuffled(spark):
    from archloom.sources.shared import Bucketed

    seen = Bucketed(spark, "url", spark.range(1).selectExpr("string(id) as url").schema)
    seen.add(spark.range(100).selectExpr("string(id) as url"))
    seen.add(spark.range(100, 200).selectExpr("string(id) as url"))
    new = spark.range(150, 250).selectExpr("string(id) as url").join(seen.read().hint("merge"), "url", "left_anti")
    assert new.count() == 50
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    seen.drop()


def _crossing(df):
    """Columns that go through the exchanges of a plan."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return " ".join(line for block in text.split("\n\n") if ") Exchange" in block or ") SortAggregate" in block for line in block.splitlines() if line.startswith("Input"))


def test_no_body_crosses_an_exchange(spark):
    from archloom.operators.crawl import named

    site = spark.createDataFrame([(f"{_AT}/{k}", f"{_AT}/", 200, c, _HOME, 1, "") for k, c in enumerate(("text/html", "text/css"))], "url string, final_url string, status int, ctype string, body string, size long, error string")
    across = _crossing(named(Options("site.test"), site))
    assert "page_id" in across and not any(x in across for x in ("body#", "text#", "html#", "css#"))


def test_of_two_urls_of_a_final_url_the_first_is_read(spark):
    from archloom.operators.crawl import named

    site = spark.createDataFrame([(f"{_AT}/b", f"{_AT}/z", 200, "text/html", '<a href="/from-b">', 1, ""), (f"{_AT}/a", f"{_AT}/z", 200, "text/html", '<a href="/from-a">', 1, "")], "url string, final_url string, status int, ctype string, body string, size long, error string")
    assert [(r.src, r.url) for r in named(Options("site.test"), site).collect()] == [(f"{_AT}/z", f"{_AT}/from-a")]


def test_pages_of_a_site_are_parsed_once(spark):
    """The links of pages come from files, and targets meet pages by host and number, not by host alone."""
    from archloom.plans.crawls import documents
    from archloom.sources.shared import removed

    docs, found, _, made = documents(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pages.parquet") <= 2 * 2  # the bodies taken, for tags and for styles: scan and its location
    assert docs.columns == ["url", "html"] and found.select("page_id").distinct().count() > made[0].select("page_id").distinct().count()
    for x in made:
        removed(x)
