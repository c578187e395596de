"""Rules of robots files against a plain reading of them."""

import random
import re

from archloom.operators import robots as R

FILES = "host string, body string"


def matches(pattern, target):
    ends = pattern.endswith("$")
    body = pattern[:-1] if ends else pattern
    return re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if ends else ""), target) is not None


def want(rules, target):
    hits = [(len(p.encode()), allow) for allow, p in rules if matches(p, target)]
    return max(hits)[1] if hits else True


def judged(spark, files, urls):
    rows = R.rules(spark.createDataFrame(files, FILES))
    d = spark.createDataFrame([(f"https://{h}{t}", h) for h, t in urls], "url string, host string")
    return {r.url: r.allowed for r in R.allowed(d, rows.join(R.group(rows), ["host", "agent"])).collect()}


def test_hosts_of_ten_thousand_rules(spark):
    rng = random.Random(4)
    word = lambda: "/" + "".join(rng.choices("abc", k=rng.randint(1, 3)))
    path = lambda: "".join(word() for _ in range(rng.randint(1, 4)))
    rules = {h: list({path() + rng.choice(["", "", "", "*", "$", "/*x", "?q=*$", ".$a"]): rng.random() < 0.4 for _ in range(n)}.items()) for h, n in (("big.test", 14000), ("small.test", 30))}
    assert len(rules["big.test"]) > 5000
    files = [(h, "User-agent: *\n" + "\n".join(("Allow: " if a else "Disallow: ") + p for p, a in rs)) for h, rs in rules.items()]
    urls = [(h, path() + rng.choice(["", "/x", "?q=1", ".$a"])) for h in (*rules, "none.test") for _ in range(250)]
    got = judged(spark, files, urls)
    for h, t in urls:
        assert got[f"https://{h}{t}"] == want([(a, p) for p, a in rules.get(h, [])], t), (h, t)


def test_odd_rules(spark):
    body = "User-agent: *\nDisallow: *.pdf$\nAllow:\nDisallow: /a$b\nAllow: /a$b$\nDisallow: /é*\nDisallow: /x\nAllow: /x\nDisallow: /y*\nAllow: /y\n"
    got = judged(spark, [("h.test", body)], [("h.test", t) for t in ("/k.pdf", "/k.pdfx", "/a$b", "/a$bc", "/é/1", "/x", "/y1", "/", "/q?x.pdf")])
    assert {u.split("h.test")[1]: ok for u, ok in got.items()} == {"/k.pdf": False, "/k.pdfx": True, "/a$b": True, "/a$bc": False, "/é/1": False, "/x": True, "/y1": False, "/": True, "/q?x.pdf": False}


def test_delays_of_the_group_or_of_all(spark):
    files = [("a", "User-agent: *\nDisallow: /\nCrawl-delay: 4\nUser-agent: archloom\nDisallow: /x\nCrawl-delay: 2"), ("b", "User-agent: *\nCrawl-delay: 9\nUser-agent: archloom\nDisallow: /x"), ("c", "Disallow: /"), ("d", "User-agent: *\nDisallow: /\nCrawl-delay: soon"), ("e", "")]
    assert {r.host: r.delay for r in R.delays(spark.createDataFrame(files, FILES)).collect()} == {"a": 2.0, "b": 9.0, "c": None, "d": None, "e": None}
