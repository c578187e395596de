"""Paced fetching by a plug-in, and sitemap files."""

import gzip

from archloom.operators.crawl import locations
from archloom.sources.files import Pace, fetched, sitemap_files


def run(spark, urls, answers, **pace):
    """Results by URL. Time passes by sleeping alone; bodies tell when each was fetched. Workers get all of this by value."""
    now, calls = [0.0], {}

    def fetch(u):
        calls[u] = calls.get(u, 0) + 1
        return {"status": 200, "body": str(now[0]).encode()} | answers(u, calls[u])

    def sleep(seconds):
        now[0] += seconds

    d = spark.createDataFrame(urls, "url string, delay double")
    return {r.url: r for r in fetched(d, fetch, 2, Pace(**pace), (lambda: now[0], sleep)).collect()}


def test_no_host_is_served_faster_than_its_delay(spark):
    urls = [(f"http://{h}.test/{k}", 2.0 if h == "b" else None) for h in "abc" for k in range(6)]
    got = run(spark, urls + urls, lambda u, n: {}, delay=0.5)
    assert len(got) == 18
    for h, delay in (("a", 0.5), ("b", 2.0), ("c", 0.5)):
        at = sorted(float(r.body) for u, r in got.items() if f"//{h}." in u)
        assert all(y - x >= delay - 1e-9 for x, y in zip(at, at[1:]))
    # Hosts take turns: a whole partition takes no longer than its slowest host.
    assert max(float(r.body) for r in got.values()) <= 5 * 2.0 + 1e-6


def test_delays_are_held_to_a_limit(spark):
    got = run(spark, [(f"http://a.test/{k}", 1000.0) for k in range(3)], lambda u, n: {}, most_delay=3.0)
    assert max(float(r.body) for r in got.values()) == 6.0


def test_tries_are_repeated_and_failures_are_rows(spark):
    def answers(u, n):
        if u.endswith("late") and n < 3:
            return {"status": 503}
        if u.endswith("never"):
            raise OSError("refused")
        return {"status": 404} if u.endswith("gone") else {}

    got = run(spark, [(f"http://h.test/{x}", None) for x in ("late", "never", "gone", "")], answers, tries=3)
    assert {u.rsplit("/", 1)[1]: (r.status, r.error) for u, r in got.items()} == {"late": (200, ""), "never": (0, "refused"), "gone": (404, ""), "": (200, "")}


def test_redirects_and_sizes_have_limits(spark):
    def answers(u, n):
        if u.endswith("/to"):
            return {"status": 301, "location": "/there"}
        if "/loop" in u:
            return {"status": 302, "location": u + "x"}
        return {"body": b"x" * 50} if u.endswith("/big") else {}

    got = run(spark, [(f"http://h.test/{x}", None) for x in ("to", "loop", "big")], answers, delay=1.0, most_bytes=20)
    assert got["http://h.test/to"].final_url == "http://h.test/there" and got["http://h.test/to"].status == 200
    assert got["http://h.test/loop"].error == "too many redirects"
    assert (got["http://h.test/big"].body, got["http://h.test/big"].size, got["http://h.test/big"].error) == (None, 50, "larger than the per-file limit")


def test_sitemap_files_are_unpacked(spark, tmp_path):
    body = b"<urlset><url><loc>https://h/a&amp;b</loc></url></urlset>"
    (tmp_path / "a.xml").write_bytes(body)
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(body))
    (tmp_path / "c.xml.gz").write_bytes(gzip.compress(body)[:20])
    d = sitemap_files(spark, str(tmp_path))
    assert d.count() == 3
    assert [r.loc for r in locations(d.withColumnRenamed("path", "url")).collect()] == ["https://h/a&b"] * 2
