"""Operators that SQL can't express, against expected rows."""

import zipfile

from pyspark.sql import functions as F

from archloom.operators.archive import pack
from archloom.operators.crawl import closure
from archloom.operators.paths import assign
from archloom.operators.ranking import ranked
from archloom.sources.files import fetched, tree
from archloom.streaming.incremental import tick


def test_path_assignment_shares_twins_and_skips_natural_names(spark):
    rows = [(0, "/a", "a/index.html", "h1"), (1, "/a/", "a/index.html", "h2"), (2, "/a/index.html", "a/index.html", "h2"), (3, "/b", "b/index.html", "h1"), (4, "/a/x", "a/index-2.html", "h9"), (5, "/a?", "a/index.html", "h1")]
    got = {r.seq: r.file for r in assign(spark.createDataFrame(rows, "seq long, url string, path string, hash string")).collect()}
    assert got == {0: "a/index.html", 1: "a/index-3.html", 2: "a/index-3.html", 3: "b/index.html", 4: "a/index-2.html", 5: "a/index.html"}


def test_path_assignment_passes_any_number_of_natural_names(spark):
    paths = ["page.html"] * 3 + [f"page-{k}.html" for k in range(2, 70)] + ["page-71.html", "page-072.html", "page-5.html", "d.x/y", "d.x/y", "d.x/y-2", "page-9999999999999999999.html"]
    rows = [(k, f"/{k}", p, f"h{k}") for k, p in enumerate(paths)]
    got = {r.seq: r.file for r in assign(spark.createDataFrame(rows, "seq long, url string, path string, hash string")).collect()}
    # By hand: in order of arrival, the first number whose name is neither natural nor given away.
    want, used = {}, set(paths)
    for k, p in enumerate(paths):
        if p not in paths[:k]:
            want[k] = p
            continue
        stem, dot, ext = p.rpartition(".") if "." in p.rsplit("/", 1)[-1] else (p, "", "")
        want[k] = next(x for n in range(2, 99) if (x := f"{stem}-{n}{dot}{ext}") not in used)
        used.add(want[k])
    assert got == want and got[1] == "page-70.html" and got[2] == "page-72.html"
    assert len(set(got.values())) == len(rows)


def test_closure_stops_at_depth_and_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "page"), ("b", "a", "page"), ("b", "c", "page"), ("c", "d", "page"), ("a", "x.css", "asset")], "src string, dst string, kind string")
    got = {r.url: r.depth for r in closure(spark.createDataFrame([("a",)], "url string"), edges, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x.css": 0}


def test_ranks_are_global(spark):
    df = ranked(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000), "k", "rank")
    assert df.where("rank <> k + 1").count() == 0


def test_archive_opens_and_keeps_bytes(spark, tmp_path):
    files = spark.createDataFrame([("a/b.html", bytearray(b"x" * 5000)), ("/../c.png", bytearray(b"y" * 2000)), ("s.txt", bytearray(b"z"))], "path string, body binary")
    assert pack(files, str(tmp_path / "a.zip")) == 3
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None
        assert {i.filename: (i.compress_type, i.file_size) for i in z.infolist()} == {"a/b.html": (8, 5000), "c.png": (0, 2000), "s.txt": (0, 1)}


def test_tree_skips_folders(spark, tmp_path):
    for name in ("a.php", "node_modules/m.js", "src/b.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    assert {(r.path, r.size) for r in tree(spark, str(tmp_path)).collect()} == {("a.php", 5), ("src/b.js", 5)}


def test_fetch_plug_in_turns_failures_into_rows(spark):
    def fetch(u):
        if u.endswith("bad"):
            raise OSError("refused")
        return {"status": 200, "final_url": u}

    got = {r.url: (r.status, r.error) for r in fetched(spark.createDataFrame([("http://h/",), ("http://h/",), ("http://h/bad",), ("",)], "url string"), fetch).collect()}
    assert got == {"http://h/": (200, ""), "http://h/bad": (0, "refused")}


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    data = str(tmp_path / "in")
    spark.range(10).coalesce(1).write.parquet(data)
    run = lambda: tick(spark, data, spark.range(1).schema, lambda s: s.dropDuplicates(["id"]), name=tmp_path.name).count()
    assert run() == 10
    spark.range(5, 15).coalesce(1).write.mode("append").parquet(data)
    assert run() == 15
