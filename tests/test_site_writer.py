"""Trees and archives written by tasks: whole, within limits, resumable."""

import glob
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from archloom.sources.site_writer import _Writer, write_archives, write_tree


def many(spark, n=60, size=400):
    return spark.range(n, numPartitions=6).select(F.format_string("d%d/p%03d.html", F.col("id") % 5, "id").alias("path"), F.repeat(F.col("id").cast("string"), size).cast("binary").alias("body"))


def test_tree_has_each_file_whole_and_none_outside(spark, tmp_path):
    odd = spark.createDataFrame([("../../up.txt", bytearray(b"x")), ("a//b\\c.txt", None), ("a/b/c.txt", None)], "path string, body binary")
    told = write_tree(many(spark).unionByName(odd), str(tmp_path / "site"))
    found = {os.path.relpath(f, tmp_path / "site"): os.path.getsize(f) for f in glob.glob(f"{tmp_path}/site/**/*.*", recursive=True) if os.path.isfile(f)}
    assert told["entries"] == 62 and found["up.txt"] == 1 and found["a/b/c.txt"] == 0 and found["d3/p008.html"] == 400 and len(found) == 63
    assert not glob.glob(f"{tmp_path}/site/.part*") and not os.path.exists(tmp_path / "up.txt")


def test_a_site_beyond_one_archive_gives_several_that_open(spark, tmp_path):
    at = str(tmp_path / "zips")
    told = write_archives(many(spark), at, "copy", most_entries=25)
    assert told["archives"] == ["copy-0001", "copy-0002", "copy-0003"] and told["entries"] == 60
    names = []
    for k in (1, 2, 3):
        with zipfile.ZipFile(f"{at}/copy-{k:04d}.zip") as z:
            assert z.testzip() is None and len(z.namelist()) <= 25
            names += z.namelist()
            assert z.read(z.namelist()[0]) == (z.namelist()[0][4:7].lstrip("0") or "0").encode() * 400
    assert names == sorted(names) and len(set(names)) == 60
    small = write_archives(many(spark), at, "small", most_bytes=9000)
    assert len(small["archives"]) > 3 and all(os.path.getsize(f"{at}/{n}.zip") <= 9000 for n in small["archives"])
    with pytest.raises(ValueError, match="half an archive"):
        write_archives(many(spark), at, "tiny", most_bytes=500)


def test_a_later_run_writes_only_what_changed(spark, tmp_path):
    at = str(tmp_path / "zips")
    write_archives(many(spark), at, most_entries=25)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{at}/*.zip")}
    assert write_archives(many(spark), at, most_entries=25)["archives"] == []
    changed = many(spark).withColumn("body", F.when(F.col("path") == "d4/p059.html", F.lit(b"new")).otherwise(F.col("body")))
    assert write_archives(changed, at, most_entries=25)["archives"] == ["site-0003"]
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{at}/*.zip")}
    assert [f for f in before if before[f] != after[f]] == [f"{at}/site-0003.zip"]


def test_a_failed_task_leaves_no_half_file(spark, tmp_path):
    at = str(tmp_path / "zips")
    bad = many(spark).withColumn("body", F.when(F.col("path") != "d0/p055.html", F.col("body")).otherwise(F.expr("cast(raise_error('lost') as binary)")))
    with pytest.raises(Exception):
        write_archives(bad, at, most_entries=25)
    assert all(zipfile.ZipFile(f).testzip() is None for f in glob.glob(f"{at}/*.zip")) and not glob.glob(f"{at}/.part*/*")
    writer = _Writer({"path": at, "kind": "zip"})

    class R:  # a row whose body can't be read, after one that can
        path, body, method, archive, digest = "a", b"x", 0, 7, "d"

    def rows():
        yield R
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(rows())
    assert not os.path.exists(f"{at}/site-0007.zip")
    writer.abort([])
    assert not glob.glob(f"{at}/.part*")


def test_no_files_give_no_archives(spark, tmp_path):
    assert write_archives(many(spark, 0), str(tmp_path / "none"))["archives"] == []
