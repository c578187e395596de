"""Sources: local trees, JSON documents, log tails, and pages fetched by a plug-in."""

from __future__ import annotations

import gzip
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archloom.operators.ranking import ranked

# Folders that a project scan leaves out.
SKIPPED = ("node_modules", ".git", ".svn", "vendor/bin", ".idea", ".vscode", "storage/jobs")
FETCHED = "url string, final_url string, status int, ctype string, body binary, size long, error string"


def tree(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED, most_bytes: int = 50 << 20) -> DataFrame:
    """Rows path (relative), size, modified of the files below root, without skipped folders and large files.

    Only the listing is read: the content column is not selected.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(root.rstrip("/")) + "/", "")
    d = d.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return d.where(~skipped(F.col("path"), skip) & (F.col("size") <= most_bytes))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def skipped(path: Column, skip: tuple[str, ...] = SKIPPED) -> Column:
    """Whether a relative path lies in a skipped folder, at any depth."""
    out = F.lit(False)
    for s in skip:
        out = out | F.concat(F.lit("/"), path).contains(f"/{s}/")
    return out


def in_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or lies below one."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def projects(entries: DataFrame) -> DataFrame:
    """Rows name, entry, place from files (name of the folder, entry): hidden folders aside, the first page of each, in order of name whatever its case."""
    d = entries.where(~F.col("name").startswith(".")).groupBy("name").agg(F.min(F.when(F.col("entry").rlike(r"\.(?:php|html|htm)$"), F.col("entry"))).alias("entry"))
    return ranked(d.withColumn("key", F.struct(F.lower("name").alias("low"), "name")), "key", "place").drop("key")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents; broken ones give nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


@dataclass(frozen=True)
class Pace:
    """How a fetch treats hosts and failures; times in seconds."""

    delay: float = 0.0
    most_delay: float = 30.0
    tries: int = 1
    wait: float = 1.0
    redirects: int = 6
    most_bytes: int = 25 << 20


#: Statuses after which a try is repeated.
_AGAIN = (0, 429, 500, 502, 503, 504)


def _followed(fetch: Callable[[str], dict], url: str, pace: Pace, due: Callable[[str], None]) -> dict:
    """What a URL gives in the end: through redirects, each at its host's pace, and with a body within the limit."""
    at, seen = url, set()
    while True:
        due(at)
        try:
            got = dict(fetch(at))
        except Exception as e:  # noqa: BLE001  a failed fetch is data
            return {"final_url": at, "status": 0, "error": str(e) or type(e).__name__}
        to = got.pop("location", None)
        if not (to and 300 <= got.get("status", 0) < 400):
            break
        seen.add(at)
        at = urljoin(at, to)
        if at in seen or len(seen) > pace.redirects:
            return {"final_url": at, "status": got["status"], "error": "too many redirects"}
    got = {"final_url": at} | got
    size = max(got.get("size") or 0, len(got.get("body") or b""))
    if size > pace.most_bytes:
        return got | {"body": None, "size": size, "error": "larger than the per-file limit"}
    return got | {"size": size}


def fetched(urls: DataFrame, fetch: Callable[[str], dict], partitions: int = 12, pace: Pace = Pace(), clock: tuple[Callable[[], float], Callable[[float], None]] = (time.monotonic, time.sleep)) -> DataFrame:
    """Fetch results of distinct, non-empty URLs by a plug-in; what it raises becomes the row's error.

    The engine itself opens no connections. urls may have a delay of each URL's host, which counts if it
    is longer than the pace's. A host's URLs lie in one partition, as their pace allows no more; the
    hosts of a partition take turns, so that one waits while others are served. Tries that fail for a
    time are repeated after a pause that doubles; redirects (status 300 to 399 with location) are
    followed at the pace of their host within the partition; a body over the limit is dropped with an error.
    """
    has_delay = "delay" in urls.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sleep = clock
        empty = {"final_url": None, "status": 0, "ctype": "", "body": None, "size": 0, "error": ""}
        free: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for u, asked in zip(pdf["url"], pdf["delay"]):
                delay = min(pace.most_delay, max(pace.delay, asked if asked == asked else 0.0))

                def due(at: str, delay: float = delay) -> None:
                    host = urlsplit(at).netloc.lower()
                    if (left := free.get(host, 0.0) - now()) > 0:
                        sleep(left)
                    free[host] = now() + delay

                for k in range(pace.tries):
                    got = _followed(fetch, u, pace, due)
                    if got.get("status", 0) not in _AGAIN or k + 1 == pace.tries:
                        break
                    sleep(pace.wait * 2**k)
                rows.append({"url": u} | empty | got)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")])

    d = urls.where("url <> ''").groupBy("url").agg((F.max("delay") if has_delay else F.lit(0.0)).cast("double").alias("delay"))
    d = d.withColumn("host", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    d = d.repartition(partitions, "host").withColumn("turn", turn).sortWithinPartitions("turn", "host")
    return d.select("url", "delay").mapInPandas(run, FETCHED)


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows path, url, body of sitemap files: gzip undone where the bytes say so, whatever the name; broken ones are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = []
            for raw in pdf["content"]:
                try:
                    bodies.append((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bytes(raw)).decode("utf-8", "replace"))
                except (OSError, EOFError, zlib.error):
                    bodies.append("")
            yield pd.DataFrame({"path": pdf["path"], "body": bodies})

    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return d.mapInPandas(run, "path string, body string")
