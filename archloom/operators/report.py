"""What a crawl tells of itself: counters, manifest, report, read-me and the plan of its archive, from its resources.

Resources are rows seq, url, kind, type, state, depth, path, code, bytes, note. Order is a column, never
that of rows; totals over all resources come from ranges (operators.ranking), not from one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.functions.text import bytes_human, html_escape
from archloom.functions.url import extension, is_dynamic

from .archive import STORED
from .ranking import running

#: Rows of a report.
MOST_ROWS = 4000


def _n(condition: str) -> Column:
    return F.count(F.when(F.expr(condition), 1))


def by_state(res: DataFrame) -> DataFrame:
    """Rows kind, state, n, bytes, dynamic: resources, and pages among them that a script on the server made."""
    made = (F.col("kind") == "page") & (F.col("state") == "ok") & is_dynamic(F.col("url"))
    return res.groupBy("kind", "state").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.sum(made.cast("long")).alias("dynamic"))


def notes(res: DataFrame) -> DataFrame:
    """The distinct notes."""
    return res.where("note <> ''").select("note").distinct()


def snapshot(res: DataFrame) -> DataFrame:
    """One row: queued, pages_done, failed, bytes, last_note (the greatest)."""
    return res.agg(_n("state = 'queued'").alias("queued"), _n("state = 'ok' and kind = 'page'").alias("pages_done"), _n("state = 'fail'").alias("failed"), F.sum("bytes").cast("long").alias("bytes"), F.max(F.when(F.col("note") != "", F.col("note"))).alias("last_note"))


def manifest(res: DataFrame) -> DataFrame:
    return res.select("seq", "url", F.col("path").alias("file"), "type", "kind", F.col("code").alias("status"), "bytes", "state", "note")


def manifest_entries(res: DataFrame) -> DataFrame:
    """Rows seq, entry: the manifest as JSON."""
    return manifest(res).select("seq", F.to_json(F.struct("url", "file", "type", "kind", "status", "bytes", "state", "note")).alias("entry"))


def copied(res: DataFrame) -> DataFrame:
    """Rows url, path of what is in the copy."""
    return res.where("state = 'ok' and path <> ''").select("url", "path")


def entry_file(res: DataFrame, root: str) -> DataFrame:
    """One row, entry: the file of the root, or else of the first page."""
    fine = F.col("state") == "ok"
    return res.agg(F.coalesce(F.max(F.when((F.col("url") == root) & fine, F.col("path"))), F.min_by("path", F.when(fine & (F.col("type") == "html"), F.col("seq")))).alias("entry"))


def first_rows(res: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Rows seq, state, shown, bytes of the first resources that were tried."""
    d = res.where("state <> 'queued'").orderBy("seq").limit(most)
    return d.select("seq", "state", F.when(F.col("state") == "ok", F.col("path")).otherwise(F.col("note")).alias("shown"), "bytes")


def report_lines(res: DataFrame, most: int = MOST_ROWS, size: Callable[[Column], Column] = bytes_human) -> DataFrame:
    """Rows seq, line: a table row of HTML for each of the first resources, all cells escaped; size says bytes."""
    d = res.orderBy("seq").limit(most)
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    safe = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    link = F.when((F.col("path") != "") & (F.col("state") == "ok"), F.concat(F.lit('<a href="../'), safe("path"), F.lit('">'), safe("path"), F.lit("</a>"))).otherwise(safe("note"))
    cells = F.concat(cell(safe("state")), cell(safe("code")), cell(safe("type")), cell(size(F.col("bytes").cast("long"))), cell(safe("url")), cell(link))
    return d.select("seq", F.concat(F.lit('<tr data-state="'), safe("state"), F.lit('">'), cells, F.lit("</tr>")).alias("line"))


def readme(res: DataFrame, host: str, size: Callable[[Column], Column] = bytes_human) -> DataFrame:
    """One row, text: what the copy holds, with lines that end in CR and LF; pages of scripts and notes where there are any; size says bytes."""
    made = F.count(F.when(F.expr("kind = 'page' and state = 'ok'") & is_dynamic(F.col("url")), 1))
    noted = F.array_sort(F.collect_set(F.when(F.col("note") != "", F.concat(F.lit(" - "), F.col("note")))))
    x = res.agg(_n("kind = 'page' and state = 'ok'").alias("pages"), _n("kind = 'asset' and state = 'ok'").alias("files"), _n("state = 'fail'").alias("failed"), _n("state = 'skip'").alias("skipped"), F.coalesce(F.sum(F.when(F.col("state") == "ok", F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), made.alias("made"), noted.alias("notes"))
    line = lambda name, c: F.concat(F.lit(name.ljust(18) + ": "), F.col(c).cast("string"))
    lines = F.array(F.lit("OFFLINE COPY OF " + host.upper()), F.lit(""), line("Pages (HTML)", "pages"), line("Other files", "files"), line("Failed", "failed"), line("Skipped", "skipped"), F.concat(F.lit("Total size".ljust(18) + ": "), size(F.col("bytes"))))
    scripts = F.when(F.col("made") > 0, F.array(F.lit(""), F.concat(F.col("made").cast("string"), F.lit(" page(s) came from scripts on the server and are kept as the HTML they gave.")))).otherwise(F.array())
    limits = F.when(F.size("notes") > 0, F.concat(F.array(F.lit(""), F.lit("NOTES")), F.col("notes"))).otherwise(F.array())
    return x.select(F.concat(F.array_join(F.concat(lines, scripts.cast("array<string>"), limits.cast("array<string>")), "\r\n"), F.lit("\r\n")).alias("text"))


def files(res: DataFrame) -> DataFrame:
    """Rows path, bytes, method of the files of the copy, each once: 8 to deflate, 0 to store what is small or compressed already."""
    d = res.where("state = 'ok' and path <> ''").groupBy("path").agg(F.max("bytes").cast("long").alias("bytes"))
    ext = extension(F.concat(F.lit("http://h/"), F.col("path")))
    return d.withColumn("method", F.when((F.col("bytes") > 1024) & ~ext.isin(*STORED), 8).otherwise(0))


def offsets(res: DataFrame) -> DataFrame:
    """The files with off: where each begins in an archive of stored files in order of path."""
    return running(files(res), "path", off=F.octet_length("path") + 30 + F.col("bytes"))


def targets(urls: DataFrame, res: DataFrame, missing: str | None = None) -> DataFrame:
    """Rows url, target: the file of each URL, or else the URL itself or missing."""
    found = urls.join(copied(res), "url", "left")
    return found.select("url", F.coalesce("path", F.lit(missing) if missing else F.col("url")).alias("target"))


def aliases(moved: DataFrame, res: DataFrame) -> DataFrame:
    """Rows url, path from redirects (url, final_url, path): both names of a file, the second where no resource has it."""
    new = moved.join(res.select(F.col("url").alias("final_url")), "final_url", "left_anti").select(F.col("final_url").alias("url"), "path")
    return moved.select("url", "path").unionByName(new)
