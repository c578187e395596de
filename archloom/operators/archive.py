"""ZIP archives from tables of files; sources.site_writer writes trees and many archives by tasks."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extensions that are stored, as they are compressed already, and limits of the format.
STORED = "jpg jpeg png gif webp avif ico mp3 mp4 webm ogg oga ogv m4a m4v mov avi mkv zip gz rar 7z woff woff2 pdf".split()
MOST_ENTRIES, MOST_BYTES = 65_000, 0xFFFF0000


def plan(files: DataFrame) -> DataFrame:
    """Files (path, body) with clean names and their method: 8 for deflate, 0 for store."""
    name = F.array_join(F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda s: ~s.isin("", ".", "..")), "/")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.select(name.alias("path"), "body", F.when((F.octet_length("body") > 1024) & ~ext.isin(*STORED), 8).otherwise(0).alias("method"))


def pack(files: DataFrame, target: str) -> int:
    """Write files to one ZIP in order of name, and return how many.

    One archive is one stream of bytes, so it is written by the driver; rows come one partition at
    a time. For a site beyond one archive, or a large one, take sources.site_writer.write_archives.
    """
    n, size = 0, 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as out:
        for row in plan(files).orderBy("path").toLocalIterator(prefetchPartitions=True):
            n, size = n + 1, size + len(row.body)
            if n > MOST_ENTRIES or size > MOST_BYTES:
                raise ValueError("beyond the limits of one archive")
            out.writestr(row.path, bytes(row.body), zipfile.ZIP_DEFLATED if row.method else zipfile.ZIP_STORED)
    return n
