"""Site trees and ZIP archives written by tasks, as a data source with commit and abort.

The folder must be one that driver and executors share as a file system. A file gets its name when it
is whole (a temporary name, then a rename), so a lost task leaves no half file and a repeated one
writes the same again. Of each archive stands a note beside it with the digest of what it holds; a run
over the same files writes only the archives whose note is missing or differs.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from archloom.operators.archive import MOST_BYTES, MOST_ENTRIES, plan
from archloom.operators.ranking import running

#: Bytes of the records that a ZIP keeps of an entry besides its name (twice) and its data.
_RECORDS = 30 + 46


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: files or archives, and entries and bytes in them."""

    names: list[str] = field(default_factory=list)
    entries: int = 0
    bytes: int = 0


def _place(root: str, name: str) -> str:
    at = os.path.normpath(os.path.join(root, name))
    if not at.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"{name} lies outside the folder")
    return at


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["path"], options.get("kind", "tree")
        self.stem, self.run = options.get("stem", "site"), uuid.uuid4().hex
        os.makedirs(os.path.join(self.root, f".part-{self.run}"), exist_ok=True)

    def _whole(self, at: str, name: str) -> None:
        """Give a finished file its name."""
        target = _place(self.root, name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(at, target)

    def _part(self) -> str:
        return os.path.join(self.root, f".part-{self.run}", uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Written:
        return self._archives(iterator) if self.kind == "zip" else self._tree(iterator)

    def _tree(self, rows: Iterator[Row]) -> Written:
        told = Written()
        for row in rows:
            at = self._part()
            with open(at, "wb") as out:
                out.write(row.body or b"")
            self._whole(at, row.path)
            told.entries, told.bytes = told.entries + 1, told.bytes + len(row.body or b"")
        return told

    def _archives(self, rows: Iterator[Row]) -> Written:
        """One archive after the other, as rows come in order of archive and path."""
        told, out, at, row = Written(), None, "", None

        def close() -> None:
            entries, size = len(out.filelist), sum(i.file_size for i in out.filelist)
            out.close()
            name = f"{self.stem}-{row_archive:04d}"
            self._whole(at, f"{name}.zip")
            note = self._part()
            with open(note, "w") as f:
                json.dump({"archive": row_archive, "digest": row_digest, "entries": entries, "bytes": size}, f)
            self._whole(note, f"notes/{name}.json")
            told.names.append(name)
            told.entries, told.bytes = told.entries + entries, told.bytes + size

        row_archive, row_digest = -1, ""
        for row in rows:
            if row.archive != row_archive:
                if out is not None:
                    close()
                row_archive, row_digest, at = row.archive, row.digest, self._part()
                out = zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED, compresslevel=6)
            # A fixed time, so that the same files give the same archive.
            out.writestr(zipfile.ZipInfo(row.path), bytes(row.body or b""), zipfile.ZIP_DEFLATED if row.method else zipfile.ZIP_STORED)
        if out is not None:
            close()
        return told

    def _swept(self) -> None:
        folder = os.path.join(self.root, f".part-{self.run}")
        for name in os.listdir(folder):
            os.unlink(os.path.join(folder, name))
        os.rmdir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        self._swept()
        told = [m for m in messages if m is not None]
        at = self.root + f"/.{self.stem}-{uuid.uuid4().hex}"
        with open(at, "w") as f:
            json.dump({"archives": sorted(n for m in told for n in m.names), "entries": sum(m.entries for m in told), "bytes": sum(m.bytes for m in told)}, f)
        os.replace(at, os.path.join(self.root, f"{self.stem}.written.json"))

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files stay, as a later run goes on from them; parts go."""
        self._swept()


class SiteSink(DataSource):
    """Format archloom_site: options path, kind (tree or zip) and stem (name of archives)."""

    @classmethod
    def name(cls) -> str:
        return "archloom_site"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def write_tree(files: DataFrame, folder: str) -> dict:
    """Write files (path, body) below a folder, each by the task that has it; what was written: entries, bytes.

    Names are cleaned as those of archives are, so none leaves the folder; of files of one name one
    is written. A null body is an empty file.
    """
    files.sparkSession.dataSource.register(SiteSink)
    plan(files).dropDuplicates(["path"]).select("path", "body").write.format("archloom_site").option("path", folder).mode("append").save()
    return _told(folder, "site")


def archives(files: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows path, body, method, archive, digest: files (path, body) dealt over archives in order of name.

    Running sums over ranges of names cut the order wherever entries or bytes reach a bound; the
    bound of bytes leaves room for the largest file. The digest tells an archive's content.
    """
    d = plan(files).dropDuplicates(["path"])
    heads = d.select("path", F.sha1(F.coalesce("body", F.lit(b""))).alias("sha"), (F.coalesce(F.octet_length("body"), F.lit(0)) + 2 * F.octet_length("path") + _RECORDS).cast("long").alias("size"))
    largest = heads.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    if 2 * largest > most_bytes:
        raise ValueError(f"a file of {largest} bytes is beyond half an archive")
    cut = running(heads, "path", n=F.lit(1), used=F.col("size"))
    cut = cut.withColumn("group", F.struct(F.floor(F.col("used") / (most_bytes - largest)).alias("b"), F.floor(F.col("n") / most_entries).alias("e")))
    # One row an archive.
    named = cut.groupBy("group").agg(F.sha1(F.to_json(F.array_sort(F.collect_list(F.struct("path", "sha"))))).alias("digest")).withColumn("archive", F.row_number().over(Window.orderBy("group")))
    return d.join(cut.join(named, "group").select("path", "archive", "digest"), "path").select("path", "body", "method", "archive", "digest")


def write_archives(files: DataFrame, folder: str, stem: str = "site", most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> dict:
    """Write files (path, body) to as many archives as the limits ask for, each by one task; what this run wrote.

    Archives of the same content that an earlier run finished are left as they are.
    """
    spark = files.sparkSession
    spark.dataSource.register(SiteSink)
    d = archives(files, most_entries, most_bytes)
    notes = os.path.join(folder, "notes")
    if os.path.isdir(notes) and any(n.startswith(f"{stem}-") for n in os.listdir(notes)):
        done = spark.read.schema("archive int, digest string").json(f"{notes}/{stem}-*.json")
        d = d.join(done, ["archive", "digest"], "left_anti")
    dealt = d.repartition("archive").sortWithinPartitions("archive", "path")
    dealt.select("path", "body", "method", "archive", "digest").write.format("archloom_site").options(path=folder, kind="zip", stem=stem).mode("append").save()
    return _told(folder, stem)


def _told(folder: str, stem: str) -> dict:
    with open(os.path.join(folder, f"{stem}.written.json")) as f:
        return json.load(f)
