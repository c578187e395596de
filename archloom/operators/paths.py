"""Files for URLs: one each, twins shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archloom.functions.url import folder

#: A number as it is appended to a stem; of more digits than names can reach, none is read.
_NUMBER = "-([1-9][0-9]{0,17})$"


def assign(arrivals: DataFrame) -> DataFrame:
    """Columns seq, url, file from (seq, url, path, hash).

    The first arrival owns a path; one with the same content and directory shares the file; the others get the
    first free of -2, -3, ... in order of arrival. A suffixed name that is itself a natural path
    belongs to its natural owner and is not free. Names of unlike paths never meet otherwise, as a
    name tells its path and number.
    """
    stem, ext = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    name = lambda n: F.when(n == 1, F.col("path")).otherwise(F.concat(stem, F.lit("-"), n.cast("string"), ext))
    same = Window.partitionBy("path", "hash", folder(F.col("url"))).orderBy("seq")
    d = arrivals.withColumn("owner", F.first("seq").over(same))
    owners = d.where("owner = seq").select("seq", "path", F.row_number().over(Window.partitionBy("path").orderBy("seq")).cast("long").alias("n"))
    # The numbers that natural paths take, by the path they would number.
    taken = arrivals.select("path").distinct().select(F.col("path").alias("natural"), F.concat(F.regexp_replace(stem, _NUMBER, ""), ext).alias("path"), F.regexp_extract(stem, _NUMBER, 1).try_cast("long").alias("m"))
    taken = taken.where((F.col("m") > 1) & (name(F.col("m")) == F.col("natural")))
    # The content from which on names lie beyond the taken number: one more than the free names below it, path included.
    beyond = F.col("m") - F.row_number().over(Window.partitionBy("path").orderBy("m")) + 1
    both = taken.select(F.lit(None).cast(owners.schema["seq"].dataType).alias("seq"), "path", beyond.alias("n"), F.lit(1).alias("taken")).unionByName(owners.where("n > 1").withColumn("taken", F.lit(0)))
    passed = F.sum("taken").over(Window.partitionBy("path").orderBy("n", F.desc("taken")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = both.withColumn("passed", passed).where("taken = 0").select("seq", "path", (F.col("n") + F.col("passed")).alias("n"))
    files = owners.where("n = 1").unionByName(later).select(F.col("seq").alias("owner"), name(F.col("n")).alias("file"))
    return d.join(files, "owner").select("seq", "url", "file")
