"""Exact duplicates through a log-structured merge index, with DataFrame functions only.

Memtables are hash-numbered batches of documents. Each flushes one run: Parquet files of
(digest, id, rank, copies), sorted by digest and carrying a Bloom filter on it, so a later
look-up of one digest skips files. Compaction merges runs, a few at a time and level by level,
and keeps for each digest only the entry of the best rank and smallest identifier, and how many
rows it stands for. A document whose digest stands for more than one row is a hit; its bytes are
compared with those of the entry kept. Digests under which unlike texts met (a collision) are
grouped anew by their whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, text_of, written

#: Documents of one memtable; the number of runs follows from it.
MEMTABLE_ROWS = 50_000
#: Runs merged in one step of compaction.
FAN_IN = 4
#: Rows of a group that one copy of the kept text is compared with.
VERIFY_ROWS = 64


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _best() -> Column:
    """Most code points first, then the smallest identifier; a null identifier comes last."""
    return F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))


def flush(docs: DataFrame, digest: Callable[[Column], Column], memtable_rows: int) -> tuple[DataFrame, int]:
    """Sorted digest runs of all documents, one a memtable, and their number.

    Repeated rows (same identifier, digest and length) become one entry with a count.
    """
    n_runs = max(1, -(-docs.count() // memtable_rows))
    entries = docs.select(
        F.pmod(F.xxhash64("id"), F.lit(n_runs)).cast("int").alias("run"),
        digest(F.col("normal")).alias("digest"),
        F.sha2("normal", 256).alias("text_sha256"),
        "id",
        F.char_length("original").cast("long").alias("n_points"),
    )
    runs = entries.groupBy("run", "digest", "text_sha256", "id", "n_points").agg(F.count("*").alias("copies"))
    runs = runs.sortWithinPartitions("run", "digest")
    return written(runs, "digest-runs", **{"parquet.bloom.filter.enabled#digest": "true"}), n_runs


def compact(runs: DataFrame, n_runs: int, fan_in: int) -> DataFrame:
    """Index entries (digest, keep_id, keep_points, group_size) after merging all runs."""
    level = runs.groupBy("run", "digest").agg(F.min(_best()).alias("best"), F.sum("copies").alias("group_size"))
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        level = level.groupBy((F.col("run") / fan_in).cast("int").alias("run"), "digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        level = written(level.sortWithinPartitions("run", "digest"), "digest-level", **{"parquet.bloom.filter.enabled#digest": "true"})
    index = level.groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return index.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), "group_size")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = _sha256,
    memtable_rows: int = MEMTABLE_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without ASCII white space; null counts as empty, so null,
    empty and blank texts are one group. Of a group the row with the most code points stays,
    then the one of the smallest identifier (null identifiers last). Rows that repeat identifier
    and text count as rows of the group; one of them is kept. An empty table gives no rows.
    Other columns of docs are not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("original"))
    docs = docs.withColumn("normal", F.regexp_replace("original", SPACE + "+", ""))
    runs, n_runs = flush(docs, digest, memtable_rows)
    index = compact(runs, n_runs, fan_in)
    found = written(runs.join(index, "digest"), "digest-found")

    hits = found.where("group_size > 1").groupBy("id", "digest").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    # The texts of hits alone: each text crosses the network once. An identifier may have several.
    texts = docs.select("id", "normal").join(hits, docs["id"].eqNullSafe(hits["id"])).drop(hits["id"])
    texts = written(texts.where(digest(F.col("normal")) == F.col("digest")), "digest-hits")
    salts = (F.col("group_size") / VERIFY_ROWS).cast("int") + 1
    kept = texts.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "group_size").agg(F.min("normal").alias("kept_text"))
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    compared = texts.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(kept.drop("group_size"), ["digest", "salt"])
    collided = written(compared.where(F.col("normal") != F.col("kept_text")).select("digest").distinct(), "digest-collided")

    columns = ["id", "keep_id", "keep_points", "group_size", "text_sha256", "copies", "n_points"]
    out = found.select(*columns)
    if not collided.isEmpty():
        again = docs.withColumn("digest", digest(F.col("normal"))).join(collided, "digest", "left_semi").withColumn("n_points", F.char_length("original").cast("long"))
        rows = again.groupBy("normal", "id", "n_points").agg(F.count("*").alias("copies"))
        groups = rows.groupBy("normal").agg(F.min(_best()).alias("best"), F.sum("copies").alias("group_size"))
        rest = rows.join(groups, "normal").select("id", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), "group_size", F.sha2("normal", 256).alias("text_sha256"), "copies", "n_points")
        out = found.join(collided, "digest", "left_anti").select(*columns).unionByName(rest)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
  FROM documents
), w AS (
  SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
         row_number() OVER g AS place, sha256(normal) AS text_sha256
  FROM d WINDOW g AS (PARTITION BY normal ORDER BY n_points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""
