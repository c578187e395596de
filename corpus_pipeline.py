"""Corpus pipeline: STAGES in order, each one training-data operator applied to what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents. Their results are written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.llm.common import table, written
from archloom.llm.divergence_rules import passing
from archloom.llm.patience_lines import line_dedup
from archloom.llm.shingle_join import one_of_each
from archloom.llm.source_mix import mixed
from archloom.llm.swap_packing import pack


def _documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars counted anew where the text may have changed."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the reference of their language."""
    return passing(docs).select(*docs.columns)


def line_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one has; those left without words go."""
    out = line_dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _documents(out, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram links hold together."""
    return one_of_each(docs).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _documents(mixed(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_blocks),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]

#: Packing counts tokens of a byte-pair vocabulary, which SQL can't; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
