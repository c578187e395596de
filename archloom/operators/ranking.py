"""Global ranks and running sums without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archloom.sources.shared import kept


def running(df: DataFrame, key: str, **sums: Column) -> DataFrame:
    """df with, for each named value, its sum over all rows before in order of key (unique).

    Rows are range-partitioned by key and checkpointed, so that both uses see the same partitions;
    each partition sums its own rows, and the totals of the partitions before, one row each, are
    added.
    """
    d = kept(df.repartitionByRange(F.col(key)).withColumns({"__part": F.spark_partition_id(), **{f"__{n}": v.cast("long") for n, v in sums.items()}}))
    own = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("__part").agg(*(F.sum(f"__{n}").alias(f"__all_{n}") for n in sums))
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__all_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums))
    # One row per shuffle partition.
    out = d.join(F.broadcast(totals), "__part")
    out = out.withColumns({n: F.coalesce(F.sum(f"__{n}").over(own), F.lit(0)) + F.col(f"__before_{n}") for n in sums})
    return out.select(*df.columns, *sums)


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the 1-based rank of each row in order of key (unique)."""
    return running(df, key, **{name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def running_by(df: DataFrame, group: str, key: str, **sums: Column) -> DataFrame:
    """df with, for each named value, its sum over the rows of the same group before in order of key (unique in a group).

    Ranges of (group, key) are summed as in running(), so a group is not a task; what lies before a
    group's first row, one row a group, is taken off.
    """
    d = running(df.withColumn("__order", F.struct(group, key)), "__order", **sums)
    first = d.groupBy(group).agg(*(F.min_by(n, "__order").alias(f"__first_{n}") for n in sums)).withColumnRenamed(group, "__group")
    out = d.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return out.select(*df.columns, *((F.col(n) - F.col(f"__first_{n}")).alias(n) for n in sums))
