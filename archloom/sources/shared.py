"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset, as in local tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="archloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/archloom/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a step with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a step by a Parquet folder in the shared folder, which removed() takes away."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def removed(df: DataFrame) -> None:
    """Delete the folder of a result of stored() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


class Bucketed:
    """A table of rows dealt by a key over buckets of files, to which rows are added.

    Joins on the key read its buckets as they lie: only the other side is shuffled. Each addition
    writes one file a bucket.
    """

    def __init__(self, spark: SparkSession, key: str, schema: StructType, n: int = 0):
        self.spark, self.key, self.schema = spark, key, schema
        self.n = min(n or int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own limit
        self.name, self.path = f"archloom_{uuid.uuid4().hex}", new_folder(spark, "buckets")
        self.add(spark.createDataFrame([], schema))

    def add(self, df: DataFrame, dealt: bool = False) -> None:
        """Add rows; dealt tells that they lie in n partitions by the key already."""
        rows = df.select(*self.schema.names)
        rows = rows if dealt else rows.repartition(self.n, self.key)
        rows.write.format("parquet").bucketBy(self.n, self.key).sortBy(self.key).option("path", self.path).mode("append").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
