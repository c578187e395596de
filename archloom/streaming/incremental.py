"""Resumable runs: Structured Streaming over files, one bounded tick per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archloom.sources.shared import shared_dir


def tick(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], mode: str = "append", files_per_tick: int = 1, name: str | None = None) -> DataFrame:
    """Run a stream over the files of path until all are read, and return what it gave.

    The checkpoint in the shared folder holds the cursor and the state: a run of the same name goes
    on where the last one ended. Append results are Parquet; complete results replace each other
    batch by batch.
    """
    at = f"{shared_dir(spark)}/streams/{name or uuid.uuid4().hex}"
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_tick).parquet(path))
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/out"))
    writer.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
