"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.sources.shared import shared_dir

#: The six ASCII white-space bytes, as a character class for Java and RE2.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    The rows are then on shared storage, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/archloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a result of written() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that are written and no longer referred to."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or the other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(*names: str):
    """Names of helper columns that can't clash with columns of the caller."""
    return [f"__loom_{n}" for n in names]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def planes(x: np.ndarray, n_bytes: int) -> bytes:
    """Whole numbers by bytes of like weight, which sorted ones let the shuffle compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def numbers(parts: list[bytes], n_bytes: int) -> list[np.ndarray]:
    """The numbers of each part that planes() made."""
    out = []
    for p in parts:
        x = np.zeros((len(p) // n_bytes, 8), np.uint8)
        x[:, :n_bytes] = np.frombuffer(p, np.uint8).reshape(n_bytes, -1).T
        out.append(x.view("<u8").ravel())
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, whose high bytes are 0 and cost nothing; np.cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


#: Bytes that are hashed at once.
_BLOCK = 1 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(_BLOCK + 1, np.uint64)
_powers[1:] = np.cumprod(np.full(_BLOCK, ODD[0]))
_inverses = np.ones(_BLOCK + 1, np.uint64)
_inverses[1:] = np.cumprod(np.full(_BLOCK, np.uint64(pow(int(ODD[0]), -1, 1 << 64))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data, words being runs of bytes other than ASCII white space.

    The data is cut into blocks between words; a word that no block can hold is hashed apart.
    """
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        buf = np.frombuffer(data, np.uint8, min(_BLOCK, len(data) - at), at)
        space = _SPACE[buf]
        if at + len(buf) < len(data):
            ends = np.flatnonzero(space)
            if not len(ends):
                n = len(data[at:].split(None, 1)[0])
                hashes.append(np.frombuffer(hashlib.blake2b(data[at : at + n], digest_size=8).digest(), np.uint64))
                starts.append(np.array([at]))
                at += n
                continue
            buf, space = buf[: ends[-1] + 1], space[: ends[-1] + 1]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = np.concatenate([[0] if not space[0] else [], edge, [len(buf)] if not space[-1] else []]).astype(np.int64)
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _powers[: len(buf)], out=sums[1:])
        hashes.append((sums[last] - sums[first]) * _inverses[first])
        starts.append(first + at)
        at += len(buf)
    return np.concatenate(hashes), np.concatenate(starts)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the keys come from the left."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        on = one if on is None else on & one
    return left.join(right, on, how).drop(*(f"__right_{k}" for k in keys))


def text_key(column: str = "text") -> Column:
    """A hash that tells rows of one identifier apart by their texts; null counts as empty."""
    return F.xxhash64(text_of(column))


def rows_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, once: bool = False) -> DataFrame:
    """The rows of docs whose identifier and text hash are in keys (id, t); with once, one of rows that repeat both."""
    keyed = docs.withColumns({"__loom_id": F.col(id_col), "__loom_t": text_key(text_col)})
    keys = keys.select(F.col("id").alias("__loom_id"), F.col("t").alias("__loom_t"), *(c for c in keys.columns if c not in ("id", "t")))
    out = join_null_safe(keyed, keys, ["__loom_id", "__loom_t"])
    if once:
        out = out.dropDuplicates(["__loom_id", "__loom_t"])
    return out.drop("__loom_id", "__loom_t")
