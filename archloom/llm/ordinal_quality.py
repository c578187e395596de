"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > k) = sigmoid(w . x - threshold_k), with one weight vector w for all grades and ordered
thresholds. x holds, for each distinct lower-cased word, its hashed bucket, and a few shares of character kinds. Words
whose presence does not depend on the grade in the labelled rows get no weight. The grades of a document are 0 for
poor, 1 for readable but toxic and 2 for readable and clean; P(grade > 1) selects.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

BUCKETS = 1 << 18
#: Labelled rows that the fit uses at most, the first in the order of a hash of their identifiers.
MOST_LABELLED = 6_000
#: Share of the labelled rows held out: those whose crc32 of the identifier leaves 1 when divided by 5.
FOLDS, HELD_OUT = 5, 1
GRADES = 3
#: Standard deviations from chance, and factor of chance, at which a word is used. The factor
#: leaves out words that are only more frequent in the longer texts of a grade.
LEAST_FACTOR = 3.0
LEAST_Z = 4.0
#: P(grade > 1) from which a document is kept.
LEAST_TAIL = 0.7
_DENSE = 6
_MARKS = b".,;:!?'\"()"
_KINDS = tuple(re.compile(p) for p in (r"[#*$%&|<>]", r"[A-Z]", r"[0-9]", r"[!?]", r"\|"))


def featurize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values of one whole text, words without their outer marks; the last buckets are the shares of character kinds."""
    words = {w.strip(_MARKS) for w in text.encode("utf-8", "replace").lower().split()}
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    where = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
    value = np.ones(len(words))
    dense = [1.0, *(min(2.0, 20 * len(k.findall(text)) / len(text)) for k in _KINDS)]
    return np.concatenate([where, np.arange(BUCKETS, BUCKETS + _DENSE)]), np.concatenate([value, dense]).astype(np.float32)


def screened(where: np.ndarray, grade: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Which features depend on the grade: their rows in some grade differ from chance by LEAST_Z."""
    share = present / present.sum()
    seen = np.bincount(where, minlength=BUCKETS + _DENSE)
    keep = np.zeros(BUCKETS + _DENSE, bool)
    for g in range(GRADES):
        expected = seen * share[g]
        found = np.bincount(where[grade == g], minlength=BUCKETS + _DENSE)
        z = (found - expected) / np.sqrt(expected * (1 - share[g]) + 1)
        keep |= (z >= LEAST_Z) & (found + 1 >= LEAST_FACTOR * (expected + 1))
    keep[BUCKETS:] = True
    return keep


def fit(indptr: np.ndarray, where: np.ndarray, value: np.ndarray, grade: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood.

    The step between thresholds is kept as a logarithm, so their order holds throughout. With no
    rows, all weights are 0.
    """
    w, start, gaps = np.zeros(BUCKETS + _DENSE), -0.5, np.zeros(GRADES - 2)
    theta = np.concatenate([w, [start], gaps])
    if not len(grade):
        return w, np.cumsum(np.concatenate([[start], np.exp(gaps)]))
    row = np.repeat(np.arange(len(grade)), np.diff(indptr))
    present = np.bincount(grade, minlength=GRADES)
    # A rare grade counts for more than its rows, though not for as much as a common one.
    weight = np.sqrt(len(grade) / np.maximum(present, 1))[grade]
    weight /= weight.sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    above = grade[:, None] > np.arange(GRADES - 1)
    telling = screened(where, grade[row], present)
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([[theta[-GRADES + 1]], np.exp(theta[len(theta) - GRADES + 2 :])]))
        score = np.bincount(row, value * theta[where], len(grade))
        # d/dz of the sum over cuts of the log-likelihood of being above or below each cut.
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
        slope = (p - above) * weight[:, None]
        g = np.zeros_like(theta)
        g[: BUCKETS + _DENSE] = np.bincount(where, value * slope.sum(1)[row], BUCKETS + _DENSE) + ridge * theta[: BUCKETS + _DENSE]
        g[: BUCKETS + _DENSE] *= telling
        down = -slope.sum(0)
        g[BUCKETS + _DENSE] = down.sum()
        for k in range(1, GRADES - 1):
            g[BUCKETS + _DENSE + k] = np.exp(theta[BUCKETS + _DENSE + k]) * down[k:].sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[: BUCKETS + _DENSE], np.cumsum(np.concatenate([[theta[BUCKETS + _DENSE]], np.exp(theta[BUCKETS + _DENSE + 1 :])]))


def _fold(column: str):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the bounded sample of labelled rows outside the held-out fold.

    Rows without a quality label are left out; a missing toxic label counts as not toxic.
    """
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    known = labels.where("quality is not null").where(~_fold(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.min(grade).alias("__grade"))
    # An order by a hash of the identifier, then by the identifier: the same rows each time.
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [featurize(t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__grade"), pa.array([w.astype("<i4").tobytes() for w, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], ["id", "grade", "w", "v"])

    id_type = texts.schema["__id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"id {id_type}, grade int, w binary, v binary").orderBy("id").toPandas()
    where = [np.frombuffer(x, "<i4") for x in rows.w]
    value = [np.frombuffer(x, "<f4") for x in rows.v]
    indptr = np.cumsum([0, *map(len, where)])
    return fit(indptr, np.concatenate([np.zeros(0, np.int32), *where]).astype(np.int64), np.concatenate([np.zeros(0, np.float32), *value]), rows.grade.to_numpy(dtype=np.int64))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """One row per document: id_col, held_out, expected_grade, p_above_0, p_above_1, kept.

    A null or blank text has no features: it gets the grade of the thresholds alone and is not
    kept. Without labelled rows every document gets the same grade. Repeated rows are rows of
    their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    weights, cuts = train(docs, labels, id_col, text_col)
    # Fixed size: the buckets.
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in slices(batches):
            out = np.zeros((b.num_rows, GRADES - 1))
            blank = np.zeros(b.num_rows, bool)
            for i, text in enumerate(b.column("text").to_pylist()):
                where, value = featurize(text)
                blank[i] = not len(where)
                out[i] = 1 / (1 + np.exp(-np.clip((w[where] * value).sum() - cuts, -30, 30)))
            grade = out.sum(1)
            kept = (out[:, -1] >= least_tail) & ~blank
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), *map(pa.array, (grade, out[:, 0], out[:, 1], kept))], ["id", "held_out", "expected_grade", "p_above_0", "p_above_1", "kept"])

    d = docs.select(F.col(id_col).alias("id"), _fold(id_col).alias("held_out"), text_of(text_col).alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, held_out boolean, expected_grade double, p_above_0 double, p_above_1 double, kept boolean"
    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
