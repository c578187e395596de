"""Line dedup by pairwise alignment.

Documents that share a run of lines with enough words overlap. Of the documents that hold a run,
the one of the smallest identifier is its first holder, and each later holder is paired with it.
So a run in m documents gives at most m - 1 pairs. The runs are the shortest ones from each line on
and up to each line; as every line of a common block lies in one of the block's, no block is left
without a pair. A pair is aligned by patience diff over line hashes, and the common blocks of
enough words are deleted from the later document. All pairs are judged on the texts as they came.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, join_null_safe, table, text_of, written

#: Words of a common block that is deleted.
LEAST_WORDS = 20


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two hash sequences, rising in both.

    Equal ends are matched first; then the lines found once in either part, in the longest run that
    rises in both, split the part, and the pieces between are treated alike. Parts without such
    lines are left unmatched beyond their equal ends.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: k for k, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        once = [(k, where[x]) for k, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]
        if not once:
            continue
        # The longest rising run of places in b, by the tops of patience piles.
        tops, at, back = [], [], [-1] * len(once)
        for k, (_, y) in enumerate(once):
            pile = bisect_left(tops, y)
            back[k] = at[pile - 1] if pile else -1
            tops[pile : pile + 1] = [y]
            at[pile : pile + 1] = [k]
        run, k = [], at[-1]
        while k >= 0:
            run.append(once[k])
            k = back[k]
        a2, b2 = a0, b0
        for x, y in reversed(run):
            found.append((x, y))
            todo.append((a2, x, b2, y))
            a2, b2 = x + 1, y + 1
        todo.append((a2, a1, b2, b1))
    return sorted(found)


def runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of at least least_words words, from each line on and up to each line.

    begin, end: where the document of each line begins and ends among the lines, none of which is blank.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    lines = np.arange(len(words))
    stop = np.searchsorted(total, total[:-1] + least_words)
    start = np.searchsorted(total, total[1:] - least_words, side="right") - 1
    on, up = stop <= end, start >= begin
    both = np.unique(np.stack([np.concatenate([lines[on], start[up]]), np.concatenate([stop[on], lines[up] + 1])]), axis=1)
    return both[0], both[1]


def run_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lines of each run, in order."""
    keys = np.ones(len(starts), np.uint64)
    for k in range(int((ends - starts).max(initial=0))):
        at = np.flatnonzero(starts + k < ends)
        x = (keys[at] ^ hashes[starts[at] + k]) * np.uint64(0x9E3779B97F4A7C15)
        keys[at] = x ^ (x >> np.uint64(32))
    return keys.view(np.int64)


def common_lines(first: list[int], later: list[int], words: list[int], least_words: int) -> list[int]:
    """Places in later of the lines in common blocks with at least least_words words.

    A block is a run of lines that follow each other in both documents, blank lines aside. The
    blocks that rise in both are aligned; those that do not, as they are repeated or in another
    order, are found by their shortest runs of enough words.
    """
    # Blank lines have no words and don't part blocks.
    keep_a = [k for k, x in enumerate(first) if x is not None]
    keep_b = [k for k, n in enumerate(words) if n]
    a, b, w = [first[k] for k in keep_a], [later[k] for k in keep_b], np.array([words[k] for k in keep_b], np.int64)
    pairs = patience(a, b)
    gone = np.zeros(len(b), bool)
    block: list[tuple[int, int]] = []
    for pair in [*pairs, (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            places = [y for _, y in block]
            if w[places].sum() >= least_words:
                gone[places] = True
            block = []
        block.append(pair)
    if not gone.all():
        starts, ends = runs(w, np.zeros(len(b), np.int64), np.full(len(b), len(b)), least_words)
        left = np.concatenate([[0], np.cumsum(~gone)])
        some = left[ends] > left[starts]
        starts, ends = starts[some], ends[some]
        for n in np.unique(ends - starts).tolist():
            in_a = set(zip(*(a[k:] for k in range(n))))
            for k in starts[ends - starts == n].tolist():
                if tuple(b[k : k + n]) in in_a:
                    gone[k : k + n] = True
    return [keep_b[k] for k in np.flatnonzero(gone)]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs with the text left, and n_lines, n_removed and n_partners.

    Lines are equal if they are so without outer ASCII white space; blank lines are never counted
    or deleted alone, and stay. A null text stays null; rows with a null identifier take no part.
    Rows that repeat an identifier are one document for pairing (the smallest of their texts) and
    lose the same lines only where their texts agree. Columns named as the three
    counts are replaced; every other column passes through. An empty table gives no rows.
    """
    trim = lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.split(text_col, "\n").alias("l"))
    d = d.select("id", "t", F.transform("l", lambda x: F.when(x.rlike(WORD), F.xxhash64(trim(x)))).alias("h"), F.transform("l", lambda x: F.regexp_count(x, F.lit(WORD))).alias("w"))
    lines = written(d.groupBy("id").agg(F.min_by(F.struct("t", "h", "w"), "t").alias("s")).select("id", "s.*"), "line-hashes")

    id_type = lines.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w = b.column("h").flatten(), b.column("w").flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), b.column("h").value_lengths().to_numpy(zero_copy_only=False))
            some = h.is_valid().to_numpy(zero_copy_only=False)
            hashes, doc = h.drop_null().to_numpy().view(np.uint64), doc[some]
            starts, ends = runs(w[some], np.searchsorted(doc, doc), np.searchsorted(doc, doc, side="right"), least_words)
            # Each run once a document.
            each = np.unique(np.stack([doc[starts], run_keys(hashes, starts, ends)]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(each[0])), pa.array(each[1])], ["id", "run"])

    held = lines.select("id", "h", "w").mapInArrow(keyed, f"id {id_type}, run long")
    # Written, so that the join can split a run that very many documents hold.
    holders = written(held.groupBy("run").agg(F.count("*").alias("holders"), F.min("id").alias("first")).where("holders > 1"), "first-holders")
    pairs = held.join(holders, "run").where(F.col("id") > F.col("first")).select("id", "first").distinct()

    later = lines.select("id", "h", "w")
    first = lines.select(F.col("id").alias("first"), F.col("h").alias("first_h"))
    both = pairs.join(later, "id").join(first, "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [common_lines(x, y, w, least_words) for x, y, w in zip(b.column("first_h").to_pylist(), b.column("h").to_pylist(), b.column("w").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.list_(pa.int32()))], ["id", "places"])

    aligned = both.select("id", "h", "w", "first_h").mapInArrow(run, f"id {id_type}, places array<int>")
    gone = aligned.where(F.size("places") > 0).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("__loom_gone"), F.count("*").alias("__loom_partners"))
    gone = gone.join(lines.select("id", F.col("t").alias("__loom_t")), "id").withColumnRenamed("id", id_col)
    out = join_null_safe(docs, gone, [id_col], "left")
    same = F.xxhash64(text_col) == F.col("__loom_t")
    out = out.withColumn("__loom_gone", F.when(same, F.col("__loom_gone")))
    kept = F.filter(F.split(text_col, "\n"), lambda x, k: ~F.array_contains("__loom_gone", k))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n")))
    # The three counts first, as they read the text that the last step replaces.
    out = out.withColumns({"n_lines": n_lines.cast("long"), "n_removed": F.when(F.col("__loom_gone").isNull(), 0).otherwise(F.size("__loom_gone")).cast("long"), "n_partners": F.when(F.col("__loom_gone").isNull(), 0).otherwise(F.col("__loom_partners")).cast("long")})
    out = out.withColumn(text_col, F.when(F.col("__loom_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return out.drop("__loom_gone", "__loom_partners", "__loom_t")


def op8_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and the hash of the text left of every document."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_partners", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2(text_of("text"), 256).alias("text_sha256"))
