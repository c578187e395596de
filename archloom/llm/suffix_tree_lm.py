"""LM scoring by a probabilistic suffix tree over words.

The root is the smoothed distribution of all training tokens. Below it stand contexts of one, two,
... tokens: one is counted if it occurs LEAST_CONTEXT times, and kept if its own suffix is and if
the distribution of its next tokens diverges from its suffix's by more than chance. Distributions
are smoothed into those of the suffix. A text is scored from the longest suffix kept at each place.

All least counts are absolute, so vocabulary and tree grow with the corpus; neither is gathered in
one place. Documents are dealt over batches and cut into tokens once. A batch sends its distinct
tokens and n-grams, sorted and with their counts, to buckets by hash, and gets back the counts over
all training documents where they differ from its own. The test of a context is a sum over the
n-grams that begin with it: of the batches that have an n-gram the first adds it, the others only ask
which contexts are kept. Tokens are counted first, then one level takes one pass, in rounds over the
buckets. Tokens and answers lie in tables dealt by batch, so each is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.sources.shared import Bucketed

from .common import ODD, forget, mixed, numbers, planes, steps, table, text_of, word_hashes, written

FOLDS, HELD_OUT = 5, 1
DEPTH = 3
#: Batches of a bucket of the table of texts.
BATCHES_TOGETHER = 4
#: Times that a context occurs, and that a next token does to be tested on its own.
LEAST_CONTEXT, LEAST_NEXT = 8, 2
#: Standard deviations above chance of the divergence of a context that is kept.
LEAST_DEVIATIONS = 4.0
#: Bytes of text of a batch, and entries of a bucket, at the mean.
BATCH_BYTES, BUCKET_ENTRIES = 8 << 20, 2_000_000
#: Hash of the end of a document, which also stands once before its first word.
END = np.uint64(0x5BD1E9955BD1E995)
#: Contexts that are tested at once.
_SLICE = 1 << 18
#: Rounds in which texts are dealt, and n-grams counted: only a share of them is in a shuffle at a time.
ROUNDS = 2
#: Bytes of the hash of a token, and of a count.
_TOKEN, _COUNT = 8, 6


def gram_bytes(n_bytes: int) -> int:
    """Bytes of the hash of an n-gram: so many that one by chance is known with a likelihood under 1 in 20,000."""
    return min(8, max(5, -(-(n_bytes // 6 * 20_000).bit_length() // 8)))


_COUNTS, _SUMS, _KEPT = range(3)
_SENT = {"bucket": pa.int64(), "batch": pa.int64(), "kind": pa.int32(), "level": pa.int32(), "g": pa.binary(), "n": pa.binary()}
_BACK = {k: _SENT[k] for k in ("batch", "kind", "level", "bucket")} | {"bits": pa.binary(), "n": pa.binary(), "first": pa.binary(), "tokens": pa.int64(), "distinct": pa.int64()}
_ZSTD = pa.Codec("zstd")


def _schema(columns: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[k]}" for c, k in columns.items())


def _table(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.Table:
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.table([pa.array(v, k) for v, k in zip(values, columns.values())], names=list(columns))


def _packed(t: pa.Table) -> pa.Table:
    """Binary columns compressed value by value, their lengths before them."""
    for i, f in enumerate(t.schema):
        if f.type == pa.binary():
            t = t.set_column(i, f, pa.array([len(x).to_bytes(8, "little") + _ZSTD.compress(x, asbytes=True) for x in t.column(i).to_pylist()], f.type))
    return t


def _unpacked(t: pa.Table) -> pa.Table:
    for i, f in enumerate(t.schema):
        if f.type == pa.binary():
            t = t.set_column(i, f, pa.array([_ZSTD.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in t.column(i).to_pylist()], f.type))
    return t


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the number of each element among them."""
    # Values whose low bits give way to their places sort faster than places by value.
    low = np.uint64((1 << max(len(x) - 1, 1).bit_length()) - 1)
    least, most = (x.min(), x.max()) if len(x) else (np.uint64(0), np.uint64(0))
    order = (x - least) << np.uint64(min(63, 64 - int(most - least).bit_length()))
    order &= ~low
    order |= np.arange(len(x), dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int64)
    sorted_x = x[order]
    if (sorted_x[1:] < sorted_x[:-1]).any():  # values that differ in the low bits alone
        order = np.argsort(x)
        sorted_x = x[order]
    new = np.append(True, sorted_x[1:] != sorted_x[:-1])[: len(x)]
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return sorted_x[new], number


def _cuts(g: np.ndarray, size: int, n_buckets: int) -> np.ndarray:
    """Where the sorted hashes of each bucket begin and end."""
    bucket = ((g >> np.uint64(8 * size - 32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(bucket, np.arange(n_buckets + 1))


def _chosen(bits: bytes, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))


def tokenised(t: pa.Table) -> pa.Table:
    """Texts of a batch as one row: documents, distinct tokens by hash and the number of each word among them."""
    texts = pc.cast(t.column("text"), pa.binary()).to_pylist()
    size, texts = np.array([len(x) + 1 for x in texts], np.int64), b"\n".join(texts)
    words, starts = word_hashes(texts.lower())
    del texts
    n = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)])))
    known, number = _distinct(np.append(mixed(words), END))
    whole = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
    lists = {"held_out": pa.array([t.column("held_out").to_pylist()], pa.list_(pa.bool_())), "n": whole(n)}
    return pa.table(lists | {"words": [planes(steps(known), _TOKEN)], "numbers": [planes(number[:-1].astype(np.uint64), 4)]})


class Batch:
    """Tokens of a batch of documents, and what its passes have learnt of them.

    Places run over all documents: an end, the words, an end. The first is a context alone.
    """

    def __init__(self, t: pa.Table, told: list[tuple[int, int, int, bytes, bytes, bytes]], root: tuple[int, int] | None, depth: int, width: int, n_buckets: int):
        """Of texts, or of the row that tokenised() makes of them."""
        self.width, self.n_buckets = width, n_buckets
        t = tokenised(t) if "text" in t.column_names else t
        n = np.array(t.column("n")[0].as_py(), np.int64)
        #: Distinct tokens, and the number of the token at each place.
        self.words = np.cumsum(numbers([t.column("words")[0].as_py()], _TOKEN)[0])
        self.begin = np.concatenate([[0], np.cumsum(n + 2)])
        inner = np.ones(self.begin[-1], bool)
        inner[self.begin[:-1]] = inner[self.begin[1:] - 1] = False
        self.number = np.full(len(inner), np.searchsorted(self.words, END), np.int32)
        self.number[inner] = numbers([t.column("numbers")[0].as_py()], 4)[0]
        self.token = self.words[self.number]
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
        self.place = np.arange(len(self.token), dtype=np.int32) - self.begin.astype(np.int32)[self.doc]
        self.train = ~np.array(t.column("held_out")[0].as_py(), bool)[self.doc] & (self.place > 0)
        self.told, self.depth = told, depth
        #: Of each level: the places of its n-grams and their numbers, the distinct ones, their counts here, and which are added here.
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.count: list[np.ndarray] = []
        self.root = root

    def level(self, k: int) -> np.ndarray:
        """Count over all training documents of the k + 1 tokens that end at each place; 0 where they are not counted."""
        last = k
        while len(self.count) <= last:
            j = len(self.count)
            at = np.flatnonzero(self.place > 0 if j == 0 else self.place >= j)
            if j:  # contexts that are rare have no children
                at = at[self.before(j)[at] >= LEAST_CONTEXT]
            if j == 0:
                known, number = self.words, self.number[at]
            else:
                known, number = _distinct(self.key(j + 1, at))
            own = np.bincount(number, self.train[at], len(known)).astype(np.int64)
            total, first = own.copy(), own > 0
            # Answers tell places in what was sent, which is found anew.
            cuts = _cuts(known, self.width if j else _TOKEN, self.n_buckets)
            for kind, level, k, bits, counts, mine in self.told:
                if kind == _COUNTS and level == j:
                    other = cuts[k] + _chosen(bits, cuts[k + 1] - cuts[k])
                    total[other] = numbers([counts], _COUNT)[0]
                    if j:
                        first[other] = np.unpackbits(np.frombuffer(mine, np.uint8), count=len(other))
            self.grams.append((at.astype(np.int32), number, known, own, first))
            here = np.zeros(len(self.token), np.int64)
            here[at] = total[number]
            self.count.append(here)
        return self.count[last]

    def before(self, k: int) -> np.ndarray:
        """Count of the context of k tokens before each place; that of the start is the number of documents."""
        out = np.zeros(len(self.token), np.int64)
        out[1:] = self.level(k - 1)[:-1]
        if k == 1:
            first = np.flatnonzero(self.place == 1)
            out[first] = self.level(0)[self.begin[self.doc[first] + 1] - 1]
        return out

    def key(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hash of the k tokens that end at each of these places."""
        g = self.token[at]
        for i in range(1, k):  # the token i places before
            g = mixed(g * ODD[i % 5] + self.token[at - i])
        return g >> np.uint64(64 - 8 * self.width)

    def chances(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token from the longest suffix of at most k tokens kept, and whether all k are."""
        n, v = self.root
        p = (self.level(0) + 0.5) / (n + 0.5 * (v + 1))
        kept = self.place > 0
        for j in range(1, k + 1):
            at, known, number = self.contexts(j, kept)
            cuts = _cuts(known, self.width, self.n_buckets)
            kinds = np.zeros(len(known))
            for kind, level, b, bits, x, _ in self.told:
                if kind == _KEPT and level == j:
                    kinds[cuts[b] + _chosen(bits, cuts[b + 1] - cuts[b])] = numbers([x], _COUNT)[0]
            kinds = kinds[number]
            hit = kinds > 0
            kept = np.zeros(len(p), bool)
            at, kind = at[hit], kinds[hit]
            kept[at] = True
            # The longer context holds its next tokens and, in the share of their kinds, what its suffix says.
            p[at] = (self.level(j)[at] + kind * p[at]) / (self.before(j)[at] + kind)
        return p, kept

    def contexts(self, k: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places after a frequent context of k tokens whose suffix is kept there; the distinct contexts, and the number of each place's."""
        at = np.flatnonzero(kept & (self.place >= k) & (self.before(k) >= LEAST_CONTEXT))
        # A context is an n-gram of the level before, numbered there; the start is the end before it.
        places, number, known, *_ = self.grams[k - 1]
        all_numbers = np.full(len(self.token), np.searchsorted(self.words, END) if k == 1 else 0, np.int32)
        all_numbers[places] = number
        number = all_numbers[at - 1]
        del all_numbers
        some = np.zeros(len(known), bool)
        some[number] = True
        known = known[some]
        return at, known >> np.uint64(64 - 8 * self.width) if k == 1 else known, (np.cumsum(some, dtype=np.int32) - 1)[number]

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of k tokens that may be kept, and parts of their sums over the n-grams that are added
        here: kinds of next tokens, of those frequent enough divergence and probability by the suffix, places of
        the rest, and kinds of those frequent enough; then the count."""
        p, kept = self.chances(k - 1)
        context = self.before(k)
        # Contexts without n-grams that are added here are asked for, and add nothing to the sums.
        at, known, number = self.contexts(k, kept)
        out = np.zeros((6, len(known)))
        out[5, number] = context[at]
        all_numbers = np.full(len(self.token), -1, np.int32)
        all_numbers[at] = number
        self.level(k)
        places, gram, grams, own, first = self.grams[k]
        # One place of each n-gram, whichever it is.
        one = np.zeros(len(grams), np.int32)
        one[gram] = places
        one = one[first & (own > 0)]
        one = one[all_numbers[one] >= 0]
        number = all_numbers[one]
        del all_numbers
        out[0] = np.bincount(number, minlength=len(known))
        n = self.level(k)[one].astype(float)
        often = n >= LEAST_NEXT
        out[3] = np.bincount(number[~often], n[~often], len(known))
        one, number, n = one[often], number[often], n[often]
        out[1] = np.bincount(number, n * np.log(n / (context[one] * p[one])), len(known))
        out[2] = np.bincount(number, p[one], len(known))
        out[4] = np.bincount(number, minlength=len(known))
        return known, out


def kept_contexts(sums: np.ndarray) -> np.ndarray:
    """Which contexts diverge from their suffixes by more than chance; a row of sums as Batch.sums gives them."""
    _, divergence, above, rest, freedom, total = sums
    rest, rest_above = rest / total, 1 - above
    some = (rest > 1e-12) & (rest_above > 1e-12)
    divergence = divergence + np.where(some, total * rest * np.log(np.where(some, rest, 1.0) / np.where(some, rest_above, 1.0)), 0.0)
    return (2 * divergence > freedom + LEAST_DEVIATIONS * np.sqrt(2 * freedom)) & (freedom > 0)


def _send(b: Batch, batch: int, done: int, part: int = 0, rounds: int = 1) -> Iterator[tuple]:
    """Rows of a round of a pass: sums of the last level counted, if it isn't the first, and counts of the next."""

    def deal(g: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        cuts = _cuts(g, size, b.n_buckets)
        return ((k, int(i), int(j)) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j and k % rounds == part)

    level = done + 1
    if level <= b.depth:
        b.level(level)
        _, _, g, own, _ = b.grams[level]
        size = b.width if level else _TOKEN
        yield from ((3 * k + min(level, 1), batch, _COUNTS, level, planes(steps(g[i:j]), size), planes(own[i:j], _COUNT)) for k, i, j in deal(g, size))
    if done > 0:
        g, sums = b.sums(done)
        yield from ((3 * k + 2, batch, _SUMS, done, planes(steps(g[i:j]), b.width), sums[:5, i:j].astype("<f4").tobytes() + planes(sums[5, i:j], _COUNT)) for k, i, j in deal(g, b.width))


def _meet(t: pa.Table, width: int) -> pa.Table:
    """Answers of a bucket to its batches: counts that differ from their own, and of these what they add to the
    sums, which the first batch with an n-gram does; or the contexts kept, and their kinds of next tokens."""
    t = t.sort_by("batch")  # parts of sums, in single precision, are added in this order, whichever came first
    kind, level = t.column("kind")[0].as_py(), t.column("level")[0].as_py()
    batches, bucket = t.column("batch").to_pylist(), t.column("bucket")[0].as_py() // 3
    each = [np.cumsum(x) for x in numbers(t.column("g").to_pylist(), width if level else _TOKEN)]
    known, number = _distinct(np.concatenate(each))
    rows, at = [], 0
    if kind == _COUNTS:
        own = [x.astype(np.int64) for x in numbers(t.column("n").to_pylist(), _COUNT)]
        some = np.concatenate(own)
        total = np.bincount(number, some, len(known)).astype(np.int64)
        has, first = np.flatnonzero(some)[::-1], np.zeros(len(number), bool)
        one = np.full(len(known), -1, np.int64)
        one[number[has]] = has  # the last that is set, so the first batch
        first[one[one >= 0]] = True
        for k, (batch, g, mine) in enumerate(zip(batches, each, own)):
            whole, adds = total[number[at : at + len(g)]], first[at : at + len(g)]
            at += len(g)
            other = whole != mine
            rows.append((batch, kind, level, bucket, np.packbits(other).tobytes(), planes(whole[other], _COUNT), np.packbits(adds[other]).tobytes() if level else b"", int(total.sum()) * (k == 0), int((total > 0).sum()) * (k == 0)))
        if level:
            rows = [(*r[:7], 0, 0) for r in rows]
        return _table(rows, _BACK)
    sent = list(zip(t.column("n").to_pylist(), each))
    sums = np.zeros((6, len(known)))
    for k in range(5):
        sums[k] = np.bincount(number, np.concatenate([np.frombuffer(x, "<f4", len(g), 4 * k * len(g)) for x, g in sent]), len(known))
    sums[5, number] = np.concatenate(numbers([x[20 * len(g) :] for x, g in sent], _COUNT))
    kept = np.concatenate([kept_contexts(sums[:, i : i + _SLICE]) for i in range(0, max(len(known), 1), _SLICE)])
    for batch, g in zip(batches, each):
        k = number[at : at + len(g)]
        at += len(g)
        some = kept[k]
        rows.append((batch, _KEPT, level, bucket, np.packbits(some).tobytes(), planes(sums[0][k][some].astype(np.int64), _COUNT), b"", 0, 0))
    return _table(rows, _BACK)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null, empty or blank text is its end alone. A null identifier hashes as the empty text.
    Repeated rows are rows of their own. Without training documents every word is unknown. An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT
    d = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), text_of(text_col).alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Documents are dealt over batches and cut into tokens once; each pass reads those where they lie.
    n_batches = max(12, n_bytes // BATCH_BYTES)
    d = d.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(n_batches)))

    def cut(t: pa.Table) -> pa.Table:
        ids = pa.ListArray.from_arrays([0, t.num_rows], t.column("id").combine_chunks())
        return _packed(tokenised(t)).add_column(0, "ids", ids).add_column(0, "batch", t.column("batch")[:1])

    row = f"batch long, ids array<{id_type}>, held_out array<boolean>, n array<long>, words binary, numbers binary"
    n_files = n_batches // BATCHES_TOGETHER
    tokens = Bucketed(spark, "batch", spark.createDataFrame([], row).schema, n_files)
    for part in range(ROUNDS):
        some = d.where(F.col("batch") % ROUNDS == part).repartition(n_files, "batch")
        tokens.add(some.groupBy("batch").applyInArrow(cut, row), dealt=True)
        forget(spark)
    d = tokens.read()
    n_buckets, width = max(12, n_bytes // 5 // BUCKET_ENTRIES), gram_bytes(n_bytes)

    def meet(t: pa.Table) -> pa.Table:
        return _packed(_meet(_unpacked(t), width))

    def batch_of(t: pa.Table, got: pa.Table, root: tuple[int, int] | None) -> Batch:
        got = _unpacked(got)
        told = list(zip(*(got.column(c).to_pylist() for c in ("kind", "level", "bucket", "bits", "n", "first"))))
        return Batch(_unpacked(t.drop_columns("ids")), told, root, depth, width, n_buckets)

    def sent(done: int, part: int, rounds: int, root: tuple[int, int] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def more(t: pa.Table, got: pa.Table) -> pa.Table:
            rows = _send(batch_of(t, got, root), t.column("batch")[0].as_py(), done, part, rounds) if t.num_rows else ()
            return _packed(_table(list(rows), _SENT))

        return more

    told = Bucketed(spark, "batch", spark.createDataFrame([], _schema(_BACK)).schema, n_files)
    root = None
    for done in range(-1, depth + 1):
        rounds = ROUNDS if 0 <= done < depth else 1
        for part in range(rounds):
            rows = d.groupBy("batch").cogroup(told.read().groupBy("batch")).applyInArrow(sent(done, part, rounds, root), _schema(_SENT))
            told.add(rows.groupBy("bucket").applyInArrow(meet, _schema(_BACK)))
            del rows
            forget(spark)
        if root is None:
            root = told.read().agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()[:]
    n, v = root

    columns = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(t: pa.Table, got: pa.Table) -> pa.Table:
        b = batch_of(t, got, (n, v))
        count, real = b.level(0), b.place > 0
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        p, _ = b.chances(depth)
        by = lambda x: pa.array(np.bincount(b.doc[real], x[real], len(b.begin) - 1))
        whole = lambda x: pc.cast(by(x), pa.int64())
        ids, held = (t.column(c).combine_chunks().flatten() for c in ("ids", "held_out"))
        return pa.table([ids, held, whole(np.ones(len(count))), whole(count > 0), pa.array(np.full(len(ids), n), pa.int64()), by(base), by(np.log10(p))], names=columns)

    out = d.groupBy("batch").cogroup(told.read().groupBy("batch")).applyInArrow(scored, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = written(out, "scores")
    told.drop()
    tokens.drop()
    return out.withColumnRenamed("id", id_col)


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
