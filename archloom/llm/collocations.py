"""Phrase collocations from word-id suffix arrays.

Documents are dealt once over shards and kept there as word numbers, with the shard's dictionary.
In a shard, prefix doubling ranks the suffixes of the word sequence; runs of suffixes that share
their first n words (LCP intervals) are the n-grams, and their lengths the counts. Counts are merged
over shards by key.

Most n-grams of a shard are rare everywhere, so their words don't travel: their key is a
hash, long enough that no two of the corpus are likely to share one. A shard sends the counts of its words and pairs to buckets of keys, which add them up and
tell it which of them are frequent; then those of n-grams all of whose pairs are. One of the shards
that sent a frequent n-gram is its speaker: it hears the whole count and gives the words. So what is
given out is one row a frequent n-gram, however many shards have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archloom.sources.shared import Bucketed

from .common import ODD, discard, forget, mixed, numbers, planes, steps, table, text_of, word_hashes, written

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Bytes of text of a shard, and hashes of a bucket, at the mean.
SHARD_BYTES, BUCKET_ENTRIES = 4 << 20, 1_000_000
#: Shards of a bucket of the table of shards.
SHARDS_TOGETHER = 4
#: Characters that end a piece of a text, all made line ends; the blank and the tab stay between words.
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_COUNT, _NUMBER, _TOTAL = 4, 4, 6
_SHARD = "shard long, seq binary, words binary, word_lang binary, langs array<string>, lang_words array<bigint>"
_SENT = "bucket long, shard long, round int, g binary, n binary"
_BACK = "shard long, round int, bucket long, often binary, speaks binary, totals binary"
_FOUND = "lang string, phrase string, n_words int, f long"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    s = _arrow(schema)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(s), s.types)], schema=s)


def lang_hash(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "<u8")[0]


def key_bytes(n_bytes: int) -> int:
    """Bytes of a key: so many that any two n-grams of a corpus share one with a likelihood under 1 in 1,000."""
    return max(5, -(-(2 * n_bytes.bit_length() + 9) // 8))


def _identity(word: np.ndarray, lang: np.ndarray, langs: list[str]) -> np.ndarray:
    """What tells a language's word from all others everywhere, from the hash of the word and the number of its language."""
    return mixed(word ^ np.array([lang_hash(x) for x in langs], np.uint64)[lang])


def deal(t: pa.Table) -> pa.Table:
    """A shard of documents as one row: word numbers from 1 with a 0 after each piece, and their dictionary.

    A word of two languages is two words.
    """
    langs = sorted(set(t.column("lang").to_pylist()))
    number = {x: k for k, x in enumerate(langs)}
    doc_lang = np.array([number[x] for x in t.column("lang").to_pylist()])
    texts = [x.lower().translate(_BREAKS) for x in pc.cast(t.column("text"), pa.binary()).to_pylist()]
    data = b"\n".join(texts)
    begin = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
    hashes, starts = word_hashes(data)
    lang = doc_lang[np.searchsorted(begin, starts, "right") - 1]
    h = _identity(hashes, lang, langs)
    _, first, number_of = np.unique(h, return_index=True, return_inverse=True)
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    ends = np.append(gaps, len(data))[np.searchsorted(gaps, starts[first])]
    words = b" ".join(data[i:j] for i, j in zip(starts[first].tolist(), ends.tolist()))
    piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
    last = np.append(piece[1:] != piece[:-1], True)[: len(piece)]
    seq = np.zeros(len(h) + int(last.sum()), np.int64)
    seq[np.arange(len(h)) + np.concatenate([[0], np.cumsum(last)])[: len(h)]] = number_of.ravel() + 1
    counts = np.bincount(lang, minlength=len(langs))
    row = (t.column("shard")[0].as_py(), planes(seq, _NUMBER), words, lang[first].astype("<u4").tobytes(), langs, counts)
    return _table([row], _SHARD)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense rank of each place by two keys."""
    a, b = keys
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].ravel().astype(np.int64)


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


class Shard:
    """Word numbers of a shard, its suffix array to MOST_WORDS words, and what buckets told of its n-grams."""

    def __init__(self, row: dict, told: list[tuple], width: int, n_buckets: int):
        self.shard, self.width, self.n_buckets, self.told = row["shard"], width, n_buckets, told
        self.seq = numbers([row["seq"]], _NUMBER)[0].astype(np.int64)
        self.words, self.langs = row["words"].split(b" ") if row["words"] else [], row["langs"]
        self.word_lang = np.frombuffer(row["word_lang"], "<u4")
        self.hash = np.concatenate([np.zeros(1, np.uint64), _identity(word_hashes(row["words"])[0], self.word_lang, self.langs)])
        # Words from each place to the end of its piece.
        at = np.arange(len(self.seq))
        stop = np.flatnonzero(self.seq == 0)
        self.left = stop[np.searchsorted(stop, at)] - at if len(stop) else at
        #: Rank of each suffix by its first 1, 2, 4 and 5 words; a piece's end is rank 0.
        self.rank = {1: self.seq}
        self.kept: dict[int, tuple[np.ndarray, ...]] = {}

    def doubled(self) -> None:
        r = self.rank
        if 2 not in r:
            r[2] = _ranks(r[1], _shift(r[1], 1))
            r[4] = _ranks(r[2], _shift(r[2], 2))
            r[5] = _ranks(r[4], _shift(r[1], 4))

    def grams(self, lengths: tuple[int, ...], far: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each length, one place of each distinct n-gram and its count; far: words that an n-gram may have at each place.

        Equal n-grams must have equal leave in far.
        """
        self.doubled()
        r = self.rank
        at = np.flatnonzero(far >= min(lengths))
        at = at[np.argsort(r[5][at], kind="stable")]  # the suffix array
        a, b = at[:-1], at[1:]
        same = {1: r[1][a] == r[1][b], 2: r[2][a] == r[2][b], 4: r[4][a] == r[4][b], 5: r[5][a] == r[5][b]}
        third = _shift(r[1], 2)
        same[3] = same[2] & (third[a] == third[b])
        for n in lengths:
            new = np.append(True, ~same[n])[: len(at)]  # where an interval of n common words begins
            edge = np.flatnonzero(new)
            size = np.diff(np.append(edge, len(at)))
            fits = far[at[edge]] >= n
            yield n, at[edge][fits], size[fits]

    def key(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of the n-gram at each place, the same in all shards: 8 bytes or less that order it, and those beyond 8."""
        g, more = self.hash[self.seq[at]], mixed(self.hash[self.seq[at]] * ODD[4])
        for k in range(1, n):
            word = self.hash[self.seq[at + k]]
            g, more = mixed(g * ODD[k % 5] + word), mixed(more + word * ODD[(k + 1) % 5])
        beyond = max(0, self.width - 8)
        return mixed(g + np.uint64(n)) >> np.uint64(64 - 8 * min(8, self.width)), more >> np.uint64(64 - 8 * beyond) if beyond else np.zeros(len(g), np.uint64)

    def distinct(self, round_: int) -> tuple[np.ndarray, ...]:
        """Length, place, key (two arrays) and count here of the distinct n-grams of a round, in order of key."""
        if round_ not in self.kept:
            found = [(np.full(len(at), n), at, *self.key(at, n), size) for n, at, size in self.grams(*self.asked(round_))]
            columns = [np.concatenate(x) for x in zip(*found)]
            order = np.argsort(columns[2], kind="stable")
            self.kept[round_] = tuple(x[order] for x in columns)
        return self.kept[round_]

    def cuts(self, g: np.ndarray) -> np.ndarray:
        top = g >> np.uint64(8 * min(8, self.width) - 32)
        return np.searchsorted((top * np.uint64(self.n_buckets) >> np.uint64(32)).astype(np.int64), np.arange(self.n_buckets + 1))

    def sent(self, round_: int) -> Iterator[tuple]:
        _, _, g, more, size = self.distinct(round_)
        c = self.cuts(g)
        for k, (i, j) in enumerate(zip(c[:-1].tolist(), c[1:].tolist())):
            if i < j:
                yield k, self.shard, round_, planes(steps(g[i:j]), min(8, self.width)) + planes(more[i:j], max(0, self.width - 8)), planes(size[i:j], _COUNT)

    def asked(self, round_: int) -> tuple[tuple[int, ...], np.ndarray]:
        """Lengths that a round counts, and how many words an n-gram may have at each place."""
        if round_ == 0:
            return (1, 2), np.minimum(self.left, 2)
        # Words from each place on whose pairs are all frequent.
        n, at, g, *_ = self.distinct(0)
        frequent = np.zeros(len(g), bool)
        for i, often, *_ in self.answers(0):
            frequent[i : i + len(often)] = often
        often = np.zeros(len(self.rank[2]) + 1, bool)
        often[self.rank[2][at[frequent & (n == 2)]]] = True
        pair = often[self.rank[2]] & (self.left >= 2)
        bad = np.flatnonzero(~pair)
        i = np.arange(len(pair))
        run = (np.append(bad, len(pair))[np.searchsorted(bad, i)] - i + 1) if len(pair) else i
        return tuple(range(3, MOST_WORDS + 1)), np.minimum(run, MOST_WORDS)

    def answers(self, round_: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
        """Of each bucket that answered: where its keys begin, which are frequent, which this shard speaks for, and their totals."""
        c = self.cuts(self.distinct(round_)[2])
        for r, bucket, often, speaks, totals in self.told:
            if r == round_:
                flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=c[bucket + 1] - c[bucket]).astype(bool) for x in (often, speaks)]
                yield c[bucket], *flags, totals

    def phrases(self) -> Iterator[tuple[str, str, int, int]]:
        for round_ in (0, 1):
            n, at, *_ = self.distinct(round_)
            for first, _, speaks, totals in self.answers(round_):
                mine = first + np.flatnonzero(speaks)
                for length, place, f in zip(n[mine].tolist(), at[mine].tolist(), numbers([totals], _TOTAL)[0].tolist()):
                    ids = self.seq[place : place + length] - 1
                    yield self.langs[self.word_lang[ids[0]]], b" ".join([self.words[k] for k in ids]).decode(), length, f


def _meet(least: int, width: int) -> Callable[[pa.Table], pa.Table]:
    def meet(t: pa.Table) -> pa.Table:
        """What a bucket tells each shard of the keys that it sent."""
        sent, high = t.column("g").to_pylist(), min(8, width)
        cut = np.cumsum([0] + [len(x) // width for x in sent])
        g = np.concatenate([np.cumsum(x) for x in numbers([x[: len(x) // width * high] for x in sent], high)])
        more = np.concatenate(numbers([x[len(x) // width * high :] for x in sent], width - 8)) if width > 8 else np.zeros(len(g), np.uint64)
        own = np.concatenate(numbers(t.column("n").to_pylist(), _COUNT)).astype(np.int64)
        order = np.lexsort((more, g))  # stable, so of each key the first shard's comes first
        g, more = g[order], more[order]
        edge = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (more[1:] != more[:-1])))
        total = np.add.reduceat(own[order], edge)
        often, speaks, whole = np.zeros(len(g), bool), np.zeros(len(g), bool), np.zeros(len(g), np.int64)
        frequent = total >= least
        often[order] = np.repeat(frequent, np.diff(np.append(edge, len(g))))
        speakers = order[edge[frequent]]
        speaks[speakers], whole[speakers] = True, total[frequent]
        rows = []
        for k, (shard, round_, bucket) in enumerate(zip(*(t.column(c).to_pylist() for c in ("shard", "round", "bucket")))):
            i, j = cut[k], cut[k + 1]
            if often[i:j].any():
                rows.append((shard, round_, bucket, np.packbits(often[i:j]).tobytes(), np.packbits(speaks[i:j]).tobytes(), planes(whole[i:j][speaks[i:j]], _TOTAL)))
        return _table(rows, _BACK)

    return meet


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows lang, phrase, n_words, f of all phrases of 1 to MOST_WORDS words that occur least times or more; rows lang, n of all words."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Repeated texts are dealt apart by their place in the scan, so that a shard has no more than its share.
    n_shards = max(12, n_bytes // shard_bytes)
    d = d.withColumn("shard", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(n_shards)))
    n_buckets = max(12, n_bytes // 4 // BUCKET_ENTRIES)
    # Texts are shuffled once; shards are read again without a shuffle, as they lie dealt by number.
    held = Bucketed(spark, "shard", StructType.fromDDL(_SHARD), n_shards // SHARDS_TOGETHER)
    held.add(d.repartition(held.n, "shard").groupBy("shard").applyInArrow(deal, _SHARD), dealt=True)
    forget(spark)
    shards, width = held.read(), key_bytes(n_bytes)
    n = shards.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                yield from _table(list(Shard(row, [], width, n_buckets).sent(0)), _SENT).to_batches()

    def with_told(step: Callable[[Shard], Iterator[tuple]], schema: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(t: pa.Table, told: pa.Table) -> pa.Table:
            if not t.num_rows:
                return _table([], schema)
            answers = list(zip(*(told.column(c).to_pylist() for c in ("round", "bucket", "often", "speaks", "totals"))))
            return _table(list(step(Shard(t.to_pylist()[0], answers, width, n_buckets))), schema)

        return run

    meet = _meet(least, width)
    told = written(shards.mapInArrow(first, _SENT).repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(meet, _BACK), "phrase-pairs")
    again = shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(with_told(lambda s: s.sent(1), _SENT), _SENT)
    more = written(again.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(meet, _BACK), "phrase-grams")
    both = told.unionByName(more)
    found = shards.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(with_told(Shard.phrases, _FOUND), _FOUND)
    counts, n = written(found, "phrase-counts"), written(n, "lang-words")
    for x in (told, more):
        discard(x)
    held.drop()
    return counts, n


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, cover: int = 100, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first top phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to MOST_WORDS words of one piece of a text, A-Z as a-z. a, l, r count it and the two
    parts of its lowest-scoring cut (the first among equals), n the language's words; score is
    floor(1000 * a * n / (l * r)), exact. A phrase goes if a longer one with it inside has cover per
    cent of its count or more. A null language is `und`, and joins a language of that name; null and
    empty texts have no words. Repeated rows all count. An empty table, or one without frequent
    phrases, gives no rows. Other columns are not read.
    """
    counts, n = phrase_counts(docs, lang_col, text_col, least, shard_bytes)
    c = counts.where("n_words > 1").withColumn("w", F.split("phrase", " "))
    inner = c.where("n_words > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, n_words - 1), k -> transform(sequence(1, n_words - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    c = c.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("f"), F.lit(True)))
    cut = c.select("lang", "phrase", F.col("f").alias("a"), F.posexplode(F.expr("transform(sequence(1, n_words - 1), k -> struct(array_join(slice(w, 1, k), ' ') as first, array_join(slice(w, k + 1, n_words), ' ') as rest))")).alias("k", "x")).select("lang", "phrase", "a", "k", "x.*")
    part = counts.select("lang", "phrase", "f")
    cut = cut.join(part.toDF("lang", "first", "l"), ["lang", "first"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"]).join(n, "lang")
    whole = lambda x, digits: F.col(x).cast(f"decimal({digits},0)")
    over, under = whole("a", 15) * whole("n", 16) * F.lit(1000).cast("decimal(4,0)"), whole("l", 15) * whole("r", 15)
    cut = cut.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), longer AS (
  SELECT lang, g[i : i + k - 1] AS g, max(f) AS longer FROM f, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE k < len(g) AND i + k - 1 <= len(g) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, p.f AS l, q.f AS r, n, (1000 * c.f::HUGEINT * n // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM f c LEFT JOIN longer o ON o.lang = c.lang AND o.g = c.g JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < len(c.g)
  JOIN f p ON p.lang = c.lang AND p.g = c.g[1 : k] JOIN f q ON q.lang = c.lang AND q.g = c.g[k + 1 :] JOIN total t ON t.lang = c.lang
  WHERE len(c.g) > 1 AND coalesce(100 * longer < 100 * c.f, true)
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER o AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM best WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) QUALIFY row_number() OVER o <= 2000
"""
