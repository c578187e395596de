"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenized whole; those longer than a sequence are cut so that only their first piece
is short. Pieces go to shards of bounded size by a hash; each shard packs its pieces by best fit
and then moves pieces between bins that are not full, or exchanges one for one or two for one,
where that raises the sum of squared fills, until bins empty or no step helps. What lies in bins
still far from full then meets in fewer shards for a second round.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of, written

CAPACITY, END_ID = 2048, 0
#: Pieces of a shard at the mean.
SHARD_PIECES = 20_000
#: Bins filled to this share or more are left as they are in the second round.
FULL_ENOUGH = 0.995
#: Distinct words whose ids a worker remembers.
REMEMBERED = 800_000

class Ids:
    """Token ids as little-endian bytes, by the tokenizers library.

    A blank alone between two other characters always starts a pre-token, and a line end alone is
    one, as are each of two. So the text between them is encoded on its own and remembered. A text
    with other white space around its blanks or line ends is encoded whole; that is seen from its
    words, of which only those not yet remembered are looked at.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.after_blank: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.line_end = self.encode(["\n"])[0]
        vocabulary = self.tokenizer.get_vocab()
        #: Ids of the tokens that begin with a blank, in byte-level spelling.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[k for w, k in vocabulary.items() if w.startswith("\u0120")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def encode_words(self, words: list[str], at_once: int = 500) -> list[bytes]:
        """The ids of words after a blank each, many in one text; a token with a blank begins a word."""
        groups = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        out: list[bytes] = []
        for group, got in zip(groups, self.encode(["".join([" " + w for w in g]) for g in groups])):
            at = 4 * np.flatnonzero(self.begins[np.frombuffer(got, "<u4")])
            if len(at) != len(group):
                out += self.encode([" " + w for w in group])
            else:
                cuts = [*at.tolist(), len(got)]
                out += [got[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def remember(self, known: dict[str, bytes], fresh: list[str], encode: Callable[[list[str]], list[bytes]]) -> Callable[[str], bytes]:
        """The ids of words, those known and those that encode gives for the fresh ones."""
        ids = dict(zip(fresh, encode(fresh)))
        room = max(0, REMEMBERED - len(known))
        known.update(ids if len(ids) <= room else zip(fresh[:room], map(ids.__getitem__, fresh[:room])))
        if len(ids) <= room:
            return known.__getitem__
        return lambda w: known[w] if w in known else ids[w]

    def all(self, texts: list[str]) -> list[bytes]:
        lines = [[] if "\n\n\n" in t or t.endswith("\n\n") else [x.split(" ") for x in t.split("\n")] for t in texts]
        starts, words = set(), set()
        for t in lines:
            for x in t:
                starts.add(x[0])
                words.update(x[1:])
        starts -= self.at_start.keys()
        words -= self.after_blank.keys()
        odd = {w for w in words if not w or w[0].isspace() or w[-1].isspace() or "<|" in w}
        odd_start = {w for w in starts if w and (w[0].isspace() or w[-1].isspace() or "<|" in w)}
        for k, t in enumerate(lines):
            # A line that begins with a blank has an empty first word before others.
            if any(not x[0] and len(x) > 1 for x in t) or odd and any(not odd.isdisjoint(x[1:]) for x in t) or odd_start and any(x[0] in odd_start for x in t):
                lines[k] = []
        start = self.remember(self.at_start, list(starts - odd_start), self.encode)
        after = self.remember(self.after_blank, list(words - odd), self.encode_words)
        whole = iter(self.encode([t for x, t in zip(lines, texts) if not x]))
        return [self.line_end.join([start(x[0]) + b"".join(map(after, x[1:])) for x in t]) if t else next(whole) for t in lines]


_ids: dict[str, Ids] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None) -> DataFrame:
    """Columns id, row, piece, start, length, ids_crc32, one row per piece; row tells repeated rows apart."""
    d = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    id_type = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path or tokenizer_path()
        ids = _ids.setdefault(at, Ids(at)) if at not in _ids else _ids[at]
        end = np.array([END_ID], "<u4").tobytes()
        for b in slices(batches, 2048):
            rows: list[tuple] = []
            for k, got in enumerate(ids.all(b.column("text").to_pylist())):
                got += end
                n = len(got) // 4
                start, piece = 0, 0
                length = n % capacity or capacity
                while start < n:
                    rows.append((k, piece, start, length, zlib.crc32(got[4 * start : 4 * (start + length)])))
                    start, piece, length = start + length, piece + 1, capacity
            k, *rest = (np.array(x, np.int64) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(k)), b.column("row").take(pa.array(k)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], ["id", "row", "piece", "start", "length", "ids_crc32"])

    return d.mapInArrow(run, f"id {id_type}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some bin has, in order
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect_left(rooms, n)
        if k == len(rooms):
            room, at = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[k]
            at = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
        bins[at].append(int(i))
        room -= n
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(at)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search between bins with room; every step raises the sum of squared fills.

    The bins are taken fullest first. Into each goes, of the bins less full than itself, the piece
    (a move), or the piece for one of its own (one for one), or the pair for one of its own (two for
    one) that fills it best. Pieces of each length are looked up by length, so a step costs about
    the number of lengths. A bin emptied is gone.
    """
    fill = [sum(int(lengths[i]) for i in b) for b in bins]
    order = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: (-fill[k], k))
    where: dict[int, list[tuple[int, int]]] = {}  # by length: (bin, item) in bins still open
    for k in reversed(order):  # the emptiest first, so the last is the fullest
        for i in bins[k]:
            where.setdefault(int(lengths[i]), []).append((k, i))
    owner = {i: k for k in order for i in bins[k]}
    done: set[int] = set()

    def take(n: int, but: int, least_full: int) -> tuple[int, int] | None:
        """A piece of length n in an open bin other than but with a fill under least_full."""
        found = where.get(n)
        while found and (owner.get(found[0][1]) != found[0][0] or found[0][0] in done):
            found.pop(0)
        for k, i in found or ():
            if k != but and k not in done and owner.get(i) == k and fill[k] < least_full:
                return k, i
        return None

    def move(i: int, source: int, target: int) -> None:
        bins[source].remove(i)
        bins[target].append(i)
        n = int(lengths[i])
        fill[source] -= n
        fill[target] += n
        owner[i] = target
        where.setdefault(n, []).append((target, i))

    for k in order:
        while bins[k] and fill[k] < capacity:
            room = capacity - fill[k]
            step = None
            sizes = sorted((n for n, x in where.items() if x), reverse=True)
            for n in sizes:  # a move that fits best
                if n <= room and (got := take(n, k, fill[k] + n)):
                    step = (n, [got], None)
                    break
            if not step or step[0] < room:
                own = {int(lengths[i]): i for i in bins[k]}
                for a, i in own.items():
                    # One for one: the other bin may end no fuller than this one was.
                    for n in range(min(capacity, a + room), a + (step[0] if step else 0), -1):
                        if n in where and (got := take(n, k, fill[k] + n - a)):
                            step = (n - a, [got], i)
                            break
                    if step and step[0] == room:
                        break
                    # Two for one, the pair from one bin or two, adding up to what fills this one.
                    want = a + room
                    for n in sizes:
                        if n <= want // 2:
                            break
                        if n < want and want - n in where and (x := take(n, k, fill[k])) and (y := take(want - n, k, fill[k])) and x[1] != y[1] and max(fill[x[0]], fill[y[0]]) + a <= fill[k]:
                            step = (room, [x, y], i)
                            break
                    if step and step[0] == room:
                        break
            if not step:
                break
            _, got, back = step
            for source, i in got:
                move(i, source, k)
            if back is not None:
                move(back, k, got[-1][0])
        done.add(k)
    return [b for b in bins if b]


def pack_shard(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it, and the bin's fill, for each piece of one shard."""
    lengths = np.asarray(lengths, np.int64)
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    bin_of, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, b in enumerate(bins):
        at = 0
        for i in sorted(b):
            bin_of[i], offset[i] = k, at
            at += int(lengths[i])
        fill[b] = at
    return bin_of, offset, fill


def _packed(p: DataFrame, n_pieces: int, shard_pieces: int, capacity: int, round_no: int) -> DataFrame:
    n_shards = max(1, -(-n_pieces // shard_pieces))
    p = p.withColumn("shard", F.pmod(F.xxhash64(F.lit(round_no), "row", "piece"), F.lit(n_shards)))
    schema = p.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ignore_index=True)
        bin_of, offset, fill = pack_shard(pdf["length"].to_numpy(), capacity)
        # Shard numbers and bins share one number: bins of a shard are fewer than 2 to the 31st.
        return pdf.assign(sequence_id=pdf["shard"] * (1 << 31) + bin_of, offset=offset, fill=fill)

    return p.groupBy("shard").applyInPandas(run, f"{schema}, sequence_id long, offset long, fill long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone. Repeated rows, and rows that share an identifier,
    are packed each on its own. An empty table gives no rows; other columns of docs are not read.
    """
    p = written(pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    full = p.where(F.col("length") == capacity)
    short = p.where(F.col("length") < capacity)
    first = written(_packed(short, short.count(), shard_pieces, capacity, 1), "packed")
    good = first.where(F.col("fill") >= FULL_ENOUGH * capacity)
    rest = first.where(F.col("fill") < FULL_ENOUGH * capacity).select(*p.columns)
    second = _packed(rest, rest.count(), shard_pieces, capacity, 2)
    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # Numbers of full pieces, and of either round, lie in ranges of their own.
    third = full.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    parts = [x.withColumn("sequence_id", 3 * F.col("sequence_id") + k).select(*columns) for k, x in enumerate((good, second, third))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("id", id_col)


def op5_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
