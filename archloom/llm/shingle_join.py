"""N-gram Jaccard join: links between documents whose sets of word n-grams are alike enough.

One global order puts the n-grams held by few documents first. To count holders, the tasks send
their n-grams as sorted arrays to buckets by range, and get back those that others hold too with
their counts; what no one else holds can't be shared, so it only takes its places in a set. Two sets
that link share an n-gram among the first of both; documents with equal sets are one class.

Sets that share one of their first n-grams are a group, and store their beginnings in a prefix tree.
It is walked level by level with the sets that lead: the overlap of a shared path is counted once, a
subtree is left when what may follow can't reach the bound, or when the pair belongs to the group of
an earlier n-gram. Pairs that come through are verified on whole sets. In the first round the first
set of each group leads, which brings together most of what links; then, in the groups that still lie
in several components, all sets outside the largest one lead. Only pairs in one component already are
left out, so no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, discard, forget, mixed, numbers, planes, rows_of, slices, table, text_key, text_of, word_hashes, written
from .components import components

WORDS, PERCENT = 5, 80
#: N-grams and documents of a batch that is sent to the buckets together, and n-grams of a bucket at the mean.
BATCH_GRAMS, BATCH_DOCS, BUCKET_GRAMS = 1 << 20, 1 << 16, 1_500_000
#: Bytes of text for each n-gram, about; it sets the number of buckets alone.
GRAM_BYTES = 6
#: Bits of an n-gram's hash in the global order, above which stands the number of its holders.
GRAM_BITS, MOST_HOLDERS = 48, (1 << 15) - 1
#: Rows of a part of a group, leaders that walk a tree at once, and pairs that are verified together.
GROUP_PART, LEADERS, CHUNK = 1024, 256, 256
#: First rounds, in which the head of each group leads alone and a set is verified with one leader.
SPROUTS = 1


def shingle_sets(texts: list[bytes], n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each whole text, end to end, and where each begins and ends.

    Words are told apart by their bytes, A-Z lower-cased. A shorter text is one n-gram; one without
    words has none.
    """
    h, start = word_hashes(b"\n".join(texts).lower())
    size = np.array([len(t) + 1 for t in texts], np.int64)
    edge = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
    first, n = edge[:-1], np.diff(edge)
    count = np.where(n >= n_words, n - n_words + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offsets[-1], np.uint64)
    for k in range(1, n_words + 1):  # texts of fewer words in turn, then all others
        docs = np.flatnonzero(n == k if k < n_words else n >= n_words)
        if not len(docs):
            continue
        to = np.repeat(offsets[docs] - np.concatenate([[0], np.cumsum(count[docs])[:-1]]), count[docs]) + np.arange(count[docs].sum())
        at = to - np.repeat(offsets[docs] - first[docs], count[docs])
        total = np.full(len(at), k, np.uint64)
        for i in range(k):
            total = mixed(total * ODD[i % 5] + h[at + i])
        out[to] = total
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out[i:j].sort()
    new = np.append(True, out[1:] != out[:-1])[: len(out)]
    new[offsets[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[offsets]


_SINGLE, _REPEATED, _HELD, _DOCS = range(4)
_GRAM, _DOC, _COUNT = GRAM_BITS // 8, 2, 4


def _rows(rows: list[tuple], first: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = [first, "batch", "kind", "a", "b", "c"]
    keep = [k for k, x in enumerate(names) if x]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) for k in keep], [names[k] for k in keep])


def _ordered(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int) -> DataFrame:
    """Per row: id, row, t, n, signature of the set, n-grams that no other document holds, how many of
    the others are among the first, and, if any is, all n-grams that others hold in the global order."""
    d = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_key(text_col).alias("t"), text_of(text_col).alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    n_bytes = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(12, n_bytes // GRAM_BYTES // BUCKET_GRAMS)
    shift = np.uint64(GRAM_BITS - 32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        n_grams = n_docs = 0

        def out() -> pa.RecordBatch:
            batch = (part << 32) | made
            about = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
            sizes = np.concatenate([x[2] for x in held])
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            key = np.sort((np.concatenate([x[1] for x in held]) >> np.uint64(64 - GRAM_BITS) << np.uint64(16)) | doc)
            gram, doc = key >> np.uint64(16), key & np.uint64(0xFFFF)
            new = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
            times = np.diff(np.append(new, len(gram)))
            single = np.repeat(times == 1, times)
            rows: list[tuple] = []
            for kind, g, x, size in ((_SINGLE, gram[single], doc[single], _DOC), (_REPEATED, gram[new[times > 1]], times[times > 1], _COUNT)):
                bucket = ((g >> shift) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rows += [(k, batch, kind, planes(g[i:j], _GRAM), planes(x[i:j], size), None) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
            # What comes back to the batch anyway takes its way over some bucket.
            rows.append((batch % n_buckets, batch, _HELD, planes(gram[~single], _GRAM), planes(doc[~single], _DOC), None))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema) as w:
                w.write_table(about)
            rows.append((batch % n_buckets, batch, _DOCS, sink.getvalue().to_pybytes(), None, None))
            return _rows(rows, "bucket")

        for b in slices(batches):
            grams, offsets = shingle_sets(pc.cast(b.column("text"), pa.binary()).to_pylist(), n_words)
            sizes = np.diff(offsets)
            marks = [hashlib.blake2b(grams[i:j], digest_size=16).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            about = pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("t"), pa.array(sizes), pa.array(marks, pa.binary())], ["id", "row", "t", "n", "signature"])
            held.append((about, grams, sizes))
            n_grams, n_docs = n_grams + len(grams), n_docs + len(sizes)
            if n_grams > BATCH_GRAMS or n_docs > BATCH_DOCS - 1024:
                yield out()
                held, n_grams, n_docs, made = [], 0, 0, made + 1
        if held:
            yield out()

    def meet(t: pa.Table) -> pa.Table:
        kind, batch = (np.array(t.column(c)) for c in ("kind", "batch"))
        a, b = (t.column(c).to_pylist() for c in ("a", "b"))
        sent = np.flatnonzero(kind < _HELD)
        grams = numbers([a[k] for k in sent], _GRAM)
        other = [numbers([b[k]], _DOC if kind[k] == _SINGLE else _COUNT)[0] for k in sent]
        every = np.concatenate([np.zeros(0, np.uint64), *grams])
        times = np.concatenate([np.zeros(0, np.int64), *(np.ones(len(x), np.int64) if kind[k] == _SINGLE else x.astype(np.int64) for k, x in zip(sent, other))])
        known, number = np.unique(every, return_inverse=True)
        holders = np.minimum(np.bincount(number, times, len(known)), MOST_HOLDERS).astype(np.uint64)[number]
        rows, at = [], 0
        for k, g, x in zip(sent, grams, other):
            c = holders[at : at + len(g)]
            at += len(g)
            some = c > 1
            if some.any():
                rows.append((0, int(batch[k]), int(kind[k]), planes(g[some], _GRAM), planes(x[some], _DOC) if kind[k] == _SINGLE else None, planes(c[some], _DOC)))
        rows += [(0, int(batch[k]), int(kind[k]), a[k], b[k], None) for k in np.flatnonzero(kind >= _HELD)]
        return pa.Table.from_batches([_rows(rows, "")])

    def order(t: pa.Table) -> pa.Table:
        kind = np.array(t.column("kind"))
        a, b, c = (t.column(x).to_pylist() for x in "abc")
        of = lambda which, column, size: np.concatenate([np.zeros(0, np.uint64), *numbers([column[k] for k in np.flatnonzero(kind == which)], size)])
        about = pa.ipc.open_stream(a[np.flatnonzero(kind == _DOCS)[0]]).read_all()
        gram, doc, holders = of(_SINGLE, a, _GRAM), of(_SINGLE, b, _DOC), of(_SINGLE, c, _DOC)
        g, h = of(_REPEATED, a, _GRAM), of(_REPEATED, c, _DOC)
        by = np.argsort(g)
        held, held_doc = of(_HELD, a, _GRAM), of(_HELD, b, _DOC)
        key = np.concatenate([holders << np.uint64(GRAM_BITS) | gram, (h[by][np.searchsorted(g[by], held)] << np.uint64(GRAM_BITS) | held) if len(held) else held])
        doc = np.concatenate([doc, held_doc]).astype(np.int64)
        by = np.lexsort((key, doc))
        key, doc = key[by].astype(np.int64), doc[by]
        n = np.array(about.column("n"))
        several = np.bincount(doc, minlength=len(n))
        lone = n - several
        # The first n-grams of a set of n meet those of any set that links with it.
        room = np.minimum(np.where(n > 0, n - -(-n * percent // 100) + 1, 0) - lone, several)
        keep = room > 0
        shared = key[keep[doc]]
        offsets = np.concatenate([[0], np.cumsum(np.where(keep, several, 0))])
        columns = [about.column(x) for x in ("id", "row", "t", "n", "signature")]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shared))
        return pa.Table.from_arrays([*columns, pa.array(lone), pa.array(np.maximum(room, 0)), lists], ["id", "row", "t", "n", "signature", "lone", "room", "shared"])

    plain = "batch long, kind int, a binary, b binary, c binary"
    sent = d.mapInArrow(send, f"bucket long, {plain}")
    met = sent.groupBy("bucket").applyInArrow(meet, plain)
    return met.groupBy("batch").applyInArrow(order, f"id {id_type}, row long, t long, n long, signature binary, lone long, room long, shared array<long>")


def may_link(n_a: np.ndarray, n_b: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n_a and n_b n-grams that share overlap of them link."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


class PrefixTree:
    """The first n-grams of sets in the global order, stored level by level as far as sets share a path.

    lists: sorted numbers of each set; n: size of the whole set; lone: n-grams before the first of
    the list that nobody shares. Sets lie in lexicographic order, so the sets below a node are a
    range; a node of one set keeps the rest of its list as it is.
    """

    def __init__(self, lists: list[np.ndarray], n: np.ndarray, lone: np.ndarray):
        self.order = np.array(sorted(range(len(lists)), key=lambda k: lists[k].astype(">i8").tobytes()), np.int64)
        self.n, self.lone = n[self.order], lone[self.order]
        self.length = np.array([len(lists[k]) for k in self.order], np.int64)
        self.values = np.concatenate([np.zeros(0, np.int64), *(lists[k] for k in self.order)])
        self.begin = np.cumsum(self.length) - self.length
        #: Of each level: parent in the level above, n-gram, range of sets, least and most n, least lone.
        self.levels: list[tuple[np.ndarray, ...]] = []
        above, at, d = np.zeros(len(lists), np.int64), np.arange(len(lists)), 0
        while len(at := at[self.length[at] > d]):
            gram = self.values[self.begin[at] + d]
            new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (above[at][1:] != above[at][:-1])))
            size = np.diff(np.append(new, len(at)))
            self.levels.append((above[at[new]], gram[new], at[new], at[new] + size, np.minimum.reduceat(self.n[at], new), np.maximum.reduceat(self.n[at], new), np.minimum.reduceat(self.lone[at], new)))
            above[at] = np.repeat(np.arange(len(new)), size)
            at, d = at[np.repeat(size > 1, size)], d + 1

    def candidates(self, token: int, lists: list[np.ndarray], n: np.ndarray, lone: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (leader, set) that may link and of which token is the first n-gram in common.

        The leaders walk the tree side by side; a pair (leader, node) goes on to the node's children
        while some set below may still reach the bound. The rest of a list that no other set shares
        is taken in one step.
        """
        size = np.array([len(x) for x in lists], np.int64)
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]))
        width = len(known) + 1
        begin = np.cumsum(size) - size
        own = np.concatenate([np.zeros(0, np.int64), *(k * width + np.searchsorted(known, x) for k, x in enumerate(lists))])
        last = np.array([x[-1] for x in lists], np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def look(x: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether each leader has the n-gram, and how many of its list come up to it."""
            at = np.searchsorted(known, gram)
            place = np.searchsorted(own, x * width + at)
            hit = (own[np.minimum(place, len(own) - 1)] == x * width + at) & (known[np.minimum(at, len(known) - 1)] == gram)
            return hit, place - begin[x] + hit

        def come(x: np.ndarray, y: np.ndarray, overlap: np.ndarray, left: np.ndarray, depth: np.ndarray) -> None:
            """Take the pairs that reach the bound with what may follow the first depth of y."""
            ok = may_link(n[x], self.n[y], overlap + np.minimum(self.n[y] - self.lone[y] - depth, left), percent)
            ok &= (100 * n[x] >= percent * self.n[y]) & (100 * self.n[y] >= percent * n[x])
            found.append((x[ok], self.order[y[ok]]))

        def each(x: np.ndarray, low: np.ndarray, high: np.ndarray, overlap: np.ndarray, left: np.ndarray, depth: int) -> None:
            times = high - low
            k = np.repeat(np.arange(len(x)), times)
            come(x[k], np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times) + low[k], overlap[k], left[k], np.full(len(k), depth))

        def rest(x: np.ndarray, y: np.ndarray, overlap: np.ndarray, depth: int) -> None:
            fit = (100 * n[x] >= percent * self.n[y]) & (100 * self.n[y] >= percent * n[x])
            x, y, overlap = x[fit], y[fit], overlap[fit]
            cuts = np.flatnonzero(np.diff((np.cumsum(self.length[y] - depth) >> 20), prepend=-1)) if len(y) else []
            for i, j in zip(cuts, [*cuts[1:], len(y)]):
                xs, ys = x[i:j], y[i:j]
                times = self.length[ys] - depth
                k = np.repeat(np.arange(len(ys)), times)
                gram = self.values[np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times) + (self.begin[ys] + depth)[k]]
                inside = gram <= last[xs[k]]
                hit = look(xs[k], gram)[0] & inside
                early = np.bincount(k[hit & (gram < token)], minlength=len(ys)) == 0
                taken = np.bincount(k[inside], minlength=len(ys))
                end = self.values[self.begin[ys] + self.length[ys] - 1]
                left = n[xs] - lone[xs] - np.where(taken < times, size[xs], look(xs, np.minimum(end, last[xs]))[1])
                come(xs[early], ys[early], (overlap[i:j] + np.bincount(k[hit], minlength=len(ys)))[early], left[early], (depth + taken)[early])

        x, node, overlap = np.arange(len(lists)), np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
        for d, (parent, gram, low, high, least, most, alone) in enumerate(self.levels):
            a, z = (np.searchsorted(parent, node, side) for side in ("left", "right"))
            k = np.repeat(np.arange(len(node)), z - a)
            node = np.arange(len(k)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[k]
            x, overlap = x[k], overlap[k]
            one = high[node] - low[node] == 1
            rest(x[one], low[node[one]], overlap[one], d)
            x, node, overlap = x[~one], node[~one], overlap[~one]
            # Beyond a leader's list it is unknown what it has, so its pairs end here.
            over = gram[node] > last[x]
            each(x[over], low[node[over]], high[node[over]], overlap[over], (n - lone - size)[x[over]], d)
            x, node, overlap = x[~over], node[~over], overlap[~over]
            hit, place = look(x, gram[node])
            overlap, left = overlap + hit, n[x] - lone[x] - place
            # The size of the sets below at which what may follow weighs most against the bound.
            best = np.clip(left + alone[node] + d + 1, least[node], most[node])
            go = may_link(n[x], best, overlap + np.minimum(best - alone[node] - d - 1, left), percent) & ~(hit & (gram[node] < token))
            x, node, overlap, left = x[go], node[go], overlap[go], left[go]
            if not len(node):
                break
            # Sets whose list ends at the node stand first in its range.
            ended = np.concatenate([[0], np.cumsum(self.length <= d + 1)])
            each(x, low[node], low[node] + (ended[high] - ended[low])[node], overlap, left, d + 1)
        pairs = [np.concatenate(c) for c in zip(*found)]
        return pairs[0], pairs[1]


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of the rows of equal keys, which lie together."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        columns = [np.array(b.column(k)) for k in keys]
        starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if b.num_rows else []
        for i, j in zip(starts, [*starts[1:], b.num_rows]):
            key = tuple(c[i] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _possible(rows: DataFrame, sets: DataFrame, percent: int, heads: bool) -> DataFrame:
    """The pairs (leader, node) of all groups that lie in different components and may link.

    A group is dealt over parts of about GROUP_PART rows, each with its prefix tree. Its leaders go to
    each part: its head alone, or the sets outside its largest component, for a pair of different
    components has one of them.
    """
    sizes = rows.groupBy("token").agg((F.count("*") / GROUP_PART).cast("int").alias("last"), F.min(F.struct("label", "node")).alias("head"))
    labels = rows.groupBy("token", "label").count()
    largest = labels.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    held = (rows.withColumn("largest", F.lit(None).cast("long")) if heads else rows.join(largest, "token")).join(sizes, "token").join(sets.select("node", "n", "lone", F.slice("shared", F.lit(1), F.col("room").cast("int")).alias("first")), "node")
    columns = ["token", "part", "leads", "node", "label", "n", "lone", "leader", "first"]
    held = held.withColumn("leader", F.col("node") == F.col("head.node") if heads else F.col("label") != F.col("largest"))
    members = held.withColumns({"part": F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"), "leads": F.lit(False)}).select(columns)
    leading = held.where("leader").withColumns({"part": F.explode(F.sequence(F.lit(0), "last")), "leads": F.lit(True)}).select(columns)
    dealt = members.unionByName(leading).repartition("token", "part").sortWithinPartitions("token", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "token", "part"):
            leads, node, label, n, lone, leader = (np.array(t.column(c)) for c in ("leads", "node", "label", "n", "lone", "leader"))
            lists = [np.asarray(x.values) for x in t.column("first")]
            members, heads = np.flatnonzero(~leads), np.flatnonzero(leads)
            if not len(members) or not len(heads):
                continue
            tree = PrefixTree([lists[k] for k in members], n[members], lone[members])
            for at in range(0, len(heads), LEADERS):
                some = heads[at : at + LEADERS]
                x, y = tree.candidates(t.column("token")[0].as_py(), [lists[k] for k in some], n[some], lone[some], percent)
                x, y = some[x], members[y]
                ok = (label[x] != label[y]) & ((node[x] < node[y]) | ~leader[y])
                yield pa.RecordBatch.from_arrays([pa.array(node[x[ok]]), pa.array(node[y[ok]])], ["leader", "node"])

    return dealt.mapInArrow(run, "leader long, node long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges a, b of the pairs (leader, node) that link, by the overlap of their whole sets."""
    parts = pairs.groupBy("leader").agg((F.count("*") / CHUNK).cast("int").alias("last"))
    sized = pairs.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    whole = sets.select("node", "n", "shared")
    members = sized.join(whole, "node").select("leader", "part", F.lit(1).alias("kind"), "node", "n", "shared")
    # A leader's set goes once to each part of its members, before them.
    own = parts.join(whole.withColumnRenamed("node", "leader"), "leader").select("leader", F.explode(F.sequence(F.lit(0), "last")).alias("part"), F.lit(0).alias("kind"), F.col("leader").alias("node"), "n", "shared")
    rows = members.unionByName(own).repartition("leader", "part").sortWithinPartitions("leader", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_set, head_n = None, np.zeros(0, np.int64), 0
        for b in slices(batches, CHUNK):
            leader, kind, node, n = (np.array(b.column(c)) for c in ("leader", "kind", "node", "n"))
            keep = np.zeros(b.num_rows, bool)
            for k, s in enumerate(b.column("shared")):
                s = np.asarray(s.values)
                if kind[k] == 0:
                    head, head_set, head_n = leader[k], s, int(n[k])
                elif head == leader[k] and len(head_set):
                    at = np.minimum(np.searchsorted(head_set, s), len(head_set) - 1)
                    keep[k] = may_link(head_n, int(n[k]), int((head_set[at] == s).sum()), percent)
            yield pa.RecordBatch.from_arrays([pa.array(leader[keep]), pa.array(node[keep])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _several(rows: DataFrame) -> DataFrame:
    """The n-grams (token) whose sets lie in several components; of those with the same sets the first."""
    members = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return members.where("low <> high").groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, row, t (a hash of the text), n, component_id, first.

    first is true for one row of each component: that of the smallest identifier. A null or blank
    text has an empty set and is a component of its own, as is a row with a null identifier
    without a copy. Repeated rows are rows of one class. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ordered = written(_ordered(docs, id_col, text_col, n_words, percent), "ordered-sets")
    forget(spark)
    rows = ordered.select("id", "row", "t", "n", "signature")
    classes = written(rows.where("n > 0").groupBy("signature").agg(F.min("row").alias("node"), F.min("id").alias("class_id")), "classes")
    heads = ordered.where("room > 0").withColumnRenamed("row", "node").join(classes.select("node"), "node")
    sets = written(heads.select("node", "n", "lone", "room", "shared"), "first-sets")
    found = sets.select("node", F.col("node").alias("label"), F.explode(F.slice("shared", F.lit(1), F.col("room").cast("int"))).alias("token"))
    open_rows = written(found.join(_several(found), "token"), "open")
    edges, labels, sprouts = [], None, SPROUTS
    while not open_rows.isEmpty():
        pairs = _possible(open_rows, sets, percent, heads=bool(sprouts))
        if sprouts:
            pairs = pairs.groupBy("node").agg(F.min("leader").alias("leader"))
        pairs = written(pairs.select("leader", "node"), "pairs")
        edges.append(written(_verified(pairs, sets, percent), "links"))
        discard(pairs)
        every = edges[0]
        for more in edges[1:]:
            every = every.unionByName(more)
        if labels is not None:
            discard(labels)
        labels = written(components(every), "labels")
        if not sprouts:
            break  # every pair of different components that may link is verified
        rest = open_rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rest = written(rest, "labelled")
        discard(open_rows)
        open_rows = written(rest.join(_several(rest), "token"), "open")
        discard(rest)
        forget(spark)
        sprouts -= 1
    out = rows.join(classes, "signature", "left")
    if labels is not None:
        out = out.join(labels, "node", "left")
        named = classes.join(labels, "node").groupBy("label").agg(F.min("class_id").alias("label_id"))
        out = out.join(named, "label", "left")
        component = F.coalesce("label_id", "class_id")
    else:
        out, component = out.withColumn("label", F.lit(None).cast("long")), F.col("class_id")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, component).otherwise(F.col("id")))
    out = written(out.select("id", "row", "t", "n", "component_id", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("group")), "components")
    for used in (ordered, classes, sets, open_rows, *edges, *([labels] if labels is not None else [])):
        discard(used)
    forget(spark)
    heads = out.where("n > 0").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head"))
    out = out.join(heads, "group", "left")
    return out.select("id", "row", "t", "n", "component_id", F.when(F.col("n") > 0, F.col("row") == F.col("head.row")).otherwise(True).alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs of the smallest identifier of each component, with all its columns.

    Rows without words are components of their own, though rows that repeat identifier and text
    stay once.
    """
    found = links(docs, id_col, text_col)
    repeated = not found.groupBy("id", "t").count().where("count > 1").isEmpty()
    return rows_of(docs, found.where("first").select("id", "t").distinct(), id_col, text_col, once=repeated)


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
