"""Repeated byte strings across documents, by deep-shallow suffix sorting of the places that may repeat.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
identifier. Every window of LENGTH bytes has an anchor, the gram of GRAM bytes in it whose hash is
least, so equal windows have equal anchors. Anchors choose the places to sort, the sort decides:

1. Batches of documents send their distinct anchors to buckets by hash and learn which of them other
   documents hold too. A window of any other anchor is found nowhere else.
2. Each shared anchor's extent (the bytes of all windows that it is the anchor of) goes to the bucket
   of the anchor, equal extents of a batch once. There the suffixes of the distinct extents are sorted:
   multikey quicksort on eight bytes at a time down to SHALLOW bytes, then blind tries for the groups
   that still agree. Suffixes that agree over LENGTH bytes are one string, whose first holder is
   the smallest document with any of their extents; it goes from all other documents.
3. The spans that a document loses are joined and cut out.

Hashes only deal and compare anchors; strings are compared by their bytes. Tasks pass each other
arrays, not rows, for the many anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, forget, join_null_safe, numbers, planes, table, text_of, written

LENGTH, GRAM, SHALLOW = 50, 24, 24
#: Bytes of text of a batch, anchors of a bucket of step 1, and suffixes of one of step 2, at the mean.
BATCH_BYTES, BUCKET_ANCHORS, BUCKET_SUFFIXES = 8 << 20, 1_000_000, 1_500_000
#: Documents with one anchor from which its windows are dealt over the buckets singly.
HOT = 20_000
#: Bytes that are hashed at once; a place has to fit in _PLACE bits.
_BLOCK, _PLACE = 1 << 19, 20
#: Bits of an anchor's hash.
_ANCHOR = 48


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


_BYTE = _random(256, 1)
_ODD = _random(8, 2) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def _anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most 2 * _BLOCK bytes, documents end to end: first and last window start and hash of each anchor, in order."""
    n = len(buf) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.view(np.uint64)
    h, width = _BYTE[buf], 1
    while width * 2 <= GRAM:
        h = h[:-width] * _ODD[2 + width.bit_length()] + h[width:]
        width *= 2
    h = _mixed(h[: len(h) - (GRAM - width)] * _ODD[3] + h[GRAM - width :])
    low = np.uint64((1 << _PLACE) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach, width = LENGTH - GRAM + 1, 1
    while width * 2 <= reach:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < reach:
        v = np.minimum(v[: len(v) - (reach - width)], v[reach - width :])
    at = (v[:n] & low).astype(np.int64)
    # Windows that lie within one document.
    inside = np.ones(n + 1, bool)
    inside[n] = False
    for e in ends[:-1]:
        inside[max(0, e - LENGTH + 1) : min(e, n)] = False
    same = inside[1:n] & inside[: n - 1] & (at[1:] == at[:-1])
    first = np.flatnonzero(inside[:n] & np.append(True, ~same))
    last = np.flatnonzero(inside[:n] & np.append(~same, True))
    # The least hashes of windows are small numbers, so they are mixed anew before they are dealt by range.
    return first, last, _mixed(h[at[first]] * _ODD[4]) >> np.uint64(64 - _ANCHOR)


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the text, first and last window start in it, and hash of each anchor, by blocks of texts.

    Texts longer than a block are cut into blocks that overlap, so that each window is in one.
    """
    k = 0
    while k < len(texts):
        if len(texts[k]) > _BLOCK:
            for s in range(0, len(texts[k]) - LENGTH + 1, _BLOCK):
                piece = np.frombuffer(texts[k], np.uint8, min(_BLOCK + LENGTH - 1, len(texts[k]) - s), s)
                first, last, g = _anchors(piece, np.array([len(piece)]))
                yield np.full(len(first), k), first + s, last + s, g
            k += 1
            continue
        j, size = k, 0
        while j < len(texts) and len(texts[j]) <= _BLOCK and size + len(texts[j]) <= _BLOCK:
            size += len(texts[j])
            j += 1
        ends = np.cumsum([len(t) for t in texts[k:j]])
        first, last, g = _anchors(np.frombuffer(b"".join(texts[k:j]), np.uint8), ends)
        own = np.searchsorted(ends, first, "right")
        begin = np.append(0, ends[:-1])[own] if len(own) else own
        yield own + k, first - begin, last - begin, g
        k = j


def _held(texts: list[bytes]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """All anchors of a batch; the distinct ones in order, and how many texts hold each."""
    found = [np.concatenate(c) for c in zip(*anchors(texts))] if texts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    own, _, _, g = found
    order = np.lexsort((own, g))
    g, own = g[order], own[order]
    each = np.append(True, (g[1:] != g[:-1]) | (own[1:] != own[:-1]))[: len(g)]
    distinct, holders = np.unique(g[each], return_counts=True)
    return tuple(found), distinct, holders


def _texts(t: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The documents of a batch in an order that each step finds anew, and their texts."""
    t = t.sort_by([("id", "ascending"), ("sha", "ascending")])
    return t, pc.cast(t.column("text"), pa.binary()).to_pylist()


def _parts(bucket: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of the runs of a sorted bucket column."""
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    return ((k, int(i), int(j)) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j)


def _table(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.Table:
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.table([pa.array(v, k) for v, k in zip(values, columns.values())], names=list(columns))


def _shared(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Columns batch, shared, hot: anchors of a batch that another batch holds too, and those of very many documents."""
    sent = {"bucket": pa.int64(), "batch": pa.int64(), "g": pa.binary(), "n": pa.binary()}
    back = {"batch": pa.int64(), "shared": pa.binary(), "hot": pa.binary()}

    def send(t: pa.Table) -> pa.Table:
        batch = t.column("batch")[0].as_py()
        _, g, n = _held(_texts(t)[1])
        bucket = (g >> np.uint64(_ANCHOR - 32)) * np.uint64(n_buckets) >> np.uint64(32)
        return _table([(k, batch, planes(g[i:j], 6), planes(n[i:j], 4)) for k, i, j in _parts(bucket.astype(np.int64), n_buckets)], sent)

    def meet(t: pa.Table) -> pa.Table:
        each, times = numbers(t.column("g").to_pylist(), 6), numbers(t.column("n").to_pylist(), 4)
        known, number = np.unique(np.concatenate(each), return_inverse=True)
        batches = np.bincount(number)[number]
        holders = np.bincount(number, np.concatenate(times).astype(np.int64))[number]
        rows, at = [], 0
        for batch, g in zip(t.column("batch").to_pylist(), each):
            shared, hot = batches[at : at + len(g)] > 1, holders[at : at + len(g)] >= HOT
            at += len(g)
            rows.append((batch, planes(g[shared], 6), planes(g[hot], 6)))
        return _table(rows, back)

    dealt = docs.groupBy("batch").applyInArrow(send, "bucket long, batch long, g binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "batch long, shared binary, hot binary")


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length by a blind trie (Patricia tree).

    An inner node holds the first place at which its strings differ, and branches on the byte there;
    a search skips all others and checks one leaf.
    """
    root: list | int = 0
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while isinstance(node, list):
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        other = strings[node]
        at = next(i for i, (a, b) in enumerate(zip(s, other)) if a != b)
        # Down again to the edge on which the place lies.
        parent, byte, node = None, 0, root
        while isinstance(node, list) and node[0] < at:
            parent, byte = node, s[node[0]]
            node = node[1][byte]
        if isinstance(node, list) and node[0] == at:
            node[1][s[at]] = k
            continue
        inner = [at, {other[at]: node, s[at]: k}]
        if parent is None:
            root = inner
        else:
            parent[1][byte] = inner
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            order.append(node)
    return order


def first_holders(buf: np.ndarray, start: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """For each suffix the least holder of those that agree with it over LENGTH bytes.

    Deep-shallow: groups are split by eight bytes at a time (multikey quicksort) while they have
    several holders; what agrees down to SHALLOW bytes is ordered by blind tries.
    """
    least = holder.copy()
    buf = np.append(buf, np.zeros(8, np.uint8))
    weights = (np.uint64(1) << (np.uint64(8) * np.arange(7, -1, -1, dtype=np.uint64))).astype(np.uint64)
    at, group, depth = np.arange(len(start)), np.zeros(len(start), np.int64), 0
    while len(at):
        # Groups of one holder are done.
        new = np.append(True, group[1:] != group[:-1])
        starts, number = np.flatnonzero(new), np.cumsum(new) - 1
        keep = (np.minimum.reduceat(holder[at], starts) < np.maximum.reduceat(holder[at], starts))[number]
        at, group = at[keep], number[keep]
        if depth >= SHALLOW or not len(at):
            break
        word = np.zeros(len(at), np.uint64)
        for i in range(8):
            word += buf[start[at] + depth + i] * weights[i]
        order = np.lexsort((word, group)) if depth else np.argsort(word, kind="stable")
        at, group, word = at[order], group[order], word[order]
        group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))) - 1
        depth += 8
    raw = buf.tobytes()
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(at) else np.zeros(0, int)
    begins, holders = start[at].tolist(), holder[at]
    for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist()):
        tails: dict[bytes, list[int]] = {}
        for k in range(i, j):
            tails.setdefault(raw[begins[k] + SHALLOW : begins[k] + LENGTH], []).append(k)
        names = list(tails)
        for name in blind_trie_order(names) if len(names) > 1 else [0]:
            leaf = tails[names[name]]
            if len(leaf) > 1:
                least[at[leaf]] = holders[leaf].min()
    return least


def _number(pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and the number of each among them."""
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(p, len(known)) for p in pieces], np.int64)
    return list(known), number


def _lost(docs: DataFrame, shared: DataFrame, n_buckets: int) -> DataFrame:
    """Columns batch, doc, from, size: spans that the documents of a batch lose."""
    sent = {"bucket": pa.int64(), "batch": pa.int64(), "pieces": pa.binary(), "size": pa.binary(), "times": pa.binary(), "doc": pa.binary(), "id": pa.binary(), "first": pa.binary()}
    spans = {"batch": pa.int64(), "doc": pa.binary(), "from": pa.binary(), "size": pa.binary()}

    def send(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], sent)
        batch = texts.column("batch")[0].as_py()
        texts, raw = _texts(texts)
        ids = np.array(texts.column("id").to_pylist(), np.int64)
        (own, first, last, g), distinct, holders = _held(raw)
        other, hot = (np.concatenate([np.zeros(0, np.uint64), *numbers(told.column(c).to_pylist(), 6)]) for c in ("shared", "hot"))
        some = np.isin(g, np.union1d(other, distinct[holders > 1]))
        own, first, last, g = own[some], first[some], last[some], g[some]
        single = np.isin(g, hot)
        if single.any():  # window by window
            times = np.where(single, last - first + 1, 1)
            k = np.repeat(np.arange(len(own)), times)
            step = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
            own, g, first = own[k], g[k], first[k] + step
            last, single = np.where(single[k], first, last[k]), single[k]
        if not len(own):
            return _table([], sent)
        pieces, number = _number([raw[d][p : q + LENGTH] for d, p, q in zip(own.tolist(), first.tolist(), last.tolist())])
        deal = np.zeros(len(pieces), np.uint64)
        deal[number] = g
        for k in np.unique(number[single]).tolist():
            deal[k] = int.from_bytes(hashlib.blake2b(pieces[k], digest_size=6).digest(), "little")
        bucket = (_mixed(deal) % np.uint64(n_buckets)).astype(np.int64)
        # Distinct pieces by bucket, and their places by piece.
        by = np.argsort(bucket, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        place = np.argsort(rank[number], kind="stable")
        own, first, number = own[place], first[place], rank[number][place]
        size, times = np.array([len(pieces[k]) for k in by]), np.bincount(number, minlength=len(by))
        at = np.concatenate([[0], np.cumsum(times)])
        rows = []
        for k, i, j in _parts(bucket[by], n_buckets):
            a, z = at[i], at[j]
            rows.append((k, batch, b"".join([pieces[x] for x in by[i:j]]), planes(size[i:j], 1), planes(times[i:j], 4), planes(own[a:z], 4), planes(ids[own[a:z]], 8), planes(first[a:z], 4)))
        return _table(rows, sent)

    def sort(t: pa.Table) -> pa.Table:
        size, times, doc, first = ([x.astype(np.int64) for x in numbers(t.column(c).to_pylist(), n)] for c, n in (("size", 1), ("times", 4), ("doc", 4), ("first", 4)))
        ids = np.concatenate([x.view(np.int64) for x in numbers(t.column("id").to_pylist(), 8)])
        each = []
        for raw, n in zip(t.column("pieces").to_pylist(), size):
            ends = np.cumsum(n).tolist()
            each += [raw[i:j] for i, j in zip([0, *ends], ends)]
        # Equal extents of several batches are one.
        pieces, number = _number(each)
        number = np.repeat(number, np.concatenate(times))
        del each
        holder = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(holder, number, ids)
        length = np.array([len(p) for p in pieces])
        n = length - LENGTH + 1
        own = np.repeat(np.arange(len(pieces)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        least = first_holders(np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(length) - length)[own] + step, holder[own])
        # All windows of an extent hold its anchor, so what a document loses of it is one span: from
        # the first to the last window with a holder before the document.
        begins = np.cumsum(n) - n
        low, high = np.minimum.reduceat(least, begins), np.maximum.reduceat(least, begins)
        a, z = np.zeros(len(ids), np.int64), n[number]
        whole = ids > high[number]
        for k in np.flatnonzero(~whole & (ids > low[number])).tolist():
            gone = np.flatnonzero(least[begins[number[k]] : begins[number[k]] + n[number[k]]] < ids[k])
            a[k], z[k] = gone[0], gone[-1] + 1
        lost = ids > low[number]
        start, span = np.concatenate(first) + a, z - a + LENGTH - 1
        doc, batch = np.concatenate(doc), np.repeat(np.array(t.column("batch")), [len(x) for x in doc])
        rows = []
        for k in np.unique(batch):
            some = np.flatnonzero(lost & (batch == k))
            some = some[np.lexsort((start[some], doc[some]))]
            if len(some):
                rows.append((int(k), planes(doc[some], 4), planes(start[some], 4), planes(span[some], 1)))
        return _table(rows, spans)

    schema = ", ".join(f"{c} {'long' if k == pa.int64() else 'binary'}" for c, k in sent.items())
    dealt = docs.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(send, schema)
    return dealt.groupBy("bucket").applyInArrow(sort, "batch long, doc binary, `from` binary, size binary")


def _cut(docs: DataFrame, lost: DataFrame, with_bytes: bool) -> DataFrame:
    """Columns id, sha, n_removed, n_spans, kept_sha256, kept (if asked for) of the documents that lose bytes."""
    columns = {"id": pa.int64(), "sha": pa.string(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if with_bytes else {})

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        if not texts.num_rows or not spans.num_rows:
            return _table([], columns)
        texts, raw = _texts(texts)
        doc, a, size = (np.concatenate(numbers(spans.column(c).to_pylist(), n)).astype(np.int64) for c, n in (("doc", 4), ("from", 4), ("size", 1)))
        order = np.lexsort((a, doc))
        doc, a, z = doc[order], a[order], (a + size)[order]
        rows = []
        ids, shas = texts.column("id").to_pylist(), texts.column("sha").to_pylist()
        for k, i, j in _parts(doc, len(raw)):
            x, y = a[i:j], np.maximum.accumulate(z[i:j])
            new = np.flatnonzero(np.append(True, x[1:] > y[:-1]))
            x, y = x[new], np.append(y[new[1:] - 1], y[-1:])
            edges = [0, *np.stack([x, y], 1).ravel().tolist(), len(raw[k])]
            kept = b"".join(raw[k][p:q] for p, q in zip(edges[::2], edges[1::2]))
            rows.append((ids[k], shas[k], len(raw[k]) - len(kept), len(x), hashlib.sha256(kept).hexdigest(), kept)[: len(columns)])
        return _table(rows, columns)

    schema = "id long, sha string, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return docs.groupBy("batch").cogroup(lost.groupBy("batch")).applyInArrow(run, schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for.

    A null text is empty. Texts of under LENGTH bytes stay whole, as do rows with a null
    identifier, which are nobody's earlier document either. Rows that share an identifier are one
    document in so far as none is smaller than another; a whole number is needed for one. An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    base = written(d.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "byte-sizes")
    n_bytes = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # Documents are dealt over batches by identifier and text, alike in each step.
    long_enough = d.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH)).withColumn("sha", F.sha2("text", 256))
    long_enough = long_enough.withColumn("batch", F.pmod(F.xxhash64("id", "sha"), F.lit(max(12, n_bytes // BATCH_BYTES))))
    n_anchors = 2 * n_bytes // (LENGTH - GRAM + 2)
    shared = written(_shared(long_enough, max(12, n_anchors // BUCKET_ANCHORS)), "shared-anchors")
    forget(spark)
    lost = written(_lost(long_enough, shared, max(12, n_bytes // BUCKET_SUFFIXES)), "lost-spans")
    discard(shared)
    forget(spark)
    cut = written(_cut(long_enough, lost, with_bytes).dropDuplicates(["id", "sha"]), "cut-texts")
    discard(lost)
    forget(spark)
    out = join_null_safe(base, cut, ["id", "sha"], "left")
    columns = [F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*columns, *(["kept"] if with_bytes else []))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
