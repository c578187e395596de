"""Merkle manifest of a dataset: an external-memory store of nodes, and proofs by coordinate.

Leaves are digests of rows. They are dealt by range of (tree, identifier) and sorted into runs;
the place of a leaf in its tree follows from its place in its run and the sizes of the runs
before. A node's coordinate is (tree, level, place). Nodes stand in Parquet partitioned by level:
a pass reads one level in order of place and writes the SPAN levels above it, as ARITY ** SPAN
consecutive places (a block) meet in the same node that many levels higher. The roots of the
trees are the leaves of one more tree, built the same way.

Proofs are extracted from the top down: a merge-scan sorts the paths of block tops among the nodes
below, so each block of nodes follows its own path. A task holds one block, whatever the size of
a tree; only one digest, the root, reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archloom.sources.shared import new_folder

from .common import discard, join_null_safe, table, text_of, written

ARITY = 3
#: Levels that one pass climbs or descends.
SPAN = 5
BLOCK = ARITY**SPAN
#: Rows of an Arrow batch that a pass gives.
_ROWS = 4096
_NODE = "tree string, level int, idx long, n long, hash binary"


def field(value: Column) -> Column:
    """A field of a leaf's input: `-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 over the fields of a row."""
    return F.unhex(F.sha2(F.concat(*(field(f) for f in fields)), 256))


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _parents(nodes: list[str]) -> list[str]:
    return [_digest(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the SPAN levels above nodes (tree, level, idx, n, hash) that come in order of place."""

    def above() -> Iterator[tuple]:
        for (tree, block), rows in groupby(_rows(batches), lambda r: (r[0], r[2] // BLOCK)):
            rows = list(rows)
            _, level, first, n, _ = rows[0]
            nodes = [r[4].hex() for r in rows]
            for _ in range(SPAN):
                if n == 1:
                    break
                nodes, level, first, n = _parents(nodes), level + 1, first // ARITY, -(-n // ARITY)
                yield from ((tree, level, first + k, n, bytes.fromhex(h)) for k, h in enumerate(nodes))

    return _batches(above(), pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("hash", pa.binary())]))


def _descend(batches: Iterator[pa.RecordBatch], paths: bool = True) -> Iterator[pa.RecordBatch]:
    """Paths and folded digests of the nodes of each block from the path of its top, which comes first.

    Rows in: tree, block, idx (-1 for a top), n, hash, other (the digest to fold in place of it), id,
    path, subroot. A path lists, level by level, the siblings on the left and on the right.
    """

    def found() -> Iterator[tuple]:
        path, top = "", None
        for (tree, block), rows in groupby(_rows(batches), lambda r: r[:2]):
            rows = list(rows)
            if rows[0][2] != -1 or len(rows) == 1:
                continue  # a top without nodes below: a tree that ends above this level
            path, top = rows[0][7], rows[0][8]
            rows = rows[1:]
            levels, n = [[r[4].hex() for r in rows]], rows[0][3]
            while n > 1 and len(levels) <= SPAN:
                levels.append(_parents(levels[-1]))
                n = -(-n // ARITY)
            above = [tuple(p.split("<")) for p in path.split(";")] if path else []
            for k, row in enumerate(rows):
                way = []
                for nodes in levels[:-1]:
                    run = k - k % ARITY
                    way.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + ARITY])))
                    k //= ARITY
                way += above
                folded = (row[5] or row[4]).hex()
                for left, right in way:
                    folded = _digest([left, folded, right])
                yield (tree, row[2], row[6], row[4], ";".join("<".join(w) for w in way) if paths else None, _digest([s for w in way for s in w]), folded, top)

    types = [("tree", pa.string()), ("idx", pa.int64()), ("id", pa.string()), ("hash", pa.binary()), ("path", pa.string()), ("proof", pa.string()), ("folded", pa.string()), ("subroot", pa.string())]
    return _batches(found(), pa.schema(types))


_FOUND = "tree string, idx long, id string, hash binary, path string, proof string, folded string, subroot string"


def runs(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, id, hash and more) with idx, their place in their tree, and n, its size.

    Runs are ranges of (tree, id, hash), sorted; nulls come first. Each run counts its trees, and the
    counts of the runs before, one row per run and tree, place it.
    """
    place = F.monotonically_increasing_id()  # run, and place in the run, of a row of a sorted partition
    d = leaves.repartitionByRange("tree", "id", "hash").sortWithinPartitions("tree", "id", "hash")
    d = written(d.withColumn("at", place).withColumn("run", F.shiftright("at", 33)), "leaf-runs")
    own = d.groupBy("run", "tree").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("run", "tree", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    out = join_null_safe(d, own, ["run", "tree"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first"))
    out = written(out.drop("at", "run", "first", "before"), "leaves")
    discard(d)
    return out


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The leaves with their coordinates (tree, id, hash, other, idx, n), the store of nodes, and its highest level.

    leaves: tree and hash, and any orderable id. The store holds level 0 too.
    """
    spark = leaves.sparkSession
    placed = runs(leaves)
    at = new_folder(spark, "merkle")
    store = lambda: spark.read.schema(_NODE).parquet(at)
    put = lambda d: d.write.partitionBy("level").mode("append").parquet(at)
    put(placed.select("tree", F.lit(0).alias("level"), "idx", "n", "hash"))
    level, top = 0, 0
    while True:
        nodes = store().where((F.col("level") == level) & (F.col("n") > 1)).select("tree", "level", "idx", "n", "hash")
        if nodes.isEmpty():
            break
        block = F.col("idx").cast("long") - F.pmod("idx", F.lit(BLOCK))
        put(nodes.repartition("tree", block).sortWithinPartitions("tree", "idx").mapInArrow(_climb, _NODE))
        level += SPAN
        top = level
    return placed, store(), top


def extract(placed: DataFrame, store: DataFrame, top: int, roots: DataFrame, paths: bool = True) -> DataFrame:
    """Rows tree, idx, id, hash, path (null without paths), proof, folded, subroot of all leaves.

    roots: tree, level of its root, the path from it and its digest in hex. Passes go down SPAN levels
    each, from the paths of the nodes SPAN levels higher or, where a tree is lower, of its root.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _descend(batches, paths)

    tops = None
    for level in range(max(0, top - SPAN), -1, -SPAN):
        here = roots.where((F.col("level") <= level + SPAN) & ((F.col("level") > level) | F.lit(level == 0)))
        heads = here.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if tops is not None:
            heads = heads.unionByName(tops.select("tree", F.col("idx").alias("block"), "path", "subroot"))
        if level:
            nodes = store.where((F.col("level") == level) & (F.col("n") > 1)).withColumns({"other": F.lit(None).cast("binary"), "id": F.lit(None).cast("string")})
        else:
            nodes = placed
        none = {"n": F.lit(0).cast("long"), "hash": F.lit(None).cast("binary"), "other": F.lit(None).cast("binary"), "id": F.lit(None).cast("string")}
        columns = ["tree", "block", "idx", "n", "hash", "other", "id", "path", "subroot"]
        nodes = nodes.withColumns({"block": F.floor(F.col("idx") / BLOCK).cast("long"), "path": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string")})
        scan = heads.withColumns(none).withColumn("idx", F.lit(-1).cast("long")).select(columns).unionByName(nodes.withColumn("id", F.col("id").cast("string")).select(columns))
        above = tops
        scan = scan.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        tops = written(scan.mapInArrow(_descend if level else leaves, _FOUND), "paths")
        if above is not None:
            discard(above)
    return tops


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", proofs: bool = True) -> DataFrame:
    """One row per row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root, verified, and with proofs proof.

    Digests are hexadecimal. proof lists the siblings level by level, from the leaf to the root: left
    ones, `<`, right ones, levels parted by `;`. folded_root is computed from the leaf and its
    siblings; for a row whose identifier has an even crc32, from the leaf of a text without line ends.

    A null in a field is `-`; an empty text has a length of 0. Null trees are one tree, the first;
    null identifiers come first and are not tampered with. Rows that repeat an identifier are leaves
    of their own in order of digest; like rows are told apart by their place alone. A lone leaf is its
    tree's root; a lone tree's root is the root. An empty table gives no rows. Other columns are not read.
    """
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    whole = leaf_digest([F.col(f) for f in fields])
    less = leaf_digest([F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text_col else F.col(f) for f in fields])
    tampered = F.when(even & text_of(text_col).contains("\n"), less)
    leaves = written(docs.select(F.col(tree_col).cast("string").alias("tree"), F.col(id_col).alias("id"), whole.alias("hash"), tampered.alias("other")), "leaf-digests")
    id_type = leaves.schema["id"].dataType
    placed, store, top = grow(leaves)
    discard(leaves)
    roots = store.where("n = 1").select("tree", "level", F.lower(F.hex("hash")).alias("subroot"))

    upper = roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.unhex("subroot").alias("hash"), F.lit(None).cast("binary").alias("other"))
    placed_roots, upper_store, upper_top = grow(upper)
    last = upper_store.where("n = 1").select("tree", "level", F.lit("").alias("path"), F.lower(F.hex("hash")).alias("subroot"))
    paths = extract(placed_roots, upper_store, upper_top, last)
    root = last.select("subroot").first()  # one row
    paths = paths.select(F.col("id").alias("tree"), "path")
    out = extract(placed, store, top, join_null_safe(roots, paths, ["tree"]), proofs)
    for d in (placed, store, placed_roots, upper_store, paths):
        discard(d)
    root = F.lit(root[0] if root else None).cast("string")
    return out.select(
        F.col("id").cast(id_type).alias(id_col), F.lower(F.hex("hash")).alias("leaf"), "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"), *([F.col("path").alias("proof")] if proofs else []),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), proofs=False)


#: Levels are climbed by recursion; siblings are those of the same run but the node itself.
OP11_SQL = r"""
WITH RECURSIVE enc AS (
  SELECT doc_id, source, crc32_even, f1 || f4 || coalesce(strlen(text) || ':' || text, '-') AS whole,
         f1 || f4 || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS less
  FROM (SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') AS f1,
               coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS f4,
               list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 2 = 1 AS crc32_even
        FROM documents)
), leaf AS (
  SELECT doc_id, source, sha256(whole) AS h, CASE WHEN crc32_even THEN sha256(less) ELSE sha256(whole) END AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM enc
), up AS (
  SELECT 0 AS level, source, idx, n, h FROM leaf
  UNION ALL
  SELECT level + 1, source, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, source, idx // 3
), sub AS (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS sources FROM up WHERE n = 1
), upper_up AS (
  SELECT 0 AS level, place AS idx, sources AS n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_up WHERE n > 1 GROUP BY level, idx // 3
), way AS (
  SELECT l.doc_id, u.level, string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx < spot) AS lefts, string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx > spot) AS rights
  FROM (SELECT doc_id, source, level, idx // (3 ** level)::BIGINT AS spot FROM leaf, (SELECT DISTINCT level FROM up) v) l
  JOIN up u ON u.source IS NOT DISTINCT FROM l.source AND u.level = l.level AND u.n > 1 AND u.idx // 3 = spot // 3
  GROUP BY ALL
), upper_way AS (
  SELECT s.source, s.height + u.level AS level, string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx < spot) AS lefts, string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx > spot) AS rights
  FROM (SELECT source, height, v.level, place // (3 ** v.level)::BIGINT AS spot FROM sub, (SELECT DISTINCT level FROM upper_up) v) s
  JOIN upper_up u ON u.level = s.level AND u.n > 1 AND u.idx // 3 = spot // 3
  GROUP BY ALL
), steps AS (
  SELECT doc_id, level, coalesce(lefts, '') AS lefts, coalesce(rights, '') AS rights FROM way
  UNION ALL
  SELECT doc_id, level, coalesce(lefts, ''), coalesce(rights, '') FROM leaf JOIN upper_way w ON w.source IS NOT DISTINCT FROM leaf.source
), folds AS (
  SELECT doc_id, 0 AS level, t AS h FROM leaf
  UNION ALL
  SELECT s.doc_id, s.level + 1, sha256(lefts || f.h || rights) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level
), folded AS (
  SELECT doc_id, arg_max(h, level) AS folded_root FROM folds GROUP BY doc_id
), proofs AS (
  SELECT doc_id, string_agg(lefts || rights, '' ORDER BY level) AS p FROM steps GROUP BY doc_id
)
SELECT doc_id, leaf.h AS leaf, subroot, r.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM leaf JOIN sub ON sub.source IS NOT DISTINCT FROM leaf.source CROSS JOIN (SELECT h FROM upper_up WHERE n = 1) r
JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""
