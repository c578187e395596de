"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Targets in words come from the weights, none above three times its source. Equal blocks of words
are then allotted to sources by highest quotients target / (2 k + 1), and each source's blocks to
its shards likewise, by the shards' words: integer quotas per shard. Inside a shard documents lie
in seeded order; its quota takes every document as often as whole rounds fit and the first blocks
of that order once more. Only one document a shard is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, join_null_safe, rows_of, table, text_key, text_of, written

#: Words of a block, and the most times that a word is taken.
BLOCK_WORDS, MOST_TIMES = 64, 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of a shard, at the mean.
SHARD_ROWS = 20_000
SEED = "loom-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sainte_lague(votes: DataFrame, group: list[str], party: list[str], seats: str, vote: str) -> DataFrame:
    """Seats for each party of each group: columns group, party, quota.

    votes has a row for each party with its votes and its group's seats. The highest quotients
    vote / (2 k + 1) win; ties go by party, nulls last. A party's seats differ from its exact share
    x by at most x n / (2 seats) + 1, with n parties, so only those quotients are ranked: about
    four for each party, however many seats there are.
    """
    g = Window.partitionBy(*group)
    v = votes.withColumn("__all", F.sum(vote).over(g)).withColumn("__n", F.count("*").over(g))
    v = v.withColumn("__x", F.when(F.col("__all") > 0, F.col(seats) * F.col(vote) / F.col("__all")).otherwise(F.lit(0.0)))
    slack = F.when(F.col(seats) > 0, F.ceil(F.col("__x") * F.col("__n") / (2 * F.col(seats)))).otherwise(F.lit(0)) + 1
    v = v.withColumn("__low", F.greatest(F.lit(0).cast("long"), F.floor("__x") - slack)).withColumn("__high", F.ceil("__x") + slack)
    v = v.withColumn("__left", F.col(seats) - F.sum("__low").over(g))
    q = v.withColumn("__k", F.explode(F.sequence("__low", "__high")))
    order = [(F.col(vote) / (2 * F.col("__k") + 1)).desc(), *(F.col(p).asc_nulls_last() for p in party), F.col("__k")]
    q = q.withColumn("__won", (F.row_number().over(g.orderBy(*order)) <= F.col("__left")).cast("long"))
    return q.groupBy(*group, *party).agg((F.max("__low") + F.sum("__won")).alias("quota"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Source, its words and its target, from (source, source_size), a row for each source.

    The targets are min(most_times * size, weight * level) at the one level where they add up to
    all words: those that reach their cap are the first in order of cap / weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", (most_times * F.col("source_size")).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")).alias("s"))).over(Window.partitionBy())
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final.getField("level")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED) -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, taken, shard, t (a hash of the text).

    A null or blank text has size 0 and is never taken; a null source is one source, last in order.
    Repeated rows are rows of their own. A table without words has targets of 0; an empty one gives
    no rows. Every run over the same rows gives the same result.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_of(text_col)).alias("size"), text_key(text_col).alias("t"))
    n_shards = max(1, -(-docs.count() // shard_rows))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("-"))))
    d = d.withColumn("key", key).withColumn("shard", F.pmod(F.crc32("key"), F.lit(n_shards)))
    d = written(d, "mix-sizes")
    cells = d.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    sources = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    words = F.sum("source_size").over(Window.partitionBy())
    seats = sources.withColumn("seats", F.round(words / block_words).cast("long")).withColumn("all", F.lit(1))
    quotas = sainte_lague(seats, ["all"], ["source"], "seats", "target").select("source", F.col("quota").alias("source_quota"))
    sources = join_null_safe(sources, quotas, ["source"])
    parts = join_null_safe(cells, sources, ["source"])
    shares = sainte_lague(parts, ["source"], ["shard"], "source_quota", "cell_size")
    parts = join_null_safe(parts, shares, ["source", "shard"])
    parts = parts.withColumn("words", F.least(F.col("quota") * block_words, MOST_TIMES * F.col("cell_size")))
    parts = parts.withColumn("rounds", F.when(F.col("cell_size") > 0, F.expr("words div cell_size")).otherwise(F.lit(0).cast("long")))
    parts = parts.withColumn("over", F.col("words") - F.col("rounds") * F.col("cell_size")).drop("cell_size", "quota", "words", "source_quota")
    order = Window.partitionBy("source", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    d = join_null_safe(d, parts, ["source", "shard"])
    once = F.greatest(F.lit(0).cast("long"), F.least(F.col("over") - F.col("start"), F.col("size")))
    return d.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + once).alias("taken"), "shard", "t")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken whole, and one for a part.

    All columns stay; the text of a part is cut at the end of its last word. What is taken of rows
    that repeat identifier and text is dealt to them evenly.
    """
    taken = written(mix(docs, id_col, text_col, source_col), "mix")
    keys = taken.groupBy(F.col(id_col).alias("id"), "t").agg(F.sum("taken").alias("__loom_taken"), F.first("size").alias("__loom_size"), F.count("*").alias("__loom_rows")).where("__loom_taken > 0")
    out = rows_of(docs, keys, id_col, text_col)
    each = F.expr("__loom_taken div __loom_rows")
    out = out.withColumn("__loom_each", each).withColumn("__loom_times", F.expr("__loom_each div __loom_size")).withColumn("__loom_part", F.col("__loom_each") - F.col("__loom_times") * F.col("__loom_size"))
    out = out.withColumn("__loom_copy", F.explode(F.sequence(F.lit(1), (F.col("__loom_times") + (F.col("__loom_part") > 0).cast("long")).cast("int"))))
    # A piece is a word and the white space before it.
    pieces = F.split(text_col, f"(?<={WORD[:-1]})(?={SPACE})")
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("__loom_part").cast("int")), "")
    out = out.withColumn(text_col, F.when(F.col("__loom_copy") > F.col("__loom_times"), part).otherwise(F.col(text_col)))
    return out.select(*docs.columns)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: For tables of one shard (SHARD_ROWS documents or fewer), where every source's quota is its shard's.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('loom-1:' || coalesce(doc_id::VARCHAR, '-')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap > weight * level) END AS target FROM l),
n AS (SELECT round(sum(source_size) / 64)::BIGINT AS seats FROM t),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r FROM t, n, range(0, (SELECT seats FROM n)) AS x(k)),
u AS (SELECT source, count(*) AS quota FROM q, n WHERE r <= seats GROUP BY source),
c AS (SELECT t.*, least(coalesce(quota, 0) * 64, 3 * source_size)::BIGINT AS words FROM t LEFT JOIN u ON u.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(words % source_size - start, size)) END)::BIGINT AS taken
FROM o JOIN c ON c.source IS NOT DISTINCT FROM o.source
"""
