"""Quality rules: distribution divergence from language references, with DataFrame functions only.

Each document gives two histograms: its characters by class, and its words by common word of its
language. The reference of a language is the median share of each bin over all its documents that
pass the base rules, which a minority of junk does not move. A document goes if the Jensen-Shannon distance of a histogram from its reference is above the limit;
guards skip a histogram of too few characters or words, whose distance is mostly noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table, text_key, text_of, words, written

# Frequent words of each language, in about the order of their frequency.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "be", "by", "this"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "dans", "qui", "par", "pour"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "no"),
}
N_COMMON = 16
#: Limits of the two distances, and the least characters and words for each to be judged.
MOST_CLASS_DISTANCE, LEAST_CHARS = 0.19, 100
MOST_WORD_DISTANCE, LEAST_WORDS = 0.28, 100
#: Base rules: least words, and most repeated words a hundred.
BASE_LEAST_WORDS, BASE_MOST_REPEATED = 50, 50


def _count(text: Column, keep: str) -> Column:
    """Characters of the class keep."""
    return F.char_length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def base_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Columns id, lang and the counts of each document; the text itself goes.

    Windows of three words are compared by 64-bit hash. Each step is a projection of its own so
    that arrays used inside lambdas are computed once a row.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text_of(text_col).alias("t"), text_key(text_col).alias("key"))
    d = d.select("id", "key", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("").alias("lang"), "t", words(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("id", "key", "lang", "t", "w", lines.alias("l"), F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("glued"))
    lists = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    d = d.select(
        "id", "key", "lang", "n_words",
        F.char_length("glued").cast("long").alias("word_chars"),
        F.char_length("t").cast("long").alias("n_chars"),
        _count(F.col("glued"), "#*$%&|<>").alias("n_symbols"),
        _count(F.col("glued"), r"\p{Ll}").alias("n_lower"),
        _count(F.col("glued"), r"\p{Lu}").alias("n_upper"),
        _count(F.col("glued"), "0-9").alias("n_digits"),
        _count(F.col("glued"), ".,;:!?'()-").alias("n_marks"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > 3, F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
        # Two blanks between words, so that neighbours don't share one.
        F.when(F.col("lang") != "", F.lower(F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")))).alias("spaced"),
        F.element_at(lists, F.col("lang")).alias("common"),
    )
    found = [F.coalesce(((F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.concat(F.lit(" "), F.get("common", F.lit(i)), F.lit(" "))))) / (F.octet_length(F.get("common", F.lit(i))) + 2)).cast("long"), F.lit(0).cast("long")) for i in range(N_COMMON)]
    d = d.select(
        "id", "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.array("n_lower", "n_upper", "n_digits", "n_marks", F.col("word_chars") - F.col("n_lower") - F.col("n_upper") - F.col("n_digits") - F.col("n_marks"), F.col("n_chars") - F.col("word_chars")).alias("classes"),
        F.array(*found).alias("commons"), "h",
    )
    d = d.withColumn("repeats", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h"))).drop("h")
    d = d.withColumn("sorted", F.sort_array(F.transform("repeats", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).drop("repeats")
    at = lambda j: F.get("sorted", j).getField("h")
    twice = F.filter("sorted", lambda e, j: F.coalesce(at(j - 1) == e.getField("h"), F.lit(False)) | F.coalesce(at(j + 1) == e.getField("h"), F.lit(False)))
    covered = F.flatten(F.transform(twice, lambda e: F.array(e.getField("i"), e.getField("i") + 1, e.getField("i") + 2)))
    return d.withColumn("n_repeat_words", F.when(F.col("sorted").isNotNull(), F.size(F.array_distinct(covered))).otherwise(0).cast("long")).drop("sorted")


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two count arrays; null if one is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))
    pq = F.zip_with(F.transform(counts, lambda x: x / F.nullif(total(counts), F.lit(0.0))), F.transform(reference, lambda x: x / F.nullif(total(reference), F.lit(0.0))), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(pq, F.lit(0.0), lambda a, x: a + x) / 2))


def _base_failed() -> Column:
    return (F.col("n_words") < BASE_LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_MOST_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_key: bool = False) -> DataFrame:
    """One row per document: id_col, the counts, the two distances, base_failed and kept.

    A null text has no words, so it fails the base rules, as does any text of under 50 words. A null
    or unknown language has a character reference of its own and no word test. Where no document
    passes the base rules there is no reference and no distance. Repeated rows are rows of their
    own; an empty table gives no rows.
    """
    d = written(base_counts(docs, id_col, text_col, lang_col).withColumn("base_failed", _base_failed()), "rule-counts")
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("bins", F.concat("commons", F.array(F.col("n_words") - whole("commons"))))
    middle = lambda c, n: F.array(*(F.percentile_approx(F.get(c, F.lit(i)) / F.nullif(whole(c), F.lit(0)), 0.5, 10_000) for i in range(n)))
    ref = d.where(~F.col("base_failed")).groupBy("lang").agg(middle("classes", 6).alias("ref_classes"), middle("bins", N_COMMON + 1).alias("ref_bins"))
    # At most one row a language of COMMON_WORDS and one for the rest.
    d = d.join(F.broadcast(ref), "lang", "left")
    real = lambda c: F.transform(c, lambda x: x.cast("double"))
    d = d.withColumn("class_distance", F.when(whole("classes") >= LEAST_CHARS, js_distance(real("classes"), F.col("ref_classes"))))
    d = d.withColumn("word_distance", F.when((F.col("lang") != "") & (F.col("n_words") >= LEAST_WORDS), js_distance(real("bins"), F.col("ref_bins"))))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance", *(["key"] if with_key else []))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    kept = quality_rules(docs, id_col, text_col, lang_col, with_key=True).where("kept").select(F.col(id_col).alias("id"), F.col("key").alias("t")).distinct()
    return rows_of(docs, kept, id_col, text_col)


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    # Distances to six places, within which engines agree.
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _sql() -> str:
    """The same rows by DuckDB, with bins as rows; medians there are exact, as they are here for few documents."""
    word = r"[^\x20\x09-\x0D]+"
    common = ", ".join(f"('{k}', {i}, '{w}')" for k, v in COMMON_WORDS.items() for i, w in enumerate(v))
    kinds = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digits": "0-9", "marks": r".,;:!?''()\-"}
    count = lambda keep: f"length(regexp_replace(glued, '[^{keep}]+', '', 'g'))"
    counts = ", ".join(f"{count(v)} AS n_{k}" for k, v in kinds.items())
    return rf"""
WITH w AS (SELECT doc_id, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
g AS (SELECT *, len(ws) AS n_words, array_to_string(ws, '') AS glued, length(t) AS n_chars, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM w),
n AS (SELECT *, length(glued) AS word_chars, {count("#*$%&|<>")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, {counts} FROM g),
x AS (SELECT doc_id, i, ws[i:i + 2] AS x FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM x) AS y, (VALUES (0), (1), (2)) AS v(j) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT n.*, coalesce(r.n, 0) AS n_repeat_words, n_words < {BASE_LEAST_WORDS} OR 100 * coalesce(r.n, 0) > {BASE_MOST_REPEATED} * n_words AS base_failed FROM n LEFT JOIN r USING (doc_id)),
cw AS (SELECT b.doc_id, c.bin, count(*) AS n FROM b, unnest(ws) AS u(x), (VALUES {common}) AS c(lang, bin, word) WHERE c.lang = b.lang AND c.word = lower(u.x) GROUP BY ALL),
bins AS (
 SELECT doc_id, lang, base_failed, n_words, 'class' AS kind, i AS bin, [n_lower, n_upper, n_digits, n_marks, word_chars - n_lower - n_upper - n_digits - n_marks, n_chars - word_chars][i] AS n FROM b, unnest(range(1, 7)) AS u(i)
 UNION ALL SELECT b.doc_id, lang, base_failed, n_words, 'word', i, CASE WHEN i < {N_COMMON} THEN coalesce(cw.n, 0) ELSE n_words - coalesce((SELECT sum(n) FROM cw AS o WHERE o.doc_id = b.doc_id), 0) END
 FROM b CROSS JOIN unnest(range(0, {N_COMMON + 1})) AS u(i) LEFT JOIN cw ON cw.doc_id = b.doc_id AND cw.bin = i),
sh AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY doc_id, kind), 0) AS p, sum(n) OVER (PARTITION BY doc_id, kind) AS total FROM bins),
rf AS (SELECT lang, kind, bin, quantile_disc(p, 0.5) AS q FROM sh WHERE NOT base_failed GROUP BY ALL),
rn AS (SELECT lang, kind, bin, q / nullif(sum(q) OVER (PARTITION BY lang, kind), 0) AS q FROM rf),
js AS (SELECT doc_id, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS distance
 FROM sh JOIN rn USING (lang, kind, bin) WHERE p IS NOT NULL AND q IS NOT NULL AND CASE kind WHEN 'class' THEN total >= {LEAST_CHARS} ELSE lang <> '' AND n_words >= {LEAST_WORDS} END GROUP BY doc_id, kind),
e AS (SELECT b.*, c.distance AS class_distance, w.distance AS word_distance FROM b LEFT JOIN js AS c ON c.doc_id = b.doc_id AND c.kind = 'class' LEFT JOIN js AS w ON w.doc_id = b.doc_id AND w.kind = 'word')
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND coalesce(class_distance, 0) <= {MOST_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MOST_WORD_DISTANCE} AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM e"""


OP4_SQL = _sql()
