"""What the query modules share: the registry, tables, fixtures and pieces of DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archloom.functions.url import BLANKS, ESCAPES, URL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(name: str, sql: str, *tables: str) -> None:
    """Register SQL that both engines read alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    query(name, sql)(run)


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A table of literals for a FROM clause."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS f({columns})"


def both(rows: list[tuple], columns: str, select: str, name: str = "f") -> str:
    """Cases of rows and what a select makes of given tables, as one relation for a FROM clause of both engines."""
    return f"(SELECT {columns} FROM {values(rows, columns)} UNION ALL {select}) AS {name}"


def given(spark: SparkSession, sf_dir: str, relation: str, *tables: str) -> DataFrame:
    """A relation over given tables as a DataFrame."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(f"SELECT * FROM {relation}")


#: Path of a page's URL, as both engines read it.
PAGE_PATH = "regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)"
PAGE_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)"


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


TRIM = chars(BLANKS.replace("\x00", ""))


def d_trim(e: str) -> str:
    return f"trim({e}, {TRIM})"


def d_canon(p: str) -> str:
    """DuckDB: dot segments and slash runs of a path."""
    folded = (
        f"list_reduce(list_transform(list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s]), "
        "lambda a, x: CASE WHEN x[1] = '..' THEN a[1:len(a)-1] ELSE list_concat(a, x) END, []::VARCHAR[])"
    )
    out = f"('/' || array_to_string({folded}, '/'))"
    out = f"(CASE WHEN {p} LIKE '%/' AND {out} <> '/' THEN {out} || '/' ELSE {out} END)"
    for c, e in ESCAPES.items():
        out = f"replace({out}, {literal(c)}, '{e}')"
    return out


def d_parts(source: str, column: str, pre: str) -> str:
    """DuckDB CTEs that end in {pre}: source with {pre}_scheme, _auth, _host, _port, _path, _query, _url."""
    return f"""
{pre}0 AS (SELECT *, split_part({d_trim(column)}, '#', 1) AS {pre}_t FROM {source}),
{pre}1 AS (SELECT *, lower(regexp_extract({pre}_t, '{URL}', 1)) AS {pre}_scheme,
    lower(regexp_replace(regexp_extract({pre}_t, '{URL}', 2), '^.*@', '')) AS {pre}_auth,
    regexp_extract({pre}_t, '{URL}', 3) AS {pre}_path, regexp_extract({pre}_t, '{URL}', 4) AS {pre}_query FROM {pre}0),
{pre}2 AS (SELECT *, regexp_extract({pre}_auth, '^(\\[[^\\]]*\\]|[^:]*)', 1) AS {pre}_host,
    regexp_extract({pre}_auth, '^(?:\\[[^\\]]*\\]|[^:]*):([0-9]*)', 1) AS {pre}_port,
    CASE WHEN {pre}_scheme = '' THEN 'http' ELSE {pre}_scheme END AS {pre}_sch FROM {pre}1),
{pre} AS (SELECT *, CASE WHEN {pre}_path = '' THEN '/' ELSE {pre}_path END AS {pre}_p,
    lower(regexp_extract(CASE WHEN {pre}_path = '' THEN '/' ELSE {pre}_path END, '\\.([^./]*)$', 1)) AS {pre}_ext,
    CASE WHEN {pre}_host = '' THEN '' ELSE {pre}_sch || '://' || {pre}_host
      || CASE WHEN {pre}_port = '' OR ({pre}_sch = 'http' AND {pre}_port = '80') OR ({pre}_sch = 'https' AND {pre}_port = '443') THEN '' ELSE ':' || {pre}_port END
      || {d_canon(pre + "_path")} || CASE WHEN {pre}_query = '' THEN '' ELSE '?' || {pre}_query END END AS {pre}_url FROM {pre}2)"""


def d_base_domain(h: str) -> str:
    from archloom.functions.url import SECOND_LEVEL

    s = f"string_split({h}, '.')"
    seconds = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    return f"(CASE WHEN len({s}) <= 2 THEN {h} WHEN {s}[-2] IN ({seconds}) AND length({s}[-1]) <= 3 THEN array_to_string({s}[-3:], '.') ELSE array_to_string({s}[-2:], '.') END)"


def d_bare(h: str) -> str:
    return f"regexp_replace({h}, '^www\\.', '')"


def d_type(ext: str) -> str:
    from archloom.functions.url import TYPES

    whens = " ".join(f"WHEN {ext} IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in TYPES.items())
    return f"(CASE {whens} ELSE '' END)"


def d_decode(e: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        e = f"replace({e}, {literal(a)}, {literal(b)})"
    return e


def d_ref(base: str, ref: str) -> str:
    """DuckDB: a reference against base columns of d_parts, before it is normalised; NULL where it is none."""
    r = d_trim(f"translate({d_decode(ref)}, {chars(chr(13) + chr(10) + chr(9))}, '')")
    at = f"{base}_sch || '://' || {base}_auth"
    folder = f"coalesce(nullif(regexp_extract({base}_path, '^(.*/)', 1), ''), '/')"
    return (
        f"(CASE WHEN {r} = '' OR {r} LIKE '#%' THEN NULL WHEN regexp_matches({r}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN CASE WHEN regexp_matches({r}, '(?i)^https?://') THEN {r} END "
        f"WHEN {base}_auth = '' THEN NULL WHEN {r} LIKE '//%' THEN {base}_sch || ':' || {r} WHEN {r} LIKE '/%' THEN {at} || {r} "
        f"WHEN {r} LIKE '?%' THEN {at} || {base}_p || {r} ELSE {at} || {folder} || {r} END)"
    )


