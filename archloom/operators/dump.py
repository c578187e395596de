"""A whole database as SQL text: header, tables with their rows in chunks, views, footer.

Every piece is a row with its place; only the plan of tables and views, whose number is that of the
catalog, is made on the driver. Rows of a table are dealt to chunks by rank, from the counts of key
ranges, so that no task numbers a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampType

from archloom.functions.text import sql_literal, strip_definer

from .ranking import ranked

#: Rows of a statement.
CHUNK = 400
# Column types of the dump.
_TYPES = {LongType: "bigint", IntegerType: "int", ShortType: "smallint", DoubleType: "double", FloatType: "float", BooleanType: "tinyint(1)", DateType: "date", TimestampType: "datetime(6)", BinaryType: "longblob", StringType: "longtext"}
_HEADER = ["SET NAMES utf8mb4;", "SET FOREIGN_KEY_CHECKS=0;"]
_FOOTER = "SET FOREIGN_KEY_CHECKS=1;\n-- End of dump"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _type(t: DataType) -> str:
    if isinstance(t, DecimalType):
        return f"decimal({t.precision},{t.scale})"
    return _TYPES.get(type(t), "longtext")


def table_ddl(name: str, df: DataFrame) -> str:
    """DROP and CREATE of a table from its schema."""
    columns = ",\n".join(f"  {_quoted(f.name)} {_type(f.dataType)}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)
    return f"DROP TABLE IF EXISTS {_quoted(name)};\nCREATE TABLE {_quoted(name)} (\n{columns}\n);"


def _value(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    c = F.col(_quoted(name))
    if isinstance(t, (DateType, TimestampType)):
        return sql_literal(F.date_format(c, "yyyy-MM-dd" if isinstance(t, DateType) else "yyyy-MM-dd HH:mm:ss.SSSSSS"), "string")
    return sql_literal(c if _type(t) != "longtext" or isinstance(t, StringType) else F.to_json(c), t.simpleString() if not isinstance(t, StringType) else "string")


def inserts(name: str, df: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Rows chunk, sql: statements of so many rows each, in order of the keys; all columns tell rows apart after them."""
    order = F.struct(*[_quoted(k) for k in keys], *[_quoted(c) for c in df.columns if c not in keys], F.monotonically_increasing_id())
    rows = df.select(order.alias("__order"), F.concat(F.lit("("), F.concat_ws(", ", *(_value(df, c) for c in df.columns)), F.lit(")")).alias("__row"))
    d = ranked(rows, "__order", "__rank").select(F.floor((F.col("__rank") - 1) / chunk).cast("long").alias("chunk"), F.struct("__rank", "__row").alias("s"))
    told = d.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x.getField("__row")), ",\n").alias("rows"))
    return told.select("chunk", F.concat(F.lit(f"INSERT INTO {_quoted(name)} VALUES\n"), "rows", F.lit(";")).alias("sql"))


def dump(spark: SparkSession, database: str, tables: dict[str, tuple[DataFrame, list[str]]], views: dict[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows place, name, chunk, sql of a database: tables (a DataFrame and its keys) by name, then views (their DDL) by name.

    place 0 is the header; a table's or view's DDL has chunk -1, before its rows; the footer comes last.
    Views lose their definer. A table without rows has its DDL alone. In order of place and chunk
    the pieces are the dump.
    """
    views = views or {}
    head = "\n".join([f"-- Database: {database}", f"-- Tables: {len(tables)}, views: {len(views)}", *_HEADER])
    names = sorted(tables)
    fixed = [(0, "", -1, head), *((k, n, -1, table_ddl(n, tables[n][0])) for k, n in enumerate(names, 1))]
    first = len(names) + 1
    out = spark.createDataFrame([*fixed, (first + len(views), "", -1, _FOOTER)], "place int, name string, chunk long, sql string")
    for k, n in enumerate(sorted(views), first):
        ddl = F.concat(F.lit(f"DROP VIEW IF EXISTS {_quoted(n)};\n"), strip_definer(F.lit(views[n])), F.lit(";"))
        out = out.unionByName(spark.range(1).select(F.lit(k).alias("place"), F.lit(n).alias("name"), F.lit(-1).cast("long").alias("chunk"), ddl.alias("sql")))
    for k, n in enumerate(names, 1):
        df, keys = tables[n]
        out = out.unionByName(inserts(n, df, keys, chunk).select(F.lit(k).alias("place"), F.lit(n).alias("name"), "chunk", "sql"))
    return out


def write_dump(pieces: DataFrame, path: str) -> None:
    """The dump as text files whose order is that of their names; a piece lies in one file whole."""
    pieces.repartitionByRange("place", "chunk").sortWithinPartitions("place", "chunk").select("sql").write.option("lineSep", "\n\n").text(path)
