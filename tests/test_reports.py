"""Reports over tables whose totals reach units and thousands that the given tables don't."""

import duckdb
import pytest
from pyspark.sql import functions as F

from archloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chars", [1_020_000, 1_023_456_789, 1_700_000_000, 1_234_567_890_123])
@pytest.mark.parametrize("name", ["readme_text", "report_lines"])
def test_sizes_say_what_the_sql_says(spark, tmp_path, name, chars):
    spark.read.parquet(f"{SF}/pages.parquet").limit(9).write.parquet(f"{tmp_path}/pages.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id in (1, 9)")
    docs.withColumn("n_chars", F.when(F.col("doc_id") == 1, F.lit(chars)).otherwise(0)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLE_SQL[name]).fetchall())
