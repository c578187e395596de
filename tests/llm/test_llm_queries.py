"""SQL of the training-data queries on DuckDB, and the pipeline's stages."""

import duckdb

import corpus_pipeline
from archloom.llm.common import written
from archloom.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


def test_ten_queries_and_the_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_keep_documents_and_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), f"test-{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            assert docs.where("text is null or n_chars <> char_length(text)").count() == 0
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert n >= docs.select("doc_id").distinct().count() > 0
