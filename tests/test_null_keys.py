"""Scores against their SQL on papers without a key, whose made-up fields are null: their completeness and grade are."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("keys"))
    told = ("A meta-analysis\nof github 4", "A cohort study", "Nothing", "", None)
    rows = [(None if i % 3 else i, told[i % 5]) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["quality_grade_hist", "quality_score", "quality_components", "strengths_weaknesses"])
def test_same_as_sql(spark, texts, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{texts}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, texts)
    at = [want.columns.index(x) for x in got.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
