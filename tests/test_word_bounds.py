"""Queries whose patterns bound words, against their SQL on texts where a letter beyond ASCII stands before an R ("für 7")."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import entities as E


def test_bounds_are_of_ascii_words(spark):
    rows = [("für 7",), ("für R 8",), ("xR 9",), ("_R 9",), ("R 1.",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(E.software(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [["R 7"], ["R 8"], [], [], ["R 1."], []]
    ends = spark.createDataFrame([("4ü",), ("4a",), ("a4 4",)], "t string").select(E.found(F.col("t"), (r"4\b",), 0).alias("n")).collect()
    assert [len(r.n) for r in ends] == [1, 0, 2]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bounds"))
    spark.createDataFrame([(i, f"Der Wert {i}\nfür 7") for i in range(800)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["entities_software", "entity_search", "quality_score", "quality_grade_hist", "discovery_filter"])
def test_same_as_sql(spark, texts, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{texts}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, texts)
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
