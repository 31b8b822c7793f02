"""Scores, TEI, linkage, incremental runs, and the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import linkage as L
from lectern.operators import scoring as Q
from lectern.sources import tei
from lectern.streaming import incremental

DIR = "/root/testdata/sf0.001"
TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0">{}</TEI>'


def test_quality_example(spark):
    fields = (
        "title string, abstract string, venue string, year string, citations int, methods string, results string, introduction string, discussion "
        "string, num_references int, doi string, study_types array<string>, sample_sizes array<int>, p_values array<double>, intervals "
        "array<string>, effects array<double>, software array<string>, code array<string>, n_entities int, data_available boolean"
    )
    row = (
        "T", "A", "nature medicine", "2023", 25, "anova", "r", None, None, 0, None, ["randomized controlled trial"], [500], [0.01], ["95%"], [],
        ["R"], ["github.com/a/b"], 8, False
    )
    got = Q.total(Q.components(spark.createDataFrame([row], fields), 2025)).first()
    assert (got.study_type, got.sample_size, got.statistical_rigor, got.venue_quality, got.recency, got.citations, got.completeness, got.reproducibility) == (18, 9, 12, 15, 10, 4, 4, 3.5)
    assert (got.score, got.grade) == (75.5, "A-")


def test_tei(spark):
    cases = {
        "spaces": "<text><body><div><p><s>one</s><s>two <ref>[1]</ref> tail</s></p></div></body></text>",
        "nested": "<text><body><div><head>A</head><p>a</p><div><head>B</head><p>b</p></div></div></body></text>",
        "doi": '<text><back><listBibl><biblStruct><idno type="DOI">10.1/x</idno></biblStruct></listBibl></back></text>',
        "title": "<teiHeader><fileDesc><titleStmt><title>Foo <hi>bar</hi></title></titleStmt></fileDesc></teiHeader>",
        "bad": "<p>",
    }
    rows = {
        r.paper_id: r
        for r in tei.parse_tei(spark.createDataFrame([(k, TEI.format(v)) for k, v in cases.items()], "paper_id string, xml string")).collect()
    }
    assert rows["spaces"].sections[0].text == "one two  [1]  tail"
    assert [(s.title, s.text) for s in rows["nested"].sections] == [("A", "a\n\nb"), ("B", "b")]
    assert rows["doi"].doi == "10.1/x" and rows["title"].title == "Foo" and rows["bad"].parse_error


def test_links_keep_every_paper(spark):
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, k string")
    s = spark.createDataFrame([("a", 1), ("a", 5)], "k string, item_id int")
    assert sorted((r.id, r.r_item_id) for r in L.link_equal(p, s, "k", "item_id", "r_").collect()) == [(1, 5), (2, 5), (3, None)]


def test_fill_missing(spark):
    df = spark.createDataFrame([("", "x"), ("y", "z"), (None, None)], "a string, b string")
    assert [(r.a, r.n_filled) for r in L.fill_missing(df, {"a": "b"}).collect()] == [("x", 1), ("y", 0), (None, 0)]


def test_pending(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    done = spark.createDataFrame([("a", "tei", 2), ("b", "tei", 1)], "paper_id string, stage string, version int")
    assert [r.paper_id for r in incremental.pending(rows, done, "tei", 2).collect()] == ["b"]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "paper_id string, x int").write.json(str(tmp_path / "in"))
    for _ in range(2):
        incremental.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "paper_id string, x int").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


SAMPLE = [
    "doi_clean_shared", "exclusion_breakdown", "link_doi_then_title", "fill_missing", "sections_experimental", "entities_software", "quality_score",
    "coverage_fields", "session_windows"
]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    df = entry.queries()[name](spark, DIR)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(x) for x in df.columns]
    text = lambda r: str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v) for v in r])
    assert sorted(map(text, df.collect())) == sorted(text([r[i] for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_do_not_matter(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    one, many = (sorted(map(tuple, L.last_of_each(df.repartition(n), "k", "id").collect())) for n in (1, 9))
    assert one == many
