"""Fixed tables against literal values, so that a changed table cannot pass on both sides of a comparison."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.functions import text as T
from lectern.operators import scoring as Q
from lectern.operators import sections as S


def one(spark, out, text):
    return spark.createDataFrame([(text,)], "t string").select(out(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("SPSS version 26.0", ["SPSS"]), ("SPSS v26.0 was used", ["SPSS 26.0"]), ("MATLAB R2019a", ["MATLAB MATLAB R2019a"]),
    ("Microsoft Excel", ["Excel Microsoft Excel"]),
    ("R version 4.1 and Python 3.9", ["R 4.1", "Python 3.9"]), ("Stata v 16", ["Stata 16"]), ("nothing", []),
])
def test_software(spark, text, want):
    assert one(spark, E.software, text) == want


@pytest.mark.parametrize("name, want", [
    ("Problem statement", "introduction"), ("Sample size calculation", "methods"), ("Secondary outcome", "results"),
    ("Study limitation", "discussion"), ("Clinical recommendation", "conclusion"), ("Acknowledgements", "other"),
])
def test_wide_headers(spark, name, want):
    rows = spark.createDataFrame([("p", 1, name, "text")], "paper_id string, pos int, header string, content string")
    assert [r.type for r in S.sections_wide(rows).collect()] == [want]


@pytest.mark.parametrize("raw, want", [
    ("10.1234/test", "10.1234/test"), ("https://doi.org/10.1234/test", "10.1234/test"), ("http://dx.doi.org/10.1234/test", "10.1234/test"),
    ("10.1234/test.", "10.1234/test"), ("10.1234/test)", "10.1234/test"),
    ("10.13039/funder", None), ("not-a-doi", None), ("", None), (None, None), ("10.1234/test.pdf", "10.1234/test"),
    ("10.1234/test).", "10.1234/test)"), ("10.1038/s41569-022-00690-0REvIEWS", "10.1038/s41569-022-00690-0REvIEWS"),
])
def test_shared_doi(spark, raw, want):
    assert one(spark, T.doi_shared, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("10.1177/21650799231170872.From", "10.1177/21650799231170872"), ("10.2196/32714KEYWORDS", "10.2196/32714"),
        ("https://doi.org/10.1038/ABC", "10.1038/abc"), ("https://example.org/x", None)
    ]
)
def test_lookup_doi(spark, raw, want):
    assert one(spark, T.doi_lookup, raw) == want


@pytest.mark.parametrize("n, want", [(30, "30 seconds"), (90, "1.5 minutes"), (3600, "1.0 hours"), (7200, "2.0 hours")])
def test_durations(spark, n, want):
    assert spark.range(1).select(T.duration(F.lit(n)).alias("x")).first().x == want


@pytest.mark.parametrize("key, want", [("PMC123456", "PM"), ("DOI_10.1234", "DO"), ("abc", "AB"), ("X", "XX"), ("", "XX")])
def test_shards(spark, key, want):
    assert one(spark, T.shard, key) == want


def test_worked_score(spark):
    row = {
        "title": "t", "abstract": "a", "venue": "Nature Medicine", "year": "2023", "citations": 25, "methods": "We used ANOVA", "results": "r",
        "introduction": "", "discussion": "", "doi": "", "num_references": 0, "n_entities": 8,
        "study_types": ["randomized controlled trial"], "sample_sizes": [500], "p_values": [0.01], "intervals": ["95%"], "effects": [],
        "software": ["R"], "code": ["github.com/a/b"], "data_available": False,
    }
    kinds = (
        "title string, abstract string, venue string, year string, citations int, methods string, results string, introduction string, discussion "
        "string, doi string, num_references int, n_entities int, study_types array<string>, sample_sizes array<long>, p_values array<double>, "
        "intervals array<string>, effects array<double>, software array<string>, code array<string>, data_available boolean"
    )
    rows = spark.createDataFrame([tuple(row.values())], kinds)
    got = {y: Q.total(Q.components(rows, y)).first() for y in (2025, 2023)}
    assert (got[2025].score, got[2025].grade, got[2023].score) == (75.5, "A-", 79.5)
    assert (got[2025].study_type, got[2025].sample_size, got[2025].statistical_rigor, got[2025].venue_quality, got[2025].citations) == (18, 9, 12, 15, 4)


def test_venues_and_populations():
    assert len(Q.TOP_VENUES) == 14 and Q.TOP_VENUES[-1] == "nature methods"
    assert Q.expanded("care for older adults") == ["care for older adults", "elderly", "geriatric", "older adults", "seniors", "aging"] and Q.expanded("x") == ["x"]
