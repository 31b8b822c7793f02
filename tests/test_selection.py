"""Selections and payloads on small tables with nulls, ties and empty input."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import selection as X
from lectern.sources import payloads

PAPERS = "paper_id string, title string, abstract string"
SECTIONS = "paper_id string, header string, content string"


def test_structure_class(spark):
    papers = spark.createDataFrame(
        [
            ("a", "A study of x", "y" * 600), ("b", "Editorial: z", "y" * 600), ("c", "A review of x", "y" * 600), ("d", "x", None),
            ("e", "A theory of x", "y" * 600), ("f", "x", "y" * 6000)
        ],
        PAPERS
    )
    sections = spark.createDataFrame([("a", "Methods", "m"), ("a", "Misc", None), ("f", "Misc", "We saw p < 0.05 here. " + "w" * 100)], SECTIONS)
    got = {r.paper_id: (r.structure, r.reason) for r in X.structure_class(papers, sections).collect()}
    assert got == {
        "a": ("IMRaD", "has_methods_with_study_design"), "b": ("rejected", "likely_not_paper"), "c": ("non-IMRaD", "review_article"),
        "d": ("rejected", "no_content"), "e": ("non-IMRaD", "theoretical_paper"), "f": ("IMRaD", "partial_imrad_structure"),
    }
    assert X.structure_class(papers.limit(0), sections.limit(0)).count() == 0


def test_cascade_counts_every_row_once(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(20)], "i int, v int")
    got = {r.stage: r.removed for r in X.cascade(rows, [("null", F.col("v").isNull()), ("small", F.col("v") < 5)]).collect()}
    assert got == {"null": 4, "small": 4, "kept": 12}


def test_filters(spark):
    rows = spark.createDataFrame(
        [("a", ["rct"], [50, 900], [0.01], ["r", "python"], ["mimic"], "2021"), ("b", ["rct"], [], None, None, [], None)],
        "paper_id string, study_types array<string>, sample_sizes array<int>, p_values array<double>, software array<string>, datasets "
        "array<string>, year string"
    )
    assert X.entity_search(rows).count() == 2 and X.entity_search(rows, "rct").count() == 2
    assert [r.paper_id for r in X.entity_search(rows, "rct", 500, 0.05, ["python", "r"], ["mimic"], 2020).collect()] == ["a"]
    found = spark.createDataFrame(
        [("a", 70, "2022", 3, "Ann Lee"), ("b", 90, "2022", 3, "Bo"), ("c", 90, None, 3, "Ann Lee")],
        "paper_id string, score int, year string, citations int, author string"
    )
    assert {r.paper_id for r in X.discover(found, found.where("paper_id = 'b'"), "MEDIUM").collect()} == {"a"}
    assert {r.paper_id for r in X.discover(found, authors=["ann"]).collect()} == {"a"}
    with pytest.raises(ValueError):
        X.discover(found, authors=list("abcdef"))


def test_corrections_and_most_cited(spark):
    rows = spark.createDataFrame([("a", "old"), ("b", None), (None, "x")], "paper_id string, doi string")
    new = spark.createDataFrame([("a", "n1"), ("a", "n2")], "paper_id string, new string")
    assert {(r.paper_id, r.doi, r.was_corrected) for r in X.corrected(rows, new, "paper_id", "doi").collect()} == {("a", "n2", True), ("b", None, False), (None, "x", False)}
    cited = spark.createDataFrame([("a", "J2"), ("a", "J1"), ("a", None), ("b", "J3"), ("b", "J3"), ("b", "J1")], "paper string, journal string")
    assert {tuple(r) for r in X.most_cited(cited, "paper", "journal").collect()} == {("a", "J1", 1), ("b", "J3", 2)}


def test_payloads(spark):
    work = {
        "DOI": "10.1/x", "title": [], "abstract": "<p>A  <b>b</b></p>", "issued": {"date-parts": [[2020, 3]]},
        "author": [{"family": "Li"}, {"given": "Ann", "family": "Lee", "ORCID": "o"}], "reference": [{"DOI": str(i)} for i in range(150)] + [{}]
    }
    rows = spark.createDataFrame([("a", json.dumps(work)), ("b", None), ("c", "{broken"), ("d", "{}")], "paper_id string, payload string")
    got = {r.paper_id: r for r in payloads.flat_work(rows).collect()}
    assert (got["a"].doi, got["a"].title, got["a"].abstract, got["a"].issued, got["a"].authors, len(got["a"].references), got["a"].has_orcid) == ("10.1/x", None, "A b", "2020-03", ["Li", "Ann Lee"], 100, True)
    assert all(got[k].doi is None and got[k].issued is None for k in "bcd")
    graph = {
        "doi": "https://doi.org/10.1/x", "topics": [{"display_name": x} for x in "abcd"],
        "authorships": [{"author": {"display_name": "P"}, "institutions": [{"display_name": "I"}]}] * 2,
        "counts_by_year": [{"year": 2020, "cited_by_count": 4}]
    }
    r = payloads.flat_graph_work(spark.createDataFrame([("a", json.dumps(graph)), ("b", None)], "paper_id string, payload string")).orderBy("paper_id").first()
    assert (r.doi, r.topics, r.institutions, r.citations_by_year) == ("10.1/x", ["a", "b", "c"], ["I"], {2020: 4})
