"""The paper views hand whole texts to the queries: what stands behind the first hundreds of characters is found."""

import pytest

import __spark_entry__ as entry

# The tail of a text of over 300, 520 and 2000 characters.
LATE = " A study of 777 participants, p < 0.042, took ramipril; NCT87654321; code at github.com/late/found & <more>."


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("late"))
    texts = [(i, "Some title\n" + "plain words " * 200 + LATE * (i % 2)) for i in (5, 11, 12, 17)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize(
    "name, want",
    [
        ("entities_sample_sizes", "777"), ("entities_drugs", "ramipril"), ("entities_trials", "NCT87654321"),
        ("entities_code_urls", "github.com/late/found")
    ]
)
def test_late_entities(spark, late, name, want):
    got = {int(r.paper_id): want in r.out.split(",") for r in entry.queries()[name](spark, late).collect()}
    assert got == {5: True, 11: True, 12: False, 17: True}


def test_late_p_values_and_links(spark, late):
    got = {int(r.paper_id): r.least for r in entry.queries()["entities_p_values"](spark, late).collect()}
    assert got == {5: 0.042, 11: 0.03, 12: 0.04, 17: 0.042}
    points = {int(r.paper_id): r.reproducibility_points for r in entry.queries()["quality_components"](spark, late).collect()}
    # A code link and 'github' in the whole abstract: 3.5, and 1 more for software (Excel) in the tails of 5, 11 and 17; 12 has its tail's link, software and statement.
    assert {i: points[i] for i in (5, 11, 17)} == dict.fromkeys((5, 11, 17), 4.5)


def test_late_tei(spark, late):
    rows = {int(r.paper_id): r.text for r in entry.queries()["tei_sections"](spark, late).collect()}
    assert len(rows) == 4 and all((LATE.strip() in t) == (i % 2 == 1) for i, t in rows.items())
