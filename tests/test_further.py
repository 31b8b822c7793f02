"""Further payloads, mentions, gaps and averages on small tables with nulls, ties and empty input."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.operators import sections as S
from lectern.operators import selection as X
from lectern.sources import payloads

ENTRY = """<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><id>http://arxiv.org/abs/math/0301001v2</id><title> T </title><published>2020-01-02T00:00:00Z</published>
<updated>2020-01-02T00:00:00Z</updated><author><name>A</name></author><arxiv:primary_category term="b"/><category term="a"/><category term="b"/></entry>"""


def test_paper_payload(spark):
    full = {
        "paperId": "x", "externalIds": {"DOI": "10.1/a"}, "year": 2001,
        "authors": [{"name": "A", "hIndex": 0}, {"name": "B", "hIndex": 7}, {"name": "", "hIndex": 90}],
        "citations": [{"title": f"t{i}"} for i in range(12)]
    }
    rows = spark.createDataFrame([(1, json.dumps(full)), (2, "{}"), (3, None)], "id int, payload string")
    a, b, c = payloads.flat_paper(rows).orderBy("id").collect()
    assert (a.doi, a.year, a.max_author_h_index, len(a.authors), len(a.citation_titles)) == ("10.1/a", "2001", 7, 2, 10)
    assert (b.graph_id, b.citation_count, b.is_open_access, b.max_author_h_index, b.title) == ("", 0, False, None, None)
    assert c.citation_count == 0
    assert payloads.flat_paper(rows.limit(0)).count() == 0


def test_repository_payload(spark):
    works = [
        {"id": 5, "downloadUrl": "u.pdf", "language": {"name": "English"}, "fullText": "x", "links": [{"url": None}, {"url": "l"}]},
        {"language": "fr", "downloadUrl": "", "downloadCount": 0}, {"language": {"code": "de"}}
    ]
    rows = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(works)], "id int, payload string")
    a, b, c = payloads.flat_repository_work(rows).orderBy("id").collect()
    assert (a.has_pdf, a.language, a.has_fulltext, len(a.links)) == (True, "English", True, 1)
    assert (b.has_pdf, b.language, b.has_fulltext, b.download_count) == (None, "fr", False, None)
    assert c.language is None


def test_entry_payload_and_feed(spark, tmp_path):
    rows = spark.createDataFrame([(1, ENTRY), (2, "<entry/>")], "id int, payload string")
    a, b = payloads.flat_entry(rows).orderBy("id").collect()
    assert (a.title, a.arxiv_id, a.version, a.categories, a.last_updated, a.first_submitted) == ("T", "math/0301001", 2, ["b", "a"], None, "2020-01-02")
    assert (b.title, b.arxiv_id, b.version, b.categories) == ("", None, None, [])
    (tmp_path / "feed.xml").write_text(f"<feed>{ENTRY}{ENTRY}</feed>")
    assert [r.pdf_url for r in payloads.read_feed(spark, str(tmp_path)).collect()] == ["https://arxiv.org/pdf/math/0301001.pdf"] * 2


def test_author_names(spark):
    schema = "named array<struct<name: string>>, plain array<string>"
    rows = spark.createDataFrame([([("A",), (None,)], ["x"]), ([], ["x"]), (None, []), (None, None)], schema)
    assert [r[0] for r in rows.select(payloads.author_names(F.col("named"), F.col("plain"))).collect()] == [["A"], ["x"], [], []]


def test_mentions_and_header_parts(spark):
    text = "We ran it using SciPy v1.2 and using SciPy; grant: AB-1, p = 0.03, p = 0.03, n = 40 at https://x.org/a"
    rows = spark.createDataFrame([(text,), ("",)], "t string")
    a, b = rows.select(*E.mentions(F.col("t"))).collect()
    assert (a.software, a.funding, a.p_values, a.sample_sizes, a.urls) == (["SciPy"], ["AB-1"], ["0.03", "0.03"], ["40"], ["https://x.org/a"])
    assert all(x == [] for x in b)
    heads = spark.createDataFrame([("Results and Discuss",), ("Method",), (None,)], "h string")
    assert [r[0] for r in heads.select(S.header_parts(F.col("h"))).collect()] == [["results", "discussion"], ["methods"], None]


def test_moving_average_follows_every_value(spark):
    values = {"a": [3.0], "b": [1.0, 5.0, None, 2.0], "c": [float(i % 17) for i in range(500)]}
    rows = spark.createDataFrame([(k, i, v) for k, x in values.items() for i, v in enumerate(x)], "k string, i int, v double")
    got = {r.k: r.ema for r in X.moving_average(rows, "k", ["i"], "v").collect()}
    for k, x in values.items():
        want, *rest = [v for v in x if v is not None]
        for v in rest:
            want = 0.3 * v + 0.7 * want
        assert got[k] == pytest.approx(want, rel=1e-12)
    assert X.moving_average(rows.limit(0), "k", ["i"], "v").count() == 0


def test_gaps(spark):
    found = spark.createDataFrame([("1", "s", "R"), ("1", "s", "R"), ("2", "s", "R"), ("2", "s", "x")], "paper_id string, kind string, entity string")
    wanted = spark.createDataFrame([("s", "R"), ("s", "Julia"), ("s", "R")], "kind string, entity string")
    assert {(r.entity, r.papers) for r in X.entity_coverage(found, wanted).collect()} == {("R", 2), ("Julia", 0)}
    rows = (
        spark.createDataFrame(
            [(1, True, False, 90), (2, True, True, 59), (3, True, True, 60), (4, None, True, 99)],
            "id int, has_code boolean, has_data boolean, score int"
        )
    )
    ids = lambda x: sorted(r.id for r in x.collect())
    assert (ids(X.reproducible(rows)), ids(X.reproducible(rows, "code")), ids(X.reproducible(rows, "data"))) == ([3], [1, 3], [3, 4])
    sizes = (
        spark.createDataFrame([(1, [5, 2000], "RCT"), (2, [], "rct"), (3, None, "rct"), (4, [1000], None)], "id int, sample_sizes array<int>, study_type string")
    )
    assert (ids(X.large_studies(sizes)), ids(X.large_studies(sizes, 1000, "rct"))) == ([1, 4], [1])
