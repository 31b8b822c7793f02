"""Table-driven tests of scalar functions and rules."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import entities as E
from lectern.functions import text as T
from lectern.operators import classify as C
from lectern.operators import sections as S


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


CASES = [
    (
        T.doi_shared,
        {
            "10.1234/test": "10.1234/test", "https://doi.org/10.1234/test": "10.1234/test", "http://dx.doi.org/10.1234/test": "10.1234/test",
            "10.1234/test.": "10.1234/test", "10.1234/test)": "10.1234/test", "10.13039/funder": None, "not-a-doi": None, None: None, "": None,
            "10.1234/test.pdf": "10.1234/test", "10.1234/test).": "10.1234/test)",
            "10.1038/s41569-022-00690-0REvIEWS": "10.1038/s41569-022-00690-0REvIEWS"
        }
    ),
    (
        T.doi_aggressive,
        {
            "10.1038/s41569-022-00690-0REvIEWS": "10.1038/s41569-022-00690-0", "10.1016/0191-2607(82)90002-4.": "10.1016/0191-2607(82)90002-4",
            "10.12968/bjcn.2024.0022Date2024": "10.12968/bjcn.2024.0022"
        }
    ),
    (
        T.doi_lookup,
        {
            "10.1177/21650799231170872.From": "10.1177/21650799231170872", "10.2196/32714KEYWORDS": "10.2196/32714",
            "https://doi.org/10.1038/ABC": "10.1038/abc", "https://example.org/x": None
        }
    ),
    (T.header, {"2. Methods": "methods", "3.2 Results": "2 results", "III. RESULTS": "iii. results", "Methods:": "methods"}),
    (T.shard, {"PMC123456": "PM", "DOI_10.1234": "DO", "abc": "AB", "X": "XX", "": "XX"}),
    (lambda c: T.duration(c.cast("int")), {"30": "30 seconds", "90": "1.5 minutes", "3600": "1.0 hours", "7200": "2.0 hours"}),
    (lambda c: S.section_type(F.lower(c)), {"analysis results": "methods", "Data availability": "methods", "RESULTS": "results", "Misc": None}),
    (T.year_from_date, {"2021-05-01": 2021, "May 1999": 1999, "None": None, "1234": None}),
    (E.study_type, {"an arctic tale": "rct", "a cohort study": "cohort", "nothing": None}),
    (lambda c: C.article_category(c, F.lit("10.1/x")), {"Editorial: a": "other_non_articles", "Dataset of b": "datasets", "A study": "article"}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_table(spark, k):
    f, table = CASES[k]
    assert each(spark, f, list(table)) == list(table.values())


def test_header_twice(spark):
    assert each(spark, lambda c: T.header(T.header(c)), ["3.2 Results"]) == ["results"]


def test_entities(spark):
    text = (
        "We enrolled 120 patients (n = 120), p < 0.05 and P=0.01; 95% CI, OR = 1.5. SPSS version 26.0, NCT01234567 in May 2019 to June 2021, a 2 "
        "year follow-up of metformin."
    )
    row = spark.createDataFrame([(text,)], "t string").select(
        E.sample_sizes(F.col("t")).alias("n"), E.p_values(F.col("t")).alias("p"), E.ratios(F.col("t"), "OR").alias("o"),
        E.software(F.col("t")).alias("s"), E.distinct_of(F.col("t"), E.TRIAL, False).alias("c"), E.date_range(F.col("t")).alias("d"),
        E.study_duration(F.col("t")).alias("y"), E.distinct_of(F.col("t"), E.DRUG).alias("x")
    ).first()
    assert (row.n, row.p, row.o, row.s, row.c, row.d, row.y, row.x) == ([120], [0.01, 0.05], [1.5], ["SPSS"], ["NCT01234567"], "May 2019 - June 2021", "2", ["metformin"])
