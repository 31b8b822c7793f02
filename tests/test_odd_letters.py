"""Queries on entities and scores, against their SQL on what Java's patterns and lower case take otherwise: a vertical tab, a long s,
a Kelvin sign, a dotted capital I; and on null texts and keys of nine digits."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import entities as E

# A vertical tab is no white space, ſ and K stand for s and k in any case, ſ bounds a word as no letter of ASCII does, İ lowers to i.
ODD = (
    "n =\v20000", "20000\vpatients", "20000 ſubjects", "20000 participantſ", "ſample ſize of 20000", "p\v< 0.001", "p-valueſ < 0.001", "SPSS\v26",
    "ſPSS v 26", "ſAS 9", "ſR 4.1", "R\v4.1", "R verſion 4.1", "JAſP 1", "ſtata", "Mpluſ", "github.com/aſ/bK", "bitbucKet.org/a/b",
    "gitlab.com/aK/b", "doi.org/10.1/zenodo.1 ſ", "A meta-analysİs", "A rct, an edİtorİal", "regressİon", "data avaİlabİlity avaİlable",
    "A cohort study; Python\v3.9", "A cohort study; Python 3.9", "An edİtorİal on MİMİC-III and R 4.1", "mimic-iii R 4.1 ſ", "coKe Kohort", "",
)


def test_patterns_find_what_the_sql_finds(spark):
    """Every pattern of the entities with SQL, on every odd text, with DuckDB's own engine."""
    groups = [(E.SAMPLE_SIZE, 1), (E.P_VALUE, 1), (E.INTERVAL, 1), (E.CODE_URL, 0), (tuple(p for _, p in E.SOFTWARE), 0), ((r"\bs\w+\b", r"[^s\s]k"), 0)]
    groups += [(E.SOFTWARE_MENTION + E.FUNDING_MENTION + E.DATASET_MENTION, 1)]
    rows = spark.createDataFrame([(t + w,) for t in ODD for w in ("", " using ſas KK", " grant#ſ1-K xs sk ſk")], "t string")
    named = [(f"c{i}_{j}", p, g) for i, (patterns, g) in enumerate(groups) for j, p in enumerate(patterns)]
    got = rows.select("t", *(E.extracted(F.col("t"), p, g).alias(n) for n, p, g in named)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE odd AS SELECT unnest(?) AS t", [[r.t for r in got]])
    want = {r[0]: r[1:] for r in con.sql("SELECT t, " + ", ".join(f"regexp_extract_all(t, '(?i){p}', {g})" for _, p, g in named) + " FROM odd").fetchall()}
    for r in got:
        assert [list(x) for x in r[1:]] == [list(x) for x in want[r.t]], r.t


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Every odd text under many ids, so that each meets all made-up fields; null texts; ids of nine digits."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, f"Title {i}\n{ODD[i // 2 % len(ODD)]}") for i in range(2400)]
    rows += [(3000 + i, None) for i in range(400)] + [(900_000_000 + i, f"Title\n{ODD[i % 7]}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["entities_software", "entity_search", "quality_score", "quality_grade_hist", "discovery_filter"])
def test_same_as_sql(spark, texts, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{texts}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, texts)
    at = [want.columns.index(x) for x in got.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
