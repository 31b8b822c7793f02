"""Ownership of base and further candidates, with owners and repositories counted apart."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from lectern.llm import secret_scan

COPIED, OWN = 'token = "abcdefgh12"', "AKIA" + "B7C8" * 4
ROWS = [
    (1, f"x {COPIED} y {OWN}", "en", "a"), (2, f"{COPIED}", "en", "b"), (3, f"{COPIED} {'0f' * 16}", "en", "c"), (4, OWN, "fr", "a"),
    (5, "nothing", "en", "d"), (6, None, "en", "d")
]
SCHEMA = "doc_id long, text string, lang string, source string"


def test_base_candidates_are_judged(spark):
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {i: (r.n_base_live, r.n_base_example) for i, r in got.items()} == {1: (1, 1), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 0)}
    assert (got[1].base_live_spans, got[1].base_example_spans) == ("access:25:45", "assign:2:21")
    for r in got.values():
        assert sorted(filter(None, r.spans.split(","))) == sorted(filter(None, f"{r.base_live_spans},{r.base_example_spans}".split(",")))


def test_owners_and_repositories_both_decide(spark):
    """Three owners of one repository are no wide copy, nor are three repositories of one owner."""
    key = "ghp_" + "Zz09" * 9
    for n, m, examples in ((3, 1, 0), (1, 3, 0), (3, 3, 6), (2, 6, 0)):
        rows = spark.createDataFrame([(i, key, f"o{i % n}", f"r{i % m}") for i in range(6)], "doc_id long, text string, source string, lang string")
        out = secret_scan.find_secrets(rows, repository=F.col("lang")).agg(F.sum("n_example"), F.sum("n_live")).first()
        assert tuple(out) == (examples, 6 - examples)


def test_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, held = docs.collect(), defaultdict(lambda: (set(), set()))
    values = lambda t: [m[g] for _, p, g, n in secret_scan.BASE for m in re.finditer(p, t or "") if len(m[g]) >= n]
    for r in rows:
        for v in values(r.text):
            held[v][0].add(r.source)
            held[v][1].add((r.source, r.lang))
    want = {r.doc_id: sum(min(map(len, held[v])) >= secret_scan.SPREAD for v in values(r.text)) for r in rows}
    got = {r.doc_id: (r.n_base_example, r.n_base_live + r.n_base_example) for r in secret_scan.find_secrets(docs).collect()}
    assert got == {r.doc_id: (want[r.doc_id], len(values(r.text))) for r in rows} and any(n for _, n in got.values())
