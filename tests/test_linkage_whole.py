"""The fuzzy title joins against all pairs in plain Python: no block may lose a link."""

from difflib import SequenceMatcher

import pytest

from lectern.functions.text import STOP_WORDS
from lectern.operators import linkage as L

DIR = "/root/testdata/sf0.001"
BASE = "deep learning for protein folding in small soil bacteria"
EXTRA = [
    f"Editorial: {BASE}", f"The {BASE}", BASE.replace("deep", "dxep"), "of the", "x", "folding in small soil bacteria", "A survey of wide joins",
    "survey of the wide joins", ""
]


@pytest.fixture(scope="module")
def sides(spark):
    from lectern.plans.adapter import items, papers

    p = [(r.paper_id, r.title, [r.author], r.year) for r in papers(spark, DIR).collect()]
    i = [(r.item_id, r.title, [r.author], r.year) for r in items(spark, DIR).collect()]
    p += [(f"e{k}", t, ["Ann"], str(2000 + k % 2)) for k, t in enumerate(EXTRA)]
    i += [(10_000 + k, t.upper(), ["ann"], "2000") for k, t in enumerate([BASE, "OF THE", *EXTRA[4:]])]
    frames = (
        spark.createDataFrame(p, "paper_id string, title string, authors array<string>, year string"),
        spark.createDataFrame(i, "item_id long, title string, authors array<string>, year string")
    )
    return frames, p, i


def words(t):
    return set(t.lower().split())


def contains(p, i):
    a, b = p[1].lower(), i[1].lower()
    return 0.0 if len(p[1]) > 20 and (a[:50] in b or b[:50] in a) else None


def jaccard_stop(p, i):
    x, y = words(p[1]) - set(STOP_WORDS), words(i[1]) - set(STOP_WORDS)
    o = round(len(x & y) / len(x | y), 6) if x and y else float(p[1].lower() == i[1].lower())
    return o if o >= 0.85 else None


def jaccard_author(p, i):
    x, y, a, b = words(p[1]), words(i[1]), p[2][0].lower(), i[2][0].lower()
    o = len(x & y) / len(x | y)
    return round(o + (0.2 if a in b or b in a else 0), 6) if o >= 0.7 else None


def seqratio(p, i):
    m = SequenceMatcher(None, p[1].lower(), i[1].lower())
    same = 0.1 if p[3] == i[3] else 0.0
    if m.real_quick_ratio() + same < 0.79 or m.quick_ratio() + same < 0.79:
        return None
    score = round(m.ratio() + same, 6)
    return score if score >= 0.8 else None


@pytest.mark.parametrize("rule", [contains, jaccard_stop, jaccard_author, seqratio])
def test_all_pairs(sides, rule):
    (papers, items), p, i = sides
    want = {}
    for x in p:
        scored = [(s, -y[0]) for y in i if x[1] and y[1] and (s := rule(x, y)) is not None]
        if scored:
            want[x[0]] = -max(scored)[1]
    got = {r.paper_id: r.item_id for r in getattr(L, f"link_{rule.__name__}")(papers, items).collect()}
    assert got == want and len(got) > 20


def test_registered_queries_pass_first_words(spark, tmp_path):
    """Papers 23 ('Editorial: '), 27 ('The ') and 29 (a typo in the first word) link to item 16."""
    import __spark_entry__ as entry

    texts = [(16, BASE), (23, BASE), (27, f"The {BASE}"), (29, BASE.replace("deep", "dxep"))]
    spark.createDataFrame([(i, f"{t}\nmore") for i, t in texts], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {
        k: {int(r.paper_id) for r in entry.queries()[f"link_{k}"](spark, str(tmp_path)).collect()}
        for k in ("contains", "jaccard_stop", "jaccard_author", "seqratio")
    }
    assert got == {"contains": {16, 23, 27}, "jaccard_stop": {16, 23, 27}, "jaccard_author": {16, 23, 27, 29}, "seqratio": {16, 23, 27, 29}}


@pytest.mark.parametrize("few", [0, 500_000])
def test_short_titles_are_found_whether_broadcast_or_not(spark, few):
    needles = spark.createDataFrame([("soil",), ("a",), ("deep learning for soil bacteria",), ("missing",)], "t string")
    hay = spark.createDataFrame([("on deep learning for soil bacteria",), ("soil",), ("bcd",)], "u string")
    got = {tuple(r) for r in L.held_in(needles, "t", hay, "u", few).collect()}
    whole = "on deep learning for soil bacteria"
    assert got == {("soil", whole), ("soil", "soil"), ("a", whole), ("deep learning for soil bacteria", whole)}
