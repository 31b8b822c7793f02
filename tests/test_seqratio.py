"""Sequence similarity of odd titles against difflib on all pairs, and of many titles in bounded time."""

import random
import time
from difflib import SequenceMatcher

from lectern.operators import linkage as L

FIELDS = "paper_id string, title string, year string", "item_id long, title string, year string"


def titles(n, seed):
    r = random.Random(seed)
    parts = ["the ", "en", "ciona", "ß. ", "er", "ai ", "mento", "über ", "o", "th"]
    return ["".join(r.choice(parts) for _ in range(r.randint(16, 28))) for _ in range(n)]


def changed(t, r):
    at = r.randint(0, len(t))
    return t[:at] + r.choice(["", "x", "zz", "中"]) + t[at + r.randint(0, len(t) // 5 + 1) :]


def test_odd_titles_against_all_pairs(spark):
    r = random.Random(3)
    base = titles(60, 1) + ["a" * 70, "a" * 66 + "b", "ab\0\0", "ab\0c", "中文" * 40, "x", "word " * 150, "".join(titles(26, 2)), "".join(map(chr, range(300, 700)))]
    p = [(f"p{k}", t, r.choice(["2001", "2002", "2064", "Unknown", None])) for k, t in enumerate([*base, *(changed(t, r) for t in base), ""])]
    i = [(k, t.upper() if t.upper().lower() == t else t, r.choice(["2001", "2002", "Unknown", None])) for k, t in enumerate([*base[::2], *(changed(t, r) for t in base), ""])]
    want = {}
    for name, t, year in p:
        scored = []
        for item, u, other in i:
            if t and u:
                s = round(SequenceMatcher(None, t.lower(), u.lower()).ratio() + (0.1 if year and year == other else 0.0), 6)
                scored += [(s, -item)] if s >= 0.8 else []
        if scored:
            want[name] = (-max(scored)[1], max(scored)[0])
    frames = spark.createDataFrame(p, FIELDS[0]), spark.createDataFrame(i, FIELDS[1])
    got = {x.paper_id: (x.item_id, x.score) for x in L.link_seqratio(*frames).collect()}
    assert got == want and len(got) > 100


def test_many_titles_in_bounded_time(spark):
    p = [(f"p{k}", t, str(2000 + k % 30)) for k, t in enumerate(titles(6_000, 5))]
    i = [(k, t, str(2000 + k % 20)) for k, t in enumerate([*titles(6_000, 6)[:5_999], p[7][1][:-1]])]
    began = time.time()
    got = {x.paper_id: x.item_id for x in L.link_seqratio(spark.createDataFrame(p, FIELDS[0]), spark.createDataFrame(i, FIELDS[1])).collect()}
    assert got["p7"] == 5_999 and time.time() - began < 100
