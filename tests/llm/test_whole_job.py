"""What must hold at any size or form of input: hot keys, long texts, budgets, clashing names, empty tables."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import decontam, embed_dedup, line_dedup, mixing, pii, quality, secret_scan, simhash, token_output, toxicity
from lectern.llm.queries import tokenizer_path

CLASH = (
    "row", "h", "owner", "repository", "y", "shard", "block", "place", "places", "key", "value", "k", "fp", "rep", "n", "v", "own", "a", "b", "found",
    "base", "more", "votes", "size", "target", "taken", "copies", "score", "bin", "f", "x", "node", "label", "last"
)


# --- line dedup --------------------------------------------------------------------------------------------------------
def test_dealt_lines_agree_with_broadcast_ones(spark):
    rng = np.random.default_rng(3)
    lines = [f"this is line number {i} of a long list" for i in range(40)] + ["short", ""]
    rows = (
        [(int(i) if i % 9 else None, "\n".join(["A hot line that every document holds", *rng.choice(lines, 6)])) for i in range(1, 160)]
        + [(5, None), (500, "x\n" * 300 + lines[0])]
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(map(repr, line_dedup.line_dedup(docs).collect()))
    for places in (1_000_000, 3):  # three rows a place: hot shards are copied to many places
        assert sorted(map(repr, line_dedup.line_dedup(docs, broadcast_bound=0, place_rows=places).collect())) == want
    assert line_dedup.line_dedup(docs.limit(0), broadcast_bound=0).count() == 0


# --- personal data ------------------------------------------------------------------------------------------------------
def test_span_classifier_accepts_some_and_rejects_others_of_a_kind(spark):
    rng = np.random.default_rng(1)
    number = lambda: f"{rng.integers(200, 989)} 555 {rng.integers(1000, 9999)}"
    kinds = {
        "call": lambda i: f"Please call {number()} today.", "order": lambda i: f"Order {rng.integers(10**8, 10**9)} was sent",
        "invoice": lambda i: f"invoice no {rng.integers(10**8, 10**9)} paid",
        "plus": lambda i: f"ring +1 415 555 {rng.integers(1000, 9999)} now", "words": lambda i: f"write jo{i} [at] site [dot] com please",
        "bare": lambda i: f"see foo{i}@bar here", "mail": lambda i: f"mail a{i}@b.org",
        "version": lambda i: f"version 1.2.{rng.integers(256, 999)}.4 of it", "host": lambda i: f"host 93.184.{rng.integers(1, 254)}.34 up",
    }
    rows = [(i, name, kinds[name](i)) for i, name in enumerate(list(kinds) * 30)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, kind string, text string")).collect()}
    added = {name: [got[i].n_added for i, n, _ in rows if n == name] for name in kinds}
    assert set(added["call"]) == {1} and set(added["order"]) == set(added["invoice"]) == {0}, "phone numbers"
    assert set(added["words"]) == {1} and set(added["bare"]) == {0} and set(added["version"]) == {0}
    assert all(r.spans.startswith("phone:") for i, r in got.items() if rows[i][1] == "call")


def test_reliabilities_of_known_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.4
    reliable = {0: (0.95, 0.02), 1: (0.8, 0.2), 2: (0.5, 0.1), 3: (0.6, 0.2), 4: (0.0, 0.0)}  # chance of a vote for, if true and if false

    def votes(j):
        up = rng.random(6000) < np.where(truth, *reliable[j])
        return np.where(up, 1, 0 if j in (2, 4) else -1)

    each = np.stack([votes(j) for j in range(5)], 1)
    patterns, n = np.unique(each, axis=0, return_counts=True)
    post, theta, rate = pii.reliabilities(patterns, np.zeros(len(n), int), n.astype(float))
    at = {tuple(p): q for p, q in zip(patterns.tolist(), post, strict=True)}
    assert np.mean([(at[tuple(v)] > 0.5) == t for v, t in zip(each.tolist(), truth, strict=True)]) > 0.93
    assert rate[0] == pytest.approx(0.4, abs=0.06) and theta[0, 1, 1, 2] > 0.6 > 0.4 > theta[0, 1, 0, 2]
    assert np.allclose(theta.sum(-1), 1) and theta[0, 4, :, 1].min() > 0.7  # one that always abstains


def test_candidates_take_time_in_proportion():
    times = []
    for n in (20_000, 80_000):
        text = "".join(f"u{i}@mail.org, " for i in range(n))
        began = time.time()
        found = pii.candidates(text, pii.base_spans(text))
        times.append(time.time() - began)
        assert len(found) == n
    assert times[1] < 8 * times[0] + 1


# --- mixing -------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.floats(0, 3))
def test_quota_is_as_near_as_any_subset(sizes, share):
    lengths, counts = (np.array(x) for x in zip(*sorted(sizes), strict=True))
    total = int((lengths * counts).sum())
    want = round(total * share)
    copies, take = mixing.quota(lengths, counts, total * share)
    assert (take >= 0).all() and (take <= counts).all() and (copies < 3 or not take.any())
    sums = {0}
    for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + k * length for s in sums for k in range(count + 1)}
    whole = min(want // total, 3)
    below = max(s for s in sums if whole * total + s <= want) if whole < 3 else 0
    assert abs(copies * total + int((take * lengths).sum()) - want) <= abs(whole * total + below - want)


def test_quota_of_books_and_of_a_large_source():
    assert mixing.quota(np.array([100_000, 390_000]), np.array([4, 1]), 500_000)[1].tolist() == [1, 1]
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(1, 30_000, 8000))
    counts = rng.integers(1, 5000, len(lengths))
    total = int((lengths * counts).sum())
    copies, take = mixing.quota(lengths, counts, 0.37 * total)
    assert abs(int((take * lengths).sum()) - 0.37 * total) <= 1 and copies == 0


def test_mix_of_ties_repeats_and_nulls(spark):
    rows = [(1, "a b", "s")] * 6 + [(None, "a b", "s"), (2, None, "s"), (3, "", None), (4, "x " * 5000, "t"), (5, "c d", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and {r.taken for r in got if r.size == 0} == {0} and all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(3)).collect()))
    assert {(r.source, r.source_size, round(r.target)) for r in got} == {("s", 14, 42), ("t", 5002, 4974), (None, 0, 0)}


# --- embeddings ---------------------------------------------------------------------------------------------------------
def test_plan_is_calibrated():
    rng = np.random.default_rng(5)
    sample = rng.standard_normal((500, 64))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    tables = []
    for n in (100, 10**6, 10**8):
        p, lines = embed_dedup.plan(n, 0.95, sample, 11)
        assert 19 <= p["count"] <= 24 and lines.shape == (64, p["tables"] * (1 + p["bits"]) + embed_dedup.COUNTED)
        tables.append(p["tables"])
    assert tables[0] < tables[1] < tables[2] <= 60
    assert embed_dedup.plan(10, 0.95, np.ones((4, 1)), 11)[0]["tables"] >= 1  # one dimension has no other direction


def test_embeddings_odd(spark):
    kinds = "vec_id long, embedding array<float>, " + ", ".join(f"{c} string" for c in CLASH)
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (None, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]),
        (7, [float("inf"), 1.0]), (8, [1.0]), (9, [-1.0]), (10, [])
    ]
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], kinds)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_near_duplicates(docs).collect())
    assert got == [
        (-1, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
        (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)
    ]
    assert embed_dedup.embedding_near_duplicates(docs.limit(0)).count() == 0


# --- all of them, on a table whose names clash -----------------------------------------------------------------------------
LONG = "A sentence of a very long text with jo@mail.org in it.\n" * 8000
ROWS = [
    (1, "one two three four five", "s"), (1, "one two three four five", "s"), (2, "", "s"), (3, None, None), (None, "one two three four five", "t"),
    (4, LONG, "t"), (5, 'token = "abcdefgh1234" and mail jo@mail.org', "u")
]


@pytest.fixture(scope="module")
def clash(spark):
    kinds = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, "en", *CLASH) for r in ROWS], kinds)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, 1, 1), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("i1", "Two, three FOUR"), ("i2", None), (None, "five"), ("i3", "...")], "item_id string, text string")


def by_id(rows, *names):
    return sorted(((r.doc_id if r.doc_id is not None else -1, *(r[n] for n in names)) for r in rows.collect()), key=repr)


def test_values_on_clashing_names(clash, labels, bench):
    lines = LONG.count("\n") + 1
    assert by_id(line_dedup.line_dedup(clash), "n_lines", "n_dropped") == [(-1, 1, 1), (1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (4, lines, 0), (5, 1, 0)]
    assert [x[:2] for x in by_id(pii.find_pii(clash), "n_email")] == [(-1, 0), (1, 0), (1, 0), (2, 0), (3, 0), (4, 8000), (5, 1)]
    assert by_id(secret_scan.find_secrets(clash), "n_assign", "base_live_spans") == [(-1, 0, ""), (1, 0, ""), (1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 1, "assign:0:21")]
    assert by_id(decontam.decontaminate(clash, bench), "n_words", "n_hit", "n_items", "contaminated") == [
        (-1, 5, 4, 1, True), (1, 5, 4, 1, True), (1, 5, 4, 1, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 8000 * 13, 0, 0, False),
        (5, 7, 0, 0, False)
    ]
    prints = {r.doc_id: r for r in simhash.simhash_near_duplicates(clash).collect()}
    assert prints[2].fingerprint == prints[3].fingerprint == "0" * 16 and prints[3].component_id == 2 and prints[None].component_id == 1 and prints[4].component_id == 4
    tokens = by_id(token_output.token_output(clash, tokenizer_path()), "start", "n_tokens")
    assert len(tokens) == len(ROWS) and [x[2] for x in tokens if x[0] in (2, 3)] == [1, 1] and min(x[1] for x in tokens) == 0
    for out in (quality.score_quality(clash, labels), toxicity.score_toxicity(clash, labels)):
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 1}) == 1
        assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_stages_hand_on_whole_rows(clash, labels, bench):
    whole = lambda df: sorted(repr(r) for r in df.collect())
    before = whole(clash)
    for kept in (quality.accepted(clash, labels), simhash.one_of_each(clash), decontam.clean_only(clash, bench)):
        assert kept.columns == clash.columns and set(whole(kept)) <= set(before)
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else -1) for r in df.collect())
    assert ids(decontam.clean_only(clash, bench)) == [2, 3, 4, 5] and ids(decontam.clean_only(clash, bench.limit(0))) == ids(clash)
    assert ids(simhash.one_of_each(clash)) == [1, 2, 4, 5]
    assert set(whole(mixing.mixed(clash))) <= set(before) and quality.accepted(clash, labels.limit(0)).count() == len(ROWS)
    for f in (lambda d: quality.accepted(d, labels), simhash.one_of_each, lambda d: decontam.clean_only(d, bench), mixing.mixed):
        assert f(clash.limit(0)).count() == 0


def test_long_texts_are_whole(spark):
    text = "u1@mail.org, " * 50_000
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == 50_000 and r.spans.count("email:") == 50_000


def test_proximity_counts_every_place(spark, bench):
    docs = spark.createDataFrame([(1, "two x three four two three four")], "doc_id long, text string")
    assert {(r.item_id, r.position) for r in decontam.proximity_matches(docs, bench, slack=1).collect() if r.item_id == "i1"} >= {("i1", 4)}
