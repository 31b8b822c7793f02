"""The corpus operators against brute force and round trips, and on odd tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import decontam, embed_dedup, line_dedup, mixing, pii, quality, secret_scan, simhash, token_output, toxicity
from lectern.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, k int"
LONG = "word " * 60_000
ROWS = [
    (1, None, None, None, None, 1.0, "x", 1), (2, "", "en", "a", 0, None, None, None), (3, "\n \n", "en", "a", 3, None, None, None),
    (4, LONG, "en", "b", 1, None, None, None), (5, "same text here for all of us", "en", "b", 1, None, None, None),
    (5, "same text here for all of us", "en", "b", 1, None, None, None), (6, "same text here for all of us", "en", None, 1, None, None, None),
    (None, "no id", "en", "c", 1, None, None, None)
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 1, 0), (4, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("1", "Same text HERE"), ("2", None), ("3", "...")], "item_id string, text string")


def test_odd_and_empty_tables(odd, none, labels, bench):
    for docs in (odd, none):
        n = docs.count()
        for out in (
            quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels), line_dedup.line_dedup(docs), pii.find_pii(docs),
            mixing.mix_sources(docs), token_output.token_output(docs, tokenizer_path()), simhash.simhash_near_duplicates(docs),
            decontam.decontaminate(docs, bench), secret_scan.find_secrets(docs)
        ):
            assert len(out.collect()) == n
        for kept in (quality.accepted(docs, labels), simhash.one_of_each(docs), decontam.clean_only(docs, bench), mixing.mixed(docs)):
            assert kept.columns == docs.columns and kept.count() <= 3 * n


def test_no_labels(odd, labels, bench):
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert all(0 <= r.score <= 1 for r in f(odd, labels.limit(0)).collect())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300) | st.just(1), max_size=600))
def test_simple8b_round_trip(ids):
    v = np.array(ids, np.uint64)
    assert (token_output.decode_block(token_output.encode_block(v), len(v)) == v).all()
    _, table, got = token_output.unpack(token_output.pack([(7, v[:3]), (9, v[3:])], 0, 0, 100))
    assert (got == v).all() and table["n"].sum() == len(v)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60) | st.text("aé'.İ Σ<|>endoftx\x1c\x85", max_size=40))
def test_pieces_encode_as_whole(text):
    code = token_output.Encoder(tokenizer_path())
    assert code.apart and code(text) == code.whole(text)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64))
    assert sorted(line_dedup.PerfectHash(keys)(keys)) == list(range(len(keys)))


def test_lines_with_and_without_broadcast(spark):
    line = "A Line of over twenty characters"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}\n {line.lower()} ") for i in range(5)] + [(9, "short\nshort")] * 3, "doc_id long, text string")
    one, two = (sorted(map(tuple, line_dedup.line_dedup(docs, broadcast_bound=b).collect())) for b in (1 << 20, 0))
    assert one == two
    assert [(r[0], r[2]) for r in one] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 0), (9, 0), (9, 0), (9, 0)]


def test_decontamination_slices(spark, bench):
    item = " ".join(f"w{i}" for i in range(14))
    items = bench.unionByName(spark.createDataFrame([("7", item), ("8", "b a")], "item_id string, text string"))
    docs = (
        spark.createDataFrame([(1, "x " + " ".join(f"W{i}" for i in range(2, 14)) + " y"), (2, "a b"), (3, "Same... text here!")], "doc_id long, text string")
    )
    one, two = ({r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(docs, items, slice_words=s).collect()} for s in (10**6, 1))
    assert one == two == {1: (14, 12, ["7"]), 2: (2, 0, []), 3: (3, 3, ["1"])}
    near = decontam.proximity_matches(docs, items, slack=2).collect()
    assert (2, "8") in {(r.doc_id, r.item_id) for r in near}


def test_simhash_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60)
    fps = (
        {int(b ^ sum(1 << int(i) for i in rng.choice(62, k, False))) for b in base for k in (0, 2, 4, 7) for _ in range(4)}
        | {int(base[0] ^ (1 << i)) for i in range(60)}
    )
    prints = spark.createDataFrame(list(enumerate(sorted(fps))), "doc_id long, fp long")
    for bound in (4096, 8):
        got = {r.rep: r.component for r in simhash.near_components(prints, bound=bound).collect()}
        ids = sorted(fps)
        comp = list(range(len(ids)))
        for i in range(len(ids)):
            for j in range(i):
                if bin(ids[i] ^ ids[j]).count("1") <= 4 and comp[i] != comp[j]:
                    a, b = comp[i], comp[j]
                    comp = [min(a, b) if x in (a, b) else x for x in comp]
        assert got == dict(enumerate(comp))


def test_covering_triples():
    from itertools import combinations

    t = [set(x) for x in simhash.covering_triples()]
    assert len(t) == 20 and all(any(x <= set(four) for x in t) for four in combinations(range(8), 4))


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(2)
    X = rng.standard_normal((400, 16))
    X[200:300] = X[:100] + 0.05 * rng.standard_normal((100, 16))
    X[300:320] = X[5]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X.astype(np.float32))] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    for bound in (4096, 16):
        got = {
            r.vec_id: r
            for r in embed_dedup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), bound=bound).collect()
        }
        V = X.astype(np.float32).astype(float)
        V /= np.linalg.norm(V, axis=1)[:, None]
        want = ((V @ V.T) >= 0.95).sum(1) - 1
        found = np.array([got[i].n_links for i in range(400)])
        assert len(got) == 404 and (found <= want).all() and found.sum() >= 0.9 * want.sum()
        assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903)) and got[310].component_id == got[5].component_id


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame(
        [(i, "w " * int(n), None, "abc"[i % 3] if i % 7 else "d", 0) for i, n in enumerate(rng.integers(0, 90, 600))],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    rows = mixing.mix_sources(docs).collect()
    for s in "abcd":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 3 * r.size for r in own)
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6


def test_pii_and_secrets(spark):
    t = "Mail a.b@x.org or call +1 (974) 555-3436, card 4111 1111 1111 1111, host 10.0.0.1; contact jo [at] site [dot] com. Phone: 415 555 2671"
    r = pii.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.count(",") >= 3
    key = "ghp_" + "a1B2" * 9
    rows = [(1, f'x token = "abcdefgh12" {key}', "en", "a")] + [(i, "ghp_" + "Zz09" * 9, "en", s) for i, s in ((2, "a"), (3, "b"), (4, "c"))]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1].n_assign == 1 and "vendor:" in got[1].spans and all(got[i].spans == "" and got[i].n_example == 1 for i in (2, 3, 4))


def test_toxic_sentence_is_located():
    docs = [(f"the cat sat. {'you moron. ' if i % 4 == 0 else ''}a dog ran on {i}.", int(i % 4 == 0)) for i in range(200)]
    words, bias, leak = toxicity.train(docs, 1.0)
    p = toxicity.sentence_scores("the dog sat. you moron. ran on.", toxicity.Weights(words), bias)
    assert p.argmax() == 1 and p[1] > 0.5 > p[0]


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    for out, label in ((quality.score_quality(docs, labels), "quality"), (toxicity.score_toxicity(docs, labels), "toxic")):
        rows = out.join(labels, "doc_id").where(F.col("held_out")).collect()
        assert sum(r.predicted == r[label] for r in rows) >= 0.85 * len(rows)
