"""Quality and toxicity against plain Python, and what their training may and may not use."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import quality, toxicity
from lectern.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def kind(byte):
    ch = chr(byte)
    if byte >= 128:
        return 5
    if ch in SIGNS:
        return 6 + SIGNS.index(ch)
    return 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 4 if ch == "\n" else 3


def plain_features(text):
    """The same description, a byte and a word at a time."""
    n_kinds = 6 + len(SIGNS)
    raw = text.encode()
    if not raw:
        return [0.0] * (n_kinds * n_kinds + n_kinds + 18)
    kinds = [kind(b) for b in raw]
    two, one = Counter(zip(kinds, kinds[1:], strict=False)), Counter(kinds)
    out = [math.sqrt(two[a, b] / len(raw)) for a in range(n_kinds) for b in range(n_kinds)] + [math.sqrt(one[a] / len(raw)) for a in range(n_kinds)]
    lines, words = raw.split(b"\n"), raw.split()
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    loud = sum(w.isupper() and len(w) > 2 for w in words) / n
    noted = sum(w[-1] < 128 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ".," for w in words) / n
    odd = sum(v for k, v in one.items() if k >= 6) - one[6 + SIGNS.index(".")] - one[6 + SIGNS.index(",")]
    out += [
        1 - len(set(lines)) / len(lines), 1 - len(set(words)) / n, min(1, len(words) / 50), math.log1p(len(words)) / 12, min(1, len(raw) / n / 20),
        min(1, max(map(len, words), default=0) / 100),
        min(1, n / len(lines) / 100), loud, noted, again, math.sqrt(again), math.sqrt(loud), math.sqrt(noted), min(1, 8 * again), min(1, 8 * loud),
        min(1, 8 * noted), min(1, 20 * odd / len(raw)), 1,
    ]
    return out


def test_quality_scores_by_hand(spark, tables):
    docs, labels = tables
    w = quality.fit(docs, labels)
    each = {r.doc_id: sum(a * b for a, b in zip(plain_features(r.text or ""), w[:-1], strict=True)) + w[-1] for r in docs.collect()}
    ones = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    measuring = {r.doc_id for r in spark.createDataFrame([(i,) for i in ones], "doc_id long").where(quality._measuring()).collect()}
    assert measuring and measuring < ones
    bins = lambda values: np.bincount([min(max(math.floor(f / 0.05), -800), 799) + 800 for f in values], minlength=1600)
    positive, unlabelled = bins([each[i] for i in measuring if i in each]), bins(each.values())
    best = None
    for k in range(1599, -1, -1):  # thresholds from the highest on
        p, u = positive[k:].sum() / positive.sum(), unlabelled[k:].sum() / unlabelled.sum()
        margin = sum(math.sqrt(math.log(40) / (2 * x.sum())) for x in (positive, unlabelled))
        if p and (best is None or (u + margin) / p < best[0]):
            best = (u + margin) / p, u / p
    prior = min(0.99, max(0.01, best[1]))
    got = quality.measured(quality.outputs(docs, w), labels, None)
    assert got[0] == pytest.approx(prior)
    slope, shift = got[1:]
    centres = (np.arange(1600) - 800 + 0.5) * 0.05

    def risk(a, b):
        z = a * centres + b
        return (np.logaddexp(0, z) * unlabelled).sum() / unlabelled.sum() - prior * (z * positive).sum() / positive.sum() + 5e-4 * ((a - 1) ** 2 + b * b)

    least = risk(slope, shift)
    assert all(least <= risk(min(5, max(0.2, slope + x)), shift + y) + 1e-9 for x in (-0.05, 0, 0.05) for y in (-0.05, 0, 0.05))
    for r in QUERIES["op1_quality"](spark, DIR).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(slope * each[r.doc_id] + shift))), abs=1e-5)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_never_sees_label_zero_nor_held_out_labels(tables):
    docs, labels = tables
    score = lambda x: sorted((r.doc_id, r.score) for r in quality.score_quality(docs, x).collect())
    want = score(labels)
    assert score(labels.where("quality = 1")) == want
    assert score(labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")) == want


@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_class_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(4)
    of = lambda centre, n: quality.histogram(rng.normal(centre, 1, n))
    unlabelled = of(3, int(40_000 * share)) + of(-3, int(40_000 * (1 - share)))
    assert quality.class_prior(of(3, 20_000), unlabelled) == pytest.approx(share, abs=0.03)
    assert quality.class_prior(np.zeros(5), np.ones(5)) == 0.5


def test_calibration_keeps_few_of_the_negatives():
    rng = np.random.default_rng(6)
    positive, negative = rng.normal(1.5, 0.5, 20_000), rng.normal(-0.2, 0.4, 4_000)  # raw outputs that all look good
    P, U = quality.histogram(positive[:10_000]), quality.histogram(np.concatenate([positive[10_000:], negative]))
    prior = quality.class_prior(P, U)
    a, b = quality.calibration((np.arange(quality.BINS) - quality.BINS // 2 + 0.5) * quality.STEP, P, U, prior)
    kept = lambda f: (1 / (1 + np.exp(-(a * f + b))) >= 0.3).mean()
    assert (1 / (1 + np.exp(-negative)) >= 0.3).mean() > 0.9 and kept(negative) < 0.3 and kept(positive) > 0.95


def plain_toxicity(text, words, bias, leak):
    clean, where = 1 - 1 / (1 + math.exp(-leak)), []
    at = 0
    for part in re.split(rb"([.!?\n]+)", text.encode()):
        own = {w for w in re.findall(rb"[0-9a-z\x80-\xff]+", part.lower())} if not re.fullmatch(rb"[.!?\n]+", part) else set()
        if own:
            f = bias + sum(words.get(x, 0.0) for w in own for x in [w, *(w[:k] + b"~" for k in range(4, 9) if len(w) >= k)])
            p = 1 / (1 + math.exp(-min(35, max(-35, f))))
            clean *= 1 - max(0, (p - 0.1) / 0.9)
            if p >= 0.5:
                where.append(f"{at}:{at + len(part)}")
        at += len(part)
    return 1 - clean, ",".join(where)


def test_toxicity_scores_by_hand(spark, tables):
    docs, labels = tables
    words, bias, leak = toxicity.fit(docs, labels)
    assert words
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        score, where = plain_toxicity(r.text or "", words, bias, leak)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].offending == where and got[r.doc_id].n_offending == len([x for x in where.split(",") if x])


def test_clean_sentences_do_not_add_up(spark):
    rng = np.random.default_rng(8)
    names = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    sentence = lambda: " ".join(rng.choice(names, 8)) + ". "
    train = [("".join(sentence() for _ in range(30)) + ("what a filthy moron. " if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(1200)]
    words, bias, leak = toxicity.train(train, 1.0)
    long = "".join(sentence() for _ in range(10_000))
    score = lambda t: plain_toxicity(t, words, bias, leak)
    assert score(long)[0] < 0.3 and score(long)[1] == ""
    half = len(long) // 2
    cut = long.index(". ", half) + 2
    found, where = score(long[:cut] + "you filthy moron! " + long[cut:])
    start, end = map(int, where.split(":"))
    assert found > 0.9 and (long[:cut] + "you filthy moron! ")[start:end] == " you filthy moron"


def test_repeated_ids_train_once(spark):
    rows = [(1, "good text here")] * 50 + [(2, "you moron")] * 50 + [(3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)] * 20 + [(2, 0, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    from lectern.llm.common import labelled, shares

    got = labelled(docs, labels, "toxic", 4, 99, 10).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in got) == [(1, "good text here", 0), (2, "you moron", 1), (3, "", 0)]
    assert shares(labels, "toxic", 4, 99) == (1, 2)
