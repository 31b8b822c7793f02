"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score p is the logistic of its words' weights; a document's score is the
noisy-or 1 - prod(1 - q) of q = max(0, (p - QUIET) / (1 - QUIET)), with one leak for what no sentence shows. A sentence
of no more than QUIET counts for exactly nothing, so clean sentences don't add up to a toxic document however many they
are. Training needs document labels only: the likelihood's gradient runs through the noisy-or, so the sentences that
explain a label get it. The trained weights then point at the offending sentences. Features are the words of a sentence
(A-Z lower-cased, without signs) and the words' beginnings of 4 to 8 bytes, which stand for inflected forms, as far as
at least `LEAST` training documents hold them; each distinct word of a sentence brings its own, in training as in
scoring.

Training sees at most `most` learning documents of each class, picked by a seeded hash, of at most `longest` characters
each, in one task, weighted to the true class shares; scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts have no sentence and get the leak's score. Very long texts are scored whole, one
sentence at a time. Repeated rows are scored alike; in training a repeated doc_id is one document, and of several labels
the largest counts. Rows with a null doc_id are scored, held_out false, and not learned from. Without labels of both
classes, and for an empty table, every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_split, labelled, shares, sigmoid, small, strings, texts
from lectern.llm.decontam import _TO_WORDS

MOD, REST, FLOOR = 4, 2, 0.3
#: Most training documents of each class, most characters of one of them, and the least number of them that must hold a feature.
MOST, LONGEST, LEAST = 2500, 200_000, 4
#: The sentence score up to which a sentence adds nothing to its document's.
QUIET = 0.1
Model = tuple[dict[bytes, float], float, float]
NONE: Model = ({}, -35.0, -35.0)
_END = re.compile(rb"[.!?\n]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) in bytes of UTF-8 of the parts between sentence ends, without empty ones."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for m in _END.finditer(raw):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(raw)))
    return [(s, e) for s, e in out if raw[s:e].strip()]


def bags(text: str) -> list[list[bytes]]:
    raw = _END.split(text.encode("utf-8", "surrogatepass"))
    return [w for w in (s.translate(_TO_WORDS).split() for s in raw) if w]


def parts(word: bytes) -> list[bytes]:
    """A word's features: itself, and its beginnings with a mark."""
    return [word, *(word[:k] + b"~" for k in range(4, min(9, len(word) + 1)))]


def hazard(p: np.ndarray) -> np.ndarray:
    """-log of the chance that a sentence of score p leaves its document clean; 0 for scores up to QUIET."""
    return -np.log1p(-np.minimum(np.maximum(0, (p - QUIET) / (1 - QUIET)), 1 - 1e-12))


def train(docs: list[tuple[str, int]], ratio: float, epochs: tuple[int, int] = (60, 40), least: int = LEAST) -> Model:
    """(feature weights, bias, leak) of the noisy-or model. ratio: how much a row of label 0 weighs against one of label 1.

    The first epochs fit a noisy-or without QUIET, so that sentences which start below it get a gradient at all; the
    others fit the model that scores.
    """
    each = [bags(t) for t, _ in docs]
    y = np.array([x for _, x in docs], float)
    seen: Counter = Counter()
    for b in each:
        seen.update({x for w in {w for s in b for w in s} for x in parts(w)})
    number = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}
    known: dict[bytes, list[int]] = {}
    doc_of, ptr, idx = [], [0], []
    for d, b in enumerate(each):
        for s in b:
            for w in set(s):  # as in scoring, each distinct word of a sentence brings its features
                if w not in known:
                    known[w] = [number[x] for x in parts(w) if x in number]
                idx.extend(known[w])
            ptr.append(len(idx))
            doc_of.append(d)
    idx, ptr, doc_of = np.array(idx, np.int64), np.array(ptr), np.array(doc_of, np.int64)
    sent = np.repeat(np.arange(len(doc_of)), np.diff(ptr))
    weight = np.where(y > 0, 1.0, ratio)
    weight /= weight.sum()
    w, b, leak = np.zeros(len(number)), -5.0, -4.0
    m, v = np.zeros(len(number) + 2), np.zeros(len(number) + 2)
    for t in range(1, sum(epochs) + 1):
        last = t > epochs[0]
        p = sigmoid(np.bincount(sent, w[idx], len(doc_of)) + b)
        # log of prod(1 - p), with the leak as one more part of each document
        log0 = -np.bincount(doc_of, hazard(p) if last else -np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + np.log1p(-sigmoid(np.array(leak)))
        # d loss / d log0, with y explained by any part, and 0 by none; d log0 / d f is -p for every part that counts
        g = weight * np.where(y > 0, np.exp(log0) / np.maximum(-np.expm1(log0), 1e-9), -1.0)
        gs = g[doc_of] * np.where(p > QUIET, -p, 0) if last else g[doc_of] * -p
        grad = np.concatenate([np.bincount(idx, gs[sent], len(number)), [gs.sum(), (g * -sigmoid(np.array(leak))).sum()]])
        grad[:-2] += 2e-5 * w + 5e-5 * np.sign(w)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = (0.1 if last else 0.25) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w, b, leak = w - step[:-2], b - step[-2], leak - step[-1]
    return {k: float(w[i]) for k, i in number.items()}, float(b), float(leak)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, longest: int = LONGEST) -> Model:
    import pickle

    ones, zeros = shares(labels, "toxic", MOD, REST)
    rows = labelled(docs, labels, "toxic", MOD, REST, most).where(F.length("text") <= longest)
    ratio = max(zeros, 1) / max(1, min(zeros, most)) * (max(1, min(ones, most)) / max(ones, 1))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["doc_id"], r["text"], r["y"]) for b in batches for r in b.to_pylist())
        model = train([(t, y) for _, t, y in got], ratio) if len({y for *_, y in got}) == 2 else NONE
        yield pa.record_batch([pa.array([pickle.dumps(model)])], ["m"])

    got = rows.repartition(1).mapInArrow(learn, "m binary").collect()
    return pickle.loads(got[0][0]) if got else NONE


class Weights(dict):
    """A word's weight: the sum of its features', kept for words seen before."""

    def __init__(self, features: dict[bytes, float], most: int = 300_000):
        self.features, self.most = features, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = sum(self.features.get(f, 0.0) for f in parts(word))
        return x


def sentence_scores(text: str, words: Weights, bias: float) -> np.ndarray:
    """Features that several words of a sentence share count for each of them, as they show more of the same."""
    get = words.__getitem__
    return sigmoid(np.array([bias + sum(map(get, set(s))) for s in bags(text)], float))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, offending (spans start:end of sentences, in bytes of UTF-8)."""
    words, bias, leak = fit(docs, labels)
    words = {k: x for k, x in words.items() if x}
    held = docs.sparkSession.sparkContext.broadcast(words)  # bounded by the training rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    quiet = float(np.log1p(-sigmoid(np.array(leak))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Weights(held.value)
        for b in small(batches):
            out, spans = [], []
            for t in strings(b.column(1)):
                p = sentence_scores(t, known, bias)
                out.append(-np.expm1(quiet - hazard(p).sum()))
                bad = np.flatnonzero(p >= 0.5)
                where = _located(t) if len(bad) else []
                spans.append([f"{where[i][0]}:{where[i][1]}" for i in bad])
            yield pa.record_batch([b.column(0), pa.array(out, pa.float64()), pa.array(spans, pa.list_(pa.string()))], ["doc_id", "score", "offending"])

    out = texts(docs).mapInArrow(run, f"doc_id {kind}, score double, offending array<string>")
    return out.select(
        "doc_id", in_split(F.col("doc_id"), MOD, REST).alias("held_out"), "score", (F.col("score") >= FLOOR).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"), F.array_join("offending", ",").alias("offending")
    )


def _located(text: str) -> list[tuple[int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    return [(s, e) for s, e in sentences(text) if raw[s:e].translate(_TO_WORDS).split()]
