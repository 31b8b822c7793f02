"""Quality by positive-unlabelled learning.

The classifier minimises the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)). Trusted positives are learning rows labelled 1; unlabelled are texts of the corpus at large. Rows of
label 0 are never used, neither for the classifier nor for the prior nor for the calibration. Features describe a whole
text's writing: frequencies of pairs of character classes, repeated lines and words, line and word lengths; no words, no
label, lang, source or doc_id.

A seeded hash splits the positives: one half trains, the other half measures. Training sees at most `most` positives and
`most` unlabelled texts (both by a seeded hash) in one task, with a prior that the same task estimates from two halves of
its texts. Then every document is scored once, whole, and the corpus-wide histogram of these outputs, beside that of all
measuring positives, gives the class prior (the least ratio of the unlabelled to the positive share above a threshold,
with a margin for chance) and the output's slope and shift, which minimise the same unbiased risk over all documents.
Both histograms have `BINS` bins at most, whatever the corpus.

Defined results: null and empty texts are scored like any other text, with empty features; very long texts are described
whole. Repeated rows are scored alike; a repeated doc_id trains once, by its smallest text. Rows with a null doc_id are
scored and counted, held_out false, and not learned from. Without positives every score is the prior (0.5 unless given),
also for an empty table's none. Other columns are ignored, whatever their names; `accepted` hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import first_ids, in_split, learnable, sigmoid, small, strings, texts, texts_of, written

MOD, REST, FLOOR = 5, 0, 0.3
#: Most positives, and most unlabelled texts, to train on.
MOST = 3000
#: Bins of the histograms of outputs, and their width.
BINS, STEP = 1600, 0.05
# Character classes: lower, upper, digit, space, line break, beyond ASCII, and each ASCII sign by itself.
_CLASS = np.zeros(256, np.uint8)
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
for _c in range(256):
    _CLASS[_c] = (
        0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 4 if _c == 10 else 5 if _c >= 128 else 6 + _SIGNS.index(_c)
        if _c in _SIGNS else 3
    )
_N = 6 + len(_SIGNS)
WIDTH = _N * _N + _N + 18


def features(text: str) -> np.ndarray:
    """WIDTH numbers from 0 to about 1 for a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    one = np.bincount(c, minlength=_N)
    two = np.bincount(c[:-1].astype(np.int64) * _N + c[1:], minlength=_N * _N)
    out[: _N * _N] = np.sqrt(two / len(raw))
    out[_N * _N : _N * _N + _N] = np.sqrt(one / len(raw))
    lines, words = raw.split(b"\n"), raw.split()
    n = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / n
    odd = one[6:].sum() - one[6 + _SIGNS.index(b".")] - one[6 + _SIGNS.index(b",")]
    loud, noted = sum(w.isupper() and len(w) > 2 for w in words) / n, sum(w[-1] < 128 and not w[-1:].isalnum() and w[-1] not in b".," for w in words) / n
    out[-18:] = (
        1 - len(set(lines)) / len(lines), 1 - len(set(words)) / n, min(1, len(words) / 50), np.log1p(len(words)) / 12, min(1, len(raw) / n / 20),
        min(1, max(map(len, words), default=0) / 100), min(1, n / len(lines) / 100), loud, noted, again, np.sqrt(again), np.sqrt(loud), np.sqrt(noted),
        min(1, 8 * again), min(1, 8 * loud), min(1, 8 * noted), min(1, 20 * odd / len(raw)), 1,
    )
    return out


def train(P: np.ndarray, U: np.ndarray, prior: float, steps: int = 300, seed: int = 5, decay: float = 1e-2) -> np.ndarray:
    """Weights of a logistic classifier by Adam on the non-negative risk; when the negative part is below zero, its gradient is undone instead."""
    mean, sd = U.mean(0), U.std(0) + 0.02
    P, U = (P - mean) / sd, (U - mean) / sd
    w, b = np.zeros(P.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rng = np.random.default_rng(seed)
    for t in range(1, steps + 1):
        p, u = P[rng.integers(0, len(P), min(len(P), 800))], U[rng.integers(0, len(U), min(len(U), 1200))]
        sp, su = sigmoid(p @ w + b), sigmoid(u @ w + b)
        # Logistic loss: l(+) = softplus(-f), l(-) = softplus(f).
        negative = np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
        gp, gn = prior * (sp - 1) / len(p), (su / len(u), -prior * sp / len(p))
        g_neg = np.append(u.T @ gn[0] + p.T @ gn[1], gn[0].sum() + gn[1].sum())
        g = np.append(p.T @ gp, gp.sum()) + g_neg if negative >= 0 else -g_neg
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    w = w / sd
    return np.append(w, b - mean @ w)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """The share of positives among the unlabelled, from counts of both by rising score.

    Above any threshold the unlabelled share is at least prior times the positive share, and equals it where no negative
    scores so high; the threshold is the one with the least ratio, with a margin for what chance does to small shares.
    """
    if not positive.sum() or not unlabelled.sum():
        return 0.5
    p, u = (np.cumsum(x[::-1]) / x.sum() for x in (positive, unlabelled))
    margin = sum(np.sqrt(np.log(4 / chance) / (2 * x.sum())) for x in (positive, unlabelled))
    held = p > 0
    best = np.argmin((u[held] + margin) / p[held])
    return float(np.clip(u[held][best] / p[held][best], 0.01, 0.99))


def calibration(outputs: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of outputs that minimise the unbiased risk, given how often each output occurs among both kinds.

    For the logistic loss that risk is mean softplus(z) over the unlabelled less prior * mean z over the positives: convex
    in both. A small pull to slope 1 and shift 0, and slopes from 0.2 to 5 only, hold it down where classes part entirely.
    """
    if not positive.sum() or not unlabelled.sum():
        return 1.0, 0.0
    A = np.stack([outputs, np.ones(len(outputs))], 1)
    u, c = unlabelled / unlabelled.sum(), np.array([1.0, 0.0])
    pull, rest = np.array([1.0, 0.0]), prior * (A.T @ (positive / positive.sum()))
    for _ in range(steps):
        s = sigmoid(A @ c)
        g = A.T @ (u * s) - rest + 1e-3 * (c - pull)
        h = (A * (u * s * (1 - s))[:, None]).T @ A + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        c = c - move * min(1.0, 2 / max(1e-9, np.abs(move).max()))
        c[0] = min(5.0, max(0.2, c[0]))
    return float(c[0]), float(c[1])


def histogram(outputs: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(np.floor(outputs / STEP), -BINS // 2, BINS // 2 - 1).astype(int) + BINS // 2, minlength=BINS)


def learn(P: np.ndarray, U: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights from features; without a prior, a classifier of one half of the texts estimates it on the other."""
    if prior is None:
        prior = 0.5
        if len(P) >= 4 and len(U) >= 4:
            w = train(P[::2], U[::2], prior)
            prior = class_prior(*(histogram(x[1::2] @ w[:-1] + w[-1]) for x in (P, U)))
    return train(P, U, min(0.99, max(0.01, prior)))


def _measuring() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(2)) == 1


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, most: int = MOST) -> np.ndarray | None:
    """The classifier's weights, None without positives; features of the chosen texts are made where they lie."""
    ones = learnable(labels, "quality", MOD, REST).where("y = 1")
    chosen = texts_of(docs, first_ids(ones.where(~_measuring()), most, 17))
    wild = texts_of(docs, first_ids(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), most, 23).withColumn("y", F.lit(0)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.record_batch(
                [b.column(0), b.column(2).cast(pa.int32()), pa.array([features(t).tobytes() for t in strings(b.column(1))], pa.binary())],
                ["doc_id", "y", "x"]
            )

    described = (
        chosen.withColumn("y", F.col("y").cast("int")).unionByName(wild)
            .mapInArrow(describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary")
    )

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[2]))  # results don't depend on the order of arrival
        X = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, WIDTH).astype(float)
        y = np.array([r[1] for r in rows], int)
        if (y == 1).any() and (y == 0).any():
            yield pa.record_batch([pa.array([learn(X[y == 1], X[y == 0], prior).tobytes()])], ["w"])

    got = described.repartition(1).mapInArrow(one_task, "w binary").collect()
    return np.frombuffer(got[0][0]) if got else None


def outputs(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """(doc_id, f): the classifier's uncalibrated output for every document, as a table in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.record_batch([b.column(0), pa.array(output(strings(b.column(1)), w))], ["doc_id", "f"])

    return written(texts(docs).mapInArrow(run, f"doc_id {kind}, f double"), "quality-outputs")


def measured(raw: DataFrame, labels: DataFrame, prior: float | None) -> tuple[float, float, float]:
    """(class prior, slope, shift) from the outputs of all documents and of all measuring positives."""
    at = F.least(F.greatest(F.floor(F.col("f") / STEP), F.lit(-BINS // 2)), F.lit(BINS // 2 - 1)).cast("int") + BINS // 2
    ones = learnable(labels, "quality", MOD, REST).where((F.col("y") == 1) & _measuring()).select("doc_id")
    each = raw.groupBy("doc_id", at.alias("bin")).agg(F.count("*").alias("n"))  # a hot doc_id combines before the shuffle
    positive, unlabelled = np.zeros(BINS), np.zeros(BINS)
    for counts, held in ((positive, each.join(ones, "doc_id", "left_semi")), (unlabelled, raw.select(at.alias("bin"), F.lit(1).alias("n")))):
        rows = held.groupBy("bin").agg(F.sum("n").alias("n"))
        for k, n in rows.collect():  # at most BINS rows
            counts[k] = n
    if prior is None:
        prior = class_prior(positive, unlabelled)
    return prior, *calibration((np.arange(BINS) - BINS // 2 + 0.5) * STEP, positive, unlabelled, prior)


def output(texts_: list[str], w: np.ndarray) -> np.ndarray:
    X = np.stack([features(t) for t in texts_]) if texts_ else np.empty((0, WIDTH))
    return X @ w[:-1] + w[-1]


def score_quality(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    w = fit(docs, labels, prior)
    if w is None:
        rows = docs.select("doc_id", F.lit(0.5 if prior is None else float(prior)).alias("score"))
    else:
        raw = outputs(docs, w)
        _, slope, shift = measured(raw, labels, prior)
        rows = raw.select("doc_id", (1 / (1 + F.exp(-(F.col("f") * slope + shift)))).alias("score"))
    return rows.select("doc_id", in_split(F.col("doc_id"), MOD, REST).alias("held_out"), "score", (F.col("score") >= FLOOR).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """docs without the documents that the classifier rejects, with all their columns.

    Defined results as in the module's docstring; repeated rows stay or go together, and without positives all stay
    unless the given prior is below the floor. An empty table gives an empty one.
    """
    w = fit(docs, labels, prior)
    if w is None:
        return docs if prior is None or prior >= FLOOR else docs.limit(0)
    _, slope, shift = measured(outputs(docs, w), labels, prior)
    least = (np.log(FLOOR / (1 - FLOOR)) - shift) / slope
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array(output(strings(b.column(at)), w) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
