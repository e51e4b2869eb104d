"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over words and beginnings of words are trained in numpy from
confirmed toxic texts (P) and texts without regard to any label (U), drawn from the
whole training side, labelled or not. Labels that say "not toxic" are never used.
With the class prior p, the risk of calling U negative less p times that of calling P
negative estimates the negatives' risk; where a batch makes this estimate negative,
the step goes against it instead (the non-negative correction), so a flexible model
can't fit it below zero. Only features whose rates in P and U differ clearly
(a likelihood-ratio test) get a weight, which keeps long clean texts near the bias.

The class prior is a parameter; left out, it is estimated from P and U alone. A first
classifier, fitted with a prior in the middle, scores what it wasn't fitted to, by folds.
Above any score, the share of U divided by the share of P is at least the prior, as
toxic texts in U score like those in P, and about the prior where scores are so high that
only toxic texts have them. The least such quotient, with an allowance for chance, is taken, and a half at most:
in no corpus are most texts toxic.

Training samples are bounded by `positive_rows` and `unlabelled_rows` (about so many
rows, by the smallest xxhash64 of the id, one text an id); every document is
scored by its whole text.

A document's features are counted over its distinct words. Null and empty texts
have none and score as the bias alone says, below 0.5 in any trained model;
without any positive row every score is 0. Rows are scored one by one: repeated
rows repeat their score, an empty table gives an empty result. An id labelled
twice counts as toxic if one of its labels does; null labels and null ids are ignored.
"""

from __future__ import annotations

import math
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, below_share, chunks, held_out, load, per_text, quoted, utf8

#: Bytes of a word's beginnings that are features.
PREFIXES = (4, 5, 6, 7)
POSITIVE_ROWS, UNLABELLED_ROWS = 3_000, 8_000
#: The classifiers that the estimate of the prior begins with: folds, prior, epochs; least share of P above a score that counts, and standard errors allowed for.
FOLDS, FIRST_PRIOR, FIRST_EPOCHS, LEAST_SHARE, ERRORS = 4, 0.25, 60, 0.2, 2.0
#: Least likelihood-ratio statistic and least number of documents of a feature with a weight.
LEAST_G2, LEAST_DOCS = 12.0, 3
EPOCHS, BATCH, RATE, DECAY, BETA = 240, 256, 0.3, 1e-5, 0.0
#: Epochs with the logistic loss, whose slope reaches rows on the wrong side; the sigmoid loss then sharpens.
WARM = 30
#: From this score on a document counts as toxic.
THRESHOLD = 0.7
_STRIP = b".,;:!?\"'()[]{}#$%&*|<>-_"
_SEED = 20_240_601


def word_features(word: bytes) -> list[int]:
    return [crc32(b"w" + word), *(crc32(b"p" + word[:k]) for k in PREFIXES if len(word) >= k)]


def words_of(text: bytes) -> set[bytes]:
    return {w.strip(_STRIP) for w in text.lower().split()} - {b""}


def text_features(text: bytes, memo: Memo) -> np.ndarray:
    """The features of a text's distinct words, sorted, one entry for each word that has it."""
    known, words = memo.trim(), words_of(text)
    if new := words.difference(known):
        known.update((w, word_features(w)) for w in new)
        memo.took(new)
    found = list(chain.from_iterable(map(known.__getitem__, words)))
    return np.sort(np.array(found, np.uint32))


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The features, sorted, whose document rates in P and U differ by more than chance."""
    sides = [np.unique(np.concatenate([np.unique(f) for f in side]), return_counts=True) for side in (positive, unlabelled)]
    names = np.union1d(sides[0][0], sides[1][0])
    counts = np.zeros((2, len(names)))
    for k, (at, n) in enumerate(sides):
        counts[k, np.searchsorted(names, at)] = n
    rows = np.array([[len(positive)], [len(unlabelled)]], float)
    rate = counts.sum(0) / rows.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x, e: np.where(x > 0, x * np.log(x / e), 0.0)
        g2 = 2 * (part(counts, rows * rate) + part(rows - counts, rows * (1 - rate))).sum(0)
    return names[(g2 >= LEAST_G2) & (counts.sum(0) >= LEAST_DOCS)]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias, by the non-negative risk estimator with the logistic, then the sigmoid loss (Adagrad, mini-batches)."""
    if not positive or not unlabelled:
        return {}, -math.inf
    names = select(positive, unlabelled)

    def dense(side: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for f in side:
            at = np.minimum(np.searchsorted(names, f), max(len(names) - 1, 0))
            out.append(at[names[at] == f] if len(names) else np.zeros(0, np.int64))
        return out

    def batch(side: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [side[i] for i in which]
        return np.concatenate(own), np.repeat(np.arange(len(own)), [len(f) for f in own])

    positive, unlabelled = dense(positive), dense(unlabelled)
    weights, bias = np.zeros(len(names)), math.log(prior / (1 - prior))
    squares, bias_square = np.full(len(names), 1e-8), 1e-8
    rng = np.random.default_rng(_SEED)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    steps = math.ceil(len(unlabelled) / BATCH)
    for epoch in range(epochs):
        u_order = rng.permutation(len(unlabelled))
        p_order = rng.permutation(np.resize(np.arange(len(positive)), max(len(positive), 64 * steps)))
        for u, p in zip(np.array_split(u_order, steps), np.array_split(p_order, steps), strict=True):
            (uf, ur), (pf, pr) = batch(unlabelled, u), batch(positive, p)
            zu = np.bincount(ur, weights[uf], len(u)) + bias
            zp = np.bincount(pr, weights[pf], len(p)) + bias
            su, sp = sigmoid(zu), sigmoid(zp)
            # The risk of calling U and P negative, and the derivatives of all parts with respect to each row's z.
            if epoch < WARM:
                negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                gu, down, up = su / len(u), -prior * sp / len(p), -prior * (1 - sp) / len(p)
            else:
                negative_risk = su.mean() - prior * sp.mean()
                gu, down, up = su * (1 - su) / len(u), -prior * sp * (1 - sp) / len(p), -prior * sp * (1 - sp) / len(p)
            gu, gp = (-gu, -down) if negative_risk < -BETA else (gu, down + up)
            g = np.bincount(np.concatenate([uf, pf]), np.concatenate([gu[ur], gp[pr]]), len(names)) + DECAY * weights
            squares += g * g
            weights -= RATE * g / np.sqrt(squares)
            g = gu.sum() + gp.sum()
            bias_square += g * g
            bias -= RATE * g / math.sqrt(bias_square)
    return dict(zip(names.tolist(), weights.tolist(), strict=True)), bias


def risk(z_positive: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk of scores before the sigmoid, with the sigmoid loss."""
    loss = lambda z: 1 / (1 + np.exp(np.clip(z, -40, 40)))
    return prior * loss(z_positive).mean() + max(0.0, loss(-z_unlabelled).mean() - prior * loss(-z_positive).mean())


def logits(model: tuple[dict[int, float], float], texts: list[np.ndarray]) -> np.ndarray:
    weights, bias = model
    return np.array([bias + math.fsum(weights.get(f, 0.0) for f in own.tolist()) for own in texts])


def least_quotient(z_positive: np.ndarray, z_unlabelled: np.ndarray, least_share: float = LEAST_SHARE, errors: float = ERRORS) -> float:
    """The least share of U above a score divided by the share of P above it, with chance allowed for, over scores that so much of P reaches."""
    found = 1.0
    for cut in np.unique(z_positive):
        p, u = (z_positive >= cut).mean(), (z_unlabelled >= cut).mean()
        if p >= least_share:
            chance = math.sqrt(max(u, 1 / len(z_unlabelled)) * (1 - u) / len(z_unlabelled))
            found = min(found, (u + errors * chance) / p)
    return found


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> float:
    """The share of U that is like P, between one in U and a half."""
    scores: tuple[list, list] = ([], [])
    for fold in range(FOLDS):
        rest = [[x for k, x in enumerate(side) if k % FOLDS != fold] for side in (positive, unlabelled)]
        model = fit(*rest, FIRST_PRIOR, FIRST_EPOCHS)
        for found, side in zip(scores, (positive, unlabelled), strict=True):
            # As shares: each fold's classifier has a scale of its own, which ends between 0 and 1.
            found.append(1 / (1 + np.exp(-np.clip(logits(model, side[fold::FOLDS]), -40, 40))))
    return min(0.5, max(1 / len(unlabelled), least_quotient(*map(np.concatenate, scores))))


def _features(texts: DataFrame) -> list[np.ndarray]:
    """The features of texts (i, t), made on the executors, one text an id, in a fixed order."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("f", T.BinaryType())])

    def run(batches):
        memo = Memo(600)
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_features(t or b"", memo).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["h", "f"])

    one = texts.select(F.xxhash64(F.col("i").cast("string")).alias("h"), "t").mapInArrow(run, schema).groupBy("h").agg(F.min("f").alias("f"))
    found = sorted(zip(*(c.to_pylist() for c in one.toArrow().columns), strict=True))
    return [np.frombuffer(f, np.uint32) for _, f in found]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> tuple[dict[int, float], float]:
    """Weights and bias. df: texts of the training side; labels: (id, toxic 0/1), of which only toxic ones are read."""
    texts = df.select(quoted(id_col).alias("i"), utf8(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    toxic = labels.toDF("__lid", "__toxic").where("__lid IS NOT NULL AND __toxic = 1").select("__lid").distinct()
    n, n_toxic = df.where(quoted(id_col).isNotNull()).count(), toxic.count()
    if not n or not n_toxic:
        return fit([], [], 0.0)
    # About positive_rows ids, picked before any text is read.
    picked = toxic.where(below_share(F.col("__lid"), positive_rows, n_toxic))
    positive = _features(texts.join(F.broadcast(picked), F.col("i") == F.col("__lid"), "left_semi"))
    unlabelled = _features(texts.where(below_share(F.col("i"), unlabelled_rows, n)))
    if not positive or not unlabelled:
        return fit([], [], 0.0)
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled) if prior is None else prior)


def score(df: DataFrame, model: tuple[dict[int, float], float], id_cols: list, text_col: str = "text") -> DataFrame:
    """The id columns and score, a row for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        weights, bias = shared.value
        memo = Memo()

        def one(text: bytes | None) -> float:
            known, words = memo.trim(), words_of(text or b"")
            if new := words.difference(known):
                known.update((w, math.fsum(weights.get(f, 0.0) for f in word_features(w))) for w in new)
                memo.took(new)
            # An exact sum, as a set has no fixed order.
            z = bias + math.fsum(map(known.__getitem__, words))
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) if z > -math.inf else 0.0

        return lambda texts: [pa.array([one(t) for t in texts], pa.float64())]

    return per_text(df, id_cols, text_col, make, [T.StructField("score", T.DoubleType())])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels.where(~held_out()).select("doc_id", "toxic"))
    out = score(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
