"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm.common import append_columns, distinct_of, labelled_sample, one_task, release_memory, slices, starts_of, words

#: Labelled training texts used at most; all texts are scored.
TRAINING_TEXTS = 20_000
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»…–—“”‘’"
SKIPS = (1, 2)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties. Weights live in ``2 ** bits`` places; place 0 is the constant."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 40.0
    l2: float = 0.01
    epochs: int = 6
    positive_weight: float = 8.0


def gram_features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts and the text of each.

    Words are lower-cased and freed of punctuation at their ends; words of punctuation alone are
    left out. Features are words, pairs of neighbours and pairs with one word between.
    """
    codes, distinct, counts = words(texts)
    plain = [w.lower().strip(EDGE) for w in distinct]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in plain] or [0], np.uint64)
    real = np.array([bool(w) for w in plain] or [False], bool)[codes]
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    h = hashes[codes][real]
    shift = np.uint64(64 - bits)
    found, whose = [(h * MIX[0]) >> shift], [owner]
    for k, skip in enumerate(SKIPS, 1):
        if len(h) > skip:
            same = owner[:-skip] == owner[skip:]
            found.append((((h[:-skip] * MIX[k]) ^ h[skip:]) * MIX[3])[same] >> shift)
            whose.append(owner[:-skip][same])
    return np.maximum(np.concatenate(found).astype(np.int64), 1), np.concatenate(whose)


def fit_ftrl(features: list[np.ndarray], labels: np.ndarray, rule: Ftrl, seed: int = 3) -> np.ndarray:
    """Weights after ``rule.epochs`` passes; each text is a set of features, place 0 included.

    Every coordinate has its own rate alpha / (beta + sqrt of its squared gradients so far), and
    its weight is exactly 0 while its sum of gradients stays within l1.
    """
    z = np.zeros(1 << rule.bits)
    n = np.zeros(1 << rule.bits)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        pull = np.sign(zi) * rule.l1 - zi
        return np.where(np.abs(zi) <= rule.l1, 0.0, pull / ((rule.beta + np.sqrt(ni)) / rule.alpha + rule.l2))

    order = np.random.default_rng(seed)
    for _ in range(rule.epochs):
        for i in order.permutation(len(features)):
            at = features[i]
            ni = n[at]
            w = weights(z[at], ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            g *= rule.positive_weight if labels[i] else 1.0
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / rule.alpha * w
            n[at] = ni + g * g
    return weights(z, n).astype(np.float32)


def text_sets(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct features of each text, with the constant."""
    features, owner = gram_features(texts, bits)
    key = distinct_of((owner.astype(np.int64) << bits) | features)
    bounds = starts_of(np.bincount(key >> bits, minlength=len(texts)))
    low = (key & ((1 << bits) - 1)).astype(np.int32)
    constant = np.zeros(1, np.int32)
    return [np.concatenate([constant, low[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def toxicity_weights(docs: DataFrame, labels: DataFrame, train: Column, rule: Ftrl, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the nonzero weights, learnt in one task from at most ``bound`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, marks = [], []
        for batch in batches:
            for part in slices(batch, "text"):
                if len(sets) < bound:
                    sets += text_sets(part.column("text"), rule.bits)[: bound - len(sets)]
                    marks += part.column("label").to_pylist()
        if sets:
            w = fit_ftrl(sets, np.array(marks[: len(sets)], np.float64), rule)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], names=["place", "weight"])
        sets.clear()
        release_memory()

    sample = labelled_sample(docs, labels, "toxic", train, bound)
    task = one_task(sample, [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")])
    rows = task.mapInArrow(run, "place int, weight float").toPandas()
    return rows["place"].to_numpy(np.int64), rows["weight"].to_numpy(np.float32)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    threshold: float = 0.7,
    rule: Ftrl = Ftrl(),
    bound: int = TRAINING_TEXTS,
) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 if score >= ``threshold``).

    Input: doc_id, text and any others, all kept (columns named as the new ones are replaced);
    ``labels`` (doc_id, toxic). ``train`` is a condition on doc_id. At most ``bound`` labelled texts,
    drawn by a hash of their ids, teach the model; every whole text is scored from its text alone.
    The nonzero weights (2 ** bits at most) go to every executor. A text counts each feature once,
    so length does not matter. Null and empty texts have the score of the constant alone; with
    nothing to learn from, every score is 0.
    """
    places, values = toxicity_weights(docs, labels, train, rule, bound)
    shared = docs.sparkSession.sparkContext.broadcast((places, values))

    def compute() -> Callable[[pa.Array], list[pa.Array]]:
        at, w = shared.value
        weights = np.zeros(1 << rule.bits, np.float32)
        weights[at] = w

        def apply(texts: pa.Array) -> list[pa.Array]:
            features, owner = gram_features(texts, rule.bits)
            live = weights[features] != 0
            key = distinct_of((owner[live].astype(np.int64) << rule.bits) | features[live])
            sums = np.bincount(key >> rule.bits, weights[key & ((1 << rule.bits) - 1)], minlength=len(texts))
            score = 1 / (1 + np.exp(-np.clip(sums + weights[0], -35, 35))) if len(at) else np.zeros(len(texts))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return apply

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append_columns(docs, "text", fields, compute)
