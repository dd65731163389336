"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm.common import append_columns, distinct_of, drawn_by_key, labelled_sample, one_task, release_memory, run_sums, slices, words

#: Trusted positives and unlabelled texts used at most; all texts are scored.
TRAINING_TEXTS = 8_000
HASHED = 64


@dataclass(frozen=True)
class PuRule:
    """Network and optimiser of the fit."""

    hidden: int = 24
    steps: int = 2500
    batch: int = 512
    rate: float = 0.01
    decay: float = 1e-4
    prior_bins: int = 20
    caution: float = 0.03


def repeats(codes: np.ndarray, owner: np.ndarray, n: int, width: int) -> np.ndarray:
    """Windows of ``width`` words that stand in the same text before, per text."""
    if len(codes) < width:
        return np.zeros(n)
    key = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(key)].astype(np.uint64) + np.uint64(1)
    inside = owner[: len(key)] == owner[width - 1 :]
    key = (key * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)) | (owner[: len(key)].astype(np.uint64) << np.uint64(40))
    distinct = distinct_of(key[inside])
    first = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=n)
    return np.bincount(owner[: len(key)][inside], minlength=n) - first


def text_inputs(texts: pa.Array) -> np.ndarray:
    """Statistics of form and repetition and a few hashed character classes, one row per text."""
    n = len(texts)
    codes, distinct, counts = words(texts)
    owner = np.repeat(np.arange(n), counts)
    kinds = np.array([word_shape(w) for w in distinct] or [[0.0] * 8], np.float32)
    shape = kinds[codes]
    per_word = np.maximum(counts, 1)
    sums = np.stack([run_sums(shape[:, k].astype(np.float64), counts) for k in range(shape.shape[1])], 1) / per_word[:, None]
    pairs = distinct_of((owner.astype(np.int64) << 32) | codes)
    different = np.bincount(pairs >> 32, minlength=n)
    same_next = np.zeros(n)
    if len(codes) > 1:
        twin = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        same_next = np.bincount(owner[1:][twin], minlength=n).astype(float)
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    flat = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), n_lines)
    new_lines = np.bincount(distinct_of((line_owner.astype(np.int64) << 32) | flat) >> 32, minlength=n)
    first_letters = np.array([xxhash.xxh3_64_intdigest(w[-1:] if w else "") % HASHED for w in distinct] or [0], np.int64)[codes]
    ends = np.bincount(owner * HASHED + first_letters, minlength=n * HASHED).reshape(n, HASHED) / per_word[:, None]
    own = np.stack(
        [
            np.log1p(counts),
            different / per_word,
            np.sqrt(1 - different / per_word),
            same_next / per_word,
            repeats(codes, owner, n, 3) / per_word,
            repeats(codes, owner, n, 5) / per_word,
            1 - new_lines / np.maximum(n_lines, 1),
            np.log1p(counts / np.maximum(n_lines, 1)),
            counts == 0,
        ],
        1,
    )
    return np.concatenate([own, sums, np.sqrt(ends)], 1).astype(np.float32)


def word_shape(w: str) -> list[float]:
    letters = sum(map(str.isalpha, w))
    digits = sum(map(str.isdigit, w))
    other = len(w) - letters - digits
    return [
        min(len(w), 40) / 10,
        letters == 0,
        other > 1,
        other / len(w) if w else 0,
        digits / len(w) if w else 0,
        letters > 1 and w.isupper(),
        w[-1:] in ".,;:?!",
        len(w) > 20,
    ]


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, bins: int, caution: float) -> float:
    """Largest share of positives that the unlabelled scores allow.

    Wherever the unlabelled share of a score range falls below that of the positives, the prior
    can be no larger than their quotient. Ranges reach from a quantile of the positives upwards, so
    that each holds a steady count. ``caution`` is taken off: a prior too high leaves as many bad texts
    undecided, one too low costs little, as trusted positives weigh against it.
    """
    edges = np.quantile(positive, np.linspace(0, 1, bins + 1)[1:-1])
    above = [(np.mean(unlabelled > e), np.mean(positive > e)) for e in edges]
    quotients = [u / p for u, p in above if p > 0.05]
    return float(np.clip(min(quotients, default=0.5) - caution, 0.05, 0.98))


class Network:
    """One hidden layer with rectified units and a logistic output, on standardised inputs."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    @classmethod
    def fresh(cls, width: int, hidden: int, mean: np.ndarray, scale: np.ndarray, seed: int) -> Network:
        r = np.random.default_rng(seed)
        return cls([mean, scale, r.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)])

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, scale, a, b, c, d = self.parts
        x = np.clip((x - mean) / scale, -6, 6)
        h = np.maximum(x @ a + b, 0)
        return h @ c + d[0], h, x

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x.astype(np.float64))[0], -35, 35)))

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradient for the weights, given the slope of the loss in each margin."""
        _, h, x = self.margin(x)
        down = np.outer(slope, self.parts[4]) * (h > 0)
        return [x.T @ down, down.sum(0), h.T @ slope, np.array([slope.sum()])]


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rule: PuRule, seed: int = 5) -> Network:
    """Minimise prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)]) by Adam.

    Where the second part falls below 0 the step climbs out of it instead, as the estimator asks.
    The loss is the sigmoid loss, whose positive and negative parts add to 1.
    """
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    net = Network.fresh(both.shape[1], rule.hidden, both.mean(0), both.std(0) + 1e-3, seed)
    first, second = [np.zeros_like(p) for p in net.parts[2:]], [np.zeros_like(p) for p in net.parts[2:]]
    r = np.random.default_rng(seed)
    for step in range(1, rule.steps + 1):
        p = positive[r.integers(0, len(positive), rule.batch)].astype(np.float64)
        u = unlabelled[r.integers(0, len(unlabelled), rule.batch)].astype(np.float64)
        sp, su = net.score(p), net.score(u)
        slope_p, slope_u = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        if su.mean() - prior * sp.mean() >= 0:  # loss(-) is the score, loss(+) is 1 - score
            grads = [a + b for a, b in zip(net.gradient(p, -2 * prior * slope_p), net.gradient(u, slope_u), strict=True)]
        else:
            grads = [a + b for a, b in zip(net.gradient(p, prior * slope_p), net.gradient(u, -slope_u), strict=True)]
        rate = rule.rate * (1 - step / (rule.steps + 1))
        for k, g in enumerate(grads):
            g = g + rule.decay * net.parts[k + 2]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.parts[k + 2] = net.parts[k + 2] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def train_quality(positive: np.ndarray, unlabelled: np.ndarray, rule: PuRule) -> tuple[Network, float]:
    """The network and the class prior it was fitted with.

    The prior comes from a first fit that only tells positives from unlabelled texts, on one half
    of each, and the scores of the other half.
    """
    a, b = positive[::2], unlabelled[::2]
    first = fit_pu(a, b, 0.5, rule)
    prior = estimated_prior(first.score(positive[1::2]), first.score(unlabelled[1::2]), rule.prior_bins, rule.caution)
    return fit_pu(positive, unlabelled, prior, rule), prior


def quality_network(docs: DataFrame, labels: DataFrame, train: Column, rule: PuRule, bound: int) -> Network | None:
    """The network, learnt in one task from at most ``bound`` positives and as many unlabelled texts."""
    trusted = labelled_sample(docs, labels.where(F.col("quality") == 1), "quality", train, bound)
    open_rows = docs.where(train & F.col("doc_id").isNotNull()).select("doc_id", "text")
    drawn = drawn_by_key(open_rows, "doc_id", "text", [F.xxhash64(F.lit("unlabelled"), "doc_id"), F.col("doc_id")], bound)
    sample = trusted.unionByName(drawn.withColumn("label", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[np.ndarray]] = {0: [], 1: []}
        seen = {0: 0, 1: 0}
        for batch in batches:
            for part in slices(batch, "text"):
                inputs = text_inputs(part.column("text"))
                marks = part.column("label").to_numpy(zero_copy_only=False)
                for mark, kept in rows.items():
                    kept.append(inputs[marks == mark][: bound - seen[mark]])
                    seen[mark] += len(kept[-1])
        if min(seen.values()) >= 2:
            net, _ = train_quality(np.concatenate(rows[1]), np.concatenate(rows[0]), rule)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(net.parts))),
                    pa.array([list(p.shape) for p in net.parts], pa.list_(pa.int64())),
                    pa.array([p.ravel().tolist() for p in net.parts], pa.list_(pa.float64())),
                ],
                names=["part", "shape", "values"],
            )
        rows.clear()
        release_memory()

    task = one_task(sample, [F.xxhash64("doc_id", "label"), F.col("doc_id"), F.col("text")])
    found = sorted(task.mapInArrow(run, "part long, shape array<long>, values array<double>").collect())
    return Network([np.array(r["values"]).reshape(r["shape"]) for r in found]) if found else None


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    threshold: float = 0.3,
    rule: PuRule = PuRule(),
    bound: int = TRAINING_TEXTS,
) -> DataFrame:
    """``docs`` with score (0 to 1, higher: good quality likelier) and predicted (1 if score >= ``threshold``).

    Input: doc_id, text and any others, all kept (columns named as the new ones are replaced);
    ``labels`` (doc_id, quality). Only labels of 1 are used: they are the trusted positives. The
    unlabelled texts are rows of ``docs`` whatever their label. Both come from rows where ``train``
    (a condition on doc_id) holds, ``bound`` ids of each at most, drawn by a hash and with
    one text each; every whole text is scored, from its text alone. Null and empty texts are scored as texts without words.
    With nothing to learn from, every score is 0.
    """
    net = quality_network(docs, labels, train, rule, bound)

    def compute() -> Callable[[pa.Array], list[pa.Array]]:
        def apply(texts: pa.Array) -> list[pa.Array]:
            score = np.zeros(len(texts)) if net is None else net.score(text_inputs(texts))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return apply

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append_columns(docs, "text", fields, compute)
