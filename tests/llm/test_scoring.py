from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflow.llm.common import held_out, table
from odflow.llm.scoring import PIECE_TOKENS, LblRule, LogBilinear, Symbols, dealt_symbols, folded_words, score_texts, sigmoid


def slow_step(model, a, b, w, log_noise, drawn, rule, squares):
    """The same step written token by token: ascent on log p(data) and log (1 - p(noise)), then one update."""
    r, q, c1, c2, bias = (x.astype(np.float64) for x in (model.r, model.q, model.c1, model.c2, model.bias))
    grads = [np.zeros_like(x) for x in (r, q, c1, c2, bias)]
    k = len(drawn)
    for i, j, t in zip(a, b, w, strict=True):
        hidden = r[i] @ c1 + r[j] @ c2
        terms = [(t, 1.0), *[(n, 0.0) for n in drawn]]
        for x, wanted in terms:
            chance = sigmoid(hidden @ q[x] + bias[x] - log_noise[x] - np.log(k))
            error = wanted - chance
            grads[4][x] += error
            grads[1][x] += error * hidden
            d = error * q[x]
            grads[0][i] += c1 @ d
            grads[0][j] += c2 @ d
            grads[2] += np.outer(r[i], d)
            grads[3] += np.outer(r[j], d)
    for value, g, s in zip((r, q, c1, c2, bias), grads, squares, strict=True):
        g = g / len(w)
        s += g * g
        value += rule.rate * g / (np.sqrt(s) + 1e-6)
    return r, q, c1, c2, bias


def test_step_agrees_with_a_slow_one():
    rule, g = LblRule(words=9, classes=3, width=4), np.random.default_rng(0)
    noise = g.dirichlet(np.ones(13))
    model = LogBilinear.fresh(noise, rule)
    shapes = [x.shape for x in (model.r, model.q, model.c1, model.c2, model.bias)]
    squares = [np.full(s, 0.01, np.float32) for s in shapes]
    a, b, w, drawn = (g.integers(0, 13, n) for n in (50, 50, 50, 6))
    log_noise = np.log(noise).astype(np.float32)
    want = slow_step(model, a, b, w, log_noise, drawn, rule, [s.astype(np.float64) for s in squares])
    model.step(a, b, w, log_noise, drawn, rule, squares)
    for got, x in zip((model.r, model.q, model.c1, model.c2, model.bias), want, strict=True):
        assert np.abs(got - x).max() < 1e-4


def test_every_token_is_dealt_once_with_its_context(spark):
    texts = ["a b c d", "", None, "x " * (PIECE_TOKENS + 5), "a b c d"]
    rule = LblRule(words=5, classes=4)
    symbols = Symbols(["a", "b", "c", "d", "x"], rule)
    rows = dealt_symbols(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), symbols, 3, rule).collect()
    assert sum(len(r.s) - 2 for r in rows) == sum(len((t or "").split()) + 1 for t in texts)
    short = sorted(list(r.s) for r in rows if len(r.s) < 10)
    assert short == sorted([[0, 0, 1, 2, 3, 4, 0]] * 2 + [[0, 0, 0]] * 2 + [[5, 5, 5, 5, 5, 5, 5, 0]])
    assert {r.shard for r in rows} <= {0, 1, 2} and {r.round for r in rows} <= set(range(rule.rounds))


def scores(docs, **rule):
    return {r.doc_id: r for r in score_texts(docs, ~held_out("doc_id", 7, 2), LblRule(**rule)).collect()}


def test_model_does_not_depend_on_the_split(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    found = []
    for n in (2, 100):
        out = scores(docs.repartition(n), shard_tokens=60_000)
        held = [r for r in out.values() if not r.trained]
        found.append(sum(r.score for r in held) / sum(r.n_tokens for r in held))
        base = sum(r.base_score for r in held) / sum(r.n_tokens for r in held)
        assert found[-1] > base + 0.08
    assert abs(found[0] / found[1] - 1) < 0.005


def test_reruns_agree_to_the_bit(spark, tmp_path):
    path = str(tmp_path / "docs")
    table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").repartition(5).write.parquet(path)
    first, second = (scores(spark.read.parquet(path), shard_tokens=4000) for _ in range(2))
    assert all(first[k].score == second[k].score for k in first)


def test_score_is_the_sum_over_tokens(spark):
    """The counts, the base and the parts of the score of words with classes, by hand."""
    docs = spark.createDataFrame([(i, f"the cat number{i % 7} sat") for i in range(40)], "doc_id long, text string")
    out = score_texts(docs, F.lit(True), LblRule(words=3, classes=4, shard_tokens=100)).collect()
    counts = {"the": 40, "cat": 40, "sat": 40, "": 40, **{f"number{k}": 6 if k < 5 else 5 for k in range(7)}}
    n, v = sum(counts.values()), len(counts)
    for r in out:
        tokens = ["the", "cat", f"number{r.doc_id % 7}", "sat", ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (5, 5, n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score < 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(docs, F.lit(True)).count() == 0
    some = spark.createDataFrame([(None, None), (1, ""), (1, "a b")], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS s", "2 AS shard")
    assert score_texts(some, F.lit(False)).count() == 3
    assert score_texts(some, F.lit(True)).count() == 3


def test_folding_keeps_other_letters():
    import pyarrow as pa

    assert folded_words(pa.array(["ÀB cD"]))[1] == ["Àb", "cd"]
