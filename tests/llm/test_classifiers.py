from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from odflow.llm import quality
from odflow.llm.common import labelled_sample
from odflow.llm.language import identify_language
from odflow.llm.quality import PuRule, score_quality
from odflow.llm.scoring import LblRule, score_texts
from odflow.llm.toxicity import Ftrl, score_toxicity

VOWELS = {"en": ("th", "er", "ing", "st"), "fr": ("eau", "elle", "oi", "qu"), "de": ("sch", "ung", "heit", "z")}


def text_of(r, lang, n):
    return " ".join("".join(r.choice(VOWELS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        lang = r.choice(list(VOWELS))
        words, toxic, quality = text_of(r, lang, r.randint(20, 120)).split(), 0, 1
        if r.random() < 0.2:
            words.insert(r.randrange(len(words)), r.choice(("vile", "Vile!", "foul", "foul,")))
            toxic = 1
        if r.random() < 0.25:
            words, quality = [f"{w}!!" if i % 2 else w.upper() + "###" for w in words], 0
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
        labels.append((i, quality, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def labels(spark, corpus):
    more = [(None, 1, 1), (5, None, None), (0, 0, 0)]
    return spark.createDataFrame(corpus[1] + more, "doc_id long, quality int, toxic int")


def test_toxicity(docs_of, corpus, odd_rows, labels):
    docs = docs_of(corpus[0] + [(10_000 + i, *r[1:]) for i, r in enumerate(odd_rows)])
    out = score_toxicity(docs, labels, F.col("doc_id") % 3 != 1, rule=Ftrl(l1=8.0)).collect()
    toxic = {i: t for i, _, t in corpus[1]}
    test = [r for r in out if r.doc_id in toxic and r.doc_id % 3 == 1]
    assert sum(r.predicted == toxic[r.doc_id] for r in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r["size"] == "other" for r in out)
    assert len({round(r.score, 12) for r in out if r.doc_id in (10_000, 10_001, 10_002)}) == 1


def test_quality(docs_of, corpus, odd_rows, labels):
    docs = docs_of(corpus[0] + [(10_000 + i, *r[1:]) for i, r in enumerate(odd_rows)])
    out = score_quality(docs, labels, F.col("doc_id") % 5 != 0, rule=PuRule(steps=600)).collect()
    good = {i: q for i, q, _ in corpus[1]}
    test = [r for r in out if r.doc_id in good and r.doc_id % 5 == 0]
    assert sum(r.predicted == good[r.doc_id] for r in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.lang_pred == "other" for r in out)


def test_classifiers_without_rows_or_labels(docs_of, corpus, labels):
    none = labels.where("false")
    for score in (score_toxicity, score_quality):
        assert score(docs_of([]), labels, F.lit(True)).count() == 0
        assert {r.score for r in score(docs_of(corpus[0][:5]), none, F.lit(True)).collect()} == {0.0}


def test_language(docs_of, corpus, odd_rows):
    docs = docs_of(corpus[0] + [(10_000 + i, *r[1:]) for i, r in enumerate(odd_rows)])
    out = {r.doc_id: r for r in identify_language(docs, F.col("doc_id") % 4 != 2).collect()}
    test = [r for r in corpus[0] if r[0] % 4 == 2]
    assert sum(out[i].lang_pred == lang for i, _, lang, _ in test) / len(test) > 0.97
    assert all(out[10_000 + k].lang_pred == "und" and out[10_000 + k].score == 0 for k in range(4))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert identify_language(docs_of([]), F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify_language(docs_of(corpus[0][:3]), F.lit(False)).collect()} == {"und"}


def test_scoring_counts_and_base(docs_of, corpus, odd_rows):
    import collections
    import math
    import re

    rows = [*corpus[0][:300], *[(10_000 + i, *r[1:]) for i, r in enumerate(odd_rows)]]
    out = {r.doc_id: r for r in score_texts(docs_of(rows), F.col("doc_id") % 7 != 2, LblRule(words=50, classes=4), 60).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""] for i, t, *_ in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if i % 7 != 2 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws))
    held = [r for i, r in out.items() if i % 7 == 2]
    assert all(r.score < 0 for r in out.values())
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scoring_without_rows(docs_of, corpus):
    assert score_texts(docs_of([]), F.lit(True)).count() == 0
    got = score_texts(docs_of(corpus[0][:4]), F.lit(False), LblRule(words=5, classes=2)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)


def test_model_is_normalised():
    import numpy as np

    from odflow.llm.scoring import LogBilinear

    rule = LblRule(words=9, classes=3, width=4)
    model = LogBilinear.fresh(np.full(13, 1 / 13), rule)
    first, second, z = model.tables()
    total = (10.0 ** (first[:, None, :] + second[None, :, :] - z[:, :, None])).sum(2)
    assert np.allclose(total, 1, atol=1e-4)


def test_samples_are_bounded_by_distinct_keys(docs_of, labels, monkeypatch):
    docs = docs_of([(5, f"text {i}", "en", "a") for i in range(400)] + [(i, f"other text {i}", "en", "a") for i in range(6, 30)])
    always, seen = F.col("doc_id") >= 0, []
    kept = labelled_sample(docs, labels, "toxic", always, 20_000).collect()
    assert sorted(r.doc_id for r in kept) == list(range(5, 30))

    def one_task(df, order):
        seen.extend(df.collect())
        return df.limit(0)

    monkeypatch.setattr(quality, "one_task", one_task)
    quality.quality_network(docs, labels, always, PuRule(steps=1), 8_000)
    assert sorted(r.doc_id for r in seen if r.label == 0) == list(range(5, 30))
    seen.clear()
    quality.quality_network(docs, labels, always, PuRule(steps=1), 10)
    assert len({r.doc_id for r in seen if r.label == 0}) == sum(r.label == 0 for r in seen) == 10
