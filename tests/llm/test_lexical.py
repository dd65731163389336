from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pytest

from odflow.llm.lexical import TERM, Shard, lexical_search
from odflow.llm.oracles import LEXICAL


def terms_of(text):
    return re.findall(TERM, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k=10):
    held = [(d, t) for d, text in docs if (t := terms_of(text))]
    total, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, t in held:
            m = 100 - 90 + (90 * len(t) * total) // length
            score = 0
            for term in set(terms_of(text)) & set(t):
                tf = t.count(term)
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank + 1, None if absent else d, -s) for rank, (s, absent, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 60))) for _ in range(500)]
    docs = [(i, t if i % 3 else t.upper()) for i, t in enumerate(texts)]
    docs += [(7, texts[7]), (7, texts[9]), (None, texts[7]), (None, None), (900, None), (901, ""), (902, " ,.;\n"), (903, "w1 " * 5000)]
    docs += [(1000 + i, "The same, text: w3 w40 W41!") for i in range(60)]  # ties
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 25)))) for i in range(40)]
    items += [(3, items[3][1]), (4, "w1 w2 w3"), (None, "w5-w6 w6"), (50, None), (51, ""), (52, "..."), (53, "absent words"), (54, "w40 W41")]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS score", "0 AS n", "0 AS rank")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS doc_id", "'y' AS score")
    return d, i


@pytest.mark.parametrize("partitions", [1, 7])
def test_agrees_with_brute_force(spark, corpus, partitions):
    d, i = tables(spark, *corpus)
    out = lexical_search(d.repartition(partitions), i)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == brute_force(*corpus)


def test_blocks_of_items_and_sql(spark, corpus):
    d, i = tables(spark, *corpus)
    out = sorted(map(tuple, lexical_search(d, i, block_terms=60).collect()), key=str)
    assert out == brute_force(*corpus)
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", i.select("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    assert out == sorted(con.execute(LEXICAL).fetchall(), key=str)


def test_empty_tables(spark, corpus):
    d, i = tables(spark, *corpus)
    assert lexical_search(d.limit(0), i).count() == 0
    assert lexical_search(d, i.limit(0)).count() == 0
    assert lexical_search(d.where("text IS NULL"), i).count() == 0


def test_accumulators_are_limited():
    """Two rare terms decide; the frequent one opens no accumulator but still counts for those that are open."""
    n = 2000
    codes = [[0, 1, 2] if d < 12 else [2] for d in range(n)]
    counts = np.array([len(c) for c in codes])
    flat = np.array([x for c in codes for x in c], np.int32)
    weights = np.array([5000, 4000, 300])
    shard = Shard(np.arange(n), np.zeros(n, bool), np.full(n, 30), counts, flat, np.ones(len(flat), np.int32), weights, n, 30 * n)
    docs, scores, made = shard.search(np.array([0, 1, 2]), 10, 0)
    assert made == 12 and docs.tolist() == list(range(10))
    each = 10**9 // (1000 + 8 * 100)
    assert scores.tolist() == [9300 * each] * 10
    assert shard.search(np.array([0, 1, 2]), 10, 9301 * each)[2] == 0  # better ones are known from elsewhere
    assert not shard.sums.any() and not shard.open.any()
