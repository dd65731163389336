from __future__ import annotations

import math

import numpy as np
import pytest

from odflow.llm import search
from odflow.llm.search import Tree, coarse_cells, top_k


def brute(rows, every, k):
    """Every row is a candidate for every other; ids may repeat or be null."""
    whole = [
        (n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, q, v in whole:
        if q is not None and q % every == 0:
            pairs = sorted(
                (-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, i, w in whole if m != n and len(w) == len(v)
            )
            out += [(q, r + 1, None if absent else i, -s) for r, (s, absent, i) in enumerate(pairs[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_rows", "pack"), [(40, 3), (10_000, 512)])
def test_equals_brute_force(spark, shard_rows, pack, monkeypatch):
    monkeypatch.setattr(search, "PACK_SHARDS", pack)
    g = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in g.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # a very common vector: ties
    rows += [(500, None), (501, []), (502, [0.1] * 7 + [None]), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, [0.5] * 8)]
    rows += [(600, [0.25, 0.5]), (601, [0.5, 0.25]), (700, [1.0] * 3), (7, rows[7][1]), (800, [3e6] * 8), (801, [-3e6] * 8)]
    rows += [(20, rows[20][1]), (40, [0.5] * 8), (40, [0.4] * 8), (45, [0.5] * 8), (None, [0.6] * 8)]  # repeated ids, a query among them
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank")
    got = top_k(df, 20, 5, shard_rows, 7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 20, 5)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tree_prunes_clusters():
    g = np.random.default_rng(2)
    centres = g.normal(0, 500, (20, 4)).astype(int)
    rows = np.concatenate([c + g.integers(-3, 4, (100, 4)) for c in centres])
    tree = Tree(rows.copy(), np.arange(len(rows)), np.arange(len(rows)), 32)
    best = []
    compared = tree.search(-1, rows[0], tree.bounds(rows[:1])[0], best, 5)
    want = sorted(((int(s), -i, -i) for i, s in enumerate(rows @ rows[0])), reverse=True)[:5]
    assert sorted(best, reverse=True) == want and compared < len(rows) / 4


def test_only_open_pairs_of_shard_and_query_are_searched(spark, monkeypatch):
    """Rows in far clusters: the boxes of most shards cannot reach the kth score, so most pairs never meet."""
    g = np.random.default_rng(4)
    centres = g.normal(0, 40, (32, 6))
    rows = [(i, [float(x) for x in centres[i % 32] + g.normal(0, 0.01, 6)]) for i in range(3200)]
    pairs = []

    def counted(blocks, packs):
        found = open_pairs(blocks, packs)
        pairs.append(sum(len(r["numbers"]) // 8 for r in found.collect()))
        return found

    open_pairs = search.open_pairs
    monkeypatch.setattr(search, "open_pairs", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, 20, 5, shard_rows=100, query_block=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 20, 5)
    assert pairs[0] < 160 * 32 / 4


def test_coarse_cells_split_at_medians():
    g = np.random.default_rng(5)
    nodes = coarse_cells(g.integers(0, 1000, (640, 3)), 8)
    assert sum(n[0] < 0 for n in nodes) == 8
    assert coarse_cells(np.ones((50, 2)), 4) == [(-1, 0.0, 0, 0)]


def test_sql_agrees(spark):
    import duckdb

    from odflow.llm.oracles import SEARCH
    from odflow.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = QUERIES["op5_kd_tree_search"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(SEARCH).fetchall())
