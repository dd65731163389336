from __future__ import annotations

import itertools
import random

from odflow.llm.similarity import bands_for, components, jaccard_join


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    ids = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted((str(d), str(least[find(k)]), links[k]) for k, (d, _) in enumerate(rows)), len(ids)


def test_equals_brute_force_in_tiles(docs_of, odd_rows):
    r = random.Random(4)
    rows = []
    for base in range(6):
        words = [f"b{base}w{r.randrange(500)}" for _ in range(120)]
        for copy in range(25):
            words = list(words)
            words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"  # chains of copies of copies
            rows.append((base * 100 + copy, " ".join(words), "en", "a"))
    rows += [(900 + i, "few words only", "en", "a") for i in range(3)] + [(950, "few words", "en", "a")]
    rows += [(1000 + d, t, lang, s) if d is not None else (d, t, lang, s) for d, t, lang, s in odd_rows]
    out = jaccard_join(docs_of(rows), block=8).collect()
    want, classes = brute([(d, t) for d, t, *_ in rows])
    assert sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in out) == want
    assert sum(x.stays for x in out) == classes
    assert all(x.score == "other" for x in out)


def test_empty(docs_of):
    assert jaccard_join(docs_of([])).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


def test_bands():
    b = bands_for(0.8, 0.9999, 6)
    assert (1 - 0.8**6) ** b <= 1e-4 < (1 - 0.8**6) ** (b - 1)
