from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest

from odflow.llm.mixing import pareto_mix
from odflow.llm.oracles import MIXING
from odflow.llm.packing import binary_lengths, pack_power_of_two, write_buckets
from odflow.llm.queries import tokenizer_path


def test_binary_lengths():
    assert binary_lengths(2048 * 2 + 37, 2048) == [2048, 2048, 32, 4, 1]
    assert binary_lengths(1, 2048) == [1]


def test_pieces_are_the_tokens_of_the_whole_text(docs_of, odd_rows):
    from tokenizers import Tokenizer

    extra = [(7, "It's The,end. A b, x.,y 12,5 Été, <|endoftext|> don't.", "fr", "a")]
    extra += [(8, "letters that end in a mark: İ, क़. क़, יִ. é, ﬁ.", "hi", "a")]
    rows = [r for r in odd_rows if r[0] != 5] + extra
    out = pack_power_of_two(docs_of(rows), tokenizer_path(), 2048).collect()
    assert len({r.sequence_id for r in out}) == len(out)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_id[doc_id], key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == want
        for r in pieces:
            assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.offset == 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert pack_power_of_two(docs_of([]), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        pack_power_of_two(docs_of([]), tokenizer_path(), 1000)


def test_sequences_are_numbered_by_bucket(docs_of, tmp_path):
    rows = [(k, "word " * (k * 13 % 300), "en", "a") for k in range(200)]
    packed = pack_power_of_two(docs_of(rows), tokenizer_path(), 64)
    out = packed.collect()
    assert len({r.sequence_id for r in out}) == len(out)
    assert all(r.sequence_id >> 56 == r.length.bit_length() - 1 for r in out)
    by_place = {}
    for r in out:
        by_place.setdefault(r.sequence_id >> 32, []).append(r.sequence_id & (1 << 32) - 1)
    assert all(sorted(v) == list(range(len(v))) for v in by_place.values())
    write_buckets(packed, str(tmp_path / "buckets"))
    lengths = {r["length"] for r in out}
    assert {p.name for p in (tmp_path / "buckets").glob("length=*")} == {f"length={n}" for n in lengths}


def test_ids_of_raw_markers_and_marks_after_capitals(docs_of):
    from tokenizers import Tokenizer

    texts = [
        "one <|ENDOFTEXT|> two <|EndOfText|>, x<|ENDOFTEXT|>y. <|endoftext|> <|endoftext|>.",
        "H\u0331 J\u030c T\u0308 W\u030a h\u0331 j\u030c t\u0308 w\u030a aH\u0331ab, J\u030c. E\u0301te\u0301 \u00c9T\u00c9. \u00e9t\u00e9",
        "The THE the, THE. Don'T DON'T <|Start <|START|> <|startoftext|> <|STARTOFTEXT|>",
    ]
    out = pack_power_of_two(docs_of([(k, t, "en", "a") for k, t in enumerate(texts)]), tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for k, t in enumerate(texts):
        got = [i for r in sorted((r for r in out if r.doc_id == k), key=lambda r: r.start) for i in r.ids]
        assert got == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def mix_rows():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", f"s{i % 5}") for i in range(400)]
    return rows + [(1000 + i, " ".join(["w"] * 9), "en", None) for i in range(30)] + [(2000, None, "en", "empty"), (2001, "", "en", "empty")]


def test_mix_agrees_with_sql_and_reruns(spark, docs_of):
    docs = docs_of(mix_rows())
    got = sorted(pareto_mix(docs).selectExpr("doc_id", "size", "source_size", "target", "copies * size").collect())
    assert got == sorted(pareto_mix(docs.repartition(5)).selectExpr("doc_id", "size", "source_size", "target", "copies * size").collect())
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    assert [tuple(r) for r in got] == sorted(con.execute(MIXING).fetchall())


def test_mix_reaches_its_targets(docs_of):
    out = pareto_mix(docs_of(mix_rows())).collect()
    taken, target, size = {}, {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r["copies"] * r["size"]
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r["copies"] <= 2
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in taken:
        assert target[s] <= 2 * size[s] and abs(taken[s] - target[s]) <= 40


def test_mix_of_odd_rows(docs_of, odd_rows):
    out = pareto_mix(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert all(r["copies"] * r["size"] == 0 for r in out if not (r.text or "").strip())
    assert pareto_mix(docs_of([])).count() == 0


def test_mix_takes_a_part_of_a_large_group(docs_of):
    """A third of all rows are alike in id and size: as many of them are taken as are wanted."""
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "en", f"s{i % 3}") for i in range(600)]
    rows += [(5000, f"x y z w {i % 7}", "en", "s0") for i in range(300)] + [(None, "a null id", "en", "s1")] * 200
    out = pareto_mix(docs_of(rows)).collect()
    assert len(out) == len(rows)
    taken, target, size = {}, {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r["copies"] * r["size"]
        target[r.source], size[r.source] = r.target, r.source_size
    assert all(abs(taken[s] - target[s]) <= 50 and target[s] <= 2 * size[s] for s in taken)
    con = duckdb.connect()
    con.register("documents", docs_of(rows).select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted(((r.doc_id, r["size"], r.source_size, r.target, r["copies"] * r["size"]) for r in out), key=key)
    assert got == [pytest.approx(w) for w in sorted(con.execute(MIXING).fetchall(), key=key)]


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document is drawn about as often as its inclusion probability says, and it differs by size."""
    sizes = [4, 4, 9, 17, 33, 70, 5, 12, 40, 65] * 6
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string").coalesce(1)
    seeds = 24
    drawn = np.zeros(len(sizes))
    for seed in range(seeds):
        for r in pareto_mix(docs, weights=(1.0,), share=0.5, seed=f"s{seed}", bins=64).collect():
            drawn[r.doc_id] += r["copies"]
    weight = np.sqrt(2.0 ** np.floor(np.log2(sizes)))
    p = 0.5 * sum(sizes) / (weight * sizes).sum() * weight
    assert p.max() < 1
    by_size = {n: (drawn[np.array(sizes) == n].mean() / seeds, p[np.array(sizes) == n].mean()) for n in set(sizes)}
    assert all(abs(got - want) < 0.13 for got, want in by_size.values())
    assert by_size[4][0] < by_size[17][0] < by_size[70][0]
