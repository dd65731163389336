from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from odflow.llm.bpe import Encoder, Merges, decode_ids, encode_and_decode, encode_texts
from odflow.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def agrees(encoder, library, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    decoded, bounds = encoder.decode(ids, counts).to_pylist(), np.concatenate([[0], np.cumsum(counts)])
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, text[:80]
        assert decoded[k] == library.decode(want, skip_special_tokens=False)


def test_contractions_runs_special_tokens_and_marks(encoder, library):
    agrees(encoder, library, [
        "don't ''s 's't x're're l'l'll 'rest'm it'sthe 1'd2' '", "Hello, it's the Ann\u00e9e 42nd <|endoftext|>.",
        "<|endoftext|><|startoftext|>a<|ENDOFTEXT|>b <| |> <|endoftext <|endoftext|", "\u03a3\u03b1\u03c2 \u03a3\u0391\u03a3 \u0130x H\u0331 e\u0301",
        "x\u0085y \u0085 a\u00a0b\u2003c \u0301x \x1c\x00\x85z", "\u65e5\u672c\u8a9e \U0001f600\U0001f600 \u00bd \u00b2 \u2167 \ufb01 \uff21\uff11", None, "", " \n\t ",
    ])


def test_every_code_point_of_the_first_plane(encoder, library):
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    runs = [points[k : k + 64] for k in range(0, len(points), 64)]
    agrees(encoder, library, ["a" + "b".join(r) + "c " + " ".join(r) for r in runs])


def test_long_pieces(encoder, library):
    draw = random.Random(5)
    letters = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (99, 100, 101, 3000)]
    agrees(encoder, library, [*letters, "a" * 20_001, "ab" * 777 + "!" * 4000, " ".join(letters)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'stdrvelm19 .,<|>\n\u00e9\u0301"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_any_text(texts):
    agrees(any_encoder, any_library, texts)


any_encoder, any_library = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


def plain_bpe(symbols, ranks):
    """One merge at a time: the lowest rank, the leftmost place."""
    word = list(symbols)
    while True:
        known = [(ranks[p], k) for k, p in enumerate(zip(word, word[1:])) if p in ranks]
        if not known:
            return word
        _, k = min(known)
        word[k : k + 2] = [word[k] + word[k + 1]]


@pytest.mark.parametrize("pairs", [
    [("a", "a"), ("a", "b"), ("aa", "aa"), ("ab", "c"), ("b", "c")],
    [("ab", "c"), ("bc", "a"), ("a", "b"), ("b", "c"), ("a", "bc")],  # a pair before its symbol is made
])
def test_rounds_agree_with_single_merges(pairs):
    made = dict.fromkeys(["a", "b", "c", *[a + b for a, b in pairs]])
    vocab = {t: k for k, t in enumerate(made)}
    names, ranks, merges = list(vocab), {p: r for r, p in enumerate(pairs)}, Merges(vocab, [list(p) for p in pairs])
    draw = random.Random(3)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 14))) for _ in range(600)]
    flat = np.array([vocab[c] for w in words for c in w], np.int32)
    ids, counts = merges.merge(flat, np.array([len(w) for w in words]))
    at = 0
    for word, n in zip(words, counts, strict=True):
        assert [names[i] for i in ids[at : at + n]] == plain_bpe(word, ranks)
        if word:
            assert merges.merge_long(np.array([vocab[c] for c in word], np.int32)).tolist() == ids[at : at + n].tolist()
        at += n


def test_tables(spark, docs_of, odd_rows, library):
    docs = docs_of(odd_rows)
    out = encode_and_decode(docs, tokenizer_path())
    assert out.columns == [*docs.columns, "n_tokens", "ids", "decoded"]
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(want), np.array(want, "<u4").tobytes())
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    lists = encode_texts(docs, tokenizer_path())
    back = decode_ids(lists, tokenizer_path())
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in out.collect())
    assert encode_and_decode(docs_of([]), tokenizer_path()).count() == 0
    few = spark.createDataFrame([(None,), ([],), ([320, None, 49407, 99999],)], "ids array<int>")
    assert [r.decoded for r in decode_ids(few, tokenizer_path()).collect()] == [None, "", library.decode([320, 49407], skip_special_tokens=False)]


def test_query_on_given_texts(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = QUERIES["op13_batched_bpe"](spark, folder).collect()
    assert len(out) == len(texts)
    for r in out:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
