from __future__ import annotations

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    sizes = [s.count() for s in stages]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0


def test_no_near_copies_stay(stages):
    from odflow.llm.similarity import jaccard_join

    assert jaccard_join(stages[3]).where("n_links > 0").count() == 0


def test_mix_repeats_and_packing_covers(stages):
    from collections import Counter

    kept, mixed = Counter(r.doc_id for r in stages[3].collect()), Counter(r.doc_id for r in stages[4].collect())
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 2
    packed = Counter()
    for r in stages[5].select("doc_id", "length", "doc_tokens").collect():
        packed[r.doc_id] += r.length / r.doc_tokens
    assert all(abs(packed[d] - n) < 1e-9 for d, n in mixed.items())


CLASHING = ["score", "predicted", "size", "target", "source_size", "class_id", "n_links", "stays", "copies", "_row", "_rank", "_mark", "label"]


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    """Given documents with columns named like the operators' own, and null, empty, repeated and very long rows."""
    given = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "source")
    rows = [(None, None, None, None), (None, "", "en", None), (5, None, "en", "a"), (5, None, "en", "a"), (90001, "long " * 200_000, "en", "b")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    df = given.unionByName(odd)
    df.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) AS `{c}`" for c in CLASHING]).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_keep_clashing_columns(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        for r in docs.select("doc_id", *CLASHING).collect():
            assert all(r[c] == f"{c}{r.doc_id or 0}" for c in CLASHING)
    assert docs.count() > 50
    assert corpus_pipeline.packing(spark, docs, SF).where("length < 1").count() == 0


def test_stages_of_an_empty_table(spark, odd_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), SF).count() == 0
