from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source), with columns named like the operators' results."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
        clashing = ("score", "size", "target", "predicted", "lang_pred", "class_id", "kept", "length")
        return df.withColumns({c: F.lit("other") for c in clashing})

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, repeated, very long and letterless texts, null ids, languages and sources."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, "123 ... ###", "en", None),
        (5, "the same text of some words stands here twice", "en", "a"),
        (5, "the same text of some words stands here twice", "en", "a"),
        (None, "a row without an id and with words enough", "en", "b"),
        (None, None, None, None),
        (6, long, "en", "b"),
    ]
