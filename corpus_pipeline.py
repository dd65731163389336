"""Corpus pipeline: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. A stage's result is written and read again as the docs of the next.

Columns of any name pass through the stages unchanged, also those named like an operator's results. Rows are
judged one by one where a stage looks at a text alone, so repeated rows share their fate. Null and empty texts
are scored like others by quality and toxicity, are linked to nothing, have size 0 in the mix, and are packed as the
end id alone. Null ids are kept as rows. Empty tables give empty results. Scores exactly at a threshold count as
above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm.common import held_out, shielded, table
from odflow.llm.mixing import pareto_mix
from odflow.llm.packing import pack_power_of_two
from odflow.llm.quality import score_quality
from odflow.llm.queries import tokenizer_path
from odflow.llm.similarity import jaccard_join
from odflow.llm.toxicity import score_toxicity
from odflow.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels")

    def kept(df: DataFrame) -> DataFrame:
        return score_quality(df, labels, ~held_out("doc_id", 5, 0)).where(F.col("predicted") == 1)

    return shielded(docs, ("doc_id", "text"), kept)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier lets pass."""
    labels = table(spark, sf_dir, "labels")

    def kept(df: DataFrame) -> DataFrame:
        return score_toxicity(df, labels, ~held_out("doc_id", 3, 1)).where(F.col("predicted") == 0)

    return shielded(docs, ("doc_id", "text"), kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id, nulls last."""
    return shielded(docs, ("doc_id", "text"), lambda df: jaccard_join(df).where("stays"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""

    def taken(df: DataFrame) -> DataFrame:
        mixed = pareto_mix(df).where(F.col("copies") > 0)
        return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    return shielded(docs, ("doc_id", "text", "source"), taken)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary length with their token ids."""
    return pack_power_of_two(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]
# learnt models and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
