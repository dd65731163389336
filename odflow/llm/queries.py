"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm.bpe import encode_and_decode
from odflow.llm.common import held_out, table
from odflow.llm.extraction import extract_main_text
from odflow.llm.language import identify_language
from odflow.llm.lexical import lexical_search
from odflow.llm.mixing import pareto_mix
from odflow.llm.oracles import JACCARD, LEXICAL, MIXING, SEARCH
from odflow.llm.packing import pack_power_of_two
from odflow.llm.quality import score_quality
from odflow.llm.rules import outlier_rules
from odflow.llm.scoring import score_texts
from odflow.llm.search import top_k
from odflow.llm.similarity import jaccard_join
from odflow.llm.toxicity import score_toxicity
from odflow.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": JACCARD,
    "op5_kd_tree_search": SEARCH,
    "op9_pareto_mixing": MIXING,
    "op12_limited_accumulators": LEXICAL,
}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query
def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_power_of_two(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "class_id", "n_links")


@query
def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query
def op5_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query
def op6_block_labeller_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_mcd_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_rules(table(spark, sf_dir, "documents")).drop("distance")


@query
def op8_log_bilinear_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))
    return scored.select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query
def op10_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, ~held_out("doc_id", 4, 2))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_batched_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
