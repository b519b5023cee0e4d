"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.mtree import search_query

    return search_query(_table(spark, sf_dir, "embeddings"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.lm import lm_query

    return lm_query(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.mixing import mix_query

    return mix_query(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.pii import pii_query

    return pii_query(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.toxicity import toxicity_query

    return toxicity_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from arbora.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.capfilter import dedup_query

    return dedup_query(_table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.suffix import dedup_query

    return dedup_query(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.langid import language_query

    return language_query(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    from arbora.llm.alignment import alignment_query

    return alignment_query(_table(spark, sf_dir, "documents"), a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbora.llm.voronoi import mining_query

    return mining_query(_table(spark, sf_dir, "embeddings"))


def op13_token_grammar(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from arbora.llm.grammar import token_query

    return token_query(_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_top_k, op2_lm_scores, op3_mixing, op4_pii, op5_toxicity, op6_bpe, op7_simhash, op8_embedding_dedup, op9_suffix_dedup, op10_language_id, op11_alignment, op12_hard_negatives, op13_token_grammar]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express: the others are tested against brute force, round trips or held-out rows."""
    from arbora.llm.capfilter import DEDUP_SQL
    from arbora.llm.lm import LM_SQL
    from arbora.llm.mixing import MIX_SQL
    from arbora.llm.mtree import SEARCH_SQL
    from arbora.llm.voronoi import MINING_SQL

    return {"op1_top_k": SEARCH_SQL, "op2_lm_scores": LM_SQL, "op3_mixing": MIX_SQL, "op8_embedding_dedup": DEDUP_SQL, "op12_hard_negatives": MINING_SQL}
