"""A training-data pipeline of five stages over ``documents``; counted as part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written
as Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``.

Defined cases, in every stage: null and empty texts are documents like others (never toxic, all alike for
near-duplicates, nothing to redact; a document without a word is taken 0 times by the mix and so ends there); texts
of any length are handled whole; a null doc_id stays a row of its own; repeated rows stay rows until one of each
group of near-duplicates is kept; an empty table gives an empty one; further columns travel along whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import bpe, mixing, pii, simhash, toxicity
from arbora.llm.common import ensure_checkpoint_dir
from arbora.llm.queries import tokenizer_path
from arbora.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the grammar, learned from all labels of these documents, scores under 0.5."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id."""
    ship_package(spark)
    return simhash.keep_one_similar(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of tokens and decoded text for every document of the mix."""
    ship_package(spark)
    return bpe.digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each),
    ("pii", redact),
    ("mixing", mix),
    ("bpe", encode),
]

#: Tokens can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them goes to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
