"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from folioforge.llm.common import discard, materialise, stage_tables
from folioforge.llm.queries import tokenizer_path


#: Words that a worker keeps the ids of, twice over: fewer than alone, as the executors still hold what five stages have touched.
CACHE_WORDS = 30_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, shingle=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it replaced by their kinds."""
    return pii.sanitise_documents(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in training sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]

#: No SQL: models, tokenizers and packing are among the stages. Tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again, and what a stage wrote besides goes with its end.

    Stages take nulls in any column, empty and long texts, repeated rows, empty tables and columns beyond
    those of documents, whatever their names: the last returns pieces, all others the columns they were given.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with stage_tables() as keep:
            made = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(docs)
        docs = made
    return docs
