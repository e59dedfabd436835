"""Corpus preparation in five stages, each a whole-table job on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorflow.llm import language, mixing, near_dedup, packing, substring_dedup
from floorflow.llm.common import bound_batches, materialize
from floorflow.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go; the columns stay.

    Texts that are null, empty or without a letter have no language and go.
    Rows are told by id (null ids too) and text together, so another text with
    the same id stays; repeated rows stay or go together.  Very long texts are
    read whole.
    """
    bound_batches(spark)
    return language.drop_rejected(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest id;
    the columns stay.  Null, empty and wordless texts are in no group and stay,
    rows without an id take part, and of repeated rows one stays."""
    bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document are cut out, and documents of
    which no word is left go; the columns stay and n_chars follows.  Rows with
    a null id or text stay whole; of equal documents the smallest id does."""
    bound_batches(spark)
    return substring_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix: 90 % of all tokens by the target weights, each
    document once at most and whole (the last one of a leaf too, so that no
    text is broken); the columns stay.

    Null languages and sources are leaves of their own.  Texts without words
    cost nothing and stay, as do rows without an id, which no budget can name;
    rows of one id stay or go together.
    """
    return mixing.keep_mix(docs, mixing.WEIGHTS, fraction=0.9)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, as op9 returns them; null
    and empty texts are their end token, repeated rows are packed each, and a
    null id stays."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
