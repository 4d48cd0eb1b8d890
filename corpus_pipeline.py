"""From raw documents to mixed, tokenised training text: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from flowseries.llm import mixing, near_copies, pii, quality_rules, sentencepiece_codec
from flowseries.llm.batches import small_batches
from flowseries.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """The stage with texts going to Python in small batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_lean
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all columns.

    A null or empty text has no words and is rejected, as is any of fewer than 50; texts of any length are judged whole;
    for a null language, or one without references, the base rules alone decide; repeated rows are judged alike, and each
    distinct text that passes the base rules counts once for the references; null ids stay; other columns stay, whatever their names; an empty table
    gives none.
    """
    return quality_rules.quality_filter(docs)


@_lean
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies (five words a shingle, Jaccard 0.8 or more).

    Null and empty texts are copies of each other; texts of any length count whole; rows are told apart by id and text,
    null ids come after all others, so a group of null ids alone keeps its rows, and of repeated rows of the smallest id
    all stay; other columns stay, whatever their names; an empty table gives none.
    """
    return near_copies.one_of_each(docs)


@_lean
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text replaced by the kind in angle brackets, and ``n_chars`` renewed.

    A null text stays null, one without personal data stays as it is; texts of any length are searched whole, in time
    that is linear in text and spans; of overlapping spans the first gives its kind; repeated rows are treated alike;
    other columns stay, whatever their names; an empty table gives none.
    """
    return pii.redact(docs)


@_lean
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows that it takes twice stand there twice.

    A null source is a source of its own, the last; null and empty texts have no words and are never taken; ties of the
    order go by source, hash and id; repeated rows of one source and id queue as one and are taken alike; other columns stay, whatever their names; an empty table gives none.
    """
    return mixing.mixed_documents(docs)


@_lean
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``token_ids`` and ``round_trip``, in place of columns so named.

    A null text encodes as an empty one, to no ids; texts of any length are encoded whole; repeated rows get the same
    ids; other columns stay; an empty table gives none.
    """
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load_model(spark))


STAGES = [("quality", quality), ("dedup", dedup), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The stages rest on XXH64 and a tokenizer, which DuckDB can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
