"""A corpus pipeline out of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it
kept, and all but the last return the columns of ``documents``. A stage's result is
written as Parquet and read again, so that a stage that is run anew starts from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyline.llm import jaccard, langid, mixing, packing, suffix
from rallyline.llm._base import Scratch, load


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages, or without a letter, go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return jaccard.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur more than once are cut out of the texts."""
    return suffix.without_repeats(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, cut and repeated as their sources' targets ask, in training order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; a row per piece."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: Kneser-Ney models and a public tokenizer's ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's table is deleted once the next one's is there."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # a checkpoint, which needs its input no more
    scratch.drop(docs)
    return out
