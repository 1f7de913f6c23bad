"""A corpus pipeline: toxicity, exact dedup, MinHash near-dedup, benchmark decontamination, mixing.

Each stage takes all that the one before kept and returns the columns of documents; the last
returns how much of each document the mixture takes. ``run`` writes every stage to the shared folder and deletes what
the stage wrote on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, exact, minhash, mixing, toxicity
from quarry.llm.common import settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return docs.filter(toxicity.toxicity(docs, table(spark, sf_dir, "labels")) < 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the smallest doc_id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also none with edits."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"), edited=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document."""
    return mixing.taken_words(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the signatures and the multinomial draw have no SQL form.
ORACLE_SQL = None
