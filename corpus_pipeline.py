"""A corpus made ready for training, stage by stage.

Every stage takes the documents its predecessor kept, as read back from Parquet, and returns
documents with the same columns; the last one returns the pieces of packed sequences. A null text
counts as an empty one in all stages, texts are read whole, and a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casedesk.llm import exact, jaccard, mixing, packing, toxicity
from casedesk.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the labels of the table train the scores.

    Rows are judged one by one, so repeated rows share their fate; null ids are not labelled. Without
    labelled rows all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.learn(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, white space aside.

    Most code points stay, then the smallest id, null last; of rows that tie in both, any one.
    Empty texts are a group.
    """
    return exact.unique_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by Jaccard similarity of 0.8 or more.

    That with the smallest id stays, null last, and once if it is repeated. Texts without words are
    linked with nothing and stay, rows equal in id and text once.
    """
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, or as much of them, as the sources' targets ask for.

    A null source is a source, the last one; repeated rows and null ids are documents like others.
    Texts without words are taken not at all.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset.

    Repeated rows and null ids are packed like all others.
    """
    return packing.pack(docs, *packing.public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Toxicity scores and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
