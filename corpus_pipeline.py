"""From raw documents to packed training sequences, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.

Defined cases, for every stage: an empty table gives no rows; other columns of ``docs``, whatever
their names, are dropped; rows that repeat are judged alike; a null in ``lang``, ``source`` or ``n_chars``
stays; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcspark.llm import decontaminate, jaccard, packing, pii, quality
from arcspark.llm.common import table
from arcspark.llm.tokens import tokenizer_path
from arcspark.plans.scratch import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null text counts as empty and is judged so; without ratings of two grades all rows stay.
    """
    return quality.select(docs.select(*COLUMNS), quality.graded(table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard of 0.8 or more.

    The least ``doc_id`` of a group stays, with all its rows; null ids, and texts that are null or
    have no words, are near nothing and stay.
    """
    return jaccard.keep_first(docs.select(*COLUMNS), words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, re-parameterised ones included.

    Null ids and null or empty texts stay; an id that one of its rows gives away goes with all its rows.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced.

    All rows stay; null texts stay null; ``n_chars`` follows the text, 0 for null.
    """
    return pii.sanitise(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences.

    A null or empty text is one piece, its end id; rows that repeat are packed each for itself.
    """
    return packing.pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard", keep_distinct),
    ("decontamination", drop_leaks),
    ("pii", sanitise),
    ("best_fit_packing", pack),
]

#: Trained weights, components and tokens aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; results between stages are written and read."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
