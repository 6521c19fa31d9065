"""A training corpus from documents: five stages, each written and read again.

    language          rejected and letterless documents go          (operator 3)
    exact_dedup       of equal texts the smallest id stays          (operator 6)
    near_dedup        of near-duplicate groups the smallest id      (operator 10)
    decontaminate     documents that a benchmark item leaks into go (operator 5)
    packing           what stays, as packed token sequences         (operator 9)

A stage takes all that its predecessor kept, and all but the last return the
columns of the documents as they came.

Edge cases: null, empty and letterless texts go with the first stage, as they
have no language; of rows that repeat an id and a text all stay together or go
together until near copies are taken apart; very long texts are read whole;
further columns pass through; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import decontaminate, exact_dedup, language, near_dedup, packing
from panelwright.llm.common import read, stage
from panelwright.llm.registry import query


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted_rows(docs, language.fit(language.training_fold(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]
# A trained model, similarity groups and tokenisation are beyond SQL.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "documents")
    for i, (name, fn) in enumerate(STAGES):
        out = fn(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = stage(out, f"kept-{name}")
    return out
