"""The corpus pipeline: language ID, near-dedup, decontamination, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns the columns of documents; the
last returns the pieces of packed sequences.

A document leaves if its language isn't recognised (no letter, or a score below 0.5), if another document of its near-duplicate
component has a smaller doc_id, or if it holds a benchmark item; personal data in the rest is replaced by its kind.

Defined cases, in every stage: a null text is an empty one, so it leaves with the first stage; a null doc_id is carried, never compared by
near-dedup and never learned from; a null lang teaches nothing; repeated rows share their fate, so all of them stay or go; rows that share a
doc_id but not the text are documents of their own; a text of any length is read whole; ties are those of the operators (equal similarity is a
link, an equal score stays); extra columns are carried whatever their names; an empty table gives an empty one; an empty benchmark
removes nothing.
"""

from __future__ import annotations

from codestrata.llm import decontam, langid, neardup, packing, pii
from codestrata.llm.common import materialize, table
from pyspark.sql import DataFrame, SparkSession

#: Word shingles of five words, a Jaccard similarity of 0.8 or more; 85 is the contract of operator 4's query alone.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.least_of_each(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses none of the stages but the filters; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
