"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last return the columns of
docs. Nulls: a null text is an empty one; of rows that repeat, near-duplicate removal keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table
from graphloom.llm.decontam import clean_documents
from graphloom.llm.near_copies import one_of_each
from graphloom.llm.packing import pack
from graphloom.llm.pii import without_personal_data
from graphloom.llm.toxicity import without_toxic
from graphloom.shared import cut, drop


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: SimHash fingerprints of five-word shingles within 3 bits, or similarity 0.8 or
    more of these shingles."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    return without_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training windows."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: A trained classifier and a tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and deleted once the next one
    has been written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
