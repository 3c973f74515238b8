"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before kept, written as Parquet and read
again; all but the last return the columns of documents. Other columns, whatever their names, come through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import base
from tidemark.llm.exact import distinct_texts
from tidemark.llm.learning import without_toxic
from tidemark.llm.near import without_near
from tidemark.llm.packing import WORD_BPE, pack
from tidemark.llm.substrings import without_repeats


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows that score 0.5 or more go. Each row is judged by its own text (null: empty); doc_id may be null
    or repeated, and an empty table stays empty."""
    return without_toxic(docs, base.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of rows with equal texts (null: empty) the one of the largest doc_id stays, null ids being smaller
    than all; of rows that repeat with their doc_id one stays. Rows are dropped, not ids: another text of the same
    doc_id isn't touched."""
    return distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, on shingles of five words: of each group of near-duplicates the row of the smallest doc_id stays (null
    ids last, of equal ids one). Rows without words stay."""
    return without_near(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages of 13 words and more that a smaller doc_id has too go; every row stays. Rows with a null
    doc_id or text stay as they are."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one row a piece of a document, with its place in a sequence. Null text: the end id alone."""
    return pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packing)]

#: The first stage learns its model; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
