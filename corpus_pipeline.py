"""A pipeline over documents: language ID, line dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. Tables are documents (doc_id, text, lang, source, n_chars); other columns go. All stages but
the last return these columns, and take tables without rows. Each stage's docstring says what becomes of nulls,
empty texts and repeats; long texts are always worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallykeep.llm.common import give_back, new_path, table
from tallykeep.llm.language import keep_known
from tallykeep.llm.lines import dedup_lines
from tallykeep.llm.mixing import mix_documents
from tallykeep.llm.near_copies import keep_first_copies
from tallykeep.llm.packing import pack_documents
from tallykeep.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, by their score; lang is filled in where there is none.

    Null texts and texts without a letter go; repeats and rows without an id are judged like others.
    """
    give_back(spark)
    return keep_known(docs.select(*COLUMNS))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; what is left empty goes, null texts too.

    Of equal texts the one with the smallest id stays whole; n_chars is counted anew.
    """
    out = dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word Jaccard similarity of 0.8 or more, found by SimHash.

    The smallest id stays, rows without an id come last; texts without words are one group.
    """
    give_back(spark)
    return keep_first_copies(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights says, so a row may repeat; without labels once each.

    Null and empty texts stay as they are: they have no tokens.
    """
    give_back(spark)
    return mix_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; null texts count as empty, repeats are packed each."""
    give_back(spark)
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", lines_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages' models and alignments can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each from what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
