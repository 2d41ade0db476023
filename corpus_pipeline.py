"""Raw documents to packed training sequences: five stages, each written as Parquet before the next reads it.

Every stage takes null ids, texts and other columns, empty and very long texts, repeated rows, empty tables and other
columns of any name; what becomes of them is said in the docstring of the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftmark.llm import decontaminate, jaccard, language, packing, suffixes
from siftmark.llm.shared import discard, tables, written
from siftmark.sources.tables import read_table

#: Naive Bayes scores and MinHash candidates have no exact SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with lang as identified; the model is trained on the labelled rows of docs."""
    return language.keep(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id, of each group of near copies."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages that an earlier place of the table has; documents of nothing else go."""
    return suffixes.remove(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("suffix_array", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, as rows of the last. What a stage keeps is written to the shared folder and read again;
    then the table before it, and those that its operator wrote, are deleted. An empty table of documents gives none."""
    docs, others = read_table(spark, f"{sf_dir}/documents.parquet"), tables()
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        path = written(found, name)
        discard(*(tables() - others - {path}))
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
