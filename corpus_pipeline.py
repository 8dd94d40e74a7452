"""A corpus from raw documents to token ids in five stages, each by one operator of millrace.llm.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and is the next one's docs. All
but the last return the columns of documents:

quality          documents that the classifier rejects (score under its threshold) go
near_duplicates  of each class of near-duplicates the document of the least id stays
decontaminate    documents with any benchmark passage go
mix              documents as the mix to target weights takes them, repeats in the text
tokens           a row for each document of the written token files
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate as _decontaminate
from millrace.llm import jaccard, mixing, quality, tokens
from millrace.llm.keys import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, score = quality.score(docs, weights)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = _decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_columns=True)
    added = found.columns[len(docs.columns) :]
    return found.where(F.col(added[1]) == 0).drop(*added)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenize(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontaminate", keep_clean),
    ("mix", mix),
    ("tokens", write_tokens),
]

#: Training, PartEnum classes, hashed draws and the tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
