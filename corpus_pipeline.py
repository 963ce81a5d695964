"""Corpus pipeline: toxicity, quality rules, near duplicates, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
docs of the next. All but the last keep the columns of documents.

Null and empty texts fail the quality rules, so none passes the second stage; rows without an id are
treated like others; of rows that repeat an id and a text one stays, rows that share an id only are texts
of their own; columns beside doc_id and text are carried whatever their names; an empty table gives no rows.
Ties (equal ids with similar texts) are decided by a hash of the whole row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vistrack.llm import packing, pii, quality, simhash, toxicity
from vistrack.session import shared_dir


#: Words whose ids a worker of the packing stage remembers: workers outlive a stage and share an executor's memory with the next.
WORDS = 100_000


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below a toxicity of 0.5."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word similarity of 0.8, that of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def no_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replace_pii(docs, pii.secret_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence."""
    return packing.pack(docs, with_ids=False, cache=WORDS)


STAGES = [("toxicity", not_toxic), ("quality", good_quality), ("near_duplicates", distinct), ("pii", no_pii), ("packing", packed)]

#: No SQL expresses the tokenizer, the classifier or the keyed hashes; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
