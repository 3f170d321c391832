"""From raw documents to training shards: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all return the columns of documents. The last adds shard and slot to every row that the mix takes. What the
stages leave in the shared folder is removed once the next one is written; the last stage's rows stay.

In all stages null and empty texts, texts of any length, null and repeated ids, equal rows and columns of other names are
allowed, and an empty table stays empty: see each operator's module. A null text scores like an empty one and goes with it;
equal rows are near copies, of which one stays; a null source is a source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import decontamination, mixing, quality, sharding, simhash
from postmill.llm.common import delete_folder, shared_dir


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows, with their texts, are dealt to shards that all have the mixture."""
    return sharding.deal(docs)


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: Training and tree search can't be said in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete_folder(spark, f"{base}/{k - 1}")
    return docs
