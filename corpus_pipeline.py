"""Corpus pipeline: documents to a clean, deduplicated, mixed and shuffled training set.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns rows with the columns of
docs as they were, extra ones and ones with any name included; the last adds shard_id and shard_pos. Each takes nulls
in any column, empty and very long texts, repeated rows and empty tables, and an empty labels or benchmark table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreweave.llm import decontaminate, mixing, neardup, sharding, toxicity
from loreweave.llm.shared import new_path

#: Training, near-duplicate search, suffix arrays, subset sums and seeded shuffles: no SQL for them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``docs`` and the labels, doesn't reject.

    Null, empty and wordless texts are never rejected; without a confirmed toxic text nothing is. Copies are decided alike.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id.

    Null, empty and wordless texts and rows without a doc_id always stay; of rows that share a doc_id one does, by the least text.
    """
    return neardup.drop_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark: 13 words in a row, or a whole item of 6 to 12; and that are no shorter item.

    Null and empty texts and items match nothing; rows without a doc_id are removed like others, copies alike.
    """
    return decontaminate.drop_affected(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that make up the target token weights of their sources, by default 0.8 of all tokens.

    Null, empty and blank texts have no token and go; null is a source of its own. Copies are documents by themselves.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, uniformly shuffled into shards of exact sizes: with shard_id and shard_pos. Every row, of whatever kind, lands in one shard."""
    return sharding.shuffle_into_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
