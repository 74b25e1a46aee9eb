"""Five stages from raw documents to shards of training data.

Each stage takes what its predecessor kept, and all but the last return the
columns of the documents.

Every stage judges whole texts of any length. NULL and empty texts are neither toxic
nor near duplicates nor leaks; mixing gives them the posteriors of the prior, and they
are put into shards with size 1. Rows with a NULL doc_id count as the smallest. Of rows
equal in doc_id and text one is left after the second stage; texts that share a doc_id
are judged each by itself for toxicity and leaks, and stand or fall together as near
duplicates. Extra columns stay, whatever their names, up to the last stage, which
returns columns of its own. Empty tables go through empty; without labels nothing is
toxic and all domains are alike, without a benchmark nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knowspark.llm import decontaminate, mixing, near_dup, sharding, toxicity
from knowspark.llm.queries import table
from knowspark.llm.scratch import written

SHARDS = 16
#: Whole documents that travel to a Python worker at once: some megabytes of text,
#: where Spark's own 10,000 rows would be tens of them on either side.
BATCH_ROWS = 2_000


def in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field scores below its threshold."""
    in_small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    in_small_batches(spark)
    return near_dup.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    in_small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the place of every document."""
    return sharding.shard_bytes(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_domains),
    ("sharding", put_into_shards),
]

#: The classifiers and the sampled splitters are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
