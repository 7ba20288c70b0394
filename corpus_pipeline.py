"""From documents to a mixed and sharded training corpus, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, and any more that docs has, whatever their names.
Null or repeated ids, equal rows, empty and very long texts and empty tables are ordinary input to each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, minhash, mixing, ring, toxicity
from tidelog.llm.common import Scratch
from tidelog.llm.queries import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; labels are learnt outside the held-out fold. Rows without text stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, labels, fold(5, 0))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id; rows without words stay.

    Rows without an id, and different texts with one id, are documents of their own; equal rows are copies.
    """
    return minhash.keep_one(docs, minhash.MinHash(shingle=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; each row is judged by its own text, with or without an id."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row appears as often as the mix takes it; rows without words appear once."""
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot; rows without an id, or with the same one, are rows like any other."""
    return ring.assign(docs, ring.Ring(shards=40))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages learn, hash and iterate; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
