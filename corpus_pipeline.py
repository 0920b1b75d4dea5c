"""From documents to balanced training shards, a table per stage.

Each stage works on all its predecessor kept and is written as Parquet before the next one
reads it. Empty tables give empty tables; what a stage does with nulls, blank and repeated
rows is said by the operator it calls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm import chosen_path, decontaminate, mixing, quality, sharding
from loglantern.llm.common import table, unused
from loglantern.llm.queries import held_out
from loglantern.session import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    own = unused(docs, "_score")
    scored = quality.score(docs.withColumnsRenamed({"score": own}), model)
    return scored.where(F.col("score") >= quality.THRESHOLD).drop("score").withColumnsRenamed({own: "score"})


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return chosen_path.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix, whole, with its shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mix),
    ("sharding", shards),
]

#: A learned model and an iterative join are no SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the last result lasts in the shared folder.

    A stage's table is removed once the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this run, on whatever storage it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
