"""Incremental analysis of a landing folder: each log arrives whole, in one row.

No state crosses batches, so every batch runs the same functions as a batch job.
Results of a batch go to folders named after it; a repeated batch replaces its own.
A build that lands again counts as it landed last, by its file's time, path and row: within
a batch earlier landings are left out, across batches ``latest`` reads the last one's results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loglantern.operators import parse
from loglantern.rules import PLATFORM_RULES, PlatformRules
from loglantern.sources.raw_logs import raw_log_columns, split_lines

LANDED = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("job_name", T.StringType()),
        T.StructField("raw_content", T.StringType()),
    ]
)


ARRIVED = "struct<landed_at: timestamp, file: string, row: bigint>"


def _arrival(row: Column) -> Column:
    time, file = (F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_path"))
    return F.struct(time.alias("landed_at"), file.alias("file"), row.alias("row")).alias("arrival")


def landed_logs(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Logs landed as rows."""
    rows = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select("*", _arrival(F.col("_metadata.row_index")))


def last_landed(batch: DataFrame) -> DataFrame:
    """One row per log, the last to arrive; texts meet only the slim table of last arrivals.

    Rows that do not tell when they arrived count by their name and text.
    """
    if "arrival" not in batch.columns:
        batch = batch.withColumn("arrival", F.struct("job_name", "raw_content"))
        last = batch.groupBy("log_id").agg(F.max("arrival").alias("arrival"))
        return last.select("log_id", "arrival.*")
    last = batch.groupBy("log_id").agg(F.max("arrival").alias("last"))
    last = last.select(F.col("log_id").alias("last_id"), "last")
    same = F.col("log_id").eqNullSafe(F.col("last_id")) & F.col("arrival").eqNullSafe(F.col("last"))
    return batch.join(last, same).drop("last_id", "last")


def latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Summaries, stages or entries of all batches, each log as it landed last."""
    arrivals = spark.read.parquet(f"{out}/arrivals")
    order = F.struct("landed_at", "file", "row", "batch")
    last = arrivals.groupBy("log_id").agg(F.max(order).alias("last"))
    last = last.select(F.col("log_id").alias("last_id"), F.col("last.batch").alias("last_batch"))
    rows = spark.read.parquet(f"{out}/{name}")
    same = F.col("log_id").eqNullSafe(F.col("last_id")) & (F.col("batch") == F.col("last_batch"))
    return rows.join(last, same, "left_semi").drop("batch")


def landed_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Logs landed as text files, one per build."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return raw_log_columns(files, _arrival(F.lit(0).cast("bigint")))


def analyse(
    raw_logs: DataFrame,
    out: str,
    checkpoint: str,
    rules: Sequence[PlatformRules] = PLATFORM_RULES,
    **trigger,
) -> StreamingQuery:
    """Write summaries, stages and entries of arriving logs under ``out``."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        builds = last_landed(batch)
        arrival = F.col("arrival") if "arrival" in builds.columns else F.lit(None).cast(ARRIVED)
        builds, arrivals = builds.drop("arrival"), builds.select("log_id", arrival.alias("a")).select("log_id", "a.*")
        facts = parse.read_lines(split_lines(builds), rules)
        # three results come from it; a lost executor's part is read again
        facts = facts.persist()
        try:
            rolled = parse.roll_up(facts, rules, headers=True)
            results = {
                "summaries": parse.named(
                    parse.log_counts(rolled, rules).join(
                        builds.select("log_id", F.col("job_name").alias("landed_name")), "log_id"
                    ),
                    {"job_name": F.col("landed_name")},
                ).drop("landed_name"),
                "stages": parse.stages(rolled),
                "entries": parse.entries(facts),
                "arrivals": arrivals,
            }
            for name, rows in results.items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            facts.unpersist()

    return (
        raw_logs.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
