"""Writers: splits, JSON records, reports, statistics and landed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(split: DataFrame, path: str) -> None:
    """Train, val and test as CSV folders ``split=...``."""
    split.write.mode("overwrite").partitionBy("split").csv(path, header=True)


def write_records(records: DataFrame, path: str) -> None:
    """JSON records as text, a folder per kind of record."""
    records.select("record", F.col("json").alias("value")).write.mode("overwrite").partitionBy(
        "record"
    ).text(path)


def write_documents(pieces: DataFrame, path: str) -> None:
    """One JSON document per log and line, from the pieces of ``reports.parsed_documents``.

    A log's pieces are sorted into one task, which writes them one after the other; its
    memory does not grow with the log.  Pieces are parted by a blank, which JSON passes over.
    """
    ordered = pieces.repartition("log_id").sortWithinPartitions("log_id", "section", "position")
    ordered.select("text").write.mode("overwrite").option("lineSep", " ").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """Report lines sorted by log, section and position over files of their range."""
    report.sort("log_id", "section", "position").write.mode("overwrite").json(path)


def write_statistics(statistics: DataFrame, path: str) -> None:
    statistics.coalesce(1).write.mode("overwrite").json(path)


def land_logs(raw_logs: DataFrame, path: str) -> None:
    """Append fetched logs, one row per build, to a landing folder read in batch or as a stream."""
    raw_logs.select("log_id", "job_name", "raw_content").write.mode("append").parquet(path)
