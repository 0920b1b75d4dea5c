"""Helpers the training-data operators share: tables, lasting results, positions in an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglantern.session import shared_folder

#: A word, wherever words are counted: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: What separates words, for splitting.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lasting(rows: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder, so that they survive lost executors."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def unused(rows: DataFrame, name: str) -> str:
    """A column name that the rows do not have."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def same(columns: list[str]) -> Column:
    """Equality of the columns of two aliased sides, nulls being equal."""
    return reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns])


def placed(
    rows: DataFrame, group: list[str], order: list[str], size: Column | None = None, buckets: int = 1024, name: str = "position"
) -> DataFrame:
    """Adds the running sum of ``size`` before each row (1 per row if None) within its group.

    ``order[0]`` must be a hash (long); rows are ordered by its bucket, then by ``order``.
    Groups are cut into ``buckets`` parts whose sums are added up first, so that no group,
    however large, meets in one task. ``group`` columns must not be null.
    """
    part = "_part"
    cut = rows.withColumn(part, F.pmod(F.col(order[0]), F.lit(buckets)).cast("int")).withColumn(
        "_size", F.lit(1).cast("long") if size is None else size.cast("long")
    )
    sums = cut.groupBy(*group, part).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(starts, [*group, part])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .drop(part, "_size", "_start")
    )
