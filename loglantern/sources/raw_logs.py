"""Readers for logs, labelled metadata and statistics, and line splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern import fixed_values as fx
from loglantern.functions.text import lines_of
from loglantern.operators.ordered import SLICE_ROWS
from loglantern.session import keep

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("error_category", T.StringType()),
        T.StructField("build_number", T.IntegerType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)
STATISTICS_SCHEMA = T.StructType(
    [
        T.StructField("total_logs", T.LongType()),
        T.StructField("platforms", T.MapType(T.StringType(), T.LongType())),
        T.StructField("error_categories", T.MapType(T.StringType(), T.LongType())),
    ]
)


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole log files: ``log_id`` (path), ``path``, ``job_name`` (file stem), ``raw_content``.

    A file is one value, of 2 GB at most; ``read_log_lines`` reads files of any size.
    """
    return raw_log_columns(spark.read.text(list(paths), wholetext=True))


def read_log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of log files of any size, as ``split_lines`` gives them of whole files.

    Spark splits files at line feeds; a split of a file is a slice.  What lies between two
    feeds is cut again at the other line breaks, and the lines are written once with their
    place in their task.  A window numbers a slice, and counts of the slices before, one row
    per split of a file, number the file.  Whether a file ends with a feed, which the reader
    does not tell, follows from its size.  Empty files give no rows: Spark reads none.

    A byte order mark is no part of the first line.  A compressed file is one slice, and ends
    as if a feed followed.
    """
    value = F.col("value")
    parts = F.split(F.regexp_replace(value, r"\r\z", ""), fx.LINE_BREAK)
    pieces = spark.read.option("lineSep", "\n").text(list(paths)).select(
        _file_path().alias("log_id"),
        F.col("_metadata.file_block_start").alias("slice"),
        F.col("_metadata.file_size").alias("file_size"),
        (F.octet_length(value) + 1).cast("bigint").alias("bytes"),
        # what follows a break that is neither feed nor return is a line only if a feed ends it
        ((value != "") & ~value.endswith("\r")).alias("open"),
        F.posexplode(parts).alias("part", "raw_line"),
        F.size(parts).alias("parts"),
    )
    last = F.col("part") == F.col("parts") - 1
    lines = keep(
        pieces.select(
            "log_id",
            "slice",
            "file_size",
            F.when(F.col("part") == 0, F.col("bytes")).otherwise(0).alias("bytes"),
            (F.col("open") & last & (F.col("raw_line") == "")).alias("may_go"),
            "raw_line",
            F.monotonically_increasing_id().alias("spot"),
        )
    )
    slices = lines.groupBy("log_id", "slice").agg(
        F.count("*").alias("n"),
        F.max("file_size").alias("file_size"),
        F.sum("bytes").alias("bytes"),
        F.max("spot").alias("last_spot"),
        F.max(F.when(F.col("may_go"), F.col("spot"))).alias("open_spot"),
    )
    whole = Window.partitionBy("log_id")
    by_place = whole.orderBy("slice")
    # a feed at the end leaves nothing over, its absence one byte less; a byte order mark adds three
    over = F.col("file_size") - F.sum("bytes").over(whole)
    facts = slices.select(
        "log_id",
        "slice",
        F.coalesce(F.sum("n").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.count("*").over(whole) > 1).alias("is_cut"),
        F.when(
            over.isin(-1, 2)
            & F.lead("slice").over(by_place).isNull()
            & (F.col("open_spot") == F.col("last_spot")),
            F.col("last_spot"),
        ).alias("no_line"),
    )
    here = F.row_number().over(Window.partitionBy("log_id", "slice").orderBy("spot"))
    return (
        lines.select("log_id", "slice", "raw_line", "spot", here.alias("place"))
        .join(facts, ["log_id", "slice"])
        .filter(~F.col("spot").eqNullSafe(F.col("no_line")))
        .select(
            "log_id",
            "slice",
            "is_cut",
            (F.col("place") + F.col("before")).cast("bigint").alias("line_number"),
            "raw_line",
        )
    )


def _file_path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def raw_log_columns(files: DataFrame, *more: Column) -> DataFrame:
    path = _file_path()
    return files.select(
        path.alias("log_id"),
        path.alias("path"),
        file_stem(path).alias("job_name"),
        F.col("value").alias("raw_content"),
        *more,
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).csv(path, header=True)


def read_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(path, multiLine=True)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """A statistics document as (field, value, logs) rows."""
    stats = spark.read.schema(STATISTICS_SCHEMA).json(path, multiLine=True)

    def part(field: str, column: str) -> DataFrame:
        return stats.select(F.lit(field).alias("field"), F.explode(column).alias("value", "logs"))

    total = stats.select(
        F.lit("total").alias("field"), F.lit("all").alias("value"), F.col("total_logs").alias("logs")
    )
    return total.unionByName(part("platform", "platforms")).unionByName(
        part("error_category", "error_categories")
    )


def reconcile(stated: DataFrame, counted: DataFrame) -> DataFrame:
    """Stated against counted numbers; ``agrees`` is 1 where they match."""
    both = stated.withColumnRenamed("logs", "stated").join(
        counted.withColumnRenamed("logs", "counted"), ["field", "value"], "full"
    )
    return both.withColumn("agrees", F.equal_null("stated", "counted").cast("bigint"))


def guard_size(raw_logs: DataFrame, limit: int = fx.MAX_LOG_CHARS) -> DataFrame:
    """Cut oversized texts, say so, and add a preview."""
    text = F.col("raw_content")
    return raw_logs.withColumns(
        {
            "truncated": (F.length(text) > limit).cast("bigint"),
            "preview": F.concat(F.substring(text, 1, fx.PREVIEW_CHARS), F.lit("...")),
            "raw_content": F.substring(text, 1, limit),
        }
    )


def split_lines(raw_logs: DataFrame) -> DataFrame:
    """Lines of raw logs, sliced by their place; an empty log stays as one row without a line."""
    whole = raw_logs.select("log_id", lines_of(F.col("raw_content")).alias("lines"))
    return whole.select(
        "log_id",
        F.coalesce(F.size("lines") > SLICE_ROWS, F.lit(False)).alias("is_cut"),
        F.posexplode_outer("lines").alias("pos", "raw_line"),
    ).select(
        "log_id",
        F.floor(F.coalesce("pos", F.lit(0)) / SLICE_ROWS).cast("bigint").alias("slice"),
        "is_cut",
        (F.col("pos") + 1).cast("bigint").alias("line_number"),
        "raw_line",
    )
