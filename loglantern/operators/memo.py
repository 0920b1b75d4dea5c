"""Content-keyed, time-limited memo of results: only what is missing is computed again.

On storage a memo is a folder per type and generation, ``cache_type=fixes/generation=3``. Results
are appended to the type's current generation. Clearing, expiring and compacting write the next
generation whole and then create an empty file, ``_generations/fixes=3``, that makes it the
current one; readers see the old state or the new one, and what a crash leaves half written is
replaced by the next attempt. Types change one by one, so clearing one does not copy the others.
A memo has one writer at a time; a result appended to a generation that is being replaced is
lost, that is, computed again. Two writes of one result are one entry.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern import fixed_values as fx

SUFFIXES = {"summaries": "", "explanations": "_explain", "fixes": "_fix"}
ENTRY = "key string, written_at timestamp_ntz, write_id bigint, value string"
MARKS = "_generations"


def content_key(content: Column, cache_type: str | None = None) -> Column:
    """Hex SHA-256 of the content and, for a log's text, the suffix of the result's type."""
    suffix = SUFFIXES[cache_type] if cache_type else ""
    return F.sha2(F.concat(content, F.lit(suffix)) if suffix else content, 256)


def known_type(cache_type: Column) -> Column:
    return F.when(cache_type.isin(*fx.MEMO_TYPES), cache_type).otherwise(fx.MEMO_TYPES[0])


def as_entries(writes: DataFrame) -> DataFrame:
    return writes.select(
        known_type(F.col("cache_type")).alias("cache_type"),
        content_key(F.col("content")).alias("key"),
        "written_at",
        "write_id",
        "value",
    )


def current(entries: DataFrame) -> DataFrame:
    """The last write of each (type, key) wins; map-side aggregation, no window."""
    return (
        entries.groupBy("cache_type", "key")
        .agg(F.max(F.struct("written_at", "write_id", "value")).alias("last"))
        .select("cache_type", "key", "last.written_at", "last.write_id", "last.value")
    )


def is_live(now: dt.datetime, ttl: int = fx.MEMO_TTL_SECONDS) -> Column:
    """Live up to and including the ttl; a later clock than ``now`` counts as young."""
    oldest = now - dt.timedelta(seconds=ttl)
    return F.col("written_at") >= F.lit(oldest.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id",
        known_type(F.col("cache_type")).alias("cache_type"),
        content_key(F.col("content")).alias("key"),
    )


def lookup(
    requests: DataFrame, entries: DataFrame, now: dt.datetime, ttl: int = fx.MEMO_TTL_SECONDS
) -> DataFrame:
    """Each request with its hit flag and, on a hit, the stored value."""
    live = current(entries).filter(is_live(now, ttl)).select("cache_type", "key", "value")
    return (
        _asked(requests)
        .join(live.withColumn("found", F.lit(True)), ["cache_type", "key"], "left")
        .select(
            "request_id",
            "cache_type",
            "key",
            F.coalesce("found", F.lit(False)).cast("bigint").alias("hit"),
            "value",
        )
    )


def missing(
    requests: DataFrame, entries: DataFrame, now: dt.datetime, ttl: int = fx.MEMO_TTL_SECONDS
) -> DataFrame:
    """The distinct (type, key) pairs asked for that have no live entry."""
    live = current(entries).filter(is_live(now, ttl))
    asked = _asked(requests).select("cache_type", "key").distinct()
    return asked.join(live.select("cache_type", "key"), ["cache_type", "key"], "left_anti")


def _storage(spark: SparkSession, path: str):
    """Hadoop's view of a path, whatever storage it lies on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    files, target = _storage(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _storage(spark, path)
    files.delete(target, True)


def generations(spark: SparkSession, path: str) -> dict[str, int]:
    """The current generation of each type."""
    found = dict.fromkeys(fx.MEMO_TYPES, 0)
    for name in _names(spark, f"{path}/{MARKS}"):
        cache_type, _, number = name.rpartition("=")
        if cache_type in found:
            found[cache_type] = max(found[cache_type], int(number))
    return found


def _append(entries: DataFrame, path: str, numbers: dict[str, int]) -> None:
    number = F.lit(None).cast("int")
    for cache_type, n in numbers.items():
        number = F.when(F.col("cache_type") == cache_type, n).otherwise(number)
    columns = ("cache_type", "key", "written_at", "write_id", "value")
    rows = entries.select(*columns, number.alias("generation")).where(F.col("generation").isNotNull())
    rows.write.mode("append").partitionBy("cache_type", "generation").parquet(path)


def store(results: DataFrame, path: str) -> None:
    """Append results (cache_type, key, written_at, write_id, value)."""
    _append(results, path, generations(results.sparkSession, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the current generations; none where nothing was stored."""
    at = [f"cache_type={t}/generation={n}" for t, n in generations(spark, path).items()]
    folders = [f"{path}/{f}" for f in at if _names(spark, f"{path}/{f}")]
    shape = f"{ENTRY}, cache_type string"
    if not folders:
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(shape).option("basePath", path).parquet(*folders)
    return rows.select("cache_type", "key", "written_at", "write_id", "value")


def rewrite(entries: DataFrame, path: str, types: Iterable[str] = fx.MEMO_TYPES) -> None:
    """Replaces what is stored of some types by ``entries``, which may be read from the same path."""
    spark = entries.sparkSession
    now = generations(spark, path)
    following = {t: now[t] + 1 for t in types}
    for cache_type, number in following.items():
        _delete(spark, f"{path}/cache_type={cache_type}/generation={number}")
    _append(entries, path, following)
    for cache_type, number in following.items():
        files, mark = _storage(spark, f"{path}/{MARKS}/{cache_type}={number}")
        files.create(mark).close()


def drop_replaced(spark: SparkSession, path: str) -> None:
    """Removes earlier generations, once no reader is left that began before they were replaced."""
    for cache_type, number in generations(spark, path).items():
        for name in _names(spark, f"{path}/cache_type={cache_type}"):
            if name.startswith("generation=") and int(name.split("=")[1]) < number:
                _delete(spark, f"{path}/cache_type={cache_type}/{name}")
        for earlier in range(number):
            _delete(spark, f"{path}/{MARKS}/{cache_type}={earlier}")


def clear(entries: DataFrame, cache_type: str | None = None) -> DataFrame:
    """What is left after clearing one type, or all."""
    return entries.filter(F.lit(False) if cache_type is None else F.col("cache_type") != cache_type)


def cleanup(entries: DataFrame, now: dt.datetime, ttl: int = fx.MEMO_TTL_SECONDS) -> DataFrame:
    """What is left after removing expired entries."""
    return current(entries).filter(is_live(now, ttl))


def cleanup_report(entries: DataFrame, now: dt.datetime, ttl: int = fx.MEMO_TTL_SECONDS) -> DataFrame:
    live = F.coalesce(is_live(now, ttl), F.lit(False))
    return current(entries).groupBy("cache_type").agg(
        F.count_if(live).alias("kept"), F.count_if(~live).alias("removed")
    )


def statistics(
    requests: DataFrame, entries: DataFrame, now: dt.datetime, ttl: int = fx.MEMO_TTL_SECONDS
) -> DataFrame:
    """Hits, misses, requests, hit rate and stored entries per type.

    Requests are counted per key before they meet the entries, so a key asked for
    very often is one row by then.
    """
    asked = _asked(requests).groupBy("cache_type", "key").agg(F.count("*").alias("asked"))
    stored = current(entries).withColumn("live", F.coalesce(is_live(now, ttl), F.lit(False)))
    hits = F.sum(F.when(F.col("live"), F.col("asked")).otherwise(0))
    return (
        asked.join(stored, ["cache_type", "key"], "full")
        .groupBy("cache_type")
        .agg(
            F.coalesce(hits, F.lit(0)).alias("hits"),
            F.coalesce(F.sum("asked"), F.lit(0)).alias("requests"),
            F.count("live").alias("entries"),
        )
        .select(
            "cache_type",
            "hits",
            (F.col("requests") - F.col("hits")).alias("misses"),
            "requests",
            F.round(
                F.coalesce(F.try_divide(100.0 * F.col("hits"), F.col("requests")), F.lit(0.0)), 6
            ).alias("hit_rate"),
            "entries",
        )
    )
