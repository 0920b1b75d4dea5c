"""Order-dependent steps over the lines of a log, safe for a log of any length.

Lines are sorted by ranges of (log, time, tie).  A log's lines within one range are a
``slice``: windows run per (log, slice), so none ever holds a whole long log, a burst of
one second or all lines without a time.  What a slice must know of the earlier ones (how
many lines they hold, which stage is open) travels in a table with one row per slice, joined
on the keys the lines are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern.session import keep

#: Lines of a slice of a log that is one text.
SLICE_ROWS = 250_000


def number_rows(rows: DataFrame, key: str, at: str, tie: str, parts: int | None = None) -> DataFrame:
    """Add ``line_number`` (1-based by ``at``, ``tie`` within ``key``), ``log_rows``, ``slice`` and ``is_cut``.

    Rows are sorted into ``parts`` ranges (as many as the session shuffles into, if None),
    whose bounds Spark samples, and written once: bounds drawn anew would number anew.  A
    window numbers a log's lines within a range, and sums of counts number the ranges of
    the logs that lie in several.  Those are at most two rows per range, so they are
    broadcast.  Lines without a time come first; repeated lines keep some order.  ``is_cut``
    marks the lines of logs that lie in several slices.
    """
    order = [F.col(c).asc_nulls_first() for c in (key, at, tie, "row_")]
    marked = rows.withColumn("row_", F.monotonically_increasing_id())
    cut = marked.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    spot = F.monotonically_increasing_id()
    sorted_rows = keep(cut.drop("row_").withColumn("spot_", spot).withColumn("slice", F.shiftright("spot_", 33)))

    one = Window.partitionBy(key, "slice")
    whole = Window.partitionBy(key)
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_rows.groupBy(key, "slice").agg(F.count("*").alias("n_"))
    spanning = counts.select(
        F.col(key).alias("key_"),
        F.col("slice").alias("slice_"),
        F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"),
        F.sum("n_").over(whole).alias("all_"),
        F.count("*").over(whole).alias("slices_"),
    ).filter("slices_ > 1")
    here = sorted_rows.withColumns(
        {"place_": F.row_number().over(one.orderBy("spot_")), "here_": F.count("*").over(one)}
    )
    same = F.col(key).eqNullSafe(F.col("key_")) & (F.col("slice") == F.col("slice_"))
    return here.join(F.broadcast(spanning), same, "left").select(
        *rows.columns,
        (F.col("place_") + F.coalesce("before_", F.lit(0))).cast("bigint").alias("line_number"),
        F.coalesce("all_", "here_").alias("log_rows"),
        "slice",
        F.col("all_").isNotNull().alias("is_cut"),
    )


LINE_KEYS = ["log_id", "slice"]
#: What places a line: its log, slice, and whether the log has other slices.
PLACE = [*LINE_KEYS, "is_cut"]


def log_context(
    lines: DataFrame,
    latest: Mapping[str, Column] | None = None,
    anywhere: Mapping[str, Column] | None = None,
    earliest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Tell each line what the rest of its log says.

    ``latest``: the last non-null value of an expression at or before the line.
    ``earliest``: the first non-null value in the log.
    ``anywhere``: whether a condition holds on any line of the log.

    A window over the slice says all that a log of one slice needs; only lines of logs cut
    into several are looked at again, and only these logs have rows in the table of slices.
    """
    latest, anywhere, earliest = dict(latest or {}), dict(anywhere or {}), dict(earliest or {})
    marked = lines.select(
        "*",
        *[value.alias(f"{n}_now") for n, value in (latest | earliest).items()],
        *[F.coalesce(flag, F.lit(False)).alias(f"{n}_now") for n, flag in anywhere.items()],
    )
    part = Window.partitionBy(*LINE_KEYS)
    so_far = part.orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = {n: F.last(f"{n}_now", ignorenulls=True).over(so_far) for n in latest}
    here |= {n: F.max(f"{n}_now").over(part) for n in anywhere}
    all_lines = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here |= {n: F.first(f"{n}_now", ignorenulls=True).over(all_lines) for n in earliest}
    per_slice = (
        marked.filter("is_cut").groupBy(*LINE_KEYS)
        .agg(
            *[
                pick(
                    f"{n}_now", F.when(F.col(f"{n}_now").isNotNull(), F.col("line_number"))
                ).alias(n)
                for pick, names in ((F.max_by, latest), (F.min_by, earliest))
                for n in names
            ],
            *[F.max(f"{n}_now").alias(n) for n in anywhere],
        )
    )
    whole = Window.partitionBy("log_id")
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    all_slices = whole.orderBy("slice").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    carried = per_slice.select(
        "log_id",
        "slice",
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_else") for n in latest],
        *[F.max(n).over(whole).alias(f"{n}_else") for n in anywhere],
        *[F.first(n, ignorenulls=True).over(all_slices).alias(f"{n}_else") for n in earliest],
    )
    both = marked.select("*", *[value.alias(f"{n}_here") for n, value in here.items()]).join(
        carried, ["log_id", "slice"], "left"
    )
    return both.select(
        *lines.columns,
        *[F.coalesce(f"{n}_here", f"{n}_else").alias(n) for n in latest],
        *[F.coalesce(f"{n}_else", f"{n}_here").alias(n) for n in (*anywhere, *earliest)],
    )


def first_rows(rows: DataFrame, key: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows per key with their ``position``.

    Spark keeps only ``n`` rows per key in each task before it shuffles, so a hot
    key costs no more than others.
    """
    spot = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("position", spot.cast("bigint")).filter(F.col("position") <= n)


def rank_by_hash(
    rows: DataFrame, group: str | None, seed: int, id_column: str, digits: int = 4
) -> DataFrame:
    """Exact ``position`` within the group by (md5 of seed and id, id), and ``group_rows``.

    The hash spreads evenly, so its first digits cut any group into small buckets:
    ranks inside a bucket come from a window, those before it from bucket counts.
    """
    digest = F.md5(F.concat(F.lit(str(seed)), F.col(id_column).cast("string")))
    keyed = rows.withColumn("digest_", digest).withColumn(
        "bucket_", F.substring("digest_", 1, digits)
    )
    groups = [group] if group else []
    counts = keyed.groupBy(*groups, "bucket_").agg(F.count("*").alias("n_"))
    # at most 16 ** digits rows per group
    whole = Window.partitionBy(*(groups or [F.lit(1)]))
    before = whole.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *groups,
        "bucket_",
        F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"),
        F.sum("n_").over(whole).alias("group_rows"),
    )
    spot = F.row_number().over(
        Window.partitionBy(*groups, "bucket_").orderBy("digest_", id_column)
    )
    return (
        keyed.withColumn("spot_", spot)
        .join(starts, [*groups, "bucket_"])
        .withColumn("position", (F.col("spot_") + F.col("before_")).cast("bigint"))
        .drop("digest_", "bucket_", "spot_", "before_")
    )
