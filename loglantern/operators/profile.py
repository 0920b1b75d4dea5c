"""Profile of a labelled log collection and its splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.operators.ordered import rank_by_hash
from loglantern.rules import UNKNOWN_PLATFORM


def attach_text(metadata: DataFrame, files: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Metadata with log text by path; a missing file reads as ``""`` or is left out."""
    how = "left" if keep_missing else "inner"
    joined = metadata.join(files, "file_path", how)
    return joined.withColumn("text", F.coalesce("text", F.lit("")))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / whole, 1)


def frequency(rows: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("logs"))
    # the window sees one row per value of a small fixed domain
    total = F.sum("logs").over(Window.partitionBy(F.lit(1)))
    return counts.select(column, "logs", percent(F.col("logs"), total).alias("share"))


def corpus_statistics(metadata: DataFrame) -> DataFrame:
    """Total, per platform and per category in one long table, from one pass."""
    sets = [[], ["platform"], ["error_category"]]
    return (
        metadata.groupingSets(sets, "platform", "error_category")
        .agg(F.count("*").alias("logs"), F.grouping_id().alias("which"))
        .select(
            F.when(F.col("which") == 3, "total")
            .when(F.col("which") == 1, "platform")
            .otherwise("error_category")
            .alias("field"),
            F.coalesce("platform", "error_category", F.lit("all")).alias("value"),
            "logs",
        )
    )


def crosstab(metadata: DataFrame) -> DataFrame:
    """Logs per category and platform, in rows; combinations that do not occur count 0.

    Logs without a platform count under ``unknown``, those without a category under null.
    """
    platform = F.coalesce("platform", F.lit(UNKNOWN_PLATFORM)).alias("platform")
    counts = metadata.groupBy("error_category", platform).agg(F.count("*").alias("logs"))
    # both lists are short: one row per category, one per platform
    cells = counts.select("error_category").distinct().join(
        counts.agg(F.collect_set("platform").alias("platforms"))
    )
    grid = cells.select("error_category", F.explode("platforms").alias("platform"))
    own = F.col("g.error_category").eqNullSafe(F.col("c.error_category")) & (F.col("g.platform") == F.col("c.platform"))
    return grid.alias("g").join(counts.alias("c"), own, "left").select(
        "g.error_category", "g.platform", F.coalesce("c.logs", F.lit(0)).cast("bigint").alias("logs")
    )


def balance(metadata: DataFrame) -> DataFrame:
    counts = metadata.groupBy("error_category").agg(F.count("*").alias("n"))
    ratio = F.col("smallest") / F.col("largest")
    return counts.agg(F.min("n").alias("smallest"), F.max("n").alias("largest")).select(
        "smallest",
        "largest",
        F.round(ratio, 2).alias("balance"),
        F.when(ratio >= fx.BALANCED_AT, "balanced")
        .when(ratio >= fx.MODERATE_AT, "moderate")
        .otherwise("imbalanced")
        .alias("verdict"),
    )


def split_sizes(metadata: DataFrame) -> DataFrame:
    total = metadata.agg(F.count("*").alias("logs"))
    return total.select(
        "logs",
        *[
            F.floor(F.col("logs") * F.lit(share)).cast("bigint").alias(f"{name}_logs")
            for name, share in fx.SPLIT_SHARES
        ],
    )


def length_stats(texts: DataFrame, limit_logs: int | None = None, exact: bool = True) -> DataFrame:
    """Mean, smallest, largest and median text length."""
    lengths = texts.select("log_id", F.length("text").cast("bigint").alias("chars"))
    if limit_logs is not None:
        lengths = lengths.orderBy("log_id").limit(limit_logs)
    counts = lengths.where("chars IS NOT NULL").groupBy("chars").agg(F.count("*").alias("n"))
    if exact:
        middle = median(counts, "chars")
    else:
        middle = lengths.agg(F.percentile_approx("chars", 0.5, 10_000).cast("double").alias("median"))
    return (
        counts.agg(
            F.round(F.sum(F.col("chars") * F.col("n")) / F.sum("n"), 6).alias("mean_chars"),
            F.min("chars").alias("min_chars"),
            F.max("chars").alias("max_chars"),
        )
        .withColumn("k", F.lit(1))
        # one row on either side
        .join(F.broadcast(middle.withColumn("k", F.lit(1))), "k", "left")
        .drop("k")
        .withColumn("median_chars", F.round("median", 6))
        .drop("median")
    )


def median(counts: DataFrame, value: str, count: str = "n", low_bits: int = 12) -> DataFrame:
    """One row with ``median``, the mean of the two middle ones of counted values from 0 up.

    Found by digits: counts of the high bits tell the bins that hold the middle, counts of the
    low bits the values in them. A text has at most 2^31 characters, so at most 2^19 bins and
    2^12 values of two bins meet in one task, however many rows are counted.
    """
    high = F.shiftright(value, low_bits).alias("bin")
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(high).agg(F.sum(count).alias("held"))
    bins = bins.select(
        "bin",
        "held",
        F.coalesce(F.sum("held").over(order), F.lit(0)).alias("before"),
        F.sum("held").over(Window.partitionBy(F.lit(1))).alias("total"),
    )

    def holds(place, first, held):
        return (place >= first) & (place < first + held)

    lower, upper = F.expr("(total - 1) DIV 2"), F.expr("total DIV 2")
    chosen = bins.where(holds(lower, F.col("before"), F.col("held")) | holds(upper, F.col("before"), F.col("held")))
    inside = counts.withColumn("bin", high).join(F.broadcast(chosen), "bin")
    so_far = Window.partitionBy("bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum(count).over(so_far), F.lit(0))
    placed = inside.select(F.col(value).alias("value"), F.col(count).alias("held"), first.alias("first"), "total")
    halves = sum(F.when(holds(place, F.col("first"), F.col("held")), F.col("value") / 2).otherwise(0) for place in (lower, upper))
    return placed.agg(F.sum(halves).alias("median"))


def length_histogram(texts: DataFrame, bins: int = 20) -> DataFrame:
    """Logs per equal-width length bin; the last bin is closed."""
    counts = texts.groupBy(F.length("text").cast("bigint").alias("chars")).agg(
        F.count("*").alias("n")
    )
    # one row: the range of lengths
    span = counts.agg(F.min("chars").alias("low"), F.max("chars").alias("high"))
    place = F.floor((F.col("chars") - F.col("low")) * bins / F.greatest(F.lit(1), F.col("high") - F.col("low")))
    return (
        counts.select("chars", "n", F.lit(1).alias("k"))
        .join(F.broadcast(span.withColumn("k", F.lit(1))), "k")
        .select(F.least(place + 1, F.lit(bins)).cast("bigint").alias("bin"), "n")
        .groupBy("bin")
        .agg(F.sum("n").alias("logs"))
    )


def categories(metadata: DataFrame) -> DataFrame:
    return metadata.select("error_category").distinct()


def sample_per_category(texts: DataFrame, max_lines: int = 25) -> DataFrame:
    """The first log of each category with its first lines."""
    first = texts.groupBy("error_category").agg(F.min("log_id").alias("log_id"))
    return _preview(texts.join(first, ["error_category", "log_id"], "left_semi"), max_lines)


def first_samples(texts: DataFrame, n: int = 3, max_lines: int = 5) -> DataFrame:
    return _preview(texts.orderBy("log_id").limit(n), max_lines)


def _preview(texts: DataFrame, max_lines: int) -> DataFrame:
    lines = F.split("text", "\n")
    return texts.select(
        "log_id",
        "error_category",
        "platform",
        F.size(lines).cast("bigint").alias("total_lines"),
        F.posexplode(F.slice(lines, 1, max_lines)).alias("pos", "line"),
    ).select(
        "log_id",
        "error_category",
        "platform",
        "total_lines",
        (F.col("pos") + 1).cast("bigint").alias("line_number"),
        "line",
    )


def stratified_split(
    rows: DataFrame, by: str = "error_category", seed: int = fx.SPLIT_SEED, id_column: str = "log_id"
) -> DataFrame:
    """Train, val and test with the same shares in every class; the same rows every time.

    Within a class the held-out 30 % is rounded to whole rows, then halved.
    """
    ranked = rank_by_hash(rows, by, seed, id_column)
    size = F.col("group_rows")
    train = size - F.round(size * F.lit(0.3)).cast("bigint")
    val = train + F.floor((size - train) / 2)
    split = (
        F.when(F.col("position") <= train, "train").when(F.col("position") <= val, "val").otherwise("test")
    )
    return ranked.withColumn("split", split).drop("position", "group_rows")


def shuffled(rows: DataFrame, seed: int = fx.SPLIT_SEED, id_column: str = "log_id") -> DataFrame:
    """A repeatable shuffle: ``position`` is the row's place in it."""
    return rank_by_hash(rows, None, seed, id_column).drop("group_rows")


def split_distribution(split: DataFrame, by: str = "error_category") -> DataFrame:
    return split.groupBy("split", by).agg(F.count("*").alias("logs"))


def label_codes(split: DataFrame, by: str = "error_category") -> DataFrame:
    """Codes from 0 in alphabetical order of the classes seen in train."""
    seen = split.filter(F.col("split") == "train").select(by).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy(by)  # one row per class
    return seen.select(by, (F.dense_rank().over(order) - 1).cast("bigint").alias("label"))


def encode_labels(split: DataFrame, by: str = "error_category") -> DataFrame:
    # one row per class: a fixed small domain
    return split.join(F.broadcast(label_codes(split, by)), by, "left")


def seen_platforms(split: DataFrame) -> DataFrame:
    """One row: the platforms of the train rows, in order, as ``platforms``."""
    train = split.filter((F.col("split") == "train") & F.col("platform").isNotNull())
    return train.agg(F.sort_array(F.collect_set("platform")).alias("platforms"))


def one_hot(platform: Column, platforms: Column) -> Column:
    """1 at the platform's place; one place more stands for platforms that train has not."""
    place = F.coalesce(F.array_position(platforms, platform), F.lit(0))
    own = F.transform(platforms, lambda _, at: (at + 1 == place).cast("bigint"))
    return F.concat(own, F.array((place == 0).cast("bigint")))


def platform_one_hot(split: DataFrame) -> DataFrame:
    """The one-hot code of each row, a row per fitted platform and one for the rest."""
    names = F.concat(F.transform("platforms", lambda p: F.concat(F.lit("platform_"), p)), F.array(F.lit("platform_other")))
    coded = split.join(F.broadcast(seen_platforms(split))).select(
        "log_id", "split", F.inline(F.arrays_zip(names.alias("feature"), one_hot(F.col("platform"), F.col("platforms")).alias("value")))
    )
    return coded.toDF("log_id", "split", "feature", "value")


def class_weights(rows: DataFrame, by: str = "error_category") -> DataFrame:
    """Balanced weight n / (classes * n_class) of each class."""
    counts = rows.groupBy(by).agg(F.count("*").alias("logs"))
    whole = Window.partitionBy(F.lit(1))  # one row per class
    weight = F.sum("logs").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("logs"))
    return counts.select(by, "logs", F.round(weight, 6).alias("weight"))


def weighted(rows: DataFrame, by: str = "error_category") -> DataFrame:
    weights = class_weights(rows, by).select(by, "weight")
    return rows.join(weights, by, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def feature_means(features: DataFrame, names: Sequence[str], by: str = "error_category") -> DataFrame:
    """Mean of each feature per class, as one long table."""
    means = features.groupBy(by).agg(*[F.avg(n).alias(n) for n in names])
    return means.unpivot([by], list(names), "feature", "mean").select(
        by, "feature", F.round("mean", 6).alias("mean")
    )
