"""Evaluation of predictions: tables with ``model``, ``label`` and ``prediction``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def confusion(predictions: DataFrame) -> DataFrame:
    """Long form: rows per (model, label, prediction).  Everything else derives from it."""
    return predictions.groupBy("model", "label", "prediction").agg(F.count("*").alias("rows"))


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall (per-class accuracy), F1 and support of each class."""
    cells = confusion(predictions)
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(none)

    def side(name: str, hits: Column, support: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(name).alias("class"),
            hits.alias("hits"),
            support.alias("support"),
            predicted.alias("predicted"),
        )

    sides = F.array(
        side("label", hit, F.col("rows"), none), side("prediction", none, none, F.col("rows"))
    )
    sums = (
        cells.select("model", F.inline(sides))
        .groupBy("model", "class")
        .agg(*[F.sum(n).alias(n) for n in ("hits", "support", "predicted")])
    )
    precision = _or_zero(F.col("hits"), F.col("predicted"))
    recall = _or_zero(F.col("hits"), F.col("support"))
    f1 = _or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return (
        sums.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)
    ).select("model", "class", "hits", "support", "precision", "recall", "f1")


def compare_models(predictions: DataFrame) -> DataFrame:
    """Accuracy and support-weighted F1 per model."""
    report = class_report(predictions)
    return report.groupBy("model").agg(
        F.round(F.sum("hits") / F.sum("support"), DIGITS).alias("accuracy"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), DIGITS).alias("weighted_f1"),
        F.sum("support").alias("rows"),
    )


def best_model(comparison: DataFrame) -> DataFrame:
    """The model of highest accuracy; of equals, the name that sorts first."""
    return comparison.orderBy(F.desc("accuracy"), "model").limit(1)


def chosen(predictions: DataFrame) -> DataFrame:
    """The best model on the ``val`` rows, with its accuracy and weighted F1 there and on the ``test`` rows."""
    best = best_model(compare_models(predictions.filter(F.col("split") == "val")))
    # one row
    own = predictions.filter(F.col("split") == "test").join(F.broadcast(best.select("model")), "model", "left_semi")
    tested = compare_models(own).select("model", *[F.col(c).alias(f"test_{c}") for c in ("accuracy", "weighted_f1", "rows")])
    return best.join(tested, "model", "left")


def rounded(report: DataFrame) -> DataFrame:
    return report.select(
        *[
            F.round(c, DIGITS).alias(c) if t == "double" else F.col(c)
            for c, t in report.dtypes
        ]
    )
