"""Classifiers of a log's error category with Spark's own learners.

Everything between a raw log (``platform, text``) and its category is a stage of one
``PipelineModel``: normalised words, structural and platform flags, counted terms, their
weights, the learner's model and the names of the classes.  Saved and loaded as one, it scores
logs that nobody has labelled.  Several models are compared on the same rows in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizerModel, IndexToString, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.operators import features, profile

FEATURES, LABEL, WEIGHT, CATEGORY = "features", "label", "class_weight", "predicted_category"
WORDS, TERMS, COUNTS, RAW, TEXT_VECTOR = "words_", "terms_", "counts_", "raw_weights_", "text_vector"


def _flag(platform: str) -> str:
    return f"platform_{platform.replace('-', '_')}"


def words_in(text: Column) -> Column:
    """The words of the normalised text; a null text has none."""
    return features.words_of(features.normalise(F.coalesce(text, F.lit(""))))


class LogFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a log's terms, structural features and platform flags; null texts have no terms.

    Words that were made before come as the column ``WORDS``.
    """

    platforms = Param(Params._dummy(), "platforms", "platforms that have a flag", TypeConverters.toListString)

    @keyword_only
    def __init__(self, platforms: Sequence[str] = ()):
        super().__init__()
        self._set(platforms=list(platforms))

    def _transform(self, logs: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        flags = {
            _flag(p): F.coalesce(F.col("platform") == p, F.lit(False)).cast("int") for p in self.getOrDefault("platforms")
        }
        words = logs if WORDS in logs.columns else logs.withColumn(WORDS, words_in(F.col("text")))
        named = dict(zip(features.STRUCTURAL_NAMES, features.structural_features(text), strict=True))
        return words.withColumns({TERMS: features.terms_of(F.col(WORDS)), **named, **flags}).drop(WORDS)


class TermWeights(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Weighs a vector of term counts by (1 + ln tf) * idf."""

    idf = Param(Params._dummy(), "idf", "inverse document frequency per term", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, idf: Sequence[float] = ()):
        super().__init__()
        self._set(idf=list(idf))

    def _transform(self, rows: DataFrame) -> DataFrame:
        weights = features.term_weights(F.col(COUNTS), self.getOrDefault("idf"))
        return rows.withColumn(RAW, array_to_vector(weights))


def feature_stages(vocabulary: DataFrame, platforms: Sequence[str]) -> PipelineModel:
    """From ``platform, text`` to one vector of features; the vocabulary must not be empty."""
    terms, idf = features.known_terms(vocabulary)
    columns = [TEXT_VECTOR, *features.STRUCTURAL_NAMES, *[_flag(p) for p in platforms]]
    return PipelineModel(
        [
            LogFeatures(platforms=list(platforms)),
            CountVectorizerModel.from_vocabulary(terms, inputCol=TERMS, outputCol=COUNTS),
            TermWeights(idf=idf),
            Normalizer(p=2.0, inputCol=RAW, outputCol=TEXT_VECTOR),
            VectorAssembler(inputCols=columns, outputCol=FEATURES),
        ]
    )


def feature_names(stages: PipelineModel) -> list[str]:
    """The name of each place of the feature vector."""
    return [*stages.stages[1].vocabulary, *stages.stages[4].getInputCols()[1:]]


def labelled_features(texts: DataFrame, stages: PipelineModel, by: str) -> DataFrame:
    """The features of each log (``log_id, split, platform, text`` and the class in ``by``), with label and weight.

    Codes and weights, a row per class, are handed to the tasks: rows shuffled by their class would be
    in as many parts as there are classes, and a learner has no more tasks than its rows have parts.
    """
    train = texts.filter(F.col("split") == "train")
    codes = profile.label_codes(texts, by)
    weights = profile.class_weights(train, by).select(by, F.col("weight").alias(WEIGHT))
    made = [c for c in (WORDS,) if c in texts.columns]
    return (
        stages.transform(texts.select("log_id", "split", by, "platform", "text", *made))
        .join(F.broadcast(codes), by, "left")
        .join(F.broadcast(weights), by, "left")
        .select(
            "log_id",
            "split",
            by,
            # a class that train has not keeps its rows: no code stands for it
            F.coalesce("label", F.lit(-1)).cast("double").alias(LABEL),
            F.coalesce(WEIGHT, F.lit(1.0)).alias(WEIGHT),
            FEATURES,
        )
    )


def for_learners(rows: DataFrame) -> DataFrame:
    """The rows in no more parts than there are cores, however many of them there are.

    Each round of a learner is a job over all parts.  A round of a forest shuffles the counts of every
    node it splits from every part: parts that grow with the rows, as nodes do, would make what
    is shuffled grow with the square of the rows.
    """
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


# --- fixed values: settings of the three learners ------------------------------------
def logistic(train_rows: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        weightCol=WEIGHT,
        family="multinomial",
        maxIter=1000,
        regParam=1.0 / train_rows,
        standardization=False,
    )


def forest() -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        weightCol=WEIGHT,
        numTrees=100,
        maxDepth=20,
        minInstancesPerNode=2,
        # rows keep the node they have reached, instead of walking down each tree again
        cacheNodeIds=True,
        seed=fx.SPLIT_SEED,
    )


def boosted(rounds: int = 100, depth: int = 10) -> OneVsRest:
    tree = GBTClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        weightCol=WEIGHT,
        maxIter=rounds,
        maxDepth=depth,
        stepSize=0.1,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=fx.SPLIT_SEED,
    )
    return OneVsRest(classifier=tree, featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT)


def _confidence(scored: DataFrame) -> Column:
    """The largest probability; null where a model gives none."""
    return F.array_max(vector_to_array("probability")) if "probability" in scored.columns else F.lit(None).cast("double")


def predicted(models: Mapping[str, Model], rows: DataFrame) -> DataFrame:
    """Predictions of several models over the same features, one row per model and log, in one pass.

    Columns as evaluation tables take them; the confidence is null where a model gives none.
    """
    scored, sides = rows.select("log_id", "split", LABEL, FEATURES), []
    for at, (name, model) in enumerate(models.items()):
        own = model.transform(scored)
        # only what the table needs goes on, under names of its own
        scored = own.select(*scored.columns, F.col("prediction").cast("bigint").alias(f"prediction_{at}"), _confidence(own).alias(f"sure_{at}"))
        sides.append(F.struct(F.lit(name).alias("model"), F.col(f"prediction_{at}").alias("prediction"), F.col(f"sure_{at}").alias("confidence")))
    told = scored.select("log_id", "split", F.col(LABEL).cast("bigint").alias("label"), F.inline(F.array(*sides)))
    return told.select("model", "log_id", "split", "label", "prediction", "confidence")


def scorer(stages: PipelineModel, model: Model, classes: Sequence[str]) -> PipelineModel:
    """One pipeline from raw logs to the name of their category; ``classes`` in order of their codes."""
    names = IndexToString(inputCol="prediction", outputCol=CATEGORY, labels=list(classes))
    return PipelineModel([*stages.stages, model, names])


def classes_of(codes: DataFrame, by: str) -> list[str]:
    """Class names in order of their codes; one row per class."""
    return [r[by] for r in codes.orderBy("label").collect()]


def classify(pipeline: PipelineModel, logs: DataFrame) -> DataFrame:
    """Category and confidence of logs nobody has labelled (``log_id, platform, text``)."""
    scored = pipeline.transform(logs.select("log_id", "platform", "text"))
    return scored.select("log_id", CATEGORY, _confidence(scored).alias("confidence"))


def top_features(spark: SparkSession, model: Model, names: Sequence[str], n: int = 20) -> DataFrame:
    """The most important features of a tree model, by name."""
    importances = model.featureImportances
    rows = [(names[int(i)], float(v)) for i, v in zip(importances.indices, importances.values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def save(pipeline: PipelineModel, facts: dict, path: str) -> None:
    """The pipeline, and one row that describes it."""
    pipeline.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([facts]).write.mode("overwrite").json(f"{path}/facts")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
