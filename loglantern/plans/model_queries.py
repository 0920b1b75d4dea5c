"""Fits on the documents' language, a class that can be learnt and is unbalanced."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loglantern.operators import evaluate, features, models, profile
from loglantern.plans.registry import Registry
from loglantern.session import keep, shared_folder

registry = Registry()
query = registry.add
QUERIES, ORACLE = registry.queries, registry.oracle

CLASS = "lang"


class Fitting:
    """Features of all documents, written once: learners read their input many times."""

    def __init__(self, logs):
        documents = logs.table("documents")
        labelled = logs.metadata.join(
            documents.select(F.col("doc_id").alias("log_id"), CLASS, "text"), "log_id"
        )
        split = profile.stratified_split(labelled, CLASS)
        self.texts = keep(split.withColumn(models.WORDS, models.words_in(F.col("text"))))
        words = self.texts.filter("split = 'train'").select("log_id", F.col(models.WORDS).alias("words"))
        platforms = profile.seen_platforms(self.texts).first()["platforms"]
        self.stages = models.feature_stages(features.vocabulary(words), platforms)
        self.classes = models.classes_of(profile.label_codes(self.texts, CLASS), CLASS)
        self.rows = keep(models.labelled_features(self.texts, self.stages, CLASS))
        self.train = models.for_learners(self.rows.filter("split = 'train'"))
        self.held_out = self.rows.filter("split <> 'train'")

    def logistic(self):
        return models.logistic(self.train.count()).fit(self.train)

    def forest(self):
        return models.forest().fit(self.train)

    def compared(self):
        """Predictions of both models over all held-out documents, written once."""
        return keep(models.predicted({"logistic": self.logistic(), "forest": self.forest()}, self.held_out))


@query("fit_logistic")
def _(logs):
    """Accuracy and weighted F1 on validation."""
    fitting = Fitting(logs)
    found = models.predicted({"logistic": fitting.logistic()}, fitting.held_out)
    return evaluate.compare_models(found.filter("split = 'val'"))


@query("fit_forest")
def _(logs):
    fitting = Fitting(logs)
    found = models.predicted({"forest": fitting.forest()}, fitting.held_out)
    return evaluate.compare_models(found.filter("split = 'val'"))


@query("forest_importance")
def _(logs):
    fitting = Fitting(logs)
    return models.top_features(logs.spark, fitting.forest(), models.feature_names(fitting.stages))


@query("predicted_category")
def _(logs):
    """Category and confidence of every held-out log."""
    fitting = Fitting(logs)
    found = models.predicted({"logistic": fitting.logistic()}, fitting.held_out)
    names = F.array(*[F.lit(c) for c in fitting.classes])
    category = F.get(names, F.col("prediction").cast("int")).alias("predicted_category")
    return found.select("log_id", "split", category, F.round("confidence", 6).alias("confidence"))


@query("scored_logs")
def _(logs):
    """All documents scored as raw logs by a pipeline that was saved and loaded again."""
    fitting = Fitting(logs)
    path = f"{shared_folder(logs.spark)}/scorer-{uuid.uuid4().hex}"
    pipeline = models.scorer(fitting.stages, fitting.logistic(), fitting.classes)
    models.save(pipeline, {"model": "logistic", "classes": len(fitting.classes)}, path)
    raw = logs.metadata.join(logs.table("documents").select(F.col("doc_id").alias("log_id"), "text"), "log_id")
    found = models.classify(models.load(path), raw)
    return found.withColumn("confidence", F.round("confidence", 6))


@query("fitted_confusion")
def _(logs):
    return evaluate.confusion(Fitting(logs).compared().filter("split = 'val'"))


@query("fitted_report")
def _(logs):
    return evaluate.rounded(evaluate.class_report(Fitting(logs).compared().filter("split = 'val'")))


@query("fitted_compare")
def _(logs):
    return evaluate.compare_models(Fitting(logs).compared().filter("split = 'val'"))


@query("fitted_best")
def _(logs):
    """The model that is best on validation, and what it reaches on test, scored once."""
    return evaluate.chosen(Fitting(logs).compared())
