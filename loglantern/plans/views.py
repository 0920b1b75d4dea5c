"""The tables most queries start from, built from one folder of given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.operators import features, legacy, parse, profile
from loglantern.session import keep, spread
from loglantern.sources import corpus


class Logs:
    """The event log corpus and everything read from it.

    Numbering lines and what is written once run while a plan is built, all else with the query.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return corpus.read_table(self.spark, self.folder, name)

    @cached_property
    def lines(self) -> DataFrame:
        return corpus.event_log_lines(self.table("events"))

    @cached_property
    def kept_lines(self) -> DataFrame:
        """The lines, written once and dealt by log and slice, for readers that need windows over them."""
        return keep(self.lines)

    @cached_property
    def facts(self) -> DataFrame:
        return parse.read_lines(self.kept_lines)

    def written(self) -> Logs:
        """These logs with their facts written once, for queries that join several parts of them."""
        if "facts_written" not in self.__dict__:
            self.__dict__["facts_written"] = self.__dict__["facts"] = keep(self.facts)
        return self

    @cached_property
    def entries(self) -> DataFrame:
        return parse.entries(self.facts)

    @cached_property
    def rolled(self) -> DataFrame:
        return parse.roll_up(self.facts)

    @cached_property
    def stages(self) -> DataFrame:
        return parse.stages(self.rolled)

    @cached_property
    def counts(self) -> DataFrame:
        return parse.log_counts(self.rolled)

    @cached_property
    def named_counts(self) -> DataFrame:
        """Counts with what the caller knows of a build, without trigger and duration."""
        return parse.named(self.counts, corpus.build_names(F.col("log_id")))

    @cached_property
    def summary(self) -> DataFrame:
        full = parse.log_counts(parse.roll_up(self.facts, headers=True))
        return parse.named(full, corpus.build_names(F.col("log_id")))

    @cached_property
    def legacy_facts(self) -> DataFrame:
        return legacy.legacy_lines(self.lines)

    @cached_property
    def kept_legacy(self) -> DataFrame:
        """Legacy facts of the lines that matter to a report, written once for its many parts."""
        return keep(legacy.telling_lines(self.legacy_facts))

    @cached_property
    def legacy_rows(self) -> DataFrame:
        return legacy.legacy_stage_rows(self.legacy_facts)

    @cached_property
    def legacy_totals(self) -> DataFrame:
        return legacy.legacy_totals(self.legacy_rows)

    @cached_property
    def legacy_rollup(self) -> DataFrame:
        return legacy.legacy_rollup(self.legacy_totals, legacy.finished_marks(self.legacy_facts))

    @cached_property
    def metadata(self) -> DataFrame:
        return corpus.document_metadata(self.table("documents"))

    @cached_property
    def texts(self) -> DataFrame:
        """Labelled metadata with text, from one scan over all cores."""
        return corpus.document_metadata(spread(self.table("documents").select("doc_id", "text")), "text")

    @cached_property
    def words(self) -> DataFrame:
        """The words of the normalised texts."""
        clean = features.normalise(F.col("text"))
        return self.texts.select("log_id", features.words_of(clean).alias("words"))

    @cached_property
    def kept_words(self) -> DataFrame:
        """The same, written once for readers that count and weigh terms."""
        return keep(self.words)

    @cached_property
    def texts_by_path(self) -> DataFrame:
        """The same by way of the metadata's paths, as it is where texts are files."""
        return self.with_files(corpus.document_files(self.table("documents")))

    @cached_property
    def labelled_files(self) -> DataFrame:
        return corpus.labelled_files(self.table("documents"), self.table("labels"))

    def with_files(self, files: DataFrame, keep_missing: bool = True) -> DataFrame:
        return profile.attach_text(self.metadata, files, keep_missing)

    @cached_property
    def split(self) -> DataFrame:
        return profile.stratified_split(self.metadata)

    @cached_property
    def raw_documents(self) -> DataFrame:
        return corpus.document_logs(self.table("documents"))
