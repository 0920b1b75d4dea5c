"""The corpus pipeline: what each stage keeps of the smallest tables, against plain rules."""

import pytest
from llm_cases import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from loglantern.llm import decontaminate, quality
from loglantern.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def test_stages_return_the_columns_of_documents(spark, stages):
    columns = table(spark, SMALL, "documents").columns
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(stages[n].columns == columns for n in list(stages)[:-1])


def test_each_stage_works_on_what_the_one_before_kept(spark, stages):
    names = list(stages)
    ids = {n: {r.doc_id for r in stages[n].select("doc_id").collect()} for n in names}
    assert all(ids[b] <= ids[a] for a, b in zip(names, names[1:], strict=False))
    good = table(spark, SMALL, "labels").where("quality = 1").join(table(spark, SMALL, "documents").select("doc_id"), "doc_id")
    kept = good.join(stages["quality"].select("doc_id"), "doc_id", "left_semi")
    assert kept.count() >= 0.95 * good.count()
    texts = stages["near_duplicates"].groupBy(F.lower("text")).count()
    assert texts.where("count > 1").count() == 0
    assert decontaminate.leaks(stages["decontamination"], table(spark, SMALL, "benchmark")).count() == 0
    assert decontaminate.leaks(stages["near_duplicates"], table(spark, SMALL, "benchmark")).count() > 0
    assert stages["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert stages["sharding"].count() == stages["mixing"].count()


def test_run_applies_all_stages(spark, stages):
    """The same counts again; no stage depends on the order of rows."""
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() == stages["sharding"].count()
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in stages["sharding"].collect())


def test_shards_hold_whole_documents(spark, stages):
    """The last table has what the mix kept, with shards that differ by one row at most."""
    columns = table(spark, SMALL, "documents").columns
    assert set(columns) | {"shard", "slot"} <= set(stages["sharding"].columns)
    assert stages["sharding"].select(*columns).exceptAll(stages["mixing"]).count() == 0
    counts = [r["count"] for r in stages["sharding"].groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_odd_documents_through_all_stages(spark, odd_documents, tmp_path):
    """Nulls, repeats, long and empty texts, and columns named like helpers."""
    docs = odd_documents.withColumns({c: F.lit(c) for c in ("_key", "_score", "_same", "_copy", "_row", "_times")})
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        assert name == "sharding" or after.columns == docs.columns
        assert after.where("not (_key = '_key' and _score = '_score' and _row = '_row')").count() == 0
        docs = after


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SMALL, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_classifier_is_the_one_of_the_operator():
    assert quality.THRESHOLD == 0.3
