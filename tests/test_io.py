"""Readers, writers, the landing stream and model files."""

import datetime as dt
import json
import os
import random
import statistics

import pytest
from small_tables import SMALL
from pyspark.sql import functions as F

from loglantern.operators import answers, evaluate, memo, models, parse, profile, reports
from loglantern.plans.views import Logs
from loglantern.sources import corpus, raw_logs, sinks
from loglantern.streaming import landing

LOG = "Started by user A\n[Pipeline] { (Build)\nERROR one\nFinished: FAILURE\n"


def test_read_logs_whole_with_names(spark, tmp_path):
    (tmp_path / "job one+a.b.txt").write_text(LOG, encoding="utf-8")
    (tmp_path / "empty").write_text("", encoding="utf-8")
    logs = {r.job_name: r for r in raw_logs.read_logs(spark, str(tmp_path)).collect()}
    assert logs["job one+a.b"].raw_content == LOG
    assert logs["job one+a.b"].path.endswith("/job one+a.b.txt")


def test_files_cut_into_splits_have_the_lines_of_whole_files(spark, tmp_path):
    """Splits of a few bytes fall on every kind of break, also on the last character."""
    bits = ["a", "bé", "\n", "\r", "\r\n", "\x0c", "\u2028", "\x1c", "\n\n", "long words "]
    pick = random.Random(8)
    ends = ["", "\n", "\r", "\r\n", "\x0c", "\x0c\n", "\x0c\r", "\r\r", "\x85", "a"]
    for n in range(40):
        text = "".join(pick.choice(bits) for _ in range(pick.randint(0, 60))) + ends[n % len(ends)]
        (tmp_path / f"log {n}.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    columns = ["log_id", "line_number", "raw_line"]
    whole = raw_logs.split_lines(raw_logs.read_logs(spark, str(tmp_path)))
    small = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        lines = raw_logs.read_log_lines(spark, str(tmp_path))
        got = sorted((tuple(r[c] for c in columns) for r in lines.collect()), key=repr)
        cut = lines.filter("is_cut").select("log_id", "slice").distinct().count()
    finally:
        for name in small:
            spark.conf.unset(name)
    assert got == sorted((tuple(r[c] for c in columns) for r in whole.collect()), key=repr)
    assert cut > 40
    assert not any(r[0].endswith("empty.txt") for r in got)


def test_a_parse_of_cut_files_is_that_of_whole_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG.replace("ERROR one\n", "ERROR one\n" * 200), encoding="utf-8")
    whole = raw_logs.split_lines(raw_logs.read_logs(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        lines = raw_logs.read_log_lines(spark, str(tmp_path))
        assert lines.filter("is_cut").select("slice").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    records = [parse.log_counts(parse.roll_up(parse.read_lines(x), headers=True)).first() for x in (lines, whole)]
    assert records[0] == records[1]
    assert (records[0].total_lines, records[0].error_count) == (203, 201)  # FAILURE counts too


def test_nested_documents_of_odd_logs(spark, tmp_path):
    """Logs without stages or entries, quotes in messages, a null value: all read back as JSON."""
    summary = spark.createDataFrame([(1, "a \"b\"", None, 5), (2, "x", "y", 6), (None, "z", "y", 0)], "log_id long, status string, extra string, slice long")
    stages = spark.createDataFrame([(1, "s]}", 2), (1, "s,", 1)], "log_id long, stage string, stage_order long")
    entries = spark.createDataFrame(
        [(1, "error", 9, "two\n"), (1, "error", 3, "one"), (1, "warning", 4, None), (2, "warning", 1, "é")],
        "log_id long, kind string, line_number long, message string",
    )
    path = str(tmp_path / "documents")
    sinks.write_documents(reports.parsed_documents(summary, stages, entries), path)
    lines = [json.loads(line) for f in sorted(os.listdir(path)) if f.endswith(".txt") for line in open(f"{path}/{f}") if line.strip()]
    got = {d.get("log_id"): d for d in lines}
    assert len(lines) == 3 and spark.read.json(path).count() == 3
    assert got[1]["log"] == {"status": 'a "b"'} and [s["stage"] for s in got[1]["stages"]] == ["s,", "s]}"]
    assert [e["message"] for e in got[1]["errors"]] == ["one", "two\n"] and got[1]["warnings"] == [{"line_number": 4}]
    assert (got[2]["errors"], got[2]["stages"], got[2]["warnings"][0]["message"]) == ([], [], "é")
    assert got[None]["log"] == {"status": "z", "extra": "y"}
    sinks.write_documents(reports.parsed_documents(*[t.limit(0) for t in (summary, stages, entries)]), str(tmp_path / "none"))
    assert not spark.read.text(str(tmp_path / "none")).take(1)


def test_metadata_csv_and_json(spark, tmp_path):
    rows = [
        ("a_1", "logs/a_1.txt", "jenkins", "timeout", 1, "2025-10-30T21:43:43.968175"),
        ("a_2", "logs/a_2.txt", "gitlab-ci", "syntax_error", 2, "2025-10-30T21:43:44"),
    ]
    names = ["log_id", "file_path", "platform", "error_category", "build_number", "timestamp"]
    (tmp_path / "d.csv").write_text("\n".join([",".join(names), *[",".join(map(str, r)) for r in rows]]))
    (tmp_path / "d.json").write_text(json.dumps([dict(zip(names, r)) for r in rows], indent=2))
    from_csv = raw_logs.read_metadata(spark, str(tmp_path / "d.csv")).collect()
    from_json = raw_logs.read_metadata_json(spark, str(tmp_path / "d.json")).collect()
    assert from_csv == from_json
    assert from_csv[0].timestamp.microsecond == 968175


def test_statistics_reconcile_with_counts(spark, tmp_path):
    metadata = Logs(spark, SMALL).metadata
    counted = profile.corpus_statistics(metadata)
    stated = {"total_logs": 0, "platforms": {}, "error_categories": {}}
    for r in counted.collect():
        if r.field == "total":
            stated["total_logs"] = r.logs
        else:
            stated["platforms" if r.field == "platform" else "error_categories"][r.value] = r.logs
    (tmp_path / "s.json").write_text(json.dumps(stated, indent=2))
    read = raw_logs.read_statistics(spark, str(tmp_path / "s.json"))
    assert raw_logs.reconcile(read, counted).filter("agrees = 0").count() == 0
    stated["platforms"]["jenkins"] += 1
    (tmp_path / "s2.json").write_text(json.dumps(stated))
    off = raw_logs.reconcile(raw_logs.read_statistics(spark, str(tmp_path / "s2.json")), counted)
    assert [r.value for r in off.filter("agrees = 0").collect()] == ["jenkins"]
    sinks.write_statistics(counted, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == counted.count()


def test_splits_are_written_and_read_back(spark, tmp_path):
    split = Logs(spark, SMALL).split
    sinks.write_splits(split, str(tmp_path / "splits"))
    back = spark.read.csv(str(tmp_path / "splits"), header=True)
    assert sorted(map(tuple, back.groupBy("split").count().collect())) == sorted(
        map(tuple, split.groupBy("split").count().collect())
    )


def test_records_and_reports_are_written(spark, tmp_path):
    logs = Logs(spark, SMALL)
    records = reports.parsed_json(logs.counts, logs.stages, logs.entries)
    sinks.write_records(records, str(tmp_path / "records"))
    stages = spark.read.json(str(tmp_path / "records" / "record=stage"))
    assert stages.count() == logs.stages.count()
    report = reports.markdown_report(logs.named_counts, logs.stages, logs.entries)
    sinks.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == report.count()


def test_landing_stream_reads_each_log_once(spark, tmp_path):
    land, out, marks = (str(tmp_path / n) for n in ("land", "out", "marks"))

    def arrive(*logs):
        rows = spark.createDataFrame(list(logs), "log_id string, job_name string, raw_content string")
        sinks.land_logs(rows, land)

    def catch_up():
        landing.analyse(landing.landed_logs(spark, land), out, marks).awaitTermination()

    arrive(("1", "j", LOG), ("2", "k", "##[group]A\n::warning::w\n"))
    catch_up()
    arrive(("3", "j", LOG.replace("FAILURE", "SUCCESS")))
    catch_up()
    catch_up()
    rows = {r.log_id: r for r in spark.read.parquet(f"{out}/summaries").collect()}
    assert {k: (r.status, r.error_count) for k, r in rows.items()} == {
        "1": ("FAILED", 2),
        "2": ("UNSTABLE", 0),
        "3": ("SUCCESS", 1),
    }
    assert rows["1"].triggered_by == "user A" and rows["1"].job_name == "j"
    assert spark.read.parquet(f"{out}/stages").count() == 3
    assert spark.read.parquet(f"{out}/entries").count() == 4


@pytest.mark.parametrize("batches", [1, 2])
def test_a_build_landed_again_counts_as_its_later_arrival(spark, tmp_path, batches):
    land, out, marks = (str(tmp_path / n) for n in ("land", "out", "marks"))
    for n, (name, text) in enumerate([("z", LOG), ("a", LOG.replace("FAILURE", "SUCCESS"))]):
        rows = spark.createDataFrame([("1", name, text), (str(n + 2), name, text)], "log_id string, job_name string, raw_content string")
        sinks.land_logs(rows.coalesce(1), land)
        for file in (tmp_path / "land").glob("*.parquet"):
            if not (tmp_path / f"seen-{file.name}").exists():
                (tmp_path / f"seen-{file.name}").touch()
                os.utime(file, (1_700_000_000 + 60 * n,) * 2)
        if n + 1 >= 3 - batches:
            landing.analyse(landing.landed_logs(spark, land), out, marks).awaitTermination()
    found = {r.log_id: (r.job_name, r.status) for r in landing.latest(spark, out, "summaries").collect()}
    assert found == {"1": ("a", "SUCCESS"), "2": ("z", "FAILED"), "3": ("a", "SUCCESS")}
    assert landing.latest(spark, out, "summaries").count() == 3
    assert spark.read.parquet(f"{out}/summaries").count() == (3 if batches == 1 else 4)


def test_text_files_stream_too(spark, tmp_path):
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "b7.log").write_text(LOG)
    files = landing.landed_files(spark, str(tmp_path / "land"))
    landing.analyse(files, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "summaries")).collect()
    assert [(r.job_name, r.total_lines) for r in rows] == [("b7", 4)]


def test_memo_store_and_last_write(spark, tmp_path):
    path = str(tmp_path / "memo")
    schema = "cache_type string, content string, written_at timestamp_ntz, write_id bigint, value string"
    for n in (1, 2):
        rows = spark.createDataFrame([("fixes", "x", None, n, f"v{n}")], schema).withColumn(
            "written_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'")
        )
        memo.store(memo.as_entries(rows), path)
    stored = spark.read.parquet(path)
    assert [r.value for r in memo.current(stored).collect()] == ["v2"]
    assert memo.clear(stored).count() == 0


def test_memo_is_rewritten_or_stays_as_it_was(spark, tmp_path, monkeypatch):
    path, now = str(tmp_path / "memo"), dt.datetime(2024, 1, 31)
    assert memo.read(spark, path).count() == 0

    def write(*rows):
        shape = "cache_type string, key string, day int, write_id bigint, value string"
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("written_at")
        memo.store(spark.createDataFrame(list(rows), shape).select("cache_type", "key", at, "write_id", "value"), path)

    def values(entries=None):
        return sorted(tuple(r) for r in memo.current(memo.read(spark, path)).select("cache_type", "key", "value").collect())

    write(("fixes", "a", 29, 1, "old"), ("fixes", "b", 0, 1, "stale"), ("summaries", "a", 29, 1, "s"))
    write(("fixes", "a", 29, 2, "new"), ("fixes", "a", 29, 2, "new"))
    before = [("fixes", "a", "new"), ("fixes", "b", "stale"), ("summaries", "a", "s")]
    assert values() == before

    # a crash after the rows and before the mark: readers see the old state, the next attempt starts anew
    with monkeypatch.context() as crash:
        crash.setattr(memo, "MARKS", "elsewhere")
        memo.rewrite(memo.read(spark, path).limit(0), path, ["explanations"])
        memo.rewrite(memo.read(spark, path), path)
    assert values() == before
    memo.rewrite(memo.cleanup(memo.read(spark, path), now), path)
    assert values() == [("fixes", "a", "new"), ("summaries", "a", "s")]
    assert memo.read(spark, path).count() == 2

    memo.rewrite(memo.clear(memo.read(spark, path), "fixes"), path, ["fixes"])
    memo.drop_replaced(spark, path)
    assert values() == [("summaries", "a", "s")]
    assert memo.generations(spark, path) == {"summaries": 1, "explanations": 1, "fixes": 2}
    write(("fixes", "c", 30, 9, "again"))
    assert values() == [("fixes", "c", "again"), ("summaries", "a", "s")]
    memo.rewrite(memo.clear(memo.read(spark, path)), path)
    memo.drop_replaced(spark, path)
    assert values() == []


@pytest.mark.parametrize("values", [[], [None], [7], [1, 9000], [0, 0, 5, 4096, 70000], [3, 3, 3, 4], [5000, 4095, 4096, None]])
def test_median_by_digits(spark, values):
    rows = spark.createDataFrame([(str(n), None if v is None else "x" * v) for n, v in enumerate(values)], "log_id string, text string")
    (found,) = profile.length_stats(rows).collect()
    known = [v for v in values if v is not None]
    assert found.median_chars == (statistics.median(known) if known else None)
    assert (found.min_chars, found.max_chars) == ((min(known), max(known)) if known else (None, None))
    assert "percentile" not in profile.length_stats(rows)._jdf.queryExecution().toString()


FIX = """Intro words
 more
**QUICK FIX** (if available):
```bash
do it
```

**DETAILED STEPS**:
1. one
   more of one
2. two ```inline``` end
```bash
code
```
10. ten

**CODE CHANGES** (if needed):
File: `a.py`
```python
x = 1
```
File: a.py
```
x = 2
```

**PREVENTION TIPS**:
- tip
12. odd

**VERIFICATION**:
run again
**CONFIDENCE**: 88%
"""


def test_fix_answer(spark):
    rows = spark.createDataFrame([("1", FIX), ("2", "")], "answer_id string, answer string")
    full, empty = answers.structure_fixes(rows).orderBy("answer_id").collect()
    assert full.diagnosis == "Intro words more"
    assert full.quick_fix == "do it"
    assert full.detailed_steps == ["one\n   more of one", "two [See code block] end", "ten"]
    assert full.code_changes == {"a.py": "x = 2"}
    assert full.prevention_tips == ["tip", "2. odd"]
    assert (full.verification, full.confidence) == ("run again", 88)
    assert empty.diagnosis.startswith("Unable to diagnose")
    assert (empty.quick_fix, empty.code_changes, empty.confidence) == (None, {}, 75)
    assert len(empty.detailed_steps) == 3


def test_explanation_items_lose_one_character_only(spark):
    text = "**COMMON SCENARIOS**:\n1. do it\n- dash\nScenario 3: x\nplain\n**Bold**\n- out"
    rows = spark.createDataFrame([("1", text)], "answer_id string, answer string")
    got = answers.structure_explanations(rows).first()
    assert got.common_scenarios == [". do it", "dash", "Scenario 3: x"]
    assert got.confidence == 80


def test_class_report_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    logs = Logs(spark, SMALL)
    predictions = corpus.score_predictions(logs.table("documents"), logs.table("labels"))
    ours = {r.model: r for r in evaluate.compare_models(predictions).collect()}
    typed = predictions.withColumn("label", F.col("label").cast("double")).withColumn(
        "prediction", F.col("prediction").cast("double")
    )
    for name, row in ours.items():
        one = typed.filter(F.col("model") == name)
        for metric, value in (("accuracy", row.accuracy), ("f1", row.weighted_f1)):
            theirs = MulticlassClassificationEvaluator(metricName=metric).evaluate(one)
            assert value == pytest.approx(theirs, abs=1e-6)


@pytest.fixture(scope="module")
def fitting(spark):
    from loglantern.plans.model_queries import Fitting

    return Fitting(Logs(spark, SMALL))


def test_boosted_trees_fit_save_and_load(spark, fitting, tmp_path):
    model = models.boosted(rounds=2, depth=2).fit(fitting.train)
    found = models.predicted({"boosted": model}, fitting.held_out)
    assert evaluate.compare_models(found.filter("split = 'val'")).first().accuracy > 0.6
    pipeline = models.scorer(fitting.stages, model, fitting.classes)
    raw = fitting.texts.select("log_id", "platform", "text")
    before = sorted(map(tuple, models.classify(pipeline, raw).collect()))
    models.save(pipeline, {"model": "boosted"}, str(tmp_path))
    assert sorted(map(tuple, models.classify(models.load(str(tmp_path)), raw).collect())) == before


def test_a_saved_pipeline_scores_raw_logs_as_before(spark, fitting, tmp_path):
    model = fitting.logistic()
    pipeline = models.scorer(fitting.stages, model, fitting.classes)
    models.save(pipeline, {"model": "logistic"}, str(tmp_path))
    loaded = models.load(str(tmp_path))
    odd = spark.createDataFrame([(-1, None, None), (-2, "unheard of", ""), (-3, "jenkins", "der und die " * 50_000)], "log_id bigint, platform string, text string")
    raw = fitting.texts.select("log_id", "platform", "text").unionByName(odd)
    before, after = (sorted(map(tuple, models.classify(p, raw).collect())) for p in (pipeline, loaded))
    assert before == after and len(after) == raw.count()
    known = {r[0]: r[1] for r in after}
    right = [known[r.log_id] == r.lang for r in fitting.texts.filter("split = 'test'").collect()]
    assert sum(right) / len(right) > 0.8
    # one pass over features made for training says the same as the pipeline over raw logs
    told = models.predicted({"logistic": model}, fitting.rows).collect()
    assert all(fitting.classes[r.prediction] == known[r.log_id] for r in told)


def test_predictions_are_those_of_the_coefficients(spark, fitting):
    import numpy as np

    model = fitting.logistic()
    weights, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    for row in fitting.held_out.select("log_id", "features").collect():
        scores = weights @ row.features.toArray() + intercept
        assert int(model.predict(row.features)) == int(np.argmax(scores))


def test_several_models_are_scored_in_one_pass_and_the_best_is_tested_once(spark, fitting):
    found = {"logistic": fitting.logistic(), "boosted": models.boosted(rounds=1, depth=1).fit(fitting.train)}
    predictions = models.predicted(found, fitting.held_out)
    assert predictions.count() == 2 * fitting.held_out.count()
    alone = models.predicted({"logistic": found["logistic"]}, fitting.held_out)
    assert sorted(map(str, predictions.filter("model = 'logistic'").collect())) == sorted(map(str, alone.collect()))
    rows = predictions.collect()

    def accuracy(name, split):
        hits = [r.label == r.prediction for r in rows if (r.model, r.split) == (name, split)]
        return round(sum(hits) / len(hits), 6)

    best = min(found, key=lambda name: (-accuracy(name, "val"), name))
    row = evaluate.chosen(predictions).first()
    assert (row.model, row.accuracy, row.test_accuracy) == (best, accuracy(best, "val"), accuracy(best, "test"))


def test_platforms_seen_in_train_have_flags(fitting):
    names = models.feature_names(fitting.stages)
    assert len(names) == len(set(names)) == len(fitting.train.first().features)
    assert [n for n in names if n.startswith("platform_")] == ["platform_github_actions", "platform_gitlab_ci", "platform_jenkins"]
