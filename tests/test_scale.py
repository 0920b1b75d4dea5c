"""Long logs, hot keys and plans."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from small_tables import SMALL

from loglantern import session
from loglantern.operators import chunks, features, memo, models, ordered, parse, profile, reports
from loglantern.plans.views import Logs
from loglantern.sources import corpus


def rows_of(frame):
    return sorted(map(str, frame.drop("slice", "is_cut").collect()))


VIEWS = ["lines", "facts", "entries", "stages", "summary", "named_counts", "legacy_facts", "legacy_rollup", "legacy_rows"]


def with_lines(spark, events, parts):
    logs = Logs(spark, SMALL)
    logs.__dict__["lines"] = corpus.event_log_lines(events, parts=parts)
    return logs


@pytest.fixture(scope="module")
def whole_and_sliced(spark):
    events = corpus.read_table(spark, SMALL, "events")
    return with_lines(spark, events, 1), with_lines(spark, events, 90)


@pytest.mark.parametrize("name", VIEWS)
def test_slicing_long_logs_changes_nothing(whole_and_sliced, name):
    whole, sliced = whole_and_sliced
    assert rows_of(getattr(whole, name)) == rows_of(getattr(sliced, name))


def test_nested_outputs_have_one_row_per_log(whole_and_sliced):
    whole, sliced = whole_and_sliced
    nested = [reports.nested_entries(v.entries) for v in (whole, sliced)]
    assert rows_of(nested[0]) == rows_of(nested[1])
    assert nested[1].count() == nested[1].select("log_id").distinct().count()
    assert rows_of(reports.verdict_stages(whole.counts, whole.stages)) == rows_of(
        reports.verdict_stages(sliced.counts, sliced.stages)
    )


def test_a_log_with_a_third_of_all_lines(spark):
    events = corpus.read_table(spark, SMALL, "events")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 8).otherwise(F.col("user_id")))
    whole, sliced = with_lines(spark, hot, 1), with_lines(spark, hot, 30)
    assert sliced.lines.filter("log_id = 8").select("slice").distinct().count() >= 8
    assert sliced.lines.filter("log_id = 8 AND NOT is_cut").isEmpty() and whole.lines.filter("is_cut").isEmpty()
    for name in ("lines", "stages", "summary", "legacy_rows"):
        assert rows_of(getattr(whole, name)) == rows_of(getattr(sliced, name))


def numbered(spark, rows, parts):
    frame = spark.createDataFrame(rows, "k int, at timestamp_ntz, tie int")
    return ordered.number_rows(frame, "k", "at", "tie", parts)


def test_a_burst_is_sliced_evenly_and_lines_without_a_time_come_first(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start, n) for n in range(1000)] + [(1, start + dt.timedelta(days=n), 5000 + n) for n in range(5)]
    rows += [(1, None, 7000 + n) for n in range(10)] + [(2, None, 1), (2, start, 0)]
    random.Random(3).shuffle(rows)
    for parts in (1, 12):
        got = numbered(spark, rows, parts).collect()
        for key in (1, 2):
            own = sorted((r for r in got if r.k == key), key=lambda r: r.line_number)
            assert [r.line_number for r in own] == list(range(1, len(own) + 1))
            assert [(r.at is not None, r.at or start, r.tie) for r in own] == sorted(
                (a is not None, a or start, t) for k, a, t in rows if k == key
            )
            assert {r.log_rows for r in own} == {len(own)}
            assert [r.slice for r in own] == sorted(r.slice for r in own)
            assert {r.is_cut for r in own} == {len({r.slice for r in own}) > 1}


def test_a_million_lines_of_one_second_and_a_million_without_a_time_are_cut(spark):
    n, parts = 1_000_000, 32
    at = F.when(F.col("id") < n, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = spark.range(2 * n).select(F.lit(7).alias("k"), at.alias("at"), F.pmod(F.xxhash64("id"), F.lit(10 * n)).alias("tie"))
    got = ordered.number_rows(rows, "k", "at", "tie", parts)
    slices = got.groupBy("slice").agg(
        F.count("*").alias("rows"), F.min("line_number").alias("first"), F.max("line_number").alias("last"),
        F.count_distinct("line_number").alias("numbers"), F.min("tie").alias("low"), F.max("tie").alias("high"),
    ).orderBy("slice").collect()
    assert max(r.rows for r in slices) < n / 10
    assert slices[0].first == 1 and slices[-1].last == 2 * n
    assert all(r.rows == r.numbers == r.last - r.first + 1 for r in slices)
    assert all(b.first == a.last + 1 for a, b in zip(slices, slices[1:], strict=False))
    assert got.filter("(at IS NULL) <> (line_number <= 1000000) OR log_rows <> 2000000").isEmpty()


def test_a_line_repeated_for_a_third_of_a_log_is_cut(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("k"), F.lit(None).cast("timestamp_ntz").alias("at"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("tie"))
    got = ordered.number_rows(rows, "k", "at", "tie", 20)
    assert got.groupBy("slice").count().agg(F.max("count")).first()[0] < 6_000
    assert got.select("line_number").distinct().count() == 60_000


def test_a_log_without_a_name_is_numbered(spark):
    rows = spark.createDataFrame([(None, None, 2), (None, None, 1), (1, None, 4)], "k int, at timestamp_ntz, tie int")
    got = {(r.k, r.tie): (r.line_number, r.log_rows) for r in ordered.number_rows(rows, "k", "at", "tie", 3).collect()}
    assert got == {(None, 1): (1, 2), (None, 2): (2, 2), (1, 4): (1, 1)}


def test_only_numbering_and_writing_run_while_a_plan_is_built(spark):
    logs = Logs(spark, SMALL)
    logs.kept_lines  # noqa: B018
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    for name in VIEWS:
        getattr(logs, name)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "others")


def test_platforms_outside_train_are_kept(spark):
    rows = [(n, "train" if n < 6 else "val", ("a", "b", "c")[n % 2 if n < 6 else n % 3], "x") for n in range(12)]
    split = spark.createDataFrame(rows, "log_id long, split string, platform string, error_category string")
    coded = profile.platform_one_hot(split).collect()
    assert {r.feature for r in coded} == {"platform_a", "platform_b", "platform_other"}
    for n, _, platform, _ in rows:
        hot = [r.feature for r in coded if r.log_id == n and r.value == 1]
        assert hot == [f"platform_{platform}" if platform in "ab" else "platform_other"]
    assert {r.platform: r.logs for r in profile.crosstab(split).collect()}["c"] == 2


def test_text_work_needs_no_shuffle_but_to_reach_all_cores(spark):
    logs = Logs(spark, SMALL)
    clean = logs.texts.select("log_id", features.normalise(F.col("text")).alias("clean"))
    flags = logs.texts.select("log_id", *features.structural_features(F.col("text")))
    for frame in (clean, flags):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning") == 1
    dealt = session.spread(spark.range(100).repartition(50))
    assert "RoundRobinPartitioning(50)" in dealt._jdf.queryExecution().executedPlan().toString()


def test_weighing_terms_needs_no_shuffle(spark):
    words = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, None), (4, [])], "log_id int, words array<string>")
    known = spark.createDataFrame([("a", 2, 3, 9), ("a b", 1, 2, 9), ("z", 2, 2, 9)], "term string, df int, freq int, n_logs int")
    weights = features.tfidf(words, known)
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    idf = {"a": np.log(10 / 3) + 1, "a b": np.log(10 / 2) + 1}
    raw = np.array([(1 + np.log(2)) * idf["a"], idf["a b"]])
    got = {(r.log_id, r.term): r.weight for r in weights.collect()}
    assert got == pytest.approx({(1, "a"): (raw / np.linalg.norm(raw))[0], (1, "a b"): (raw / np.linalg.norm(raw))[1]})


def test_crosstab_keeps_logs_without_a_category_or_platform(spark):
    rows = [("a", "p"), ("a", None), (None, "p"), (None, "p"), (None, None)]
    found = profile.crosstab(spark.createDataFrame(rows, "error_category string, platform string")).collect()
    assert {tuple(r) for r in found} == {("a", "p", 1), ("a", "unknown", 1), (None, "p", 2), (None, "unknown", 1)}


@pytest.mark.parametrize("buckets", [1 << 20, 64, 1])
def test_vocabulary_is_that_of_a_full_count_whatever_the_buckets(spark, monkeypatch, buckets):
    from collections import Counter

    pick = random.Random(1)
    texts = [[f"w{int(pick.paretovariate(0.6)) % 3000}" for _ in range(pick.randint(1, 80))] for _ in range(300)]
    terms = [[*t, *map(" ".join, zip(t, t[1:], strict=False))] for t in texts]
    freq, df = Counter(x for t in terms for x in t), Counter(x for t in terms for x in set(t))
    usual = sorted((-freq[x], x) for x in freq if 2 <= df[x] <= 0.8 * len(texts))[:500]
    monkeypatch.setattr(features, "BUCKETS", buckets)
    rows = spark.createDataFrame(list(enumerate(texts)), "log_id int, words array<string>")
    found = features.vocabulary(rows).collect()
    assert sorted((-r.freq, r.term) for r in found) == usual
    assert all((r.df, r.n_logs) == (df[r.term], 300) for r in found)


def test_a_log_of_many_errors_is_chunked_in_linear_time(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"line {i} of the log" for i in range(n))
        raw = spark.createDataFrame([(1, text)], "log_id bigint, raw_content string")
        errors = spark.range(0, n, 2).select(F.lit(1).cast("bigint").alias("log_id"), (F.col("id") + 1).alias("line_number"))
        began = time.perf_counter()
        rows = chunks.body_chunks(raw, errors).collect()
        took.append(time.perf_counter() - began)
        kept = [line for line in text.split("\n")[1::2]]
        assert rows[0].chunk.split("\n") == kept[: rows[0].last_line]
        assert max(r.last_line for r in rows) == len(kept)
    assert took[1] < 12 * took[0]


@pytest.mark.parametrize("group", ["g", None])
def test_rank_by_hash_is_the_rank_of_the_sorted_hash(spark, group):
    import hashlib

    rows = [(n, n % 3) for n in range(500)]
    ranked = ordered.rank_by_hash(spark.createDataFrame(rows, "id bigint, g int"), group, 42, "id", digits=1)
    keys = {n: (hashlib.md5(f"42{n}".encode()).hexdigest(), n) for n, _ in rows}
    for r in ranked.collect():
        peers = [keys[n] for n, g in rows if group is None or g == r.g]
        assert r.position == sorted(peers).index(keys[r.id]) + 1
        assert r.group_rows == len(peers)


def test_written_lines_are_classified_without_a_shuffle(spark):
    facts = Logs(spark, SMALL).facts
    facts.collect()
    plan = facts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # only the table of slices of logs that lie in several is shuffled, and handed to all tasks
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2
    assert "SortMergeJoin" not in plan
    for sign in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert sign not in plan


def test_lines_are_written_with_what_they_need_only(spark):
    plan = Logs(spark, SMALL).lines._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan


def test_stage_sums_and_log_totals_agree(spark):
    logs = Logs(spark, SMALL)
    rows = logs.rolled.groupBy("log_id").agg(F.sum("errors").alias("errors"), F.sum("lines").alias("lines"))
    both = rows.join(logs.counts, "log_id")
    assert both.filter("errors <> error_count OR lines <> total_lines").count() == 0
    unattributed = logs.facts.filter("kind = 'error' AND context IS NULL").count()
    in_stages = logs.rolled.filter("name IS NOT NULL").agg(F.sum("errors")).first()[0]
    total = logs.counts.agg(F.sum("error_count")).first()[0]
    assert in_stages + unattributed == total


def test_split_is_disjoint_complete_and_proportional(spark):
    logs = Logs(spark, SMALL)
    split = logs.split.collect()
    assert len({r.log_id for r in split}) == len(split) == logs.metadata.count()
    train = sum(r.split == "train" for r in split) / len(split)
    assert abs(train - 0.7) < 0.05


def greedy(tokens, limit, overlap):
    """Line by line: the packing as it is told, not as it is computed."""
    out, current, used = [], [], 0
    for n, t in enumerate(tokens, start=1):
        if current and used + t > limit:
            out.append((current[0], current[-1]))
            current = current[-overlap:] + [n]
            used = sum(tokens[m - 1] for m in current)
        else:
            current.append(n)
            used += t
    return out + ([(current[0], current[-1])] if current else [])


def test_packing_against_a_line_by_line_run():
    rng = random.Random(5)
    for _ in range(500):
        tokens = [rng.choice([0, 1, 2, 5, 30, 200]) for _ in range(rng.randint(0, 80))]
        spans = chunks.pack(np.asarray(tokens, dtype=np.int64), 60, 10)
        assert [(s["first"], s["last"]) for s in spans] == greedy(tokens, 60, 10), tokens


def test_chunks_leave_out_error_lines(spark):
    text = "\n".join(f"line {n} " + "x" * 40 for n in range(1, 61))
    raw = spark.createDataFrame([(1, text)], "log_id bigint, raw_content string")
    errors = spark.createDataFrame([(1, 3), (1, 50)], "log_id bigint, line_number bigint")
    rows = chunks.body_chunks(raw, errors, limit=200).orderBy("chunk_id").collect()
    kept = [line for n, line in enumerate(text.split("\n"), 1) if n not in (3, 50)]
    spans = greedy([len(line) // 4 for line in kept], 200, 10)
    assert [(r.first_line, r.last_line) for r in rows] == spans
    assert [r.chunk for r in rows] == ["\n".join(kept[a - 1 : b]) for a, b in spans]


def test_memo_lives_up_to_its_ttl(spark):
    now = dt.datetime(2024, 1, 8)
    rows = [
        ("summaries", "edge", now - dt.timedelta(seconds=604_800), 1, "a"),
        ("summaries", "late", now - dt.timedelta(seconds=604_801), 2, "b"),
        ("other", "odd", now, 3, "c"),
        ("fixes", "twice", now, 4, "old"),
        ("fixes", "twice", now, 5, "new"),
    ]
    schema = "cache_type string, content string, written_at timestamp_ntz, write_id bigint, value string"
    entries = memo.as_entries(spark.createDataFrame(rows, schema))
    asked = [(1, "summaries", "edge"), (2, "summaries", "late"), (3, "summaries", "odd"), (4, "fixes", "twice")]
    requests = spark.createDataFrame(asked, "request_id bigint, cache_type string, content string")
    hits = {r.request_id: r.value for r in memo.lookup(requests, entries, now).collect()}
    assert hits == {1: "a", 2: None, 3: "c", 4: "new"}
    stats = {r.cache_type: r for r in memo.statistics(requests, entries, now).collect()}
    assert (stats["summaries"].hits, stats["summaries"].misses, stats["summaries"].entries) == (2, 1, 3)
    assert memo.missing(requests, entries, now).count() == 1


def test_neighbour_stage_context_and_candidates_have_bounds(spark):
    logs = Logs(spark, SMALL)
    assert parse.first_entries(logs.entries, "error", 3).groupBy("log_id").count().filter("count > 3").count() == 0


def test_terms_of_unlike_ids_are_counted_without_a_shuffle(spark):
    rows = [(1, ["a", "b", "a", "b"]), (2, ["c"]), (3, None), (4, []), (None, ["a"])]
    kind = "log_id int, words array<string>"
    alone = features.term_counts(spark.createDataFrame(rows, kind))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    want = {(1, "a", 2), (1, "b", 2), (1, "a b", 2), (1, "b a", 1), (2, "c", 1), (None, "a", 1)}
    assert sorted(map(tuple, alone.collect()), key=str) == sorted(want, key=str)
    again = features.term_counts(spark.createDataFrame([*rows, (2, ["c", "d"]), (None, ["a", "a"])], kind))
    want = want - {(2, "c", 1), (None, "a", 1)} | {(2, "c", 2), (2, "d", 1), (2, "c d", 1), (None, "a", 3), (None, "a a", 1)}
    assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str)
    assert again.dtypes == alone.dtypes == [("log_id", "int"), ("term", "string"), ("tf", "bigint")]


def test_only_pairs_of_frequent_words_are_counted(spark, monkeypatch):
    usual = [f"w{n:03}" for n in range(500)]
    texts = [usual[n:] + usual[:n] for n in range(0, 500, 100)] + [["once", f"rare{n}", "w000"] for n in range(20)]
    seen, count = [], features._frequencies
    monkeypatch.setattr(features, "_frequencies", lambda marked: seen.append(marked) or count(marked))
    rows = spark.createDataFrame(list(enumerate(texts)), "log_id int, words array<string>")
    found = [r.term for r in features.vocabulary(rows).collect()]
    assert "once" in found and "w000" not in found and len(found) == 500
    pairs = {r.term for r in seen[1].distinct().collect()}
    assert pairs and not any("rare" in p for p in pairs)


def test_flags_and_steps_look_for_pieces_that_every_match_holds(spark):
    from loglantern import fixed_values as fx
    from loglantern.functions.text import any_case, one_line, strip

    odd = ["FA\u0131LED ex\u0131t cOde", "ERROR\u017f fa\u0130led exit \u017ftatus", None, "", "\t a  b \n\n c", "TIMED OUT", "Timeout",
           "2024-01-01 10:20:30 x/ab/c/ #12 1.2.3 http://a.b/c d", "\n at f(x:1:2)", "expect\nreceived", "expect received",
           "test a FAILED", "failed a Test", "npm ERR! ABC", "TS12 ERROR: x", "EXIT STATUS 1", "an Exception", "SyntaxError"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    clean = F.lower("text")
    for pattern, into in fx.NORMALISE_STEPS:
        clean = F.regexp_replace(clean, pattern, into)
    flags = [
        F.col("text").rlike(one_line(any_case(p) if ignore else "(?U)" + p)).cast("bigint").alias(n)
        for n, p, ignore in fx.STRUCTURAL_FLAGS
    ]
    want = rows.select(strip(clean).alias("clean"), *flags)
    found = rows.select(features.normalise(F.col("text")).alias("clean"), *features.structural_features(F.col("text"))[2:])
    assert found.collect() == want.collect()
    assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_forest_keeps_the_nodes_its_rows_have_reached(spark):
    assert models.forest().getCacheNodeIds()


def test_features_take_words_that_were_made_before(spark):
    rows = spark.createDataFrame([("a", "one two"), (None, None)], "platform string, text string")
    stage = models.LogFeatures(platforms=["a"])
    made = rows.withColumn(models.WORDS, models.words_in(F.col("text")))
    assert stage.transform(made).collect() == stage.transform(rows).collect()
    given = made.withColumn(models.WORDS, F.array(F.lit("three")))
    assert [r[models.TERMS] for r in stage.transform(given).collect()] == [["three"], ["three"]]


def _labelled(spark, rows):
    classes = F.element_at(F.array(*[F.lit(c) for c in "ab"]), (F.col("id") % 2 + 1).cast("int")).alias("lang")
    split = F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split")
    texts = spark.range(0, rows, 1, 16).select(F.col("id").alias("log_id"), split, classes, F.lit("a").alias("platform"), F.lit("one two").alias("text"))
    vocabulary = spark.createDataFrame([("one", 2, 2, 4)], "term string, df bigint, freq bigint, n_logs bigint")
    return models.labelled_features(texts, models.feature_stages(vocabulary, ["a"]), "lang")


def test_features_are_not_shuffled_by_their_class(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _labelled(spark, 40)
        assert found.rdd.getNumPartitions() == 16
        assert {(r.lang, r.label, r.class_weight) for r in found.collect()} == {("a", 0.0, 1.0), ("b", 1.0, 1.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_learner_has_no_more_tasks_than_cores(spark):
    rows = models.for_learners(spark.range(0, 1000, 1, 64))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows.count() == 1000
    assert models.for_learners(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 1
