"""Labelled collections: profile, splits, features, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.operators import evaluate, features, profile
from loglantern.plans import duck
from loglantern.plans.duck import matches, q, sql, trim
from loglantern.plans.registry import Registry
from loglantern.session import keep
from loglantern.sources import corpus
from loglantern.sources.raw_logs import guard_size

registry = Registry()
query = registry.add
QUERIES, ORACLE = registry.queries, registry.oracle

META = """
metadata AS (
  SELECT doc_id AS log_id, concat('logs/', doc_id, '.txt') AS file_path,
    CASE doc_id % 3 WHEN 0 THEN 'jenkins' WHEN 1 THEN 'github-actions' ELSE 'gitlab-ci' END AS platform,
    CASE WHEN doc_id % 20 < 5 THEN 'dependency_error' WHEN doc_id % 20 < 9 THEN 'syntax_error'
      WHEN doc_id % 20 < 13 THEN 'test_failure' WHEN doc_id % 20 < 16 THEN 'timeout'
      WHEN doc_id % 20 < 18 THEN 'environment_error' WHEN doc_id % 20 < 19 THEN 'network_error'
      ELSE 'permission_error' END AS error_category,
    CAST(doc_id % 1000 + 1 AS INTEGER) AS build_number
  FROM documents),
texts AS (SELECT m.*, d.text FROM metadata m JOIN documents d ON m.log_id = d.doc_id),
files AS (SELECT concat('logs/', doc_id, '.txt') AS file_path, text FROM documents SEMI JOIN labels USING (doc_id))
"""
SPLIT = META + """,
ordered AS (
  SELECT *, md5(concat('42', log_id)) AS digest, count(*) OVER (PARTITION BY error_category) AS n
  FROM metadata),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY error_category ORDER BY digest, log_id) AS place,
    n - CAST(round(n * CAST(0.3 AS DOUBLE)) AS BIGINT) AS train FROM ordered),
split AS (
  SELECT * EXCLUDE (digest, n, place, train), CASE WHEN place <= train THEN 'train'
    WHEN place <= train + (n - train) // 2 THEN 'val' ELSE 'test' END AS split FROM placed)
"""


@query("metadata_text", sql(META, """SELECT log_id, file_path, platform, error_category,
  coalesce(f.text, '') AS text FROM metadata LEFT JOIN files f USING (file_path)"""))
def _(logs):
    rows = logs.with_files(logs.labelled_files)
    return rows.select("log_id", "file_path", "platform", "error_category", "text")


@query("metadata_found", sql(META, """SELECT log_id, file_path, length(f.text) AS chars
  FROM metadata JOIN files f USING (file_path)"""))
def _(logs):
    rows = logs.with_files(logs.labelled_files, keep_missing=False)
    return rows.select("log_id", "file_path", F.length("text").cast("bigint").alias("chars"))


@query("truncate_guard", f"""SELECT doc_id AS log_id, CAST(length(text) > 10000000 AS BIGINT) AS truncated,
  substring(text, 1, 10000000) AS raw_content, concat(substring(text, 1, 500), '...') AS preview
  FROM documents""")
def _(logs):
    return guard_size(logs.raw_documents)


def _frequency(name, column):
    @query(name, sql(META, f"""SELECT {column}, count(*) AS logs,
      round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM metadata GROUP BY {column}"""))
    def _(logs):
        return profile.frequency(logs.metadata, column)


_frequency("category_freq", "error_category")
_frequency("platform_freq", "platform")


@query("corpus_statistics", sql(META, """SELECT 'total' AS field, 'all' AS value, count(*) AS logs FROM metadata
UNION ALL SELECT 'platform', platform, count(*) FROM metadata GROUP BY platform
UNION ALL SELECT 'error_category', error_category, count(*) FROM metadata GROUP BY error_category"""))
def _(logs):
    return profile.corpus_statistics(logs.metadata)


@query("corpus_total", sql(META, "SELECT count(*) AS logs FROM metadata"))
def _(logs):
    return logs.metadata.agg(F.count("*").alias("logs"))


@query("crosstab", sql(META, """SELECT error_category, platform, count(m.log_id) AS logs
  FROM (SELECT DISTINCT error_category FROM metadata) CROSS JOIN (SELECT DISTINCT platform FROM metadata)
  LEFT JOIN metadata m USING (error_category, platform) GROUP BY ALL"""))
def _(logs):
    return profile.crosstab(logs.metadata)


@query("balance", sql(META, """SELECT min(n) AS smallest, max(n) AS largest,
  round(min(n) / max(n), 2) AS balance, CASE WHEN min(n) / max(n) >= 0.7 THEN 'balanced'
    WHEN min(n) / max(n) >= 0.5 THEN 'moderate' ELSE 'imbalanced' END AS verdict
  FROM (SELECT count(*) AS n FROM metadata GROUP BY error_category)"""))
def _(logs):
    return profile.balance(logs.metadata)


@query("split_sizes", sql(META, """SELECT count(*) AS logs,
  CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS train_logs,
  CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS val_logs,
  CAST(floor(count(*) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS test_logs FROM metadata"""))
def _(logs):
    return profile.split_sizes(logs.metadata)


@query("length_stats", sql(META, """SELECT round(avg(length(text)), 6) AS mean_chars,
  min(length(text)) AS min_chars, max(length(text)) AS max_chars,
  round(median(length(text)), 6) AS median_chars FROM texts"""))
def _(logs):
    return profile.length_stats(logs.texts)


@query("length_hist", sql(META, """SELECT least(20, 1 + (length(text) - low) * 20 // greatest(1, high - low)) AS bin,
  count(*) AS logs FROM texts, (SELECT min(length(text)) AS low, max(length(text)) AS high FROM texts)
  GROUP BY bin"""))
def _(logs):
    return profile.length_histogram(logs.texts)


@query("categories", sql(META, "SELECT DISTINCT error_category FROM metadata"))
def _(logs):
    return profile.categories(logs.metadata)


_PREVIEW = """SELECT log_id, error_category, platform, CAST(len(p) AS BIGINT) AS total_lines,
  CAST(generate_subscripts(p[:{n}], 1) AS BIGINT) AS line_number, unnest(p[:{n}]) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS p FROM {rows})"""


@query("sample_per_category", sql(META, _PREVIEW.format(n=25, rows="""(SELECT * FROM texts WHERE log_id IN
  (SELECT min(log_id) FROM texts GROUP BY error_category))""")))
def _(logs):
    return profile.sample_per_category(logs.texts)


@query("first_samples", sql(META, _PREVIEW.format(n=5, rows="(SELECT * FROM texts ORDER BY log_id LIMIT 3)")))
def _(logs):
    return profile.first_samples(logs.texts)


@query("stratified_split", sql(SPLIT, "SELECT log_id, error_category, split FROM split"))
def _(logs):
    return logs.split.select("log_id", "error_category", "split")


@query("split_dist", sql(SPLIT, "SELECT split, error_category, count(*) AS logs FROM split GROUP BY ALL"))
def _(logs):
    return profile.split_distribution(logs.split)


@query("shuffled", sql(META, """SELECT log_id, row_number() OVER (ORDER BY md5(concat('42', log_id)), log_id)
  AS position FROM metadata"""))
def _(logs):
    return profile.shuffled(logs.metadata).select("log_id", "position")


@query("label_encode", sql(SPLIT, """SELECT log_id, split, error_category, c.label FROM split LEFT JOIN (
  SELECT error_category, row_number() OVER (ORDER BY error_category) - 1 AS label
  FROM (SELECT DISTINCT error_category FROM split WHERE split = 'train')) c USING (error_category)"""))
def _(logs):
    return profile.encode_labels(logs.split).select("log_id", "split", "error_category", "label")


@query("platform_one_hot", sql(SPLIT, """SELECT log_id, split, concat('platform_', p) AS feature,
  CAST(CASE WHEN p = 'other' THEN platform IS NULL OR platform NOT IN (SELECT platform FROM split WHERE split = 'train')
    ELSE coalesce(platform = p, false) END AS BIGINT) AS value
  FROM split, (SELECT DISTINCT platform AS p FROM split WHERE split = 'train' UNION ALL SELECT 'other')"""))
def _(logs):
    return profile.platform_one_hot(logs.split)


@query("class_weights", sql(SPLIT, """SELECT error_category, count(*) AS logs,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
  FROM split WHERE split = 'train' GROUP BY error_category"""))
def _(logs):
    return profile.class_weights(logs.split.filter("split = 'train'"))


def _normalised(x: str) -> str:
    out = f"lower({x})"
    for pattern, into in fx.NORMALISE_STEPS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(into)}, 'g')"
    return trim(out)


CLEAN = META + f""",
clean AS (SELECT log_id, {_normalised("text")} AS clean FROM texts)
"""


@query("normalise_text", sql(CLEAN, "SELECT log_id, clean FROM clean"))
def _(logs):
    return logs.texts.select("log_id", features.normalise(F.col("text")).alias("clean"))


def _flag_sql(pattern: str, ignore_case: bool) -> str:
    return f"CAST({matches('text', pattern, ignore_case)} AS BIGINT)"


STRUCTURAL = META + f""",
features AS (SELECT log_id, error_category, length(text) AS log_length,
  length(text) - length(replace(text, chr(10), '')) AS num_lines,
  {", ".join(f"{_flag_sql(p, i)} AS {n}" for n, p, i in fx.STRUCTURAL_FLAGS)} FROM texts)
"""


@query("structural_features", sql(STRUCTURAL, "SELECT * EXCLUDE (error_category) FROM features"))
def _(logs):
    return logs.texts.select("log_id", *features.structural_features(F.col("text")))


_UNPIVOTED = " UNION ALL ".join(
    f"SELECT error_category, '{n}' AS feature, round(avg({n}), 6) AS mean FROM features GROUP BY 1"
    for n in features.STRUCTURAL_NAMES
)


@query("feature_means", sql(STRUCTURAL, _UNPIVOTED))
def _(logs):
    flat = logs.texts.select("error_category", *features.structural_features(F.col("text")))
    return profile.feature_means(flat, features.STRUCTURAL_NAMES)


TERMS = CLEAN + f""",
words AS (SELECT log_id, regexp_extract_all(lower(clean), {q(fx.TOKEN)}) AS w FROM clean),
terms AS (
  SELECT log_id, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: concat(p[1], ' ', p[2]))))
    AS term FROM words),
counts AS (SELECT log_id, term, count(*) AS tf FROM terms GROUP BY ALL)
"""
VOCABULARY = TERMS + SPLIT.replace(META, "") + """,
train AS (SELECT log_id FROM clean SEMI JOIN (SELECT log_id FROM split WHERE split = 'train') USING (log_id)),
vocabulary AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS freq, (SELECT count(*) FROM train) AS n_logs
  FROM counts SEMI JOIN train USING (log_id) GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= CAST(0.8 AS DOUBLE) * (SELECT count(*) FROM train)
  ORDER BY freq DESC, term LIMIT 500),
raw AS (
  SELECT log_id, term, (1 + ln(tf)) * (ln((1 + n_logs) / (1 + df)) + 1) AS raw
  FROM counts JOIN vocabulary USING (term)),
tfidf AS (
  SELECT log_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY log_id)) AS weight FROM raw)
"""


def _train_vocabulary(logs):
    train = logs.split.filter("split = 'train'").select("log_id")
    return features.vocabulary(keep(logs.kept_words.join(train, "log_id", "left_semi")))


@query("term_counts", sql(TERMS, "SELECT log_id, term, tf FROM counts"))
def _(logs):
    return features.term_counts(logs.words)


@query("vocabulary", sql(VOCABULARY, "SELECT term, df, freq, n_logs FROM vocabulary"))
def _(logs):
    return _train_vocabulary(logs)


@query("tfidf", sql(VOCABULARY, "SELECT log_id, term, round(weight, 6) AS weight FROM tfidf"))
def _(logs):
    weights = features.tfidf(logs.kept_words, _train_vocabulary(logs))
    return weights.select("log_id", "term", F.round("weight", 6).alias("weight"))


PREDICTIONS = """
predictions AS (
  SELECT concat('limit-', t) AS model, d.doc_id, CAST(quality AS BIGINT) AS label,
    CAST(n_chars > t AS BIGINT) AS prediction
  FROM documents d JOIN labels l USING (doc_id), (SELECT unnest([200, 500, 1000]) AS t)),
sides AS (
  SELECT model, label AS class, prediction = label AS hit, 1 AS support, 0 AS predicted FROM predictions
  UNION ALL SELECT model, prediction, false, 0, 1 FROM predictions),
sums AS (
  SELECT model, class, CAST(count(*) FILTER (hit) AS BIGINT) AS hits,
    CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted
  FROM sides GROUP BY ALL),
rates AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0::DOUBLE END AS precision,
    CASE WHEN support > 0 THEN hits / support ELSE 0.0::DOUBLE END AS recall FROM sums),
report AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
    ELSE 0.0::DOUBLE END AS f1 FROM rates),
compared AS (
  SELECT model, round(sum(hits) / sum(support), 6) AS accuracy,
    round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS rows
  FROM report GROUP BY model)
"""


def _predictions(logs):
    return corpus.score_predictions(logs.table("documents"), logs.table("labels"))


@query("confusion", sql(PREDICTIONS, "SELECT model, label, prediction, count(*) AS rows FROM predictions GROUP BY ALL"))
def _(logs):
    return evaluate.confusion(_predictions(logs))


@query("class_report", sql(PREDICTIONS, """SELECT model, class, hits, support, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report"""))
def _(logs):
    return evaluate.rounded(evaluate.class_report(_predictions(logs)))


@query("class_accuracy", sql(PREDICTIONS, "SELECT model, class, round(recall, 6) AS accuracy FROM report"))
def _(logs):
    report = evaluate.class_report(_predictions(logs))
    return report.select("model", "class", F.round("recall", 6).alias("accuracy"))


@query("model_compare", sql(PREDICTIONS, "SELECT * FROM compared"))
def _(logs):
    return evaluate.compare_models(_predictions(logs))


@query("best_model", sql(PREDICTIONS, "SELECT * FROM compared ORDER BY accuracy DESC, model LIMIT 1"))
def _(logs):
    return evaluate.best_model(evaluate.compare_models(_predictions(logs)))


# the documents hold none of the flags' words; the event corpus does, line by line
@query("line_flags", f"""WITH {duck.LINES} SELECT log_id, line_number,
  {", ".join(f"CAST({matches('raw_line', p, i)} AS BIGINT) AS {n}" for n, p, i in fx.STRUCTURAL_FLAGS)} FROM lines""")
def _(logs):
    flags = features.structural_features(F.col("raw_line"))[2:]
    return logs.lines.select("log_id", "line_number", *flags)
