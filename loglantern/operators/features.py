"""Text features: normalised text, structural flags, terms, vocabulary and tf-idf weights.

Terms are counted from a log's ``words``, the words of its normalised text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern import fixed_values as fx
from loglantern.functions.text import any_case, one_line, strip
from loglantern.session import keep

#: Counters of the first, rough count of pairs; rows of a table that is handed to the tasks.
BUCKETS = 1 << 20

STRUCTURAL_NAMES = ("log_length", "num_lines", *[name for name, _, _ in fx.STRUCTURAL_FLAGS])


#: Literal pieces that every match of a normalising step holds.
_PIECES = dict(
    zip(
        [pattern for pattern, _ in fx.NORMALISE_STEPS],
        [("-", ":"), (":",), ("://",), ("/",), ("#",), (".",)],
        strict=False,
    )
)
#: Pieces that every match of a flag holds: one of several lists, all of its pieces.  Flags that ignore
#: case are looked up in lower case, so their pieces have no letter (i, k, s) that others fold to.
_FLAG_PIECES = {
    "has_error_keyword": (("error",),),
    "has_failed_keyword": (("led", "fa"),),
    "has_exception": (("except",),),
    "has_timeout": (("meout",), ("med out",)),
    "has_pip_error": (("ERROR:",),),
    "has_ts_error": (("TS",),),
    "has_syntax_error": (("SyntaxError",), ("IndentationError",)),
    "has_test_failed": (("led", "fa", "te"),),
    "has_assertion_error": (("AssertionError",), ("expect", "received")),
    "has_stack_trace": (("at", "(", ":", ")"),),
    "has_exit_code": (("t code",), ("tatu",)),
}


def holds(text: Column, pieces: Sequence[str]) -> Column:
    """Whether the text holds all of the pieces; null for a null text."""
    return reduce(and_, [text.contains(piece) for piece in pieces], F.lit(True))


def _replaced(text: Column, pattern: str, into: str, pieces: Sequence[str]) -> Column:
    """Replaces a pattern in texts that hold its pieces; a list's element, so that the text is made once."""
    def change(t: Column) -> Column:
        return F.when(holds(t, pieces), F.regexp_replace(t, pattern, into)).otherwise(t)

    return F.get(F.transform(F.array(text), change), F.lit(0))


def normalise(text: Column) -> Column:
    """Lower-case text with dates, times, addresses, paths, numbers and versions taken out, and single blanks.

    A pattern is tried only on texts that hold the literal pieces any match of it has.
    """
    out = F.lower(text)
    for pattern, into in fx.NORMALISE_STEPS:
        out = _replaced(out, pattern, into, _PIECES.get(pattern, ()))
    return strip(out)


def structural_features(text: Column) -> list[Column]:
    """14 features: length, line feeds and twelve flags; a pattern is tried only where its pieces occur."""
    small = F.lower(text)
    flags = []
    for name, pattern, ignore_case in fx.STRUCTURAL_FLAGS:
        found = text.rlike(one_line(any_case(pattern) if ignore_case else "(?U)" + pattern))
        options = _FLAG_PIECES.get(name, ((),))
        seen = reduce(or_, [holds(small if ignore_case else text, own) for own in options])
        flags.append((seen & found).cast("bigint").alias(name))
    return [
        F.length(text).cast("bigint").alias("log_length"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint").alias("num_lines"),
        *flags,
    ]


def words_of(clean_text: Column) -> Column:
    """Words of at least two characters."""
    return F.regexp_extract_all(F.lower(clean_text), F.lit(fx.TOKEN), 0)


def pairs_of(words: Column) -> Column:
    """Pairs of neighbouring words."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    seconds = F.slice(words, 2, F.size(words))
    return F.zip_with(firsts, seconds, lambda a, b: F.concat_ws(" ", a, b))


def terms_of(words: Column) -> Column:
    """Words, and pairs of neighbouring words."""
    return F.concat(words, pairs_of(words))


def _counted_within(texts: DataFrame) -> DataFrame:
    """Occurrences of each term per row: in order, equal terms are runs."""
    ordered = texts.select("log_id", F.sort_array(terms_of(F.col("words"))).alias("terms"))
    begins = F.transform("terms", lambda term, at: F.when(~term.eqNullSafe(F.get("terms", at - 1)), at))
    runs = ordered.select("log_id", "terms", F.array_compact(begins).alias("begins"))
    ends = F.concat(F.slice("begins", 2, F.greatest(F.size("begins"), F.lit(0))), F.array(F.size("terms")))
    counted = F.zip_with(
        "begins", ends, lambda a, b: F.struct(F.get("terms", a).alias("term"), (b - a).cast("bigint").alias("tf"))
    )
    # a log without terms has an end only
    return runs.select("log_id", F.inline(counted)).filter(F.col("term").isNotNull())


def term_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of each term per log, from its ``words``.

    Terms are counted within the row.  Only ids are shuffled to find those of several rows, and
    only the counts of such logs to add them up.
    """
    several = keep(
        texts.groupBy("log_id").agg(F.count("*").alias("rows_")).filter("rows_ > 1").select(F.col("log_id").alias("id_"))
    )
    ids = several.count()
    if not ids:
        return _counted_within(texts)
    same = F.col("log_id").eqNullSafe(F.col("id_"))
    # no more rows than BUCKETS are handed to the tasks
    side = F.broadcast(several) if ids <= BUCKETS else several
    added = _counted_within(texts.join(side, same, "left_semi")).groupBy("log_id", "term").agg(F.sum("tf").alias("tf"))
    return _counted_within(texts.join(side, same, "left_anti")).unionByName(added)


def marked_terms(texts: DataFrame, terms: Column) -> DataFrame:
    """(term, first) of every one of a log's ``terms``; ``first`` marks one of its equal terms."""
    ordered = texts.select(F.sort_array(terms).alias("terms"))
    marked = F.zip_with(
        F.col("terms"),
        F.concat(F.array(F.lit("")), F.col("terms")),
        lambda term, before: F.struct(term.alias("term"), (term != before).alias("first")),
    )
    return ordered.select(F.inline(marked)).filter(F.col("term").isNotNull())


def _frequencies(marked: DataFrame) -> DataFrame:
    return marked.groupBy("term").agg(F.count_if("first").alias("df"), F.count("*").alias("freq"))


def _usual(n_logs: int) -> Column:
    most = F.lit(float(n_logs)) * F.lit(fx.VOCABULARY_MAX_SHARE)
    return (F.col("df") >= fx.VOCABULARY_MIN_DOCS) & (F.col("df") <= most)


def vocabulary(texts: DataFrame) -> DataFrame:
    """The most frequent terms found in at least two logs and at most 80 % of them, with their numbers.

    Ties go to the term that sorts first.  Words are counted first: the last term of the
    vocabulary is at least as frequent as the last of as many usual words.  A pair is no more
    frequent than either of its words, so only pairs of words that reach this number, in at
    least as many logs as a term needs, are counted.  Pairs of more words than ``BUCKETS`` has
    pairs for are first counted by hash bucket, in ``BUCKETS`` counters per task that are then
    added up: no pair is more frequent than its bucket.
    """
    n_logs = texts.count()
    words = keep(_frequencies(marked_terms(texts, F.col("words"))).filter(F.col("df") >= fx.VOCABULARY_MIN_DOCS))
    sure = words.filter(_usual(n_logs)).orderBy(F.desc("freq")).limit(fx.VOCABULARY_SIZE)
    known = sure.agg(F.count("*").alias("terms"), F.min("freq").alias("least")).first()
    bar = known["least"] if known["terms"] == fx.VOCABULARY_SIZE else fx.VOCABULARY_MIN_DOCS
    frequent = words.filter(F.col("freq") >= bar)
    few = frequent.count()
    side = frequent.select(F.col("term").alias("word"))
    side = F.broadcast(side) if few <= BUCKETS else side
    pairs = marked_terms(texts, pairs_of(F.col("words")))
    for at in (1, -1):
        pairs = pairs.join(side, F.substring_index("term", " ", at) == F.col("word"), "left_semi")
    if few * few > BUCKETS:
        pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
        full = pairs.groupBy("bucket").agg(F.count("*").alias("freq")).filter(F.col("freq") >= bar)
        # no more rows than BUCKETS
        pairs = pairs.join(F.broadcast(keep(full.select("bucket"))), "bucket", "left_semi")
    chosen = frequent.unionByName(_frequencies(pairs)).filter(_usual(n_logs)).orderBy(F.desc("freq"), "term").limit(fx.VOCABULARY_SIZE)
    return chosen.select("term", "df", "freq", F.lit(n_logs).cast("bigint").alias("n_logs"))


def known_terms(vocabulary_rows: DataFrame) -> tuple[list[str], list[float]]:
    """The vocabulary (``VOCABULARY_SIZE`` terms at most) in alphabetical order, and the inverse document frequencies."""
    rows = sorted(vocabulary_rows.collect(), key=lambda r: r["term"])
    return [r["term"] for r in rows], [math.log((1 + r["n_logs"]) / (1 + r["df"])) + 1 for r in rows]


def _constant(values: list, kind: str) -> Column:
    """A list as one literal; one per value would make a long plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def counted_terms(texts: DataFrame, terms: list[str], into: str = "counts") -> DataFrame:
    """Adds a vector of the occurrences of the known terms among a log's ``words``."""
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="terms_", outputCol=into)
    listed = F.coalesce(terms_of(F.col("words")), F.array().cast("array<string>"))
    return counter.transform(texts.withColumn("terms_", listed)).drop("terms_")


def term_weights(counts: Column, idf: list[float]) -> Column:
    """Weights (1 + ln tf) * idf of a vector of counts, not yet scaled; 0 for terms a log has not."""
    factors = _constant(idf, "array<double>")
    return F.transform(vector_to_array(counts), lambda tf, at: F.when(tf > 0, (1 + F.log(tf)) * F.get(factors, at)).otherwise(0.0))


def tfidf(texts: DataFrame, vocabulary_rows: DataFrame) -> DataFrame:
    """Weights (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length 1 per log.

    The vocabulary is handed to the tasks; a log's terms are counted and weighed within its
    row, so nothing is shuffled.
    """
    terms, idf = known_terms(vocabulary_rows)
    if not terms:
        return texts.select("log_id", F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    counted = counted_terms(texts, terms).select("log_id", "counts")
    names = _constant(terms, "array<string>")

    def with_length(weights: Column) -> Column:
        present = F.transform(weights, lambda w, at: F.struct(F.get(names, at).alias("term"), w.alias("raw")))
        norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda total, w: total + w * w))
        return F.struct(F.filter(present, lambda e: e["raw"] > 0).alias("present"), norm.alias("norm"))

    # inlined, so that the list is made once for both its length and its rows
    told = counted.select("log_id", F.inline(F.transform(F.array(term_weights(F.col("counts"), idf)), with_length)))
    rows = told.select("log_id", "norm", F.inline("present"))
    return rows.select("log_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))
