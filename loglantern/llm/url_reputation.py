"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted per host. A host's good rate is shrunk
towards its registered domain's, that one towards its suffix's and that one towards the
overall rate, by beta-binomial priors whose strength is fitted by the method of moments,
one number per level. A host is blocked if even the upper bound of its posterior good
rate lies below ``min_good``. Explicit rules go first.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path; the
empty host is a host like any other. Null outcomes are left out; repeated rows count as
often as they occur. Without any outcome every host has the prior rate of a half, whose
bound is wide, so nothing is blocked. Columns of the pages are passed through; the added
columns replace equally named ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import lasting

#: Common suffixes of two labels; every other suffix is the last label.
DOUBLE_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk",
)

#: Rules are literals of the plan; longer lists belong into a table.
MOST_RULES = 1000

Z = 1.645
MIN_GOOD = 0.5
#: Bounds of the fitted intra-class correlation; prior strength is 1 / correlation - 1.
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host; user, port and a last dot are no part of it."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$|[\[\]:]")
    double = F.substring_index(name, ".", -2).isin(*DOUBLE_SUFFIXES)
    suffix = F.when(address, name).when(double, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(double, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return suffix, domain


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host and path) that fits a host or one above it, and its verdict."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0])):  # the longest is asked first
        top, _, below = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + below)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _correlation(units: DataFrame, mean: str) -> Column:
    """Method-of-moments intra-class correlation of good counts around ``mean``."""
    rate, n = F.col(mean), F.col("n")
    excess = F.sum((F.col("good") - n * rate) * (F.col("good") - n * rate) / (n * rate * (1 - rate)) - 1)
    raw = F.coalesce(F.try_divide(excess, F.sum(n - 1).cast("double")), F.lit(LEAST_CORRELATION))
    return F.least(F.greatest(raw, F.lit(LEAST_CORRELATION)), F.lit(MOST_CORRELATION))


def _shrunk(units: DataFrame, mean: str, out: str) -> DataFrame:
    """Adds the posterior rate of each unit under a prior around ``mean`` and the prior's strength."""
    fitted = units.where("n > 0").agg(_correlation(units, mean).alias("rho")).select((1 / F.col("rho") - 1).alias(f"{out}_strength"))
    strength = F.col(f"{out}_strength")
    return units.join(F.broadcast(fitted)).withColumn(out, (strength * F.col(mean) + F.col("good")) / (strength + F.col("n")))


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior good rate and its bound per host, of rows (host, good); good may be null.

    One shuffle by host carries pre-aggregated counts; the levels above are made of those.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = lasting(hosts.withColumns({"suffix": suffix, "domain": domain}))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("overall"))
    suffixes = _shrunk(suffixes.join(F.broadcast(overall)), "overall", "suffix_rate")
    domains = _shrunk(domains.join(suffixes.select("suffix", "suffix_rate"), "suffix"), "suffix_rate", "domain_rate")
    hosts = _shrunk(hosts.join(domains.select("suffix", "domain", "domain_rate"), ["suffix", "domain"]), "domain_rate", "rate")
    weight = F.col("rate_strength") + F.col("n")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return hosts.select(
        "host",
        F.col("n").alias("labelled"),
        F.col("rate"),
        F.least(F.col("rate") + z * spread, F.lit(1.0)).alias("rate_bound"),
    )


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], min_good: float = MIN_GOOD, z: float = Z
) -> DataFrame:
    """Pages with host, path, rule, verdict, posterior rate and bound.

    ``outcomes`` has (host, good). Hosts without an outcome take their domain's rate.
    """
    host, path = host_and_path(F.col("url"))
    added = ("host", "path", "rule", "verdict", "labelled", "rate", "rate_bound")
    parsed = pages.drop(*added).withColumns({"host": host, "path": path})
    known = reputations(outcomes.select("host", "good").unionByName(parsed.select("host", F.lit(None).cast("int").alias("good"))), z)
    rule, ruling = ruled(F.col("host"), F.col("path"), rules)
    by_rate = F.when(F.col("rate_bound") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(known, "host", "left").withColumns({"rule": rule, "verdict": F.coalesce(ruling, by_rate)})
