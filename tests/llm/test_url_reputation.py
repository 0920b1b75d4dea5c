from pyspark.sql import functions as F

from loglantern.llm import url_reputation as ur
from loglantern.llm.queries import RULES

SCHEMA = "page_id int, url string, host string, verdict string"


def judged(spark, urls, outcomes, **more):
    pages = spark.createDataFrame([(n, u, "clash", "clash") for n, u in enumerate(urls)], SCHEMA)
    known = spark.createDataFrame(outcomes, "host string, good int")
    return {r.page_id: r for r in ur.judge(pages, known, RULES, **more).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        "HTTP://WWW.Example.COM/en/1?x=/y#z", "http://a.example.com/en/", "http://example.com/EN/", "http://example.com",
        "http://b.net/es/1", "http://net/fr/", "http://xnet/fr/1", "http://b.net/de/", None, "", "no scheme/en/", "a://b://c/d",
        "http://h?q/en/", "http://h#f", "http://x.net/es/1", "http://x.net/es/1",
    ]
    rows = judged(spark, urls, [("b.net", 1)])
    told = [(rows[n].host, rows[n].path, rows[n].rule) for n in range(len(urls))]
    assert told == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"),
        ("example.com", "/EN/", "com/"), ("example.com", "", None), ("b.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"),
        ("xnet", "/fr/1", None), ("b.net", "/de/", None), ("", "", None), ("", "", None), ("", "", None), ("b:", "//c/d", None),
        ("h", "", None), ("h", "", None), ("x.net", "/es/1", "net/es/"), ("x.net", "/es/1", "net/es/"),
    ]
    assert rows[0].verdict == "allow" and rows[1].verdict == "block" and rows[4].verdict == "block"


def test_shrinkage_goes_from_host_to_domain_to_suffix(spark):
    bad = [("bad.spam.org", 0)] * 40 + [("worse.spam.org", 0)] * 40 + [("odd.spam.org", 1)]
    good = [(f"h{n}.fine{n % 3}.org", 1) for n in range(60)] + [("x.other.de", 1)] * 20 + [("x.other.de", None)] * 5
    urls = ["http://bad.spam.org/", "http://new.spam.org/", "http://new.fine1.org/", "http://new.org/", "http://x.other.de/"]
    rows = judged(spark, urls, bad + good)
    rate = [rows[n].rate for n in range(5)]
    assert rows[0].verdict == "block" and rows[4].verdict == "allow" and rows[2].verdict == "allow"
    assert rate[0] < rate[1] < rate[3] < rate[2]
    assert rows[4].labelled == 20 and rows[1].labelled == 0
    assert all(r.rate <= r.rate_bound <= 1 for r in rows.values())


def test_no_outcomes_and_no_pages(spark):
    rows = judged(spark, ["http://a.b/", None], [("a.b", None)])
    assert {r.verdict for r in rows.values()} == {"allow"} and abs(rows[0].rate - 0.5) < 1e-9
    empty = spark.createDataFrame([], SCHEMA)
    assert ur.judge(empty, spark.createDataFrame([], "host string, good int"), RULES).count() == 0


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "u@x.com:80", "1.2.3.4", "com", "", "a.b.com."]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix, domain = ur.suffix_and_domain(F.col("host"))
    rows = {r.host: (r.s, r.d) for r in frame.select("host", suffix.alias("s"), domain.alias("d")).collect()}
    assert rows == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "u@x.com:80": ("com", "x.com"),
        "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "com": ("com", "com"), "": ("", ""), "a.b.com.": ("com", "b.com"),
    }
