from pyspark.sql import functions as F

from slantframe.llm.url_filter import Rule, build_cascade, judge_urls, passed


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key")).union(spark.createDataFrame([(None,), ("7",)], "key string"))
    listed = universe.where("cast(key as int) % 9 = 0")
    cascade = build_cascade(universe, listed)
    assert len(cascade.levels) > 1
    got = passed(universe.where("key is not null"), cascade.levels).collect()
    assert all((r.passed % 2 == 1) == (int(r.key) % 9 == 0) for r in got)
    assert build_cascade(universe, listed, most_bytes=10) is None


def test_verdicts(spark):
    rules = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("com", "/fr/", "allow")]
    urls = ["http://A.example.org/es/1", "http://example.org/e?x", "http://x.org", "https://bad.net/#x", "http://b.com/fr/", None, "no url", "http://notexample.org/es/", "http://u://v", "://"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(0, urls[0], "again")], "page_id long, url string, key string")
    listed = spark.createDataFrame([("bad.net",), (None,), ("x.org",)], "key string")
    for most in (1 << 20, 1):
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules, listed, most).collect() if r.page_id not in (5, 6, 3, 2, 8, 9))
        assert got == [
            (0, "a.example.org", "/es/1", "example.org/es/", "block"),
            (0, "a.example.org", "/es/1", "example.org/es/", "block"),
            (1, "example.org", "/e", "org/", "allow"),
            (4, "b.com", "/fr/", "com/fr/", "allow"),
            (7, "notexample.org", "/es/", "org/", "allow"),
        ]
        rest = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules, listed, most).collect()}
        assert rest[2] == ("x.org", "", None, "block")
        assert rest[3] == ("bad.net", "/", None, "block")
        assert rest[5] == rest[6] == ("", "", None, "allow") == rest[9]
        assert rest[8] == ("u:", "//v", None, "allow")
    assert judge_urls(pages.limit(0), rules, listed).count() == 0
