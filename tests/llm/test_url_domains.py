import duckdb

from slantframe.llm import queries
from slantframe.llm.url_filter import judge_urls, worded_hosts

SF = "/root/testdata/sf0.01"


def test_domains_cover_subdomains(spark):
    urls = ["http://www.spam-farm.example.com/", "http://m.new.pills-now.net/x", "http://spammer.net/", "http://ok.net", "http://a.bad.org.", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = worded_hosts(pages, ["spam", "pills"])
    assert {r.key for r in keys.collect()} == {"spam-farm.example.com", "pills-now.net"}
    for most in (1 << 20, 1):
        blocked = {r.page_id for r in judge_urls(pages, [], keys, most, parents=True).collect() if r.verdict == "block"}
        assert blocked == {0, 1}
        assert not {r.page_id for r in judge_urls(pages, [], keys, most).collect() if r.verdict == "block"}


def test_domains_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op9_url_filter_domains"]).fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op9_url_filter_domains(spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(r[3] is None and r[4] == "block" for r in got)
