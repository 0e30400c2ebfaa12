from slantframe.llm import queries
from slantframe.llm.url_filter import build_cascade, judge_urls, tracked_hosts

SF = "/root/testdata/sf0.1"


def test_hosts_by_their_share_of_tracked_urls(spark):
    urls = ["http://A.net/?utm_source=x", "http://a.net/", "http://b.net/?a=1&utm_b#c", "http://c.net/utm_", "http://c.net/?utm_", "http://c.net", "no?utm_x", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    # 4 of 8 urls are tracked.
    assert {r.key for r in tracked_hosts(pages).collect()} == {"b.net"}
    assert {r.key for r in tracked_hosts(pages, 0.6).collect()} == {"a.net", "b.net", "c.net"}
    got = {r.page_id: r.verdict for r in judge_urls(pages, [], tracked_hosts(pages, 0.9)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    assert tracked_hosts(pages.limit(0)).count() == 0


def test_the_list_has_a_fair_share_of_hosts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = queries.op9_url_filter(spark, SF).collect()
    hosts, blocked = {r.host for r in rows}, {r.host for r in rows if r.rule is None and r.verdict == "block"}
    listed = {r.key for r in tracked_hosts(pages).collect()}
    assert len(hosts) / 4 < len(listed) < len(hosts) * 0.75 and blocked <= listed and len(blocked) > 2
    # Of very many keys some pass the first level by chance and are told apart by the next ones.
    keys = spark.range(40_000).selectExpr("concat('h', id, '.net') as key", "id")
    cascade = build_cascade(keys.select("key"), keys.where("id % 3 = 0").select("key"))
    assert len(cascade.levels) > 2
