"""Orders that are cut into spans, and rules with their negative cases."""

import random

from pyspark.sql import functions as F

from slantframe.operators import annotation, phase_rules, rules


def test_rows_before_across_spans(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, float(rnd.randrange(9))) for i in range(300) if i % 7]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    want, last = {}, {}
    for k, i, v in rows:
        want[i] = last.get(k)
        last[k] = v
    for span in (1, 10, 1000):
        assert {r.i: r.prev_v for r in rules.with_previous(df, ["v"], "k", "i", span).collect()} == want
    got = rules.numbered(df, "k", F.floor(F.col("i") / 16), ["i"]).orderBy("i").collect()
    count = {}
    for r in got:
        count[r.k] = count.get(r.k, 0) + 1
        assert r.n == count[r.k]
    assert rules.with_previous(df.limit(0), ["v"], "k", "i").count() == 0


def test_rules_apply_only_where_they_may(spark):
    df = spark.createDataFrame([(1, 5.0, True), (2, None, True), (3, 1.0, False)], "id int, x double, on boolean")
    found = phase_rules.evaluate(df, "id", [phase_rules.Rule("big", F.col("x") > 2, F.col("x"), F.col("on")), phase_rules.Rule("any", F.lit(True), severity="warning")])
    assert sorted((r.object, r.rule, r.passed) for r in found.collect()) == [("1", "any", True), ("1", "big", True), ("2", "any", True), ("2", "big", False), ("3", "any", True)]


def test_polygons(spark):
    rings = [("square", [(0, 0), (0, 1), (1, 1), (1, 0)]), ("back", [(0, 0), (1, 0), (1, 1), (0, 1)]), ("bow", [(0, 0), (1, 1), (1, 0), (0, 1)])]
    df = spark.createDataFrame([(n, k + 1, float(x), float(y)) for n, ps in rings for k, (x, y) in enumerate(ps)], "ring string, vtx int, x double, y double")
    bad = {(r.object, r.rule) for r in phase_rules.polygon_rules(df).collect() if not r.passed}
    assert bad == {("back", "polygon_clockwise"), ("bow", "polygon_simple"), ("bow", "polygon_clockwise")}


def test_cycles_and_deep_trees(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "z")]
    df = spark.createDataFrame(links, "parent string, child string")
    assert {r.id for r in annotation.labels_on_cycles(spark, df).collect()} == {"a", "b", "c"}
    assert annotation.labels_on_cycles(spark, df.limit(0)).count() == 0
