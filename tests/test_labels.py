import pytest

from slantframe.operators import annotation


def test_label_paths_have_no_deepest_level(spark):
    links = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(36)], "parent string, child string").coalesce(1)
    got = {r.id: (r.depth, r.path) for r in annotation.label_paths(spark, links).collect()}
    assert got == {f"a{i}": (i, "/".join(f"a{k}" for k in range(i + 1))) for i in range(37)}


def test_label_paths_report_cycles(spark):
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "parent string, child string")
    links = links.unionAll(spark.createDataFrame([("q", "r")], "parent string, child string"))
    with pytest.raises(ValueError, match="cycle"):
        annotation.label_paths(spark, links)
