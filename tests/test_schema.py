import pytest

from slantframe.operators import schema


def test_edits_that_break_a_schema(spark):
    labels = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b")], "id string, name string, parent string")
    for edit in (lambda: schema.add_label(labels, "a", "x"), lambda: schema.add_label(labels, "d", "x", "zz"), lambda: schema.change_label(labels, "a", "A", "c"), lambda: schema.change_label(labels, "q", "Q", None), lambda: schema.delete_label(labels, "b")):
        with pytest.raises(schema.SchemaError):
            edit()
    assert {r.id for r in schema.delete_label(labels, "b", recursive=True).collect()} == {"a"}
    assert {r.id for r in schema.delete_label(labels, "c").collect()} == {"a", "b"}
    assert {r.id for r in schema.subtree(labels, "b").collect()} == {"b", "c"}
