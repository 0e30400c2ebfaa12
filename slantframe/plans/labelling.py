"""Queries of label schemas and annotations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slantframe.operators import schema
from slantframe.plans import views as v
from slantframe.plans.registry import query

_LABELS = "labels as (select 'r' || r_regionkey as id, r_name as name, null as parent from region union all select 'n' || n_nationkey, n_name, 'r' || n_regionkey from nation union all select 's' || s_suppkey, s_name, 'n' || s_nationkey from supplier)"


def _labels(spark, sf):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = v.table(spark, sf, "region").select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    n = v.table(spark, sf, "nation").select(key("n", "n_nationkey"), "n_name", key("r", "n_regionkey"))
    s = v.table(spark, sf, "supplier").select(key("s", "s_suppkey"), "s_name", key("n", "s_nationkey"))
    return r.unionAll(n).unionAll(s)


@query("q_label_delete", f"with {_LABELS}, gone as (select id from labels where id = 'r2' or parent = 'r2' or parent in (select id from labels where parent = 'r2')) select id, name, parent from labels where id not in (select id from gone)")
def q_label_delete(spark, sf):
    """A schema without a region and all below it."""
    return schema.delete_label(_labels(spark, sf), "r2", recursive=True)


@query("q_label_edit", f"with {_LABELS} select id, case when id = 'n3' then 'moved' else name end as name, case when id = 'n3' then 'r4' else parent end as parent from labels union all select 'new', 'a new one', 'n3'")
def q_label_edit(spark, sf):
    """A schema with a label that is renamed and moved, and one more below it."""
    return schema.add_label(schema.change_label(_labels(spark, sf), "n3", "moved", "r4"), "new", "a new one", "n3")


@query("q_label_valid", "select event_id as id, event_type in ('view', 'click', 'error') and user_id % 4 in (1, 2) and event_id % 3 in (0, 1) as valid from events")
def q_label_valid(spark, sf):
    """Annotations whose label, confidence and geometries are in the schema."""
    names = spark.createDataFrame([("view",), ("click",), ("error",)], "id string")
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c + 1).cast("int"))
    a = v.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), pick(("low", "medium", "high", "none"), F.col("user_id") % 4).alias("confidence"), F.array(F.lit("Point"), pick(("Point", "Polygon", "Circle"), F.col("event_id") % 3)).alias("geometry"))
    return schema.with_validity(a, names, ("medium", "high"), ("Point", "Polygon")).select("id", "valid")


@query("q_annotation_geometry", "select o_orderkey as id, (3 - (o_orderkey % 4 in (0, 1, 2))::int + 1)::int as n, list_filter(['g0', 'g1', 'g2', 'g9'], lambda g: g <> 'g' || (o_orderkey % 4)) as geometries from orders")
def q_annotation_geometry(spark, sf):
    """Features with a geometry taken out and one put in, their properties in step."""
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    names = ("g0", "g1", "g2")
    shapes, facts = F.array(*map(F.lit, names)), F.array(*[F.struct(F.lit(k).cast("long").alias("id"), F.lit(f"p{k}").alias("note")) for k in range(3)])
    o = o.withColumns({"shapes": shapes, "facts": facts})
    kept, facts = schema.remove_geometry(F.col("shapes"), F.col("facts"), F.col("id") % 4)
    o = o.select("id", kept.alias("shapes"), facts.alias("facts"))
    shapes, facts = schema.add_geometry(F.col("shapes"), F.col("facts"), F.lit("g9"), F.struct(F.lit(9).cast("long").alias("id"), F.lit("p9").alias("note")))
    return o.select("id", F.size(facts).alias("n"), shapes.alias("geometries"))


@query("q_chip_boxes", "with b as (select o_orderkey as id, (o_orderkey % 500)::double as low, (o_orderkey % 500 + o_custkey % 200)::double as high from orders) select id, greatest(floor(low - greatest((high - low) * 0.05::double, 4)), 0)::int as first, least(ceil(high + greatest((high - low) * 0.05::double, 4)), 600)::int as last from b")
def q_chip_boxes(spark, sf):
    """Chips around objects, padded, within their image."""
    o = v.table(spark, sf, "orders")
    low, high = (F.col("o_orderkey") % 500).cast("double"), (F.col("o_orderkey") % 500 + F.col("o_custkey") % 200).cast("double")
    first, last = schema.padded_box(low, high, 600, least=4)
    return o.select(F.col("o_orderkey").alias("id"), first.alias("first"), last.alias("last"))
