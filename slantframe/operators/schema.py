"""Label schemas and annotations: labels are rows (id, name, parent), annotations rows with structs and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import ensure_checkpoint_dir


class SchemaError(ValueError):
    """An edit that would break a schema."""


def add_label(labels: DataFrame, ident: str, name: str, parent: str | None = None) -> DataFrame:
    """labels with one more; its id must be new and its parent there (null: a root)."""
    if labels.where(F.col("id") == ident).limit(1).count():
        raise SchemaError(f"label {ident} exists")
    if parent is not None and not labels.where(F.col("id") == parent).limit(1).count():
        raise SchemaError(f"no label {parent}")
    row = labels.sparkSession.createDataFrame([(ident, name, parent)], "id string, name string, parent string")
    return labels.select("id", "name", "parent").unionByName(row)


def change_label(labels: DataFrame, ident: str, name: str, parent: str | None) -> DataFrame:
    """labels with another name and parent of one label, which may not go below itself."""
    if not labels.where(F.col("id") == ident).limit(1).count():
        raise SchemaError(f"no label {ident}")
    if parent is not None and subtree(labels, ident).where(F.col("id") == parent).limit(1).count():
        raise SchemaError(f"{parent} is {ident} or below it")
    own = F.col("id") == ident
    return labels.select("id", F.when(own, F.lit(name)).otherwise(F.col("name")).alias("name"), F.when(own, F.lit(parent)).otherwise(F.col("parent")).alias("parent"))


def subtree(labels: DataFrame, ident: str) -> DataFrame:
    """(id) of a label and all below it, level by level; cycles end where no new label is found."""
    ensure_checkpoint_dir(labels.sparkSession)
    found = new = labels.where(F.col("id") == ident).select("id").distinct().checkpoint()
    while not new.isEmpty():
        below = labels.join(new.withColumnRenamed("id", "parent"), "parent").select("id").distinct()
        new = below.join(found, "id", "left_anti").checkpoint()
        found = found.unionAll(new).checkpoint()
    return found


def delete_label(labels: DataFrame, ident: str, recursive: bool = False) -> DataFrame:
    """labels without one; with recursive, without all below it as well, else a label with others below it is an error."""
    if recursive:
        return labels.join(subtree(labels, ident), "id", "left_anti").select("id", "name", "parent")
    if labels.where(F.col("parent") == ident).limit(1).count():
        raise SchemaError(f"{ident} has labels below it")
    return labels.where(F.col("id") != ident).select("id", "name", "parent")


def with_validity(annotations: DataFrame, labels: DataFrame, confidences: Sequence[str], geometries: Sequence[str]) -> DataFrame:
    """annotations (label, confidence, geometry types in an array) and valid: all three are in the schema.

    Without confidences or geometries in the schema any is allowed; a null
    label or geometry isn't valid.
    """
    known = labels.select(F.col("id").alias("label"), F.lit(True).alias("known_")).distinct()
    met = annotations.join(known, "label", "left")
    sure = F.col("confidence").isin(list(confidences)) if confidences else F.lit(True)
    shaped = F.forall("geometry", lambda g: g.isin(list(geometries))) if geometries else F.col("geometry").isNotNull()
    valid = F.coalesce(F.col("known_"), F.lit(False)) & F.coalesce(sure, F.lit(False)) & F.coalesce(shaped, F.lit(False))
    return met.withColumn("valid", valid).drop("known_")


def add_geometry(geometries: Column, properties: Column, geometry: Column, property_: Column) -> tuple[Column, Column]:
    """Geometries and their properties, in step, with one more of each."""
    return F.array_append(geometries, geometry), F.array_append(properties, property_)


def remove_geometry(geometries: Column, properties: Column, ident: Column) -> tuple[Column, Column]:
    """Both without those whose properties have an id."""
    kept = F.filter(F.arrays_zip(geometries.alias("g"), properties.alias("p")), lambda x: ~x["p"]["id"].eqNullSafe(ident))
    return F.transform(kept, lambda x: x["g"]), F.transform(kept, lambda x: x["p"])


def padded_box(low: Column, high: Column, size: int, fraction: float = 0.05, least: float = 0.0) -> tuple[Column, Column]:
    """A chip's bounds around an object along one axis: padded by a share of its length, within the image."""
    pad = F.greatest((high - low) * fraction, F.lit(float(least)))
    return F.greatest(F.floor(low - pad), F.lit(0)).cast("int"), F.least(F.ceil(high + pad), F.lit(size)).cast("int")
