"""Label trees, label histories and radar cross-section statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import ensure_checkpoint_dir


def label_paths(spark, links: DataFrame) -> DataFrame:
    """(id, depth, path) of every label at or below a root, over (parent, child).

    A level is a join of the one above, checkpointed, until no label is found.
    A cycle below a root is an error; links without a parent or a child take no part.
    """
    ensure_checkpoint_dir(spark)
    links = links.select("parent", "child").where("parent is not null and child is not null")
    roots = links.select(F.col("parent").alias("id")).distinct().join(links.select(F.col("child").alias("id")), "id", "left_anti")
    level = roots.select("id", F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"), F.array("id").alias("above")).checkpoint()
    out = level
    while True:
        met = level.join(links, F.col("id") == F.col("parent"))
        level = met.select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), "child").alias("path"), F.array_append("above", F.col("child")).alias("above"), F.array_contains("above", F.col("child")).alias("again")).checkpoint()
        if level.isEmpty():
            return out.select("id", "depth", "path")
        if met_again := level.where("again").first():
            raise ValueError(f"a cycle of labels: {met_again.path}")
        level = level.drop("again")
        out = out.unionAll(level)


def labels_on_cycles(spark, links: DataFrame) -> DataFrame:
    """(id) of the labels that no order of parents before children can hold: those on a cycle or between two.

    Labels without a parent or without a child are peeled off, round by
    round, until none is left to peel; a round is two joins, checkpointed.
    """
    ensure_checkpoint_dir(spark)
    left = links.select("parent", "child").where("parent is not null and child is not null").distinct().checkpoint()
    count = left.count()
    while count:
        inner = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        inner = inner.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child").checkpoint()
        before, count, left = count, inner.count(), inner
        if count == before:
            break
    return left.select(F.col("parent").alias("id")).union(left.select("child")).distinct()


def inverted_forks(links: DataFrame) -> DataFrame:
    """Labels with more than one parent."""
    return links.groupBy("child").agg(F.countDistinct("parent").alias("parents")).where("parents > 1")


def latest_label(rows: DataFrame) -> DataFrame:
    """(feature, label, ts): the newest label of each feature; ties go to the larger label."""
    return rows.groupBy("feature").agg(F.max(F.struct("ts", "label")).alias("m")).select("feature", F.col("m.label").alias("label"), F.col("m.ts").alias("ts"))


def rcs_statistics(pixels: DataFrame, keys: list[str], power: str = "power") -> DataFrame:
    """n, mean, population deviation, least and largest power, and total in decibels.

    Finite powers only; sums of squares are merged from partial ones.
    """
    p = F.col(power)
    use = F.when(p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")), p)
    return pixels.groupBy(*keys).agg(F.count(use).alias("n"), F.avg(use).alias("mean"), F.stddev_pop(use).alias("std"), F.min(use).alias("low"), F.max(use).alias("high"), (10 * F.log10(F.nullif(F.sum(use), F.lit(0.0)))).alias("total_db"))


def partitions(images: DataFrame, equal: list[str]) -> DataFrame:
    """(image, part): images that agree in the given properties; a part is named by its least image."""
    least = images.groupBy(*equal).agg(F.min("image").alias("part"))
    return images.join(least, equal).select("image", "part")
