"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import saved


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each named share): exact quantiles of value, between two values by their distance.

    Equal values are counted in the tasks first; the counts are dealt by
    ranges of (keys, value), and a count's place is its sum within the range
    on top of those of the ranges before, of which a key has one a range: no
    task holds a group's values.  Nulls and values that aren't finite take no
    part; a group without values has no row, and a null key is a group.
    """
    v = F.col(value).cast("double")
    counts = df.select(*keys, v.alias("v_")).where(F.col("v_").isNotNull() & ~F.isnan("v_") & (F.abs("v_") < float("inf"))).groupBy(*keys, "v_").agg(F.count("*").alias("n_"))
    dealt = saved(counts.repartitionByRange(*keys, "v_").withColumn("range_", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "range_").agg(F.sum("n_").alias("held_"))
    ordered = Window.partitionBy(*keys).orderBy("range_")
    before = sums.select(*(F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)), F.col("range_").alias("at_"), F.coalesce(F.sum("held_").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("held_").over(Window.partitionBy(*keys)).alias("all_"))
    met = F.col("range_") == F.col("at_")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"k{i}_"))
    own = Window.partitionBy("range_", *keys).orderBy("v_")
    placed = dealt.withColumn("upto_", F.sum("n_").over(own)).join(before, met)
    placed = placed.withColumns({"last_": F.col("before_") + F.col("upto_") - 1, "first_": F.col("before_") + F.col("upto_") - F.col("n_")})

    out = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("all_") - 1)
        holds = lambda x: (F.col("first_") <= x) & (F.col("last_") >= x)
        low, high = F.max(F.when(holds(F.floor(place)), F.col("v_"))), F.max(F.when(holds(F.ceil(place)), F.col("v_")))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*keys).agg(*out)
