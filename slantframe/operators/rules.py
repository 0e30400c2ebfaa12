"""Consistency rules over phase-history tables: (object, rule, severity, passed, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ("object", "rule", "severity", "passed", "detail")


def _result(df: DataFrame, key: str, rule: str, passed: Column, detail: Column, severity: str = "error") -> DataFrame:
    return df.select(F.col(key).cast("string").alias("object"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("double").alias("detail"))


#: Places in a channel's order that are sorted together.
SPAN = 1 << 16


def with_previous(df: DataFrame, values: list[str], key: str, order: str, span: int = SPAN) -> DataFrame:
    """df with prev_<value>: the values of the row before in the order (a whole number) of its key; null in the first.

    Spans of the order are sorted by themselves, and each takes the row before
    its first from the last rows of the spans, of which a key has one for
    ``span`` places: a key that holds most rows isn't one task's.
    """
    mark = F.floor(F.col(order) / span)
    own = Window.partitionBy(key, "span_").orderBy(order)
    df = df.withColumn("span_", mark)
    ends = df.groupBy(key, "span_").agg(F.max_by(F.struct(*values), order).alias("last_"))
    before = ends.select(key, "span_", F.lag("last_").over(Window.partitionBy(key).orderBy("span_")).alias("before_"))
    inner = df.withColumns({"row_": F.row_number().over(own), **{f"prev_{v}": F.lag(v).over(own) for v in values}})
    met = inner.join(before, [key, "span_"], "left")
    out = met.withColumns({f"prev_{v}": F.when(F.col("row_") == 1, F.col("before_")[v]).otherwise(F.col(f"prev_{v}")) for v in values})
    return out.drop("span_", "row_", "before_")


def numbered(df: DataFrame, key: str, span: Column, order: list[str], name: str = "n") -> DataFrame:
    """df with each row's number from 1 on in the order of its key; span is a Column that grows with the order.

    Rows are numbered within a span, and spans by running sums of their
    counts.  Rows without a key are numbered within their span only.
    """
    df = df.withColumn("span_", span)
    counts = df.groupBy(key, "span_").agg(F.count("*").alias("c_"))
    before = Window.partitionBy(key).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "span_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("offset_"))
    inner = df.withColumn("row_", F.row_number().over(Window.partitionBy(key, "span_").orderBy(*order)))
    return inner.join(offsets, [key, "span_"], "left").withColumn(name, (F.col("row_") + F.coalesce("offset_", F.lit(0))).cast("int")).drop("span_", "row_", "offset_")


def time_monotonic(pvp: DataFrame, time: str = "TxTime", key: str = "channel", order: str = "vector") -> DataFrame:
    """Times grow from vector to vector; detail is the least step.  Missing times are passed over."""
    known = pvp.where(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")))
    steps = with_previous(known, [time], key, order).withColumn("step", F.col(time) - F.col(f"prev_{time}"))
    return _result(steps.groupBy(key).agg(F.min("step").alias("least")), key, "time_monotonic", F.coalesce(F.col("least") > 0, F.lit(True)), F.col("least"))


def receive_after_transmit(pvp: DataFrame, key: str = "channel") -> DataFrame:
    return _result(pvp.groupBy(key).agg(F.min(F.col("RcvTime") - F.col("TxTime")).alias("least")), key, "receive_after_transmit", F.col("least") > 0, F.col("least"))


def finite(pvp: DataFrame, columns: list[str], key: str = "channel") -> DataFrame:
    """No value of the columns is missing or non-finite; detail counts the rows that have one."""
    bad = F.lit(False)
    for c in columns:
        v = F.col(c).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return _result(pvp.groupBy(key).agg(F.sum(bad.cast("int")).alias("n")), key, "finite", F.col("n") == 0, F.col("n"))


def fixed(pvp: DataFrame, declared: DataFrame, columns: list[str], flag: str, key: str = "channel") -> DataFrame:
    """The declared flag says whether every column is constant; detail is the largest spread."""
    spread = F.greatest(*[F.max(c) - F.min(c) for c in columns], F.lit(0.0))
    met = pvp.groupBy(key).agg(spread.alias("spread")).join(declared.select(key, F.col(flag).alias("flag")), key)
    return _result(met, key, f"fixed_{flag}", (F.col("spread") == 0) == F.col("flag"), F.col("spread"))


def band(pvp: DataFrame, declared: DataFrame, key: str = "channel", tolerance: float = 1e-6) -> DataFrame:
    """The declared centre (FxC) and width (FxBW) are those of the vectors; two rows a channel."""
    sums = pvp.groupBy(key).agg(F.min("FX1").alias("low"), F.max("FX2").alias("high")).join(declared.select(key, "FxC", "FxBW"), key)
    close = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1.0))
    centre, width = (F.col("low") + F.col("high")) / 2, F.col("high") - F.col("low")
    return _result(sums, key, "fxc", close(centre, F.col("FxC")), centre).unionAll(_result(sums, key, "fxbw", close(width, F.col("FxBW")), width))


def sampling(pvp: DataFrame, key: str = "channel", least: float = 1.1, warn: float = 1.2) -> DataFrame:
    """Samples cover the band: 1 / (spacing x swath) is at least ``least``; below ``warn`` it is a warning."""
    rate = 1 / F.nullif(F.max(F.col("SCSS") * (F.col("TOA2") - F.col("TOA1"))), F.lit(0.0))
    out = pvp.groupBy(key).agg(rate.alias("rate"))
    return _result(out, key, "fx_oversampling", F.col("rate") >= warn, F.col("rate")).withColumn("severity", F.when(F.col("detail") >= least, "warning").otherwise("error"))


def within(pvp: DataFrame, limits: DataFrame, column: str, low: str, high: str, key: str = "channel") -> DataFrame:
    """No value lies outside global limits (one row, else an error); detail counts those that do."""
    found = limits.select(low, high).take(2)
    if len(found) != 1:
        raise ValueError(f"{'several' if found else 'no'} rows of limits")
    out = pvp.groupBy(key).agg(F.sum((~F.col(column).between(F.lit(found[0][0]), F.lit(found[0][1]))).cast("int")).alias("n"))
    return _result(out, key, f"within_{column}", F.col("n") == 0, F.col("n"))


def normal_signal(pvp: DataFrame, key: str = "channel") -> DataFrame:
    """At least half of the vectors are flagged as normal; detail is the share."""
    return _result(pvp.groupBy(key).agg(F.avg((F.col("SIGNAL") == 1).cast("double")).alias("share")), key, "normal_signal", F.col("share") >= 0.5, F.col("share"))


def unique_ids(nodes: DataFrame, path: str = "path", ident: str = "id") -> DataFrame:
    """Identifiers that occur more than once under one path; no rows if all is well."""
    return nodes.groupBy(path, ident).agg(F.count("*").alias("n")).where("n > 1")


def dangling(references: DataFrame, nodes: DataFrame, ident: str = "id") -> DataFrame:
    """References to identifiers that no node has."""
    return references.join(nodes.select(ident).distinct(), ident, "left_anti")


def unreachable(nodes: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (id) that no chain of links (parent, child) ties to a root (id).

    Breadth first: a round is a join of the newly found nodes, and found nodes
    are checkpointed so that plans stay small; it ends when a round finds
    none, however deep the links go.
    """
    found = roots.select("id").distinct().checkpoint()
    new = found
    while True:
        new = links.join(new.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id")).distinct().join(found, "id", "left_anti").checkpoint()
        if new.isEmpty():
            return nodes.select("id").distinct().join(found, "id", "left_anti")
        found = found.unionAll(new).checkpoint()


def gaps(ipp: DataFrame, key: str = "channel") -> DataFrame:
    """Sets of pulses (index, t_start, t_end, p_start, p_end) that don't follow on the one before: the gap in time and pulses."""
    met = with_previous(ipp, ["t_end", "p_end"], key, "index")
    out = met.withColumn("gap_time", F.col("t_start") - F.col("prev_t_end")).withColumn("gap_pulses", F.col("p_start") - F.col("prev_p_end") - 1)
    return out.where("gap_time <> 0 or gap_pulses <> 0").select(key, "index", "gap_time", "gap_pulses")
