"""Where sides of lines and rings cross: sides meet in cells of both axes, and crowded cells are quartered.

A side goes to the cells that it passes, not to those of its box, so a long
slanted side takes about as many cells as it is long.  Cells that hold more
than ``crowd`` sides are cut into four, again and again, so pairs that are
looked at stay about linear in the sides where sides don't all lie in one spot.
Equal sides are one class: they are parallel, don't cross each other, and cross
the same others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import partitions, saved
from slantframe.operators.planar import segments_cross

ENDS = ("x0", "y0", "x1", "y1")


def _cells(cell: Column, rows: Column, low: Column | None = None, high: Column | None = None) -> tuple[Column, Column]:
    """(first, last) column of cells that a side passes within a row of cells; a little more, for rounding."""
    c = F.col
    down = c("y1") - c("y0")
    at = lambda y: c("x0") + (y - c("y0")) * (c("x1") - c("x0")) / F.nullif(down, F.lit(0.0))
    bounded = lambda x: F.greatest(F.least(x, F.greatest("x0", "x1")), F.least("x0", "x1"))
    a, b = bounded(F.coalesce(at(rows * cell), c("x0"))), bounded(F.coalesce(at((rows + 1) * cell), c("x1")))
    slack = (F.abs("x0") + F.abs("x1") + F.abs("y0") + F.abs("y1")) * 1e-12 + cell * 1e-9
    first, last = F.floor((F.least(a, b) - slack) / cell), F.floor((F.greatest(a, b) + slack) / cell)
    return (first if low is None else F.greatest(first, low)), (last if high is None else F.least(last, high))


def crossings(sides: DataFrame, group: str = "ring", vtx: str = "vtx", cell: float | None = None, crowd: int = 256, levels: int = 12) -> DataFrame:
    """(group, a, b, pairs): sides of a group that meet in an inner point of one of them at least, a < b.

    sides (group, vtx, x0, y0, x1, y1) as from planar.edges.  A side stands
    for those equal to it, by its least vtx; pairs is how many pairs of sides
    that makes.  cell is the size of cells, or the mean size of sides.  At the
    last of the levels crowded cells are worked through whole, so nothing is
    lost.  Sides with a null or an infinite end take no part.
    """
    finite = reduce(lambda p, q: p & q, [F.abs(c) < F.lit(float("inf")) for c in ENDS])
    swap = (F.col("x0") > F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") > F.col("y1")))
    turned = sides.where(finite).select(group, vtx, *(F.when(swap, F.col(b)).otherwise(F.col(a)).cast("double").alias(a) for a, b in zip(ENDS, ("x1", "y1", "x0", "y0"))))
    classes = saved(turned.groupBy(group, *ENDS).agg(F.min(vtx).alias("id_"), F.count("*").alias("n_")))
    if cell is None:
        cell = classes.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).first()[0] or 1.0
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    size = F.lit(float(cell))
    tall = classes.withColumn("cy_", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    dealt = tall.withColumn("cx_", F.explode(F.sequence(*_cells(size, F.col("cy_")))))
    keys = [group, "cx_", "cy_"]
    found = []
    for level in range(levels + 1):
        dealt = saved(dealt)
        full = dealt.groupBy(*keys).agg(F.count("*").alias("in_")).where(F.col("in_") > crowd).drop("in_")
        last = level == levels or full.isEmpty()
        full = full if last else saved(full)
        found.append(_met(dealt if last else dealt.join(full, keys, "left_anti"), keys, group))
        if last:
            break
        half = F.lit(float(cell) / 2 ** (level + 1))
        inside = dealt.join(full, keys).withColumn("px_", F.col("cx_") * 2)
        rows = F.sequence(F.greatest(F.floor(low / half), F.col("cy_") * 2), F.least(F.floor(high / half), F.col("cy_") * 2 + 1))
        inside = inside.where((F.floor(low / half) <= F.col("cy_") * 2 + 1) & (F.floor(high / half) >= F.col("cy_") * 2)).withColumn("cy_", F.explode(rows))
        first, end = _cells(half, F.col("cy_"), F.col("px_"), F.col("px_") + 1)
        dealt = inside.withColumns({"from_": first, "to_": end}).where("from_ <= to_").withColumn("cx_", F.explode(F.sequence("from_", "to_"))).drop("from_", "to_", "px_")
    return reduce(DataFrame.unionAll, found).distinct()


def _met(dealt: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Pairs that cross within cells; a pair that shares several cells comes several times.

    Sides are few against their pairs, so they aren't gathered in fewer tasks.
    """
    a = dealt.repartition(partitions(dealt), *keys).select(*keys, F.col("id_").alias("a"), F.col("n_").alias("na_"), *(F.col(c).alias(f"a{c}") for c in ENDS))
    b = dealt.select(*keys, F.col("id_").alias("b"), F.col("n_").alias("nb_"), *(F.col(c).alias(f"b{c}") for c in ENDS))
    cross = segments_cross(*(F.col(f"{s}{c}") for s in "ab" for c in ENDS))
    return a.join(b, keys).where((F.col("a") < F.col("b")) & cross).select(group, "a", "b", (F.col("na_") * F.col("nb_")).alias("pairs"))
