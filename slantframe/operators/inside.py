"""Which points lie inside which rings: cells of both axes, with the parity of crossings carried along a row of cells.

A point is inside if a line from it to the right crosses a ring's sides an odd
number of times.  The line bends: from the point straight up or down to the
middle of its row of cells, and from there to the right.  Only sides in the
point's own cell can cross the first part.  What crosses the second part beyond
the cell is the same for all points of a cell, so it is worked out once for a
ring and row, as spans of cells, and a point finds the spans it lies in by
blocks of 1, 16, 256 and more cells.  So a point meets the sides of one cell
and the spans that hold it, wherever the rings' other sides lie.

Equal points are worked out once.  So are equal sides of a ring: an even number
of them crosses nothing, but points on them are still on the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slantframe.operators.checkpoints import partitions
from slantframe.operators.crossings import ENDS, _cells
from slantframe.operators.planar import edges

#: Cells of a block of the next level, and levels; at the last one a span is as many blocks as it takes.
FAN, LEVELS = 16, 6


def _blocks(first: Column, last: Column) -> Column:
    """An array of (level, block) that cover cells first to last once: a few loose ones at either end of each level."""
    loose = lambda level, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(level.alias("level"), x.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

    def step(s: Column, level: Column) -> Column:
        # Parents from up to before down are whole.
        up, down = F.ceil(s["a"] / FAN), F.floor((s["b"] + 1) / FAN)
        end = (up >= down) | (level == LEVELS - 1)
        both = F.concat(loose(level, s["a"], F.when(end, s["b"]).otherwise(up * FAN - 1)), loose(level, F.when(end, s["b"] + 1).otherwise(down * FAN), s["b"]))
        return F.struct(F.when(end, F.lit(1).cast("bigint")).otherwise(up).alias("a"), F.when(end, F.lit(0).cast("bigint")).otherwise(down - 1).alias("b"), F.concat(s["out"], both).alias("out"))

    start = F.struct(first.cast("bigint").alias("a"), last.cast("bigint").alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, lambda s, k: F.when(s["a"] > s["b"], s).otherwise(step(s, k)))["out"]


def _side(y: Column) -> Column:
    """On which side of a side (x, y) lies; of points on its line, where one a little above and less to the right lies."""
    c = F.col
    across, up = c("x1") - c("x0"), c("y1") - c("y0")
    cross = across * (y - c("y0")) - (c("x") - c("x0")) * up
    return F.when(cross != 0, cross).when(across != 0, across).otherwise(-up) > 0


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float, ring: str = "ring") -> DataFrame:
    """(pt_id, ring) of the points inside a ring or on it.

    points (pt_id, x, y), rings (ring, vtx, x, y).  Cells about as large as a
    side are best: smaller ones have more spans, larger ones more sides in a
    cell.  Points and sides with a null or infinite coordinate take no part.
    """
    finite = lambda *names: [F.abs(n) < float("inf") for n in names]
    every = lambda conditions: F.expr("true") if not conditions else conditions[0] & every(conditions[1:])
    size = F.lit(float(cell))
    sides = edges(rings, ring).where(every(finite(*ENDS))).select(F.col(ring).alias("ring_"), *(F.col(e).cast("double").alias(e) for e in ENDS))
    sides = sides.groupBy("ring_", *ENDS).agg((F.count("*") % 2).cast("int").alias("odd_"))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = sides.withColumn("cy_", F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))).withColumn("mid_", (F.col("cy_") + 0.5) * size)
    spans_mid = (F.col("y0") <= F.col("mid_")) != (F.col("y1") <= F.col("mid_"))
    at = F.col("x0") + (F.col("mid_") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))
    rows = rows.withColumn("home_", F.when(spans_mid, F.floor(at / size)))

    # Cells with an odd number of crossings to their right: from each first crossing of a pair up to before the second.
    w = Window.partitionBy("ring_", "cy_").orderBy("home_")
    pairs = rows.where("home_ is not null and odd_ = 1").select("ring_", "cy_", "home_", F.row_number().over(w).alias("k_"), F.lead("home_").over(w).alias("next_"))
    spans = pairs.where("k_ % 2 = 1 and home_ < next_").select("ring_", "cy_", F.inline(_blocks(F.col("home_"), F.col("next_") - 1)))
    own = points.where(every(finite("x", "y"))).select("pt_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # Few rows may mean many pairs, so they aren't gathered in fewer tasks.
    placed = own.select("x", "y").distinct().withColumns({"cx_": F.floor(F.col("x") / size), "cy_": F.floor(F.col("y") / size)}).repartition(partitions(points), "cx_", "cy_")
    up = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("cx_") / F.pow(F.lit(float(FAN)), k)).alias("block")))
    beyond = placed.select("x", "y", "cy_", F.inline(up)).join(spans, ["cy_", "level", "block"]).select("x", "y", "ring_", F.lit(1).alias("n_"), F.lit(False).alias("edge_"))

    dealt = rows.withColumn("cx_", F.explode(F.sequence(*_cells(size, F.col("cy_")))))
    met = placed.join(dealt, ["cx_", "cy_"])
    x, y = F.col("x"), F.col("y")
    here, there = _side(y), _side(F.col("mid_"))
    upright = (((F.col("x0") <= x) != (F.col("x1") <= x)) & (here != there)).cast("int")
    right = (F.col("home_").isNotNull() & (there == (F.col("y1") > F.col("y0")))).cast("int")
    counted = F.coalesce((F.col("home_") > F.col("cx_")).cast("int"), F.lit(0))
    cross = (F.col("x1") - F.col("x0")) * (y - F.col("y0")) - (x - F.col("x0")) * (F.col("y1") - F.col("y0"))
    on = (cross == 0) & x.between(F.least("x0", "x1"), F.greatest("x0", "x1")) & y.between(low, high)
    near = met.select("x", "y", "ring_", (F.col("odd_") * (upright + right - counted)).alias("n_"), on.alias("edge_"))

    hits = beyond.unionAll(near).groupBy("x", "y", "ring_").agg(F.sum("n_").alias("n_"), F.max("edge_").alias("edge_"))
    hits = hits.where((F.pmod(F.col("n_"), F.lit(2)) == 1) | F.col("edge_"))
    return own.join(hits, ["x", "y"]).select("pt_id", F.col("ring_").alias(ring))


def points_in_polygon(points: DataFrame, outer: DataFrame, holes: DataFrame, cell: float) -> DataFrame:
    """(pt_id, ring) of the points in an outer ring and in none of its holes (rings of the same name)."""
    out = points_in_rings(points, holes.withColumn("ring", F.struct("ring", "hole")), cell).select("pt_id", F.col("ring.ring").alias("ring"))
    return points_in_rings(points, outer, cell).join(out.distinct(), ["pt_id", "ring"], "left_anti")
