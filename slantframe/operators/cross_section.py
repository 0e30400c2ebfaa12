"""Radar cross sections of areas: polygons become spans of pixels in a line, and lines of pixels meet the spans of their own line.

An area is a table of vertices (image, feature, part, ring, vtx, x, y) in
pixels, x along rows.  A part is a polygon with all its rings; what is inside an
odd number of them is inside, so holes need no mark.  A feature may have
several parts, whose pixels all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slantframe.functions.polynomials import poly2d

PART = ("image", "feature", "part")
#: Units and the polynomials that scale a pixel's power to them.
UNITS = {"RCS": "rcs_sf", "BetaZero": "beta_sf", "SigmaZero": "sigma_sf", "GammaZero": "gamma_sf"}
#: What a crossing may be off by (pixels).
SLACK = 1e-9


def spans(areas: DataFrame) -> DataFrame:
    """(image, feature, part, r, low, high): pixels inside parts or on their sides, spans of a line that don't touch each other.

    Vertices with a null or without end take no part.
    """
    c = F.col
    own = areas.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select(*PART, "ring", "vtx", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    w = Window.partitionBy(*PART, "ring").orderBy("vtx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = own.select(*PART, c("x").alias("x0"), c("y").alias("y0"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x1"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y1"))
    top, bottom = F.least("x0", "x1"), F.greatest("x0", "x1")
    first, last = F.ceil(top), F.ceil(bottom) - 1
    # A side crosses the lines from its upper end on, its lower end not among them.
    crossed = sides.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    crossed = crossed.select(*PART, "r", (c("y0") + (c("r") - c("x0")) * (c("y1") - c("y0")) / (c("x1") - c("x0"))).alias("at"))
    line = Window.partitionBy(*PART, "r").orderBy("at")
    paired = crossed.withColumns({"k": F.row_number().over(line), "to": F.lead("at").over(line)}).where("k % 2 = 1")
    inside = paired.select(*PART, "r", c("at").alias("a"), c("to").alias("b"))
    # Ends of sides, and sides that lie in a line, may be no part of a pair.
    ends = sides.where(F.floor("x0") == c("x0")).select(*PART, F.floor("x0").alias("r"), F.when(c("x0") == c("x1"), F.least("y0", "y1")).otherwise(c("y0")).alias("a"), F.when(c("x0") == c("x1"), F.greatest("y0", "y1")).otherwise(c("y0")).alias("b"))
    pixels = inside.unionAll(ends).select(*PART, "r", F.ceil(c("a") - SLACK).alias("low"), F.floor(c("b") + SLACK).alias("high")).where("low <= high")
    order = Window.partitionBy(*PART, "r").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = pixels.withColumn("new", F.when(c("low") > F.coalesce(reach, c("low") - 1), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*PART, "r", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def cross_sections(pixels: DataFrame, areas: DataFrame, images: DataFrame) -> DataFrame:
    """(image, feature, unit, n, total, mean, std, low, high, noise_total, noise_mean, noise_std, noise_low, noise_high) of the pixels of each feature.

    pixels are (image, r, c, re, im).  images (image, scp_row, scp_col,
    first_row, first_col, row_ss, col_ss, row_oversample, col_oversample,
    rcs_sf, beta_sf, sigma_sf, gamma_sf, noise_db; one row each, as from
    derivation.derive) say what a pixel's power means: units whose polynomial
    is null are left out, PixelPower is always there.  noise_db is the
    polynomial of an absolute noise level in decibels; without it noise is
    null.  The total of RCS is over the oversampling.  A feature without
    pixels has no row; a pixel without one of its parts doesn't count.
    """
    c = F.col
    x = (c("r") + F.coalesce(c("first_row"), F.lit(0.0)) - c("scp_row")) * c("row_ss")
    y = (c("c") + F.coalesce(c("first_col"), F.lit(0.0)) - c("scp_col")) * c("col_ss")
    power: Column = c("re") * c("re") + c("im") * c("im")
    spanned = spans(areas).withColumnsRenamed({"image": "image_", "r": "r_"})
    met = pixels.select("image", "r", "c", power.alias("power")).where("power is not null").join(spanned, (c("image") == c("image_")) & (c("r") == c("r_")) & c("c").between(c("low"), c("high"))).drop("image_", "r_", "low", "high")
    met = met.join(images, "image").withColumn("noise", F.pow(F.lit(10.0), poly2d(c("noise_db"), x, y) / 10))
    entry = lambda unit, scale: F.struct(F.lit(unit).alias("unit"), scale.cast("double").alias("scale"))
    each = met.select("image", "feature", "power", "noise", (c("row_oversample") * c("col_oversample")).alias("over"), F.inline(F.array(entry("PixelPower", F.lit(1.0)), *(entry(u, poly2d(c(p), x, y)) for u, p in UNITS.items()))))
    each = each.where("scale is not null").withColumns({"value": c("power") * c("scale"), "noise": c("noise") * c("scale")})
    over = F.when(c("unit") == "RCS", F.nullif(F.max("over"), F.lit(0.0))).otherwise(F.lit(1.0))

    def figures(name: str, prefix: str) -> list[Column]:
        return [(F.sum(name) / over).alias(f"{prefix}total"), F.avg(name).alias(f"{prefix}mean"), F.stddev_pop(name).alias(f"{prefix}std"), F.min(name).alias(f"{prefix}low"), F.max(name).alias(f"{prefix}high")]

    return each.groupBy("image", "feature", "unit").agg(F.count("*").alias("n"), *figures("value", ""), *figures("noise", "noise_"))
