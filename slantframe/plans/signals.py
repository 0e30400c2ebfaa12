"""Queries of spectral filters and of image quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slantframe.functions import collection, quality
from slantframe.operators import filters
from slantframe.plans import views as v
from slantframe.plans.files import _lines
from slantframe.plans.registry import query, rounded

_GRID = f"""{v.PX}, g as (select a::int as image, b::int as r, c::int as c from range(0, 4) x(a), range(0, 256) y(b), range(0, 8) z(c)),
 z as (select image, r, c, coalesce(re::float::double, 0) as re, coalesce(im::float::double, 0) as im from g left join px using (image, r, c))"""


def _image(spark, sf):
    return _lines(spark, sf).select("image", "r", F.col("bands")[0].alias("re"), F.col("bands")[1].alias("im"))


def _samples(lines, digits, *names):
    out = lines.select("image", "r", F.posexplode(F.arrays_zip(*names)).alias("c", "z"))
    return out.select("image", "r", "c", *((F.round(f"z.{n}", digits) + 0).alias(n) for n in names))


@query(
    "q_retaper",
    f"""with {_GRID}, k as (select k::int as k, 0.54::double + 0.46::double * cos(2 * pi() * greatest(-0.5::double, least(0.5::double, (case when k >= 144 then k - 288 else k end) / 288.0::double / 0.8::double))) as w from range(0, 288) q(k)),
 s as (select image, c, k, w * sum(re * cos(2 * pi() * r * k / 288) + im * sin(2 * pi() * r * k / 288)) / 288 as re, w * sum(im * cos(2 * pi() * r * k / 288) - re * sin(2 * pi() * r * k / 288)) / 288 as im from z, k group by image, c, k, w)
 select image, n::int as r, c, round(sum(re * cos(2 * pi() * n * k / 288) - im * sin(2 * pi() * n * k / 288)), 4) + 0 as re, round(sum(im * cos(2 * pi() * n * k / 288) + re * sin(2 * pi() * n * k / 288)), 4) + 0 as im from s, range(0, 256) q(n) group by image, n, c""",
)
def q_retaper(spark, sf):
    """Four images with a Hamming taper along rows whose band fills four fifths of the spectrum; lines are padded to 288."""
    return _samples(filters.retaper(_image(spark, sf), 0, "hamming", fill=0.8), 4, "re", "im")


@query(
    "q_aperture_image",
    f"""with {_GRID}, s as (select image, c, k, sum(re * cos(2 * pi() * r * (k - 128) / 256) + im * sin(2 * pi() * r * (k - 128) / 256)) / 256 as re, sum(im * cos(2 * pi() * r * (k - 128) / 256) - re * sin(2 * pi() * r * (k - 128) / 256)) / 256 as im from z, range(64, 192) q(k) group by 1, 2, 3)
 select image, n::int as r, c, round(sum(re * cos(2 * pi() * n * (k - 128) / 256) - im * sin(2 * pi() * n * (k - 128) / 256)), 4) + 0 as re, round(sum(im * cos(2 * pi() * n * (k - 128) / 256) + re * sin(2 * pi() * n * (k - 128) / 256)), 4) + 0 as im from s, range(0, 256) q(n) group by image, n, c""",
)
def q_aperture_image(spark, sf):
    """Four images of half the bandwidth along rows."""
    return _samples(filters.aperture(_image(spark, sf), 0, 64, 192), 4, "re", "im")


@query(
    "q_colour_subaperture",
    f"""with {_GRID}, t as (select i, least(i, 64, 192 - i) / 64.0::double as w from range(1, 192) q(i)),
 f as (select b, (32 + 64 * (1 - b) + i - 1 + 256) % 256 as j, w from t, range(0, 3) q(b)),
 s as (select image, c, j, sum(re * cos(2 * pi() * r * (j - 128) / 256) - im * sin(2 * pi() * r * (j - 128) / 256)) / 256 as re, sum(im * cos(2 * pi() * r * (j - 128) / 256) + re * sin(2 * pi() * r * (j - 128) / 256)) / 256 as im from z, range(0, 256) q(j) group by 1, 2, 3),
 m as (select image, c, n as r, b, sqrt(sum(w * (re * cos(2 * pi() * n * (j - 128) / 256) + im * sin(2 * pi() * n * (j - 128) / 256))) ** 2 + sum(w * (im * cos(2 * pi() * n * (j - 128) / 256) - re * sin(2 * pi() * n * (j - 128) / 256))) ** 2) as a from s join f using (j), range(0, 256) q(n) group by 1, 2, 3, 4),
 p as (select image, r::int as r, c, max(case when b = 0 then a end) as x, max(case when b = 1 then a end) as y, max(case when b = 2 then a end) as u, max(a) as most from m group by 1, 2, 3)
 select image, r, c, case when most > 0 then round(u * sqrt(re * re + im * im) / most, 4) else 0 end as red, case when most > 0 then round(y * sqrt(re * re + im * im) / most, 4) else 0 end as green, case when most > 0 then round(x * sqrt(re * re + im * im) / most, 4) else 0 end as blue from p join z using (image, r, c)""",
)
def q_colour_subaperture(spark, sf):
    """Colours of four images by three parts of the aperture along rows; the platform goes right."""
    return _samples(filters.colours(_image(spark, sf), 0, "R"), 4, "red", "green", "blue")


def _radiometry(spark, sf):
    k = F.col("s_suppkey")
    one = lambda m, step, first: (k % m) * F.lit(step) + F.lit(first)
    return v.table(spark, sf, "supplier").select(
        k.alias("id"), one(23, 1.0, -34.0).alias("level"), F.when(k % 11 == 0, "RELATIVE").otherwise("ABSOLUTE").alias("kind"), one(5, 0.25, 1.0).alias("factor"),
        F.element_at(F.array(F.lit("V:V"), F.lit("V:H"), F.lit("UNKNOWN")), (k % 3 + 1).cast("int")).alias("pol"), one(7, 0.125, 0.25).alias("row_bw"), one(9, 0.125, 0.25).alias("col_bw"), one(13, 5.0, 0.0).alias("slope"), one(17, 0.0625, 0.0).alias("share"), (60 + k % 97).cast("int").alias("rows"), (40 + k % 83).cast("int").alias("cols"),
    )


_RADIOMETRY = """s as (select s_suppkey as id, (s_suppkey % 23) - 34e0 as level, case when s_suppkey % 11 = 0 then 'RELATIVE' else 'ABSOLUTE' end as kind, (s_suppkey % 5) * 0.25e0 + 1 as factor, (['V:V', 'V:H', 'UNKNOWN'])[s_suppkey % 3 + 1] as pol,
   (s_suppkey % 7) * 0.125e0 + 0.25e0 as row_bw, (s_suppkey % 9) * 0.125e0 + 0.25e0 as col_bw, (s_suppkey % 13) * 5e0 as slope, (s_suppkey % 17) * 0.0625e0 as share, 60 + s_suppkey % 97 as rows, 40 + s_suppkey % 83 as cols from supplier),
 n as (select *, case when kind = 'ABSOLUTE' then 10e0 ** (level / 10) * factor end as noise, case when pol = 'V:H' then 0.25e0 else 1e0 end as signal, abs(row_bw * col_bw * cos(radians(slope))) as area from s),
 d as (select *, area * log2(1 + signal / noise) as density from n)"""


@query("q_image_quality", f"with {_RADIOMETRY}, t as (select exp(1 - ln(2) * 3.4761e0 / 0.4357e0) as turn), r as (select d.*, turn, case when density > turn then 3.4761e0 + 0.4357e0 * log2(density) else density * 0.4357e0 / (turn * ln(2)) end as rating from d, t) select id, round(noise, 8) as noise, signal, round(area, 8) as area, round(density, 6) as density, round(rating, 6) as rating, round(density, 6) as back from r")
def q_image_quality(spark, sf):
    """Noise, signal, bandwidth area, information density and interpretability; the density comes back from the rating."""
    t = _radiometry(spark, sf).select("id", quality.sigma_zero_noise(F.col("level"), F.col("kind"), F.col("factor")).alias("noise"), quality.default_signal(F.col("pol")).alias("signal"), quality.bandwidth_area(F.col("row_bw"), F.col("col_bw"), F.col("slope")).alias("area"))
    t = t.withColumn("density", collection.information_density(F.col("area"), F.col("signal"), F.col("noise")))
    t = t.withColumn("rating", F.when(F.col("density").isNotNull(), collection.rniirs(F.col("density")))).withColumn("back", quality.density_for_rniirs(F.col("rating")))
    return rounded(rounded(t, 8, "noise", "area"), 6, "density", "rating", "back")


@query(
    "q_degradation",
    f"""with {_RADIOMETRY}, a as (select *, round_even(rows / greatest(1e0, 1 / (0.75e0 * row_bw)), 0) as a, round_even(cols / greatest(1e0, 1 / (0.75e0 * col_bw)), 0) as b, density * (0.35e0 + (id % 10) * 0.07e0) as wanted from d),
 i as (select *, greatest(a, b) as steps, unnest(range(0, greatest(a, b)::int)) as i from a),
 l as (select *, (a - ceil((a - 1) * i / (steps - 1))) / a as rl, (b - ceil((b - 1) * i / (steps - 1))) / b as cl from i),
 m as (select *, area * rl * cl * log2(1 + signal / noise) as own from l),
 best as (select id, min(struct_pack(m := round(abs(own / wanted - 1), 9), i := i)).i as best, arg_max(own, i) as last from m where noise is not null group by id),
 c as (select m.*, last from m join best using (id) where i = floor(best - share * best))
 select a.id, round(rl, 6) as row, round(cl, 6) as col, case when rl is not null then round(greatest(1e0, signal / noise / (2e0 ** (wanted / (area * rl * cl)) - 1)), 4) end as noise from (select id from a) a left join (select * from c where wanted <= density and wanted >= last and share between 0 and 1) c using (id)""",
)
def q_degradation(spark, sf):
    """How to reach a part of an image's information by less bandwidth and more noise, in different shares."""
    c = F.col
    t = _radiometry(spark, sf).withColumns({"noise": quality.sigma_zero_noise(c("level"), c("kind"), c("factor")), "signal": quality.default_signal(c("pol")), "area": quality.bandwidth_area(c("row_bw"), c("col_bw"), c("slope"))})
    t = t.withColumn("wanted", collection.information_density(c("area"), c("signal"), c("noise")) * (0.35 + (c("id") % 10) * F.lit(0.07)))
    over = lambda bw: quality.oversampling(F.lit(0.75), c(bw))
    t = t.withColumn("steps", quality.bandwidth_steps(c("rows"), over("row_bw"), c("cols"), over("col_bw")))
    d = quality.degradation(c("area"), c("signal"), c("noise"), c("steps"), c("wanted"), c("share"))
    return t.select("id", d.alias("d")).select("id", F.round("d.row", 6).alias("row"), F.round("d.col", 6).alias("col"), F.round("d.noise", 4).alias("noise"))


@query(
    "q_broadening",
    """with recursive a as (select s_suppkey as id, 0.4e0 + (s_suppkey % 61) / 100e0 as alpha from supplier),
 h as (select id, alpha, 0 as n, 0e0 as low, 1e0 as high from a union all
   select id, alpha, n + 1, case when y > alpha * sqrt(0.5e0) then mid else low end, case when y > alpha * sqrt(0.5e0) then high else mid end from
   (select *, (low + high) / 2 as mid, alpha * sin(pi() * mid) / (pi() * mid) + (1 - alpha) / 2 * (sin(pi() * (mid - 1)) / (pi() * (mid - 1)) + sin(pi() * (mid + 1)) / (pi() * (mid + 1))) as y from h where n < 50))
 select id, case when alpha between 0.5e0 and 1e0 then round(2 * low, 8) end as width from h where n = 50""",
)
def q_broadening(spark, sf):
    """Widths at half power of raised cosines."""
    alpha = F.lit(0.4) + (F.col("s_suppkey") % 61) / F.lit(100.0)
    return v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.round(quality.broadening(alpha), 8).alias("width"))
