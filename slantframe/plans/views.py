"""Views of the test tables in the shapes of radar data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantframe.functions.pixels import magnitude


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex pixels (image, r, c, re, im)."""
    t = table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_suppkey") % 4).cast("int").alias("image"), (F.col("l_orderkey") % 256).cast("int").alias("r"), F.col("l_linenumber").alias("c")]
    return t.groupBy(*keys).agg((F.max("l_quantity") - 25).alias("re"), (F.max("l_extendedprice") / 1000 - 50).alias("im"))


PX = """px as (select (l_suppkey % 4)::int as image, (l_orderkey % 256)::int as r, l_linenumber as c,
    max(l_quantity) - 25 as re, max(l_extendedprice) / 1000 - 50 as im from lineitem group by 1, 2, 3)"""


def amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).withColumn("amplitude", magnitude(F.col("re"), F.col("im")))


AMP = PX + ", amp as (select *, sqrt(re * re + im * im) as amplitude from px)"


def pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geodetic points (id, lat, lon, h)."""
    t = table(spark, sf_dir, "customer")
    wrap = lambda x, m: x - m * F.floor(x / m)
    lat = wrap(F.col("c_acctbal") * 7919, 180.0) - 90
    lon = wrap(F.col("c_custkey") * F.lit(37.17), 360.0) - 180
    return t.select(F.col("c_custkey").alias("id"), lat.alias("lat"), lon.alias("lon"), (F.col("c_nationkey") * 10).cast("double").alias("h"))


PT = """pt as (select c_custkey as id, c_acctbal * 7919 - 180.0::double * floor(c_acctbal * 7919 / 180.0::double) - 90 as lat,
    c_custkey * 37.17::double - 360.0::double * floor(c_custkey * 37.17::double / 360.0::double) - 180 as lon, (c_nationkey * 10)::double as h from customer)"""

ECF = PT + """, ecf as (select *, 6378137.0::double / sqrt(1 - 0.0066943799901413165::double * sin(radians(lat)) ** 2) as n from pt),
    xyz as (select *, (n + h) * cos(radians(lat)) * cos(radians(lon)) as x, (n + h) * cos(radians(lat)) * sin(radians(lon)) as y,
    (n * (1 - 0.0066943799901413165::double) + h) * sin(radians(lat)) as z from ecf)"""


def pvp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-vector parameters (channel, vector, TxTime, RcvTime, FX1, FX2, SIGNAL)."""
    from slantframe.operators.rules import numbered

    t = numbered(table(spark, sf_dir, "events"), "event_type", F.date_trunc("hour", "ts"), ["ts", "event_id"])
    n = F.col("n")
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.select(F.col("event_type").alias("channel"), n.alias("vector"), time.alias("TxTime"), (time + F.col("user_id") % 50 + 1).alias("RcvTime"), F.col("value").alias("FX1"), (F.col("value") + F.col("user_id") % 7).alias("FX2"), (F.col("event_id") % 3 != 0).cast("int").alias("SIGNAL"))


PVP = """pvp as (select event_type as channel, row_number() over (partition by event_type order by ts, event_id) as vector,
    epoch_us(ts) as TxTime, epoch_us(ts) + user_id % 50 + 1 as RcvTime, value as FX1, value + user_id % 7 as FX2, (event_id % 3 <> 0)::int as SIGNAL from events)"""


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation posts (ix, iy, elev); one post a cell of the grid."""
    t = table(spark, sf_dir, "part")
    return t.groupBy((F.col("p_partkey") % 40).cast("int").alias("ix"), (F.col("p_size") - 1).cast("int").alias("iy")).agg(F.max("p_retailprice").alias("elev"))


DEM = "dem as (select (p_partkey % 40)::int as ix, (p_size - 1)::int as iy, max(p_retailprice) as elev from part group by 1, 2)"


def tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label links (parent, child): regions, nations, and suppliers."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    a = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    b = s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"))
    return a.unionAll(b)


TAX = "tax as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier)"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of suppliers' balances for each nation with three suppliers or more, on a grid of quarters."""
    s = table(spark, sf_dir, "supplier")
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    out = s.select(F.col("s_nationkey").alias("ring"), F.row_number().over(w.orderBy("s_suppkey")).alias("vtx"), F.count("*").over(w).alias("n"), (F.round(F.col("s_acctbal") / 100) / 4).alias("x"), ((F.col("s_suppkey") * 37 % 101) / F.lit(4.0)).alias("y"))
    return out.where("n >= 3").drop("n")


RINGS = """rings as (select s_nationkey as ring, row_number() over (partition by s_nationkey order by s_suppkey) as vtx,
    round(s_acctbal / 100) / 4 as x, (s_suppkey * 37 % 101) / 4.0::double as y from supplier
    qualify count(*) over (partition by s_nationkey) >= 3),
  sides as (select ring, vtx, x as x0, y as y0, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1
    from rings window w as (partition by ring order by vtx)),
  edges as (select * from sides where x0 <> x1 or y0 <> y1)"""
