"""Queries of the phase-history rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.operators import phase_rules as p
from slantframe.plans import views as v
from slantframe.plans.registry import query

# --- a phase-history table out of the events -------------------------------------------

_COLUMNS = {
    "channel": "event_type",
    "vector": "event_id",
    "TxTime": "event_id * {milli}",
    "RcvTime": "event_id * {milli} + (user_id % 50 + 1) * {tenth}",
    "FX1": "case when event_type = 'click' then {nine} else {nine} + (user_id % 7) * {mega} end",
    "FX2": "case when event_type = 'click' then {nine} else {nine} + (user_id % 7) * {mega} end + {band}",
    "FXN1": "case when event_type = 'click' then {nine} else {nine} + (user_id % 7) * {mega} end - {mega}",
    "FXN2": "case when event_type = 'click' then {nine} else {nine} + (user_id % 7) * {mega} end + {band} + {mega}",
    "TOA1": "-{micro}",
    "TOA2": "case when event_type = 'view' then {micro} else {micro} + (user_id % 3) * {centi} end",
    "SRPPos_x": "{earth}",
    "SRPPos_y": "case when event_type = 'signup' then (user_id % 5) * {one} else {zero} end",
    "SRPPos_z": "{zero}",
    "SCSS": "{spacing}",
    "TxPos_x": "{earth} + {orbit}",
    "TxPos_y": "{aside}",
    "TxPos_z": "event_id * {seven}",
    "TxVel_x": "{zero}",
    "TxVel_y": "{zero}",
    "TxVel_z": "{fast}",
    "RcvPos_x": "{earth} + {orbit}",
    "RcvPos_y": "{aside}",
    "RcvPos_z": "event_id * {seven} + {one}",
    "RcvVel_x": "{zero}",
    "RcvVel_y": "{zero}",
    "RcvVel_z": "{fast}",
    "SIGNAL": "case when event_type = 'purchase' or event_id % 3 <> 0 then 1 else 0 end",
}
_NUMBERS = {"milli": "1e-3", "tenth": "1e-4", "nine": "9e9", "mega": "1e6", "band": "6e8", "micro": "1e-6", "centi": "1e-8", "earth": "6378137e0", "one": "1e0", "zero": "0e0", "spacing": "4e5", "orbit": "5e5", "aside": "3e5", "seven": "7e0", "fast": "7e3"}
_LIGHT = "299792458e0"
_RATES = {
    "aFDOP": f"case when event_type = 'error' and user_id = 13 then 1e-6 else 0e0 end - (TxVel_z * (TxPos_z - SRPPos_z) / sqrt((TxPos_x - SRPPos_x) * (TxPos_x - SRPPos_x) + (TxPos_y - SRPPos_y) * (TxPos_y - SRPPos_y) + (TxPos_z - SRPPos_z) * (TxPos_z - SRPPos_z)) + RcvVel_z * (RcvPos_z - SRPPos_z) / sqrt((RcvPos_x - SRPPos_x) * (RcvPos_x - SRPPos_x) + (RcvPos_y - SRPPos_y) * (RcvPos_y - SRPPos_y) + (RcvPos_z - SRPPos_z) * (RcvPos_z - SRPPos_z))) / {_LIGHT}",
    "aFRR2": f"2 / ({_LIGHT} * case when event_type = 'view' then 2e12 else 1e12 end)",
    "aFRR1": f"(FX1 + FX2) / ({_LIGHT} * case when event_type = 'view' then 2e12 else 1e12 end) * case when event_type = 'signup' then 1.01e0 else 1e0 end",
}
_ALL = {k: e.format(**_NUMBERS) for k, e in _COLUMNS.items()}
_SELECT = ", ".join(f"{e} as {k}" for k, e in _ALL.items())
_MORE = ", ".join(f"{e} as {k}" for k, e in _RATES.items())
CPHD = f"base as (select *, {_SELECT} from events), cphd as (select *, {_MORE} from base)"

#: What the file declares of each channel and of itself; some of it is wrong on purpose.
_DECLARED = (
    "select channel, 'file' as file, channel in ('click', 'error') as FXFixed, channel in ('view', 'signup') as TOAFixed, channel <> 'error' as SRPFixed,"
    " case when channel = 'click' then 9.3e9 else 9.303e9 end as FxC, case when channel = 'click' then 6e8 else 6.06e8 end as FxBW, case when channel = 'view' then 6.08e8 when channel = 'error' then 7e8 end as FxBWNoise,"
    " case when channel = 'view' then 2e-6 else 2.02e-6 end as TOASaved, case when channel = 'purchase' then 2.2e-6 end as TOAExtSaved, 'FX' as domain,"
    " channel = 'purchase' as SignalNormal, case when channel = 'view' then 2e12 else 1e12 end as tx_lfm, case when channel = 'error' then null else 9e11 end as rcv_lfm, 1e-4 as pulse_length, case when channel = 'click' then 1e6 else 2e8 end as sample_rate,"
    " 0e0 as TxTime1, 5e0 as TxTime2, 9e9 as FxMin, 9.606e9 as FxMax, -1e-6 as TOAMin, 1.01e-6 as TOAMax from "
)
_FILE = "select 'file' as file, false as FXFixedCPHD, false as TOAFixedCPHD, true as SRPFixedCPHD, 0e0 as TxTime1, 5e0 as TxTime2, 9e9 as FxMin, 9.606e9 as FxMax, -1e-6 as TOAMin, 1.02e-6 as TOAMax"


def _selected(df: DataFrame, text: str) -> DataFrame:
    return df.selectExpr("*", *(x.strip() for x in text.split(", ") if x.strip()))


def _cphd(spark, sf) -> DataFrame:
    base = v.table(spark, sf, "events").selectExpr("*", *(f"{e} as {k}" for k, e in _ALL.items()))
    return base.selectExpr("*", *(f"{e} as {k}" for k, e in _RATES.items())).drop("event_id", "ts", "user_id", "event_type", "value", "props")


def _declared(spark, sf) -> DataFrame:
    channels = v.table(spark, sf, "events").select(F.col("event_type").alias("channel")).distinct()
    return spark.sql(_DECLARED + "{channels}", channels=channels)


def _sums(spark, sf) -> DataFrame:
    met = p.channel_sums(_cphd(spark, sf)).join(_declared(spark, sf), "channel")
    return met.withColumn("LFMRate", F.array("tx_lfm"))


_RANGED = ("TxTime", "FX1", "FX2", "FXN1", "FXN2", "TOA1", "TOA2", "SRPPos_x", "SRPPos_y", "SRPPos_z")
_SUMS = (
    f"{CPHD}, sums as (select channel, count(*) as n, "
    + ", ".join(f"min({c}) as {c}_low, max({c}) as {c}_high, avg({c}) as {c}_mean" for c in _RANGED)
    + ", min(1 / (SCSS * (TOA2 - TOA1))) as osr_fx, min(RcvTime - TxTime) as least_delay, sum(SIGNAL) as signal_ones,"
    + f" max(abs(aFDOP + (TxVel_z * (TxPos_z - SRPPos_z) / sqrt((TxPos_x - SRPPos_x) ** 2 + (TxPos_y - SRPPos_y) ** 2 + (TxPos_z - SRPPos_z) ** 2) + RcvVel_z * (RcvPos_z - SRPPos_z) / sqrt((RcvPos_x - SRPPos_x) ** 2 + (RcvPos_y - SRPPos_y) ** 2 + (RcvPos_z - SRPPos_z) ** 2)) / {_LIGHT}) - 1e-6 * abs(aFDOP)) as doppler_off,"
    + " max(abs(aFRR1 / ((FX1 + FX2) / 2 * aFRR2) - 1)) as rate_off,"
    + f" max((FX1 + FX2) / ({_LIGHT} * aFRR1)) as lfm1, max(2 / ({_LIGHT} * aFRR2)) as lfm2"
    + f" from cphd group by channel), met as (select * from sums join ({_DECLARED} (select distinct event_type as channel from events)) using (channel))"
)


def _close(x: str, y: str, absolute: str = "1e-10") -> str:
    return f"(abs(({x}) - ({y})) <= {absolute} + 1e-6 * abs({y}))"


def _results(source: str, key: str, rows: list[tuple]) -> str:
    """SQL of the results of rules (name, passed, detail, when, severity), the last two optional."""
    out = []
    for name, passed, detail, *more in rows:
        when, severity = (*more, *("true", "error")[len(more) :])
        out.append(f"select {key}::varchar as object, '{name}' as rule, '{severity}' as severity, coalesce({passed}, false) as passed, ({detail})::double as detail from {source} where {when}")
    return " union all ".join(out)


def _fixed_sql(flag: str, names: list[str], absolute: str = "1e-10") -> list[tuple]:
    still = {n: f"({_close(n + '_low', n + '_mean', absolute)} and {_close(n + '_high', n + '_mean', absolute)})" for n in names}
    same = "(" + " and ".join(f"{n}_low = {n}_high" for n in names) + ")"
    spread = "greatest(" + ", ".join(f"{n}_high - {n}_low" for n in names) + ", 0)"
    return [
        *((f"{n}_does_not_change", still[n], f"{n}_high - {n}_low", flag) for n in names),
        (f"{flag}_not_constant", f"not {same}", spread, f"not {flag}"),
        (f"{flag}_not_almost_constant", "not (" + " and ".join(still.values()) + ")", spread, f"not {flag} and not {same}", "warning"),
    ]


_SRP = ["SRPPos_x", "SRPPos_y", "SRPPos_z"]


@query("q_rules_fixed", f"with {_SUMS} " + _results("met", "channel", _fixed_sql("FXFixed", ["FX1", "FX2"]) + _fixed_sql("TOAFixed", ["TOA1", "TOA2"], "1e-11") + _fixed_sql("SRPFixed", _SRP, "1e-3")))
def q_rules_fixed(spark, sf):
    """Channels whose bands, swaths and reference places are declared as fixed, or not."""
    rules = p.fixed_rules("FXFixed", ("FX1", "FX2")) + p.fixed_rules("TOAFixed", ("TOA1", "TOA2"), 1e-11) + p.fixed_rules("SRPFixed", _SRP, 1e-3)
    return p.evaluate(_sums(spark, sf), "channel", rules)


@query(
    "q_rules_band",
    f"with {_SUMS} "
    + _results(
        "met",
        "channel",
        [
            ("fxc", _close("(FX2_high + FX1_low) / 2", "FxC"), "(FX2_high + FX1_low) / 2"),
            ("fxbw", _close("FX2_high - FX1_low", "FxBW"), "FX2_high - FX1_low"),
            ("fxbwnoise_domain", "domain = 'FX'", "null", "FxBWNoise is not null"),
            ("fxbwnoise", _close("FXN2_high - FXN1_low", "FxBWNoise"), "FXN2_high - FXN1_low", "FxBWNoise is not null"),
            ("toasaved", _close("TOA2_high - TOA1_low", "TOASaved"), "TOA2_high - TOA1_low"),
            ("toaextsaved", _close("TOA2_high - TOA1_low + 1e-7", "TOAExtSaved"), "TOA2_high + 1e-7 - TOA1_low", "TOAExtSaved is not null"),
        ],
    ),
)
def q_rules_band(spark, sf):
    """Declared centres, widths and swaths; the extended swath is the saved one with a tenth of a microsecond more."""
    sums = _sums(spark, sf).withColumns({"TOAE1_low": F.col("TOA1_low"), "TOAE2_high": F.col("TOA2_high") + 1e-7})
    return p.evaluate(sums, "channel", p.band_rules())


@query("q_rules_sampling", f"with {_SUMS} " + _results("met", "channel", [("osr_fx_1.1", "osr_fx >= 1.1::double", "osr_fx", "domain = 'FX'"), ("osr_fx_1.2", "osr_fx >= 1.2::double", "osr_fx", "domain = 'FX'", "warning")]))
def q_rules_sampling(spark, sf):
    return p.evaluate(_sums(spark, sf), "channel", p.sampling_rules())


_LIMITS = [("txtime1", "TxTime_low", ">=", "TxTime1"), ("txtime2", "TxTime_high", "<=", "TxTime2"), ("fxmin", "FX1_low", ">=", "FxMin"), ("fxmax", "FX2_high", "<=", "FxMax"), ("toamin", "TOA1_low", ">=", "TOAMin"), ("toamax", "TOA2_high", "<=", "TOAMax")]


@query("q_rules_limits", f"with {_SUMS} " + _results("met", "channel", [(n, f"({x} {op} {y} or {_close(x, y)})", x) for n, x, op, y in _LIMITS]))
def q_rules_limits(spark, sf):
    """Channels against the file's limits of time, frequency and delay."""
    return p.evaluate(_sums(spark, sf), "channel", p.limit_rules())


def _known(x: str) -> str:
    return f"abs({x} - tx_lfm) <= 1e-8 + 1e-5 * abs(tx_lfm)"


@query(
    "q_rules_rates",
    f"with {_SUMS}, r as ("
    + _results("met", "channel", [("afdop", "doppler_off <= 1e-9", "doppler_off", "true", "warning"), ("afrr1_afrr2_relative", "rate_off <= 1e-6", "rate_off", "true", "warning"), ("afrr1", _known("lfm1"), "round(lfm1, -3)", "true", "warning"), ("afrr2", _known("lfm2"), "round(lfm2, -3)", "true", "warning")])
    + ") select object, rule, severity, passed, round(detail, 9) + 0 as detail from r",
)
def q_rules_rates(spark, sf):
    """Doppler and range-rate parameters against places, velocities and chirp rates."""
    out = p.evaluate(_sums(spark, sf), "channel", p.rate_rules())
    return out.withColumn("detail", F.round(F.when(F.abs("detail") > 1e6, F.round("detail", -3)).otherwise(F.col("detail")), 9) + 0)


_NEEDED = "abs(tx_lfm - rcv_lfm) * pulse_length + abs(coalesce(TOAExtSaved, TOASaved) * rcv_lfm)"


@query(
    "q_rules_receive",
    f"with {_SUMS} "
    + _results(
        "met",
        "channel",
        [
            ("rcv_finite", "true", "0"),
            ("rcv_after_tx", "least_delay > 0", "least_delay"),
            ("signal_normal", "(signal_ones = n) = SignalNormal", "signal_ones"),
            ("normal_signal_half", "signal_ones * 2 >= n", "signal_ones"),
            ("rcv_sample_rate", f"({_NEEDED} <= sample_rate or {_close(_NEEDED, 'sample_rate')})", _NEEDED, "rcv_lfm is not null"),
        ],
    ),
)
def q_rules_receive(spark, sf):
    return p.evaluate(_sums(spark, sf), "channel", p.receive_rules())


_FILE_SUMS = (
    _SUMS
    + ", f as (select 'file' as file, "
    + ", ".join(f"min({c}_low) as {c}_low, max({c}_high) as {c}_high, sum({c}_mean * n) / sum(n) as {c}_mean" for c in _RANGED)
    + ", "
    + ", ".join(f"min({c}) as {c}_low, max({c}) as {c}_high, avg({c}) as {c}_mean" for c in ("FxC", "FxBW"))
    + ", bool_and(FXFixed) as all_FXFixed, bool_and(TOAFixed) as all_TOAFixed, bool_and(SRPFixed) as all_SRPFixed from met), g as (select * from f join ("
    + _FILE
    + ") using (file))"
)


@query(
    "q_rules_file",
    f"with {_FILE_SUMS} "
    + _results(
        "g",
        "file",
        [
            ("all_SRPFixed", "all_SRPFixed", "null", "SRPFixedCPHD"),
            ("channels_differ", "not (FxC_low = FxC_high and FxBW_low = FxBW_high)", "null", "not FXFixedCPHD and all_FXFixed"),
            *_fixed_sql("FXFixedCPHD", ["FX1", "FX2"]),
            *_fixed_sql("TOAFixedCPHD", ["TOA1", "TOA2"], "1e-11"),
            *_fixed_sql("SRPFixedCPHD", _SRP, "1e-3"),
            *((f"global_{n}", _close(x, y), x) for n, x, _, y in _LIMITS),
        ],
    ),
)
def q_rules_file(spark, sf):
    """What the file declares of all its channels together."""
    sums = p.file_sums(p.channel_sums(_cphd(spark, sf)), _declared(spark, sf))
    return p.evaluate(sums.join(spark.sql(_FILE), "file"), "file", p.file_rules())


_AREAS = "select s_suppkey as area, (s_suppkey % 40 - 25)::double as low_x, -10e0 as low_y, (s_suppkey % 17)::double as high_x, (s_suppkey % 13)::double as high_y, -20e0 as outer_low_x, -10e0 as outer_low_y, 12e0 as outer_high_x, 10e0 as outer_high_y from supplier"


@query(
    "q_rules_area",
    f"with a as ({_AREAS}) "
    + _results(
        "a",
        "area",
        [
            ("area_corners", "low_x < high_x and low_y < high_y", "null"),
            ("area_low_bounded", f"(low_x >= outer_low_x or {_close('low_x', 'outer_low_x')}) and (low_y >= outer_low_y or {_close('low_y', 'outer_low_y')})", "null"),
            ("area_high_bounded", f"(high_x <= outer_high_x or {_close('high_x', 'outer_high_x')}) and (high_y <= outer_high_y or {_close('high_y', 'outer_high_y')})", "null"),
        ],
    ),
)
def q_rules_area(spark, sf):
    """Image areas of channels within the scene's."""
    s = F.col("s_suppkey")
    number = lambda x: x.cast("double")
    fixed = {"outer_low_x": -20.0, "outer_low_y": -10.0, "outer_high_x": 12.0, "outer_high_y": 10.0, "low_y": -10.0}
    df = v.table(spark, sf, "supplier").select(s.alias("area"), number(s % 40 - 25).alias("low_x"), number(s % 17).alias("high_x"), number(s % 13).alias("high_y"), *(F.lit(x).alias(k) for k, x in fixed.items()))
    return p.evaluate(df, "area", p.area_rules("low", "high", "outer_low", "outer_high"))


@query(
    "q_rules_axes",
    "with a as (select n_nationkey as scene, cos(n_nationkey * 0.1::double) as ix, sin(n_nationkey * 0.1::double) as iy, -sin(n_nationkey * 0.1::double) * (1 + (n_nationkey % 5 = 4)::int * 0.01::double) as jx, cos(n_nationkey * 0.1::double) + (n_nationkey % 7 = 6)::int * 0.001::double as jy from nation), r as ("
    + _results("a", "scene", [("iax_unit", _close("sqrt(ix*ix + iy*iy)", "1e0"), "sqrt(ix*ix + iy*iy)"), ("iay_unit", _close("sqrt(jx*jx + jy*jy)", "1e0"), "sqrt(jx*jx + jy*jy)"), ("axes_orthogonal", "abs(ix*jx + iy*jy) <= 1e-6", "ix*jx + iy*jy")])
    + ") select object, rule, severity, passed, round(detail, 9) + 0 as detail from r",
)
def q_rules_axes(spark, sf):
    """Axes of scene planes, some of them bent."""
    n = F.col("n_nationkey")
    t = n * F.lit(0.1)
    df = v.table(spark, sf, "nation").select(
        n.alias("scene"), F.cos(t).alias("iax_x"), F.sin(t).alias("iax_y"), F.lit(0.0).alias("iax_z"),
        (-F.sin(t) * (1 + (n % 5 == 4).cast("int") * F.lit(0.01))).alias("iay_x"), (F.cos(t) + (n % 7 == 6).cast("int") * F.lit(0.001)).alias("iay_y"), F.lit(0.0).alias("iay_z"),
    )
    return p.evaluate(df, "scene", p.axis_rules()).withColumn("detail", F.round("detail", 9) + 0)


@query(
    "q_rules_optional",
    "with a as (select s_suppkey as file, if(s_suppkey % 4 = 0, 'TOA', 'FX') as domain, s_suppkey % 3 = 0 as n1, s_suppkey % 3 = 0 or s_suppkey % 10 = 1 as n2, s_suppkey % 5 = 0 as e1, s_suppkey % 5 = 0 as e2, s_suppkey % 2 = 0 as grid, s_suppkey % 6 = 0 as ant, s_suppkey % 12 = 0 as cant, s_suppkey % 7 = 0 as txr from supplier) "
    + _results("a", "file", [("optional_fxn", "not (n1 or n2) or (domain = 'FX' and n1 and n2)", "null"), ("optional_toae", "e1 = e2", "null"), ("image_grid", "grid", "null", "true", "warning"), ("antenna_in_channel", "cant", "null", "ant", "warning"), ("txrcv_in_channel", "true", "null", "txr", "warning")]),
)
def q_rules_optional(spark, sf):
    s = F.col("s_suppkey")
    flags = {"has_FXN1": s % 3 == 0, "has_FXN2": (s % 3 == 0) | (s % 10 == 1), "has_TOAE1": s % 5 == 0, "has_TOAE2": s % 5 == 0, "has_ImageGrid": s % 2 == 0, "has_Antenna": s % 6 == 0, "channel_Antenna": s % 12 == 0, "has_TxRcv": s % 7 == 0, "channel_TxRcv": s % 7 == 0}
    df = v.table(spark, sf, "supplier").select(s.alias("file"), F.when(s % 4 == 0, "TOA").otherwise("FX").alias("domain"), *(x.alias(k) for k, x in flags.items()))
    return p.evaluate(df, "file", p.optional_rules())


@query(
    "q_rules_polygon",
    f"with {v.RINGS}, c as (select ring, count(*) as n, count(distinct vtx) as different, min(vtx) as first, max(vtx) as last, min(x) as x_low, min(y) as y_low, max(x) as x_high, max(y) as y_high from rings group by ring),"
    " a as (select ring, sum(x0*y1 - x1*y0) as area2 from edges group by ring),"
    " q as (select a.ring, a.x0 as ax, a.y0 as ay, a.x1 as bx, a.y1 as b_y, b.x0 as cx, b.y0 as cy, b.x1 as dx, b.y1 as dy from edges a join edges b on a.ring = b.ring and a.vtx < b.vtx),"
    " s as (select ring, sign((bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax)) * sign((bx-ax)*(dy-ay)-(b_y-ay)*(dx-ax)) as u, sign((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx)) * sign((dx-cx)*(b_y-cy)-(dy-cy)*(bx-cx)) as t from q),"
    " k as (select ring, count(*) as crossings from s where u < 0 and t <= 0 or u <= 0 and t < 0 group by ring),"
    " m as (select c.*, coalesce(area2, 0) as area2, coalesce(crossings, 0) as crossings from c left join a using (ring) left join k using (ring)) "
    + _results("m", "ring", [("polygon_indices", "first = 1 and last = n and different = n", "n"), ("polygon_simple", "crossings = 0", "crossings"), ("polygon_clockwise", "area2 < 0", "area2"), ("polygon_x1y1", "true", "null"), ("polygon_x2y2", "false", "null")]),
)
def q_rules_polygon(spark, sf):
    """Polygons of nations, against boxes whose far corner is off."""
    rings = v.rings(spark, sf)
    boxes = rings.groupBy("ring").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), (F.max("y") + 1).alias("y2"))
    return p.polygon_rules(rings, boxes)


_FILES = "select s_suppkey as file, 400 as xml_offset, 5000 + s_suppkey as xml_size, if(s_suppkey % 3 = 0, null, 6000 + s_suppkey) as support_offset, if(s_suppkey % 3 = 0, null, 800) as support_size, 7000 + s_suppkey - (s_suppkey % 11 = 0)::int * 500 as pvp_offset, 2000 as pvp_size, 9000 + s_suppkey as signal_offset, s_suppkey * 100 as signal_size, 9000 + s_suppkey * 101 + (s_suppkey % 13 = 0)::int as file_size from supplier"


@query(
    "q_rules_layout",
    f"with f as ({_FILES}) "
    + _results(
        "f",
        "file",
        [
            ("xml_early", "xml_offset < 268435456", "xml_offset", "true", "warning"),
            ("after_xml", "coalesce(support_offset, pvp_offset) - xml_offset - xml_size >= 2", "coalesce(support_offset, pvp_offset) - xml_offset - xml_size"),
            ("pvp_after_support", "pvp_offset >= support_offset + support_size", "pvp_offset - support_offset - support_size", "support_offset is not null"),
            ("signal_after_pvp", "signal_offset >= pvp_offset + pvp_size", "signal_offset - pvp_offset - pvp_size"),
            ("signal_at_end", "file_size = signal_offset + signal_size", "file_size - signal_offset - signal_size"),
        ],
    ),
)
def q_rules_layout(spark, sf):
    """Block offsets of files, some of which overlap or don't end with the signal."""
    s = F.col("s_suppkey")
    own = F.when(s % 3 != 0, 6000 + s)
    df = v.table(spark, sf, "supplier").select(
        s.alias("file"), F.lit(400).alias("xml_offset"), (5000 + s).alias("xml_size"), own.alias("support_offset"), F.when(s % 3 != 0, 800).alias("support_size"),
        (7000 + s - (s % 11 == 0).cast("int") * 500).alias("pvp_offset"), F.lit(2000).alias("pvp_size"), (9000 + s).alias("signal_offset"), (s * 100).alias("signal_size"), (9000 + s * 101 + (s % 13 == 0).cast("int")).alias("file_size"),
    )
    return p.evaluate(df, "file", p.layout_rules())


@query(
    "q_rules_polynomials",
    "with c as (select l_suppkey % 200 as poly, 3 as order1, 7 as order2, l_linenumber % 4 + (l_partkey % 97 = 0)::int as e1, l_partkey % 8 as e2 from lineitem), k as (select poly, e1, e2, count(*) as n from c group by 1, 2, 3), s as (select poly, sum((e1 > 3 or e2 > 7)::int) as over_, sum((n > 1)::int) as twice from k group by 1) "
    + _results("s", "poly", [("polynomial_orders", "over_ = 0", "over_"), ("polynomial_exponents", "twice = 0", "twice")]),
)
def q_rules_polynomials(spark, sf):
    c = F.col
    df = v.table(spark, sf, "lineitem").select((c("l_suppkey") % 200).alias("poly"), F.lit(3).alias("order1"), F.lit(7).alias("order2"), (c("l_linenumber") % 4 + (c("l_partkey") % 97 == 0).cast("int")).alias("exponent1"), (c("l_partkey") % 8).alias("exponent2"))
    return p.polynomial_rules(df)
