"""Phase-history rules as rows: one aggregation a channel feeds all of them.

A rule is a condition over the columns of one row (a channel's sums beside its
declared parameters, a file's, or an area's), with a severity and a condition
under which it applies at all.  ``evaluate`` turns each row into the results
(object, rule, severity, passed, detail) of the rules that apply to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.functions.vectors import Vec

SPEED_OF_LIGHT = 299792458.0


def approx(x: Column, y: Column | float, absolute: float = 1e-10, relative: float = 1e-6) -> Column:
    """x is as good as y."""
    y = y if isinstance(y, Column) else F.lit(y)
    return F.abs(x - y) <= absolute + relative * F.abs(y)


def at_least(x: Column, y: Column) -> Column:
    return (x >= y) | approx(x, y)


def at_most(x: Column, y: Column) -> Column:
    return (x <= y) | approx(x, y)


@dataclass(frozen=True)
class Rule:
    """passed is null where nothing can be said, which counts as failed; detail is a number that explains it."""

    name: str
    passed: Column
    detail: Column = field(default_factory=lambda: F.lit(None))
    when: Column = field(default_factory=lambda: F.lit(True))
    severity: str = "error"


def evaluate(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(object, rule, severity, passed, detail) of every row of df and every rule that applies to it."""
    row = lambda r: F.when(r.when, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.coalesce(r.passed, F.lit(False)).alias("passed"), r.detail.cast("double").alias("detail")))
    found = F.filter(F.array(*map(row, rules)), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("object"), F.inline(found))


#: Vector parameters whose least, largest and mean value rules look at, where a table has them.
RANGED = ("TxTime", "RcvTime", "FX1", "FX2", "FXN1", "FXN2", "TOA1", "TOA2", "TOAE1", "TOAE2", "SRPPos_x", "SRPPos_y", "SRPPos_z")


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def channel_sums(pvp: DataFrame, key: str = "channel", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row a channel with everything that the rules need of its vectors; partial sums come before the shuffle.

    <name>_low, _high, _mean over finite values of RANGED; n; and, where their
    columns are there: bad (vectors with a missing or non-finite time or
    place), least_delay, osr_fx, osr_toa, doppler_off, doppler_any, rate_off,
    signal_ones.
    """
    have = set(pvp.columns)
    c = F.col
    use = lambda x: F.when(_finite(x), x.cast("double"))
    out = {"n": F.count("*")}
    for name in RANGED:
        if name in have:
            v = use(c(name))
            out |= {f"{name}_low": F.min(v), f"{name}_high": F.max(v), f"{name}_mean": F.avg(v)}
    places = [x for x in ("RcvPos_x", "RcvPos_y", "RcvPos_z", "RcvTime") if x in have]
    bad = F.lit(False)
    for x in places:
        bad = bad | ~_finite(c(x))
    out["bad"] = F.sum(bad.cast("long"))
    if {"TxTime", "RcvTime"} <= have:
        out["least_delay"] = F.min(use(c("RcvTime") - c("TxTime")))
    if {"SCSS", "TOA1", "TOA2"} <= have:
        swath = c("TOAE2") - c("TOAE1") if {"TOAE1", "TOAE2"} <= have else c("TOA2") - c("TOA1")
        out["osr_fx"] = F.min(use(1 / F.nullif(c("SCSS") * swath, F.lit(0.0))))
        out["osr_toa"] = F.min(use(1 / F.nullif(c("SCSS") * (c("FX2") - c("FX1")), F.lit(0.0))))
    if "aFDOP" in have:
        srp = Vec.of("SRPPos")
        rate = lambda p: Vec.of(f"{p}Vel").dot((Vec.of(f"{p}Pos") - srp).unit())
        expected = (rate("Tx") + rate("Rcv")) * (-1 / SPEED_OF_LIGHT)
        off = F.abs(expected - c("aFDOP")) - 1e-6 * F.abs(c("aFDOP"))
        out |= {"doppler_off": F.max(use(off)), "doppler_any": F.sum((use(c("aFDOP")) != 0).cast("long"))}
    if {"aFRR1", "aFRR2"} <= have:
        centre = (c("FX1") + c("FX2")) / 2
        out["rate_off"] = F.max(use(F.abs(c("aFRR1") / F.nullif(centre * c("aFRR2"), F.lit(0.0)) - 1)))
        out["lfm1_low"], out["lfm1_high"] = (f(use(centre * 2 / F.nullif(SPEED_OF_LIGHT * c("aFRR1"), F.lit(0.0)))) for f in (F.min, F.max))
        out["lfm2_low"], out["lfm2_high"] = (f(use(2 / F.nullif(SPEED_OF_LIGHT * c("aFRR2"), F.lit(0.0)))) for f in (F.min, F.max))
    if "SIGNAL" in have:
        out["signal_ones"] = F.sum((c("SIGNAL") == 1).cast("long"))
    out |= extra or {}
    return pvp.groupBy(key).agg(*(v.alias(k) for k, v in out.items()))


def _low(x: str) -> Column:
    return F.col(f"{x}_low")


def _high(x: str) -> Column:
    return F.col(f"{x}_high")


def _still(x: str, absolute: float = 1e-10) -> Column:
    """A parameter's least and largest value are as good as its mean."""
    mean = F.col(f"{x}_mean")
    return approx(_low(x), mean, absolute) & approx(_high(x), mean, absolute)


def fixed_rules(flag: str, names: Sequence[str], absolute: float = 1e-10, prefix: str = "") -> list[Rule]:
    """Parameters are constant if the flag (a boolean column) says so, and change if it doesn't."""
    on, off = F.col(flag), ~F.col(flag)
    spread = F.greatest(*[_high(n) - _low(n) for n in names], F.lit(0.0))
    same, close = F.lit(True), F.lit(True)
    for n in names:
        same, close = same & (_low(n) == _high(n)), close & _still(n, absolute)
    return [
        *(Rule(f"{prefix}{n}_does_not_change", _still(n, absolute), _high(n) - _low(n), on) for n in names),
        Rule(f"{prefix}{flag}_not_constant", ~same, spread, off),
        Rule(f"{prefix}{flag}_not_almost_constant", ~close, spread, off & ~same, "warning"),
    ]


def band_rules() -> list[Rule]:
    """Declared centre, widths and swaths (FxC, FxBW, FxBWNoise, TOASaved, TOAExtSaved, domain) are those of the vectors."""
    c = F.col
    centre, width, noise = (_high("FX2") + _low("FX1")) / 2, _high("FX2") - _low("FX1"), _high("FXN2") - _low("FXN1")
    saved, extended = _high("TOA2") - _low("TOA1"), _high("TOAE2") - _low("TOAE1")
    return [
        Rule("fxc", approx(centre, c("FxC")), centre),
        Rule("fxbw", approx(width, c("FxBW")), width),
        Rule("fxbwnoise_domain", c("domain") == "FX", when=c("FxBWNoise").isNotNull()),
        Rule("fxbwnoise", approx(noise, c("FxBWNoise")), noise, c("FxBWNoise").isNotNull()),
        Rule("toasaved", approx(saved, c("TOASaved")), saved),
        Rule("toaextsaved", approx(extended, c("TOAExtSaved")), extended, c("TOAExtSaved").isNotNull()),
    ]


def sampling_rules() -> list[Rule]:
    """Vectors of the file's domain are sampled 1.1 times (else an error) or 1.2 times (else a warning) as densely as they must be."""
    out = []
    for domain, column in (("FX", "osr_fx"), ("TOA", "osr_toa")):
        for least, severity in ((1.1, "error"), (1.2, "warning")):
            out.append(Rule(f"{column}_{least}", F.col(column) >= least, F.col(column), F.col("domain") == domain, severity))
    return out


def limit_rules() -> list[Rule]:
    """Vectors stay within the file's limits of time, frequency and delay."""
    c = F.col
    return [
        Rule("txtime1", at_least(_low("TxTime"), c("TxTime1")), _low("TxTime")),
        Rule("txtime2", at_most(_high("TxTime"), c("TxTime2")), _high("TxTime")),
        Rule("fxmin", at_least(_low("FX1"), c("FxMin")), _low("FX1")),
        Rule("fxmax", at_most(_high("FX2"), c("FxMax")), _high("FX2")),
        Rule("toamin", at_least(_low("TOA1"), c("TOAMin")), _low("TOA1")),
        Rule("toamax", at_most(_high("TOA2"), c("TOAMax")), _high("TOA2")),
    ]


def rate_rules() -> list[Rule]:
    """Doppler and range-rate parameters agree with places, velocities and the declared chirp rates (LFMRate, an array)."""
    c = F.col
    known = lambda x: F.exists(c("LFMRate"), lambda r: F.abs(x - r) <= 1e-8 + 1e-5 * F.abs(r))
    return [
        Rule("afdop", c("doppler_off") <= 1e-9, c("doppler_off"), (c("doppler_any") > 0) & c("doppler_off").isNotNull(), "warning"),
        Rule("afrr1_afrr2_relative", c("rate_off") <= 1e-6, c("rate_off"), c("rate_off").isNotNull(), "warning"),
        Rule("afrr1", known(c("lfm1_low")) & known(c("lfm1_high")), c("lfm1_high"), (F.size("LFMRate") > 0) & c("lfm1_low").isNotNull(), "warning"),
        Rule("afrr2", known(c("lfm2_low")) & known(c("lfm2_high")), c("lfm2_high"), (F.size("LFMRate") > 0) & c("lfm2_low").isNotNull(), "warning"),
    ]


def receive_rules() -> list[Rule]:
    """Times and places of reception are finite and later than transmission; flagged signals are as declared; the sample rate is enough for the swath."""
    c = F.col
    band = F.abs(c("tx_lfm") - c("rcv_lfm")) * c("pulse_length") + F.abs(F.coalesce("TOAExtSaved", "TOASaved") * c("rcv_lfm"))
    return [
        Rule("rcv_finite", c("bad") == 0, c("bad")),
        Rule("rcv_after_tx", c("least_delay") > 0, c("least_delay")),
        Rule("signal_normal", (c("signal_ones") == c("n")) == c("SignalNormal"), c("signal_ones"), c("SignalNormal").isNotNull()),
        Rule("normal_signal_half", c("signal_ones") * 2 >= c("n"), c("signal_ones")),
        Rule("rcv_sample_rate", at_most(band, c("sample_rate")), band, _finite(c("tx_lfm")) & _finite(c("rcv_lfm"))),
    ]


def file_sums(sums: DataFrame, declared: DataFrame, key: str = "channel") -> DataFrame:
    """One row a file out of its channels' sums and declared parameters (FXFixed, TOAFixed, SRPFixed, FxC, FxBW)."""
    met = sums.join(declared, key)
    out = {}
    for n in RANGED:
        if f"{n}_low" in sums.columns:
            mean = F.sum(F.col(f"{n}_mean") * F.col("n")) / F.sum("n")
            out |= {f"{n}_low": F.min(f"{n}_low"), f"{n}_high": F.max(f"{n}_high"), f"{n}_mean": mean}
    for n in ("FxC", "FxBW"):
        out |= {f"{n}_low": F.min(n), f"{n}_high": F.max(n), f"{n}_mean": F.avg(n)}
    out |= {f"all_{n}": F.min(n) for n in ("FXFixed", "TOAFixed", "SRPFixed")}
    return met.groupBy("file").agg(*(v.alias(k) for k, v in out.items()))


def file_rules() -> list[Rule]:
    """What a file says of all its channels: fixed bands, swaths and reference places, and its own limits."""
    c = F.col
    alike = approx(_low("FxC"), c("FxC_mean")) & approx(_high("FxC"), c("FxC_mean"))
    wide = approx(_low("FxBW"), c("FxBW_mean")) & approx(_high("FxBW"), c("FxBW_mean"))
    same = (_low("FxC") == _high("FxC")) & (_low("FxBW") == _high("FxBW"))
    limits = (("txtime1", _low("TxTime"), "TxTime1"), ("txtime2", _high("TxTime"), "TxTime2"), ("fxmin", _low("FX1"), "FxMin"), ("fxmax", _high("FX2"), "FxMax"), ("toamin", _low("TOA1"), "TOAMin"), ("toamax", _high("TOA2"), "TOAMax"))
    return [
        *(Rule(f"all_{n}", c(f"all_{n}"), when=c(f"{n}CPHD")) for n in ("FXFixed", "TOAFixed", "SRPFixed")),
        Rule("same_fxc", alike, _high("FxC") - _low("FxC"), c("FXFixedCPHD")),
        Rule("same_fxbw", wide, _high("FxBW") - _low("FxBW"), c("FXFixedCPHD")),
        Rule("channels_differ", ~same, when=~c("FXFixedCPHD") & c("all_FXFixed")),
        *fixed_rules("FXFixedCPHD", ("FX1", "FX2")),
        *fixed_rules("TOAFixedCPHD", ("TOA1", "TOA2"), 1e-11),
        *fixed_rules("SRPFixedCPHD", ("SRPPos_x", "SRPPos_y", "SRPPos_z"), 1e-3),
        *(Rule(f"global_{name}", approx(found, c(declared)), found) for name, found, declared in limits),
    ]


def area_rules(low: str, high: str, outer_low: str | None = None, outer_high: str | None = None, prefix: str = "area") -> list[Rule]:
    """An area (corners <low>_x.. and <high>_x..) is well formed and, if an outer one is named, lies in it."""
    c = F.col
    when = c(f"{low}_x").isNotNull()
    out = [Rule(f"{prefix}_corners", (c(f"{low}_x") < c(f"{high}_x")) & (c(f"{low}_y") < c(f"{high}_y")), when=when)]
    if outer_low is not None:
        out.append(Rule(f"{prefix}_low_bounded", at_least(c(f"{low}_x"), c(f"{outer_low}_x")) & at_least(c(f"{low}_y"), c(f"{outer_low}_y")), when=when))
        out.append(Rule(f"{prefix}_high_bounded", at_most(c(f"{high}_x"), c(f"{outer_high}_x")) & at_most(c(f"{high}_y"), c(f"{outer_high}_y")), when=when))
    return out


def axis_rules(x: str = "iax", y: str = "iay") -> list[Rule]:
    """The axes of a scene's plane are unit vectors at right angles."""
    a, b = Vec.of(x), Vec.of(y)
    return [
        Rule("iax_unit", approx(a.norm(), 1.0), a.norm()),
        Rule("iay_unit", approx(b.norm(), 1.0), b.norm()),
        Rule("axes_orthogonal", F.abs(a.dot(b)) <= 1e-6, a.dot(b)),
    ]


def optional_rules() -> list[Rule]:
    """Optional vector parameters (has_<name>) come together and in the domain that has them; branches are used by a channel."""
    c = F.col
    fxn = c("has_FXN1") | c("has_FXN2")
    return [
        Rule("optional_fxn", ~fxn | ((c("domain") == "FX") & c("has_FXN1") & c("has_FXN2"))),
        Rule("optional_toae", c("has_TOAE1") == c("has_TOAE2")),
        Rule("image_grid", c("has_ImageGrid"), severity="warning"),
        Rule("antenna_in_channel", c("channel_Antenna"), when=c("has_Antenna"), severity="warning"),
        Rule("txrcv_in_channel", c("channel_TxRcv"), when=c("has_TxRcv"), severity="warning"),
    ]


def polygon_rules(rings: DataFrame, boxes: DataFrame | None = None, ring: str = "ring", vtx: str = "vtx") -> DataFrame:
    """Results of polygons (ring, vtx from 1, x, y): vertices counted without a gap, simple, clockwise, and, with boxes (ring, x1, y1, x2, y2), of that extent.

    A ring is simple if no two of its sides meet but neighbours in their
    common vertex; sides of a ring meet each other by an equi-join.
    """
    from slantframe.operators.planar import edges, segments_cross

    sides = edges(rings, ring, vtx)
    count = rings.groupBy(ring).agg(F.count("*").alias("n"), F.countDistinct(vtx).alias("different"), F.min(vtx).alias("first"), F.max(vtx).alias("last"), F.min("x").alias("x_low"), F.min("y").alias("y_low"), F.max("x").alias("x_high"), F.max("y").alias("y_high"))
    area = sides.groupBy(ring).agg(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("area2"))
    a = sides.select(ring, F.col(vtx).alias("i"), *(F.col(s).alias(t) for s, t in zip(("x0", "y0", "x1", "y1"), ("ax", "ay", "bx", "by"))))
    b = sides.select(ring, F.col(vtx).alias("j"), *(F.col(s).alias(t) for s, t in zip(("x0", "y0", "x1", "y1"), ("cx", "cy", "dx", "dy"))))
    meet = segments_cross(*(F.col(x) for x in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")))
    crossed = a.join(b, ring).where("i < j").where(meet).groupBy(ring).agg(F.count("*").alias("crossings"))
    met = count.join(area, ring, "left").join(crossed, ring, "left").fillna(0, ["crossings", "area2"])
    c = F.col
    rules = [
        Rule("polygon_indices", (c("first") == 1) & (c("last") == c("n")) & (c("different") == c("n")), c("n")),
        Rule("polygon_simple", c("crossings") == 0, c("crossings")),
        Rule("polygon_clockwise", c("area2") < 0, c("area2")),
    ]
    if boxes is not None:
        met = met.join(boxes, ring, "left")
        near = lambda u, v: F.abs(u - v) <= 1e-3 + 1e-6 * F.abs(v)
        rules += [
            Rule("polygon_x1y1", near(c("x_low"), c("x1")) & near(c("y_low"), c("y1")), when=c("x1").isNotNull()),
            Rule("polygon_x2y2", near(c("x_high"), c("x2")) & near(c("y_high"), c("y2")), when=c("x1").isNotNull()),
        ]
    return evaluate(met, ring, rules)


def layout_rules() -> list[Rule]:
    """Blocks of a file (offset and size of XML, support, vector and signal blocks, file_size) follow one another without overlap.

    A null support offset says that the file has no such block.
    """
    c = F.col
    xml_end, pvp_end = c("xml_offset") + c("xml_size"), c("pvp_offset") + c("pvp_size")
    support = c("support_offset").isNotNull()
    after_xml = F.coalesce("support_offset", "pvp_offset") - xml_end
    return [
        Rule("xml_early", c("xml_offset") < 1 << 28, c("xml_offset"), severity="warning"),
        Rule("after_xml", after_xml >= 2, after_xml),
        Rule("pvp_after_support", c("pvp_offset") >= c("support_offset") + c("support_size"), c("pvp_offset") - c("support_offset") - c("support_size"), support),
        Rule("signal_after_pvp", c("signal_offset") >= pvp_end, c("signal_offset") - pvp_end),
        Rule("signal_at_end", c("file_size") == c("signal_offset") + c("signal_size"), c("file_size") - c("signal_offset") - c("signal_size")),
    ]


def polynomial_rules(coefficients: DataFrame, key: str = "poly") -> DataFrame:
    """Results of polynomials given by coefficients (poly, order1, order2, exponent1, exponent2): none above its order, none twice."""
    per = coefficients.groupBy(key, "order1", "order2", "exponent1", "exponent2").agg(F.count("*").alias("n"))
    over = (F.col("exponent1") > F.col("order1")) | (F.col("exponent2") > F.col("order2"))
    out = per.groupBy(key).agg(F.sum(F.coalesce(over, F.lit(False)).cast("long")).alias("over"), F.sum((F.col("n") > 1).cast("long")).alias("twice"))
    return evaluate(out, key, [Rule("polynomial_orders", F.col("over") == 0, F.col("over")), Rule("polynomial_exponents", F.col("twice") == 0, F.col("twice"))])
