"""Complex image metadata: XML to structs, and the columns that the projections need.

Names of elements are those of the public standard; a document becomes one
struct by from_xml, and polynomials become arrays in the order of exponents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_XYZ = "struct<X:double,Y:double,Z:double>"
_POLY1 = "struct<_order1:int,Coef:array<struct<_VALUE:double,_exponent1:int>>>"
_POLY2 = "struct<_order1:int,_order2:int,Coef:array<struct<_VALUE:double,_exponent1:int,_exponent2:int>>>"
_AXIS = f"struct<UVectECF:{_XYZ},SS:double,ImpRespWid:double,Sgn:int,ImpRespBW:double,KCtr:double,DeltaK1:double,DeltaK2:double>"

#: The parts of a document that are read; others are passed over.
SCHEMA = (
    "struct<CollectionInfo:struct<CollectorName:string,CoreName:string,CollectType:string,RadarMode:struct<ModeType:string,ModeID:string>,Classification:string>,"
    "ImageData:struct<PixelType:string,AmpTable:struct<_size:int,Amplitude:array<struct<_VALUE:double,_index:int>>>,NumRows:int,NumCols:int,FirstRow:int,FirstCol:int,FullImage:struct<NumRows:int,NumCols:int>,SCPPixel:struct<Row:int,Col:int>>,"
    f"GeoData:struct<EarthModel:string,SCP:struct<ECF:{_XYZ},LLH:struct<Lat:double,Lon:double,HAE:double>>>,"
    f"Grid:struct<ImagePlane:string,Type:string,TimeCOAPoly:{_POLY2},Row:{_AXIS},Col:{_AXIS}>,"
    "Timeline:struct<CollectStart:string,CollectDuration:double>,"
    f"Position:struct<ARPPoly:struct<X:{_POLY1},Y:{_POLY1},Z:{_POLY1}>>,"
    "RadarCollection:struct<TxFrequency:struct<Min:double,Max:double>,TxPolarization:string>,"
    "ImageFormation:struct<TxRcvPolarizationProc:string,ImageFormAlgo:string>,"
    f"SCPCOA:struct<SCPTime:double,ARPPos:{_XYZ},ARPVel:{_XYZ},SideOfTrack:string,GrazeAng:double,SlopeAng:double>,"
    f"PFA:struct<FPN:{_XYZ},PolarAngPoly:{_POLY1},SpatialFreqSFPoly:{_POLY1}>,"
    "RgAzComp:struct<AzSF:double>,"
    f"RMA:struct<INCA:struct<TimeCAPoly:{_POLY1},R_CA_SCP:double,DRateSFPoly:{_POLY2}>>>"
)


def parse(xml: Column) -> Column:
    """The struct of a document; null parts where elements are missing."""
    return F.from_xml(xml, SCHEMA, {"rowTag": "SICD", "mode": "PERMISSIVE", "ignoreNamespace": "true"})


def ordered(poly: Column) -> Column:
    """Coefficients of a polynomial in one variable by exponent; null for none."""
    pick = lambda i: F.coalesce(F.get(F.filter(poly["Coef"], lambda c: c["_exponent1"] == i), F.lit(0))["_VALUE"], F.lit(0.0))
    return F.when(poly["Coef"].isNotNull(), F.transform(F.sequence(F.lit(0), poly["_order1"]), pick))


def ordered_2d(poly: Column) -> Column:
    """Rows of coefficients by exponents of the first variable, within a row by those of the second."""
    pick = lambda i, j: F.coalesce(F.get(F.filter(poly["Coef"], lambda c: (c["_exponent1"] == i) & (c["_exponent2"] == j)), F.lit(0))["_VALUE"], F.lit(0.0))
    return F.when(poly["Coef"].isNotNull(), F.transform(F.sequence(F.lit(0), poly["_order1"]), lambda i: F.transform(F.sequence(F.lit(0), poly["_order2"]), lambda j: pick(i, j))))


def projection_columns(df: DataFrame, meta: str = "sicd") -> DataFrame:
    """df with the columns of functions.projection out of a parsed document.

    The normal of the ground plane is the ellipsoid's; without a polynomial
    of aperture times their middle is half the collection's duration.
    """
    from slantframe.functions.geodesy import ellipsoid_normal
    from slantframe.functions.vectors import Vec

    m = F.col(meta)
    xyz = lambda v: Vec(v["X"], v["Y"], v["Z"])
    grid, image = m["Grid"], m["ImageData"]
    kind = F.when((grid["Type"] == "RGAZIM") & m["ImageFormation"]["ImageFormAlgo"].isin("PFA", "RGAZCOMP"), m["ImageFormation"]["ImageFormAlgo"]).when(grid["Type"] == "RGZERO", "INCA").when(grid["Type"].isin("XRGYCR", "XCTYAT", "PLANE"), "PLANE")
    half = F.array(F.array(m["Timeline"]["CollectDuration"] / 2))
    df = xyz(m["GeoData"]["SCP"]["ECF"]).attach(df, "scp")
    df = xyz(grid["Row"]["UVectECF"]).attach(df, "urow")
    df = xyz(grid["Col"]["UVectECF"]).attach(df, "ucol")
    df = ellipsoid_normal(Vec.of("scp")).attach(df, "normal")
    return df.withColumns({
        "kind": kind,
        "scp_row": image["SCPPixel"]["Row"].cast("double"), "scp_col": image["SCPPixel"]["Col"].cast("double"),
        "first_row": image["FirstRow"].cast("double"), "first_col": image["FirstCol"].cast("double"),
        "row_ss": grid["Row"]["SS"], "col_ss": grid["Col"]["SS"],
        "time_coa": F.coalesce(ordered_2d(grid["TimeCOAPoly"]), half),
        "arp_px": ordered(m["Position"]["ARPPoly"]["X"]), "arp_py": ordered(m["Position"]["ARPPoly"]["Y"]), "arp_pz": ordered(m["Position"]["ARPPoly"]["Z"]),
        "polar_angle": ordered(m["PFA"]["PolarAngPoly"]), "freq_scale": ordered(m["PFA"]["SpatialFreqSFPoly"]),
        "az_sf": m["RgAzComp"]["AzSF"], "r_ca": m["RMA"]["INCA"]["R_CA_SCP"],
        "time_ca": ordered(m["RMA"]["INCA"]["TimeCAPoly"]), "drate_sf": ordered_2d(m["RMA"]["INCA"]["DRateSFPoly"]),
    })
