"""Tagged record extensions of NITF headers: one grammar for all layouts, read and written in one pass over bytes.

A layout is a tuple of items.  Text items are names with sizes, ``NAME 12``;
a letter before the size says what the bytes are: d a decimal number, f a
32-bit float, b bytes.  ``Loop`` repeats a layout as often as a number or an
earlier field says, ``When`` has a layout that is there if an earlier field
has one of some values or bits of a mask.  Names are looked up from the
innermost loop outwards.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RecordError(ValueError):
    """Bytes that a layout doesn't fit."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    size: int


@dataclass(frozen=True)
class Loop:
    name: str
    count: str | int
    items: tuple


@dataclass(frozen=True)
class When:
    field: str
    among: tuple[str, ...] | int
    items: tuple

    def holds(self, value) -> bool:
        if isinstance(self.among, int):
            return bool(int.from_bytes(value, "big") & self.among)
        return value in self.among


def layout(*parts: str | Loop | When) -> tuple:
    """Items of texts like ``LON 15 LAT 15 COUNT d3`` and of loops and conditions between them."""
    out: list[Field | Loop | When] = []
    for part in parts:
        if isinstance(part, str):
            words = part.split()
            out += [Field(n, k[0] if k[0] in "dfb" else "s", int(k.lstrip("dfb"))) for n, k in zip(words[::2], words[1::2])]
        else:
            out.append(part)
    return tuple(out)


def _each(names: str, size: int) -> str:
    return " ".join(f"{n} {size}" for n in names.split())


def _when(field: str, mask: int, *parts) -> When:
    return When(field, mask, layout(*parts))


_CORNERS = " ".join(_each(f"{p}_ROW_{k} {p}_COL_{k}", 12) for p in ("OP", "FI") for k in ("11", "12", "21", "22"))
_COEFFICIENTS = tuple(Loop(f"{n}_COEFFS", 20, layout(f"{n}_COEFF 12")) for n in ("LINE_NUM", "LINE_DEN", "SAMP_NUM", "SAMP_DEN"))
_RPC = layout("SUCCESS 1 ERR_BIAS 7 ERR_RAND 7 LINE_OFF 6 SAMP_OFF 5 LAT_OFF 8 LONG_OFF 9 HEIGHT_OFF 5 LINE_SCALE 6 SAMP_SCALE 5 LAT_SCALE 8 LONG_SCALE 9 HEIGHT_SCALE 5", *_COEFFICIENTS)
_MASK = "EXISTENCE_MASK"
_AUX = lambda f: (When(f, ("I",), layout("APN d10")), When(f, ("R",), layout("APR f4")), When(f, ("A",), layout("APA 20")))

# Fixed values of the published formats: fields in their order, with their sizes in bytes.
LAYOUTS: dict[str, tuple] = {
    "ACCPOB": layout("NUMACPO d2", Loop("ACPOS", "NUMACPO", layout("UNIAAH 3 AAH 5 UNIAAV 3 AAV 5 UNIAPH 3 APH 5 UNIAPV 3 APV 5 NUMPTS d3", Loop("PTS", "NUMPTS", layout("LON 15 LAT 15"))))),
    "AIMIDB": layout("ACQUISITION_DATE 14 MISSION_NO 4 MISSION_IDENTIFICATION 10 FLIGHT_NO 2 OP_NUM 3 CURRENT_SEGMENT 2 REPRO_NUM 2 REPLAY 3 RESERVED_001 1 START_TILE_COLUMN 3 START_TILE_ROW 5 END_SEGMENT 2 END_TILE_COLUMN 3 END_TILE_ROW 5 COUNTRY 2 RESERVED002 4 LOCATION 11 RESERVED003 13"),
    "BANDSB": layout(
        "COUNT d5 RADIOMETRIC_QUANTITY 24 RADIOMETRIC_QUANTITY_UNIT 1 SCALE_FACTOR f4 ADDITIVE_FACTOR f4 ROW_GSD 7 ROW_GSD_UNIT 1 COL_GSD 7 COL_GSD_UNIT 1 SPT_RESP_ROW 7 SPT_RESP_UNIT_ROW 1 SPT_RESP_COL 7 SPT_RESP_UNIT_COL 1 DATA_FLD_1 b48 EXISTENCE_MASK b4",
        _when(_MASK, 0x80000000, "RADIOMETRIC_ADJUSTMENT_SURFACE 24 ATMOSPHERIC_ADJUSTMENT_ALTITUDE f4"),
        _when(_MASK, 0x40000000, "DIAMETER 7"), _when(_MASK, 0x20000000, "DATA_FLD_2 b32"), _when(_MASK, 0x01F80000, "WAVE_LENGTH_UNIT 1"),
        Loop("PARAMETERS", "COUNT", layout(
            _when(_MASK, 0x10000000, "BANDID 50"), _when(_MASK, 0x08000000, "BAD_BAND d1"), _when(_MASK, 0x04000000, "NIIRS 3"), _when(_MASK, 0x02000000, "FOCAL_LEN d5"), _when(_MASK, 0x01000000, "CWAVE 7"),
            _when(_MASK, 0x00800000, "FWHM 7"), _when(_MASK, 0x00400000, "FWHM_UNC 7"), _when(_MASK, 0x00200000, "NOM_WAVE 7"), _when(_MASK, 0x00100000, "NOM_WAVE_UNC 7"), _when(_MASK, 0x00080000, "LBOUND 7 UBOUND 7"),
            _when(_MASK, 0x00040000, "SCALE_FACTOR f4 ADDITIVE_FACTOR f4"), _when(_MASK, 0x00020000, "START_TIME 16"), _when(_MASK, 0x00010000, "INT_TIME 6"), _when(_MASK, 0x00008000, "CALDRK 6 CALIBRATION_SENSITIVITY 5"),
            _when(_MASK, 0x00004000, "ROW_GSD 7", _when(_MASK, 0x00002000, "ROW_GSD_UNC 7"), "ROW_GSD_UNIT 1 COL_GSD 7", _when(_MASK, 0x00002000, "COL_GSD_UNC 7"), "COL_GSD_UNIT 1"),
            _when(_MASK, 0x00001000, "BKNOISE 5 SCNNOISE 5"),
            _when(_MASK, 0x00000800, "SPT_RESP_FUNCTION_ROW 7", _when(_MASK, 0x00000400, "SPT_RESP_UNC_ROW 7"), "SPT_RESP_UNIT_ROW 1 SPT_RESP_FUNCTION_COL 7", _when(_MASK, 0x00000400, "SPT_RESP_UNC_COL 7"), "SPT_RESP_UNIT_COL 1"),
            _when(_MASK, 0x00000200, "DATA_FLD_3 b16"), _when(_MASK, 0x00000100, "DATA_FLD_4 b24"), _when(_MASK, 0x00000080, "DATA_FLD_5 b32"), _when(_MASK, 0x00000040, "DATA_FLD_6 b48"),
        )),
        _when(_MASK, 0x00000001, "NUM_AUX_B d2 NUM_AUX_C d2", Loop("AUX_BS", "NUM_AUX_B", layout("BAPF 1 UBAP 7", Loop("BANDS", "COUNT", _AUX("BAPF")))), Loop("AUX_CS", "NUM_AUX_C", layout("CAPF 1 UCAP 7", *_AUX("CAPF")))),
    ),
    "BLOCKA": layout("BLOCK_INSTANCE 2 N_GRAY 5 L_LINES 5 LAYOVER_ANGLE 3 SHADOW_ANGLE 3 RESERVED_001 16 FRLC_LOC 21 LRLC_LOC 21 LRFC_LOC 21 FRFC_LOC 21 RESERVED_002 5"),
    "GRDPSB": layout("NUM_GRDS d2", Loop("GRDS", "NUM_GRDS", layout("ZVL 10 BAD 10 LOD 12 LAD 12 LSO 11 PSO 11"))),
    "HISTOA": layout("SYSTYPE 20 PC 12 PE 4 REMAP_FLAG 1 LUTID 2 NEVENTS d2", Loop("EVENTS", "NEVENTS", layout(
        "PDATE 14 PSITE 10 PAS 10 NIPCOM d1", Loop("IPCOMS", "NIPCOM", layout("IPCOM 80")), "IBPP 2 IPVTYPE 3 INBWC 10 DISP_FLAG 1 ROT_FLAG 1", When("ROT_FLAG", ("1",), layout("ROT_ANGLE 8")),
        "ASYM_FLAG 1", When("ASYM_FLAG", ("1",), layout("ZOOMROW 7 ZOOMCOL 7")), "PROJ_FLAG 1 SHARP_FLAG 1", When("SHARP_FLAG", ("1",), layout("SHARPFAM 2 SHARPMEM 2")),
        "MAG_FLAG 1", When("MAG_FLAG", ("1",), layout("MAG_LEVEL 7")), "DRA_FLAG 1", When("DRA_FLAG", ("1",), layout("DRA_MULT 7 DRA_SUB 5")), "TTC_FLAG 1", When("TTC_FLAG", ("1",), layout("TTCFAM 2 TTCMEM 2")),
        "DEVLUT_FLAG 1 OBPP 2 OPVTYPE 3 OUTBWC 10",
    ))),
    "ICHIPB": layout("XFRM_FLAG 2 SCALE_FACTOR 10 ANAMRPH_CORR 2 SCANBLK_NUM 2", _CORNERS, "FI_ROW 8 FI_COL 8"),
    "PIAIMC": layout("CLOUDCVR 3 SRP 1 SENSMODE 12 SENSNAME 18 SOURCE 255 COMGEN 2 SUBQUAL 1 PIAMSNNUM 7 CAMSPECS 32 PROJID 2 GENERATION 1 ESD 1 OTHERCOND 2 MEANGSD 7 IDATUM 3 IELLIP 3 PREPROC 2 IPROJ 2 SATTRACK 8"),
    "RPC00A": _RPC,
    "RPC00B": _RPC,
    "RSMIDA": layout(
        "IID 80 EDITION 40 ISID 40 SID 40 STID 40 YEAR 4 MONTH 2 DAY 2 HOUR 2 MINUTE 2 SECOND 9 NRG 8 NCG 8 TRG 21 TCG 21 GRNDD 1", _each("XUOR YUOR ZUOR", 21), _each(" ".join(f"{a}U{b}R" for a in "XYZ" for b in "XYZ"), 21),
        _each(" ".join(f"V{k}{a}" for k in range(1, 9) for a in "XYZ"), 21), _each("GRPX GRPY GRPZ", 21), _each("FULLR FULLC MINR MAXR MINC MAXC", 8), _each(" ".join(f"{p}{s}" for p in ("IE", "IA") for s in ("0", "R", "C", "RR", "RC", "CC")), 21), _each("SPX SVX SAX SPY SVY SAY SPZ SVZ SAZ", 21),
    ),
    "STDIDC": layout("ACQUISITION_DATE 14 MISSION 14 PASS 2 OP_NUM 3 START_SEGMENT 2 REPRO_NUM 2 REPLAY_REGEN 3 BLANK_FILL 1 START_COLUMN 3 START_ROW 5 END_SEGMENT 2 END_COLUMN 3 END_ROW 5 COUNTRY 2 WAC 4 LOCATION 11 RESERV01 5 RESERV02 8"),
    "USE00A": layout("ANGLE_TO_NORTH 3 MEAN_GSD 5 RSRVD01 1 DYNAMIC_RANGE 5 RSRVD02 3 RSRVD03 1 RSRVD04 3 OBL_ANG 5 ROLL_ANG 6 RSRVD05 12 RSRVD06 15 RSRVD07 4 RSRVD08 1 RSRVD09 3 RSRVD10 1 RSRVD11 1 N_REF 2 REV_NUM 5 N_SEG 3 MAX_LP_SEG 6 RSRVD12 6 RSRVD13 6 SUN_EL 5 SUN_AZ 5"),
}


def _find(scopes: list[dict], name: str):
    for scope in reversed(scopes):
        if name in scope:
            return scope[name]
    raise RecordError(f"{name} comes later or never")


def _value(raw: bytes, kind: str):
    if kind == "b":
        return raw
    if kind == "f":
        return struct.unpack(">f", raw)[0]
    text = raw.decode("latin-1").strip()
    if kind == "d":
        if not text.isdigit():
            raise RecordError(f"{text!r} isn't a number")
        return int(text)
    return text


def read_record(items: tuple, data: bytes) -> dict:
    """The fields of a record; those of a loop as a list."""

    def take(items: tuple, at: int, scopes: list[dict]) -> int:
        own = scopes[-1]
        for x in items:
            if isinstance(x, Field):
                if at + x.size > len(data):
                    raise RecordError(f"{x.name} is cut off")
                own[x.name], at = _value(data[at : at + x.size], x.kind), at + x.size
            elif isinstance(x, When):
                if x.holds(_find(scopes, x.field)):
                    at = take(x.items, at, scopes)
            else:
                own[x.name] = []
                for _ in range(x.count if isinstance(x.count, int) else _find(scopes, x.count)):
                    own[x.name].append({})
                    at = take(x.items, at, [*scopes, own[x.name][-1]])
        return at

    out: dict = {}
    end = take(items, 0, [out])
    if end != len(data):
        raise RecordError(f"{len(data) - end} bytes are left")
    return out


def write_record(items: tuple, values: dict) -> bytes:
    """The bytes of a record's fields; counts and conditions must agree with what is there."""

    def give(items: tuple, scopes: list[dict]) -> Iterator[bytes]:
        own = scopes[-1]
        for x in items:
            if isinstance(x, Field):
                value = own[x.name]
                raw = value if x.kind == "b" else struct.pack(">f", value) if x.kind == "f" else f"{value:0{x.size}d}".encode() if x.kind == "d" else str(value).ljust(x.size).encode("latin-1")
                if len(raw) != x.size:
                    raise RecordError(f"{x.name} doesn't fit {x.size} bytes")
                yield raw
            elif isinstance(x, When):
                if x.holds(_find(scopes, x.field)):
                    yield from give(x.items, scopes)
            else:
                count = x.count if isinstance(x.count, int) else _find(scopes, x.count)
                if len(own[x.name]) != count:
                    raise RecordError(f"{x.name} has {len(own[x.name])} entries, not {count}")
                for one in own[x.name]:
                    yield from give(x.items, [*scopes, one])

    return b"".join(give(items, [values]))


def split(area: bytes) -> Iterator[tuple[str, bytes, str | None]]:
    """(tag, data, what is wrong) of the records of a header's area, one after the other."""
    at = 0
    while at < len(area):
        tag, size = area[at : at + 6].decode("latin-1").rstrip(), area[at + 6 : at + 11]
        if len(size) < 5 or not size.isdigit() or at + 11 + int(size) > len(area):
            yield tag, area[at + 11 :], "the record is cut off"
            return
        yield tag, area[at + 11 : at + 11 + int(size)], None
        at += 11 + int(size)


def joined(records: list[tuple[str, bytes]]) -> bytes:
    """An area of records (tag, data)."""
    return b"".join(tag.ljust(6).encode("latin-1") + f"{len(data):05d}".encode() + data for tag, data in records)


def _flat(values: dict, places: tuple[int, ...] = ()) -> Iterator[tuple[str, list[int], str]]:
    for name, value in values.items():
        if isinstance(value, list):
            for i, one in enumerate(value):
                yield from _flat(one, (*places, i))
        else:
            yield name, list(places), value.hex() if isinstance(value, bytes) else json.dumps(value) if isinstance(value, float) else str(value)


_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("at", pa.list_(pa.int32())), ("value", pa.string())]))


#: Areas whose fields are Python objects at once.
AREAS = 512


def _taken_apart(batch: pa.RecordBatch, keys: list[str], known: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    """The records of a batch (keys, area), some areas at a time."""
    n = len(keys)
    for start in range(0, batch.num_rows, AREAS):
        part = batch.slice(start, AREAS)
        source, rows = [], []
        for i, area in enumerate(part.column(n).to_pylist()):
            for k, (tag, data, wrong) in enumerate(split(area or b"")):
                found = None
                if wrong is None and tag in known:
                    try:
                        found = [dict(zip(("name", "at", "value"), x)) for x in _flat(read_record(known[tag], data))]
                    except RecordError as error:
                        wrong = str(error)
                source.append(i)
                rows.append((k, tag, found, data, wrong))
        columns = list(zip(*rows)) if rows else [[]] * 5
        at = pa.array(source, pa.int64())
        kinds = (pa.int32(), pa.string(), _FIELDS, pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([*(part.column(j).take(at) for j in range(n)), *(pa.array(c, t) for c, t in zip(columns, kinds))], [*keys, "number", "tag", "fields", "data", "reason"])


def read_records(areas: DataFrame, keys: list[str], content: str = "content", layouts: dict[str, tuple] | None = None) -> DataFrame:
    """(keys, number, tag, fields, data, reason): a row a record of each area of bytes.

    fields are (name, at: places in the loops around it, value as text, bytes
    as hex), null for tags without a layout; reason says why a record couldn't
    be read.  data has every record's bytes.  A null or empty area has none.
    """
    known = LAYOUTS if layouts is None else layouts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _taken_apart(batch, keys, known)

    own = ", ".join(f"`{k}` {areas.schema[k].dataType.simpleString()}" for k in keys)
    return areas.select(*keys, F.col(content)).mapInArrow(run, f"{own}, number int, tag string, fields array<struct<name:string,at:array<int>,value:string>>, data binary, reason string")
