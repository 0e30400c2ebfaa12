"""NITF files of our own making: blocked, masked and attached segments."""

import struct

import numpy as np

from slantframe.sources.nitf import BLOCKS, EXTENSION, FILE, IMAGE


def packed(layout, **values):
    return "".join(str(values.get(n, "")).ljust(k)[:k] for n, k in layout).encode("ascii")


def image(a, mode="P", block=None, absent=(), pad=None, level=1, attached=0, iloc=(0, 0), compression="NC", pixel=("R", 32, ">f4"), padded=False):
    """(subheader, body) of (rows, cols, bands) samples; absent blocks, by (number, band) in mode S, aren't stored."""
    rows, cols, bands = a.shape
    kind, bits, base = pixel
    height, width = block or (rows, cols)
    down, across = -(-rows // height), -(-cols // width)
    whole = np.zeros((down * height, across * width, bands), base)
    whole[:rows, :cols] = a
    cells = whole.reshape(down, height, across, width, bands).transpose(0, 2, 1, 3, 4).reshape(down * across, height, width, bands)
    axes = {"P": (0, 1, 2), "B": (2, 0, 1), "R": (0, 2, 1)}
    if mode == "S":
        parts = {(k, b): cells[k, :, :, b].tobytes() for b in range(bands) for k in range(len(cells))}
    else:
        parts = {(k, 0): cells[k].transpose(axes[mode]).tobytes() for k in range(len(cells))}
    body, offsets = b"", []
    for key, data in parts.items():
        offsets.append(0xFFFFFFFF if key in absent else len(body))
        body += b"" if key in absent else data
    if absent or pad is not None:
        code = b"" if pad is None else np.array(pad, base).tobytes()
        table = struct.pack(f">{len(offsets)}I", *offsets) if absent else b""
        body = struct.pack(">IHHH", 10 + len(code) + len(table), 4 if absent else 0, 0, 8 * len(code)) + code + table + body
        compression = "NM"
    head = packed(IMAGE, IM="IM", IID1="X", ISCLAS="U", ENCRYP="0", NROWS=f"{rows:08d}", NCOLS=f"{cols:08d}", PVTYPE=kind, IREP="NODISPLY", ICAT="SAR", ABPP=f"{bits:02d}", PJUST="R", ICORDS="G" if padded else "")
    head += (b" " * 60 if padded else b"") + (b"1" + b"c" * 80 if padded else b"0") + compression.encode() + (b"" if compression in ("NC", "NM") else b"0000")
    head += f"{bands}".encode() if bands < 10 else f"0{bands:05d}".encode()
    head += b"".join(b"  ".ljust(8) + b"N   " + (b"1" + b"00004" + b"\0" * 4 if padded and i == 0 else b"0") for i in range(bands))
    head += packed(BLOCKS, ISYNC="0", IMODE=mode, NBPR=f"{across:04d}", NBPC=f"{down:04d}", NPPBH=f"{width:04d}", NPPBV=f"{height:04d}", NBPP=f"{bits:02d}", IDLVL=f"{level:03d}", IALVL=f"{attached:03d}", ILOC=f"{iloc[0]:05d}{iloc[1]:05d}", IMAG="1.0 ") + b"0000000000"
    return head, body


def nitf_file(images, texts=(), sizes=None):
    """The file; sizes replaces the lengths of bodies in the header, for files with holes."""
    head = packed(EXTENSION, DE="DE", DESID="XML_DATA_CONTENT", DESVER="01", DESCLAS="U", DESSHL="0000")
    bodies = sizes or [len(b) for _, b in images]
    lists = f"{len(images):03d}".encode() + b"".join(f"{len(h):06d}{n:010d}".encode() for (h, _), n in zip(images, bodies))
    lists += b"000000000" + f"{len(texts):03d}".encode() + b"".join(f"{len(head):04d}{len(t):09d}".encode() for t in texts) + b"000" + b"0000000000"
    size = sum(n for _, n in FILE) + len(lists)
    first = packed(FILE, FHDR="NITF", FVER="02.10", CLEVEL="03", STYPE="BF01", FDT="20000101000000", FSCLAS="U", FSCOP="00000", FSCPYS="00000", ENCRYP="0", FL=f"{0:012d}", HL=f"{size:06d}")
    return first + lists + b"".join(h + b for h, b in images) + b"".join(head + t for t in texts)
