import numpy as np
import pytest
from pyspark.sql import functions as F

from slantframe.sources import nitf_image
from slantframe.sources.nitf import NitfError
from slantframe.sources.ranged import Bounds, Ranges
from tests.nitf_files import image, nitf_file

RNG = np.random.default_rng(5)


def whole(lines, bands):
    """{(path end, image): (bands, rows, cols)} of rows read."""
    out = {}
    for r in lines:
        at = out.setdefault((r.path.rsplit("/", 1)[1], r.image), {})
        at.setdefault(r.r, []).append((r.c0, np.array(r.bands)))
    return {k: np.stack([np.concatenate([b for _, b in sorted(v[r], key=lambda x: x[0])], axis=1) for r in sorted(v)], axis=1) for k, v in out.items()}


@pytest.mark.parametrize("mode", "PBRS")
@pytest.mark.parametrize("kind", [("R", 32, ">f4"), ("SI", 16, ">i2"), ("INT", 8, ">u1")])
def test_blocked_and_masked(spark, tmp_path, mode, kind):
    a = RNG.integers(0, 200, (23, 31, 3)).astype(kind[2])
    absent = {(1, 0), (4, 0)} if mode != "S" else {(1, 0), (4, 2), (5, 1)}
    (tmp_path / "a.nitf").write_bytes(nitf_file([image(a, mode, (8, 10), pixel=kind, padded=True)]))
    (tmp_path / "b.nitf").write_bytes(nitf_file([image(a, mode, (8, 10), absent, 7, pixel=kind)]))
    (tmp_path / "c.nitf").write_bytes(nitf_file([image(a, mode, None, pad=9, pixel=kind)]))
    got = whole(nitf_image.read_image(spark, f"file://{tmp_path}").collect(), 3)
    want = a.transpose(2, 0, 1).astype(float)
    assert np.array_equal(got["a.nitf", 0], want) and np.array_equal(got["c.nitf", 0], want)
    gone = want.copy()
    for number, band in absent:
        i, j = divmod(number, 4)
        gone[band if mode == "S" else slice(None), 8 * i : 8 * i + 8, 10 * j : 10 * j + 10] = 7
    assert np.array_equal(got["b.nitf", 0], gone)
    chip = nitf_image.read_image(spark, f"{tmp_path}/b.nitf", cols=(9, 22)).where("r between 6 and 17")
    assert np.array_equal(whole(chip.collect(), 3)["b.nitf", 0], gone[:, 6:18, 9:22])


def test_segments_are_one_image(spark, tmp_path):
    a = RNG.standard_normal((20, 12, 2)).astype(np.float32)
    b = RNG.standard_normal((5, 4, 1)).astype(np.float32)
    parts = [image(a[:8], level=1), image(a[8:15, :7], level=2, attached=1, iloc=(8, 0)), image(b, level=4), image(a[8:15, 7:], level=5, attached=2, iloc=(0, 7)), image(a[15:], level=3, attached=2, iloc=(7, 0))]
    (tmp_path / "s.nitf").write_bytes(nitf_file(parts))
    df = nitf_image.read_image(spark, str(tmp_path))
    got = whole(df.collect(), 2)
    assert np.array_equal(got["s.nitf", 0], a.transpose(2, 0, 1)) and np.array_equal(got["s.nitf", 1], b.transpose(2, 0, 1))
    assert sorted((r.r, r.c0) for r in df.where((F.col("image") == 0) & F.col("r").isin(7, 8)).collect()) == [(7, 0), (8, 0), (8, 7)]
    (tmp_path / "circle.nitf").write_bytes(nitf_file([image(b, level=1, attached=2), image(b, level=2, attached=1)]))
    with pytest.raises(Exception, match="circle"):
        nitf_image.read_image(spark, f"{tmp_path}/circle.nitf").collect()


def test_what_cannot_be_read_is_said(spark, tmp_path):
    a = np.ones((2, 2, 1), np.float32)
    (tmp_path / "x.nitf").write_bytes(nitf_file([image(a, compression="C8"), image(a, level=2), image(a, level=3, pixel=("C", 64, ">f4"))]))
    rows = {r.image: r for r in nitf_image.read_image(spark, str(tmp_path)).where("r is null or r = 0").collect()}
    assert (rows[0].reason, rows[1].reason, rows[2].reason) == ("compression C8", None, "samples C of 64 bits")
    (tmp_path / "cut.nitf").write_bytes(nitf_file([image(a)])[:-1])
    with pytest.raises(Exception, match="cut off"):
        nitf_image.read_image(spark, f"{tmp_path}/cut.nitf").collect()
    (tmp_path / "no.nitf").write_bytes(b"hello")
    with Ranges(f"{tmp_path}/no.nitf") as file, pytest.raises(NitfError):
        nitf_image.segments(file)


def test_a_chip_of_a_large_file_reads_its_blocks(spark, tmp_path):
    """11 GB, most of it a hole: 90,000 x 16,000 pairs of floats in blocks of 1,000 x 1,000."""
    rows, cols, side = 90_000, 16_000, 1000
    head, _ = image(np.zeros((1, 1, 2), np.float32))
    for name, old, new in (("rows", b"00000001" + b"00000001", b"%08d%08d" % (rows, cols)), ("blocks", b"0001000100010001", b"%04d%04d%04d%04d" % (cols // side, rows // side, side, side))):
        assert head.count(old) == 1, name
        head = head.replace(old, new)
    size = rows * cols * 8
    first = nitf_file([(head, b"")], sizes=[min(size, 9_999_999_999)])
    path = tmp_path / "large.nitf"
    block = RNG.standard_normal((side, side, 2)).astype(">f4")
    row, col = 47, 9
    with open(path, "wb") as f:
        f.write(first)
        f.seek(len(first) + (row * 16 + col) * side * side * 8)
        f.write(block.tobytes())
        f.truncate(len(first) + size)
    with Ranges(str(path)) as file:
        (p,) = nitf_image.image_segments(file)
        planned = file.taken
        got = nitf_image.read_window(file, p, (row * side + 100, row * side + 130), (col * side + 5, col * side + 25))
        assert np.array_equal(got, block[100:130, 5:25].transpose(2, 0, 1))
        assert planned < 2000 and file.taken - planned == 30 * side * 8
    chip = nitf_image.read_image(spark, str(path), cols=(col * side + 5, col * side + 25)).where((F.col("r") >= row * side + 100) & (F.col("r") < row * side + 130))
    assert chip.rdd.getNumPartitions() == 1 and np.array_equal(whole(chip.collect(), 2)["large.nitf", 0], got)


def test_bounds():
    b = Bounds({"r": 3}, {"r": 9}, {"image": {1}})
    assert b.span("r", 0, 20) == (3, 10) and b.span("r", 12, 20) == (12, 12) and b.span("image", 0, 5) == (1, 2)
    assert b.has("image", 1) and not b.has("image", 0) and b.has("path", "x") and not b.has("r", 2)


def test_extensions(spark, tmp_path):
    (tmp_path / "x.nitf").write_bytes(nitf_file([image(np.ones((3, 3, 1), np.float32))], [b"<a/>", "<é/>".encode()]))
    got = nitf_image.read_extensions(spark, str(tmp_path)).where("name = 'XML_DATA_CONTENT'").collect()
    assert [(r["index"], bytes(r.content).decode()) for r in sorted(got, key=lambda r: r["index"])] == [(0, "<a/>"), (1, "<é/>")]
