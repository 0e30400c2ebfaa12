import struct

import pytest
import zstandard

from slantframe.llm import warc


def test_pages_round_trip(spark):
    same = "<p>é</p>" * 50
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "x" * (i * 37 % 900), 1) for i in range(60)]
    rows += [(100, None, same, 2), (99, "u", same, 2), (101, "a\nb", same, 2), (102, "e", None, 0), (103, "e", "", 0), (104, "\x00", "\x00\r\n\r\n", 0), (105, "long", "y" * 3_000_000, 0), (7, "again", rows[7][2], 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for parts in (1, 7):
        got = warc.archive_pages(pages.repartition(parts)).collect()
        assert len(got) == len(rows)
        texts = {}
        for i, _, html, _ in rows:
            texts.setdefault(html or "", []).append(i)
        want = sorted((i, len((html or "").encode()), warc.payload_digest((html or "").encode()), "response" if i == min(texts[html or ""]) else "revisit", None if i == min(texts[html or ""]) else min(texts[html or ""])) for i, _, html, _ in rows)
        assert sorted(tuple(r)[:5] for r in got) == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
        full = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
        assert full[105] == b"y" * 3_000_000 and full[104] == b"\x00\r\n\r\n"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def _archive(*records, dictionary=b"", packed=False):
    raw = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    return struct.pack("<II", warc.DICTIONARY, len(raw)) + raw + b"".join(coder.compress(r) for r in records)


def test_reader_validates():
    good = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Date", "d")], b"H\r\n\r\nbody")
    dictionary = warc.train_dictionary([good + bytes([i % 250]) * 60 + b"%d" % (i * i) for i in range(300)])
    for packed in (False, True):
        assert [r.payload for r in warc.read_archive(_archive(good, good, dictionary=dictionary, packed=packed))] == [b"body"] * 2
    assert list(warc.read_archive(b"")) == []
    whole = _archive(good)
    for broken in (whole[:-1], whole[:-6], whole[:12], whole + b"junk-junk", _archive(good[:-1]), _archive(good.replace(b"Length: 9", b"Length: 8")), _archive(good.replace(b"WARC-Date: d\r\n", b"")), _archive(good.replace(b"WARC/1.1", b"WARC/9.9")), _archive(good + good), whole + _archive(good)):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))


def test_frames_that_dont_say_their_size():
    good = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Date", "d")], b"H\r\n\r\nbody")
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    frame = stream.compress(good) + stream.flush()
    assert zstandard.get_frame_parameters(frame).content_size in (0, zstandard.CONTENTSIZE_UNKNOWN)
    assert [r.payload for r in warc.read_archive(frame + frame)] == [b"body"] * 2
