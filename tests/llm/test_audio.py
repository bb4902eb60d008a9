"""Streams made by hand: versions, tags and variable bit rate tables that the writer doesn't make."""

import struct

import pytest

from tracegrid.llm import mpeg_audio as A


def frame(version, rate_index=0, bitrate_index=4, mode=3, body=b"", at=None):
    head = bytes((0xFF, 0xE3 | version << 3, bitrate_index << 4 | rate_index << 2, mode << 6))
    length, _, side, _, _ = A._header(head, 0)
    skip = side if at is None else at
    return head + bytes(skip) + body.ljust(length - 4 - skip, b"\0")


@pytest.mark.parametrize("version,rates,samples,length", [(3, (44100, 48000, 32000), 1152, 144 * 56000), (2, (22050, 24000, 16000), 576, 72 * 32000), (0, (11025, 12000, 8000), 576, 72 * 32000)])
def test_versions(version, rates, samples, length):
    for i, rate in enumerate(rates):
        data = b"".join(frame(version, i) for _ in range(5))
        s = A.parse(b"\xff\xf3x" + data)
        assert (s.rate, s.samples, s.skipped, len(s.offsets)) == (rate, 5 * samples, 3, 5)
        assert s.offsets == [3 + k * (length // rate) for k in range(5)] if version == 3 else s.offsets[1] - 3 == length // rate


def test_other_versions_do_not_chain():
    s = A.parse(frame(3) + frame(2) + frame(2))
    assert s.rate == 22050 and len(s.offsets) == 2 and s.skipped == len(frame(3))


@pytest.mark.parametrize("flags", range(8))
def test_xing_flags(flags):
    table = bytes(range(100))
    body = b"Xing" + struct.pack(">I", flags) + (struct.pack(">I", 3) if flags & 1 else b"") + (struct.pack(">I", 999) if flags & 2 else b"") + (table if flags & 4 else b"")
    s = A.parse(frame(3, bitrate_index=9, body=body) + frame(3) * 3)
    assert s.vbr == (3 if flags & 1 else None, 999 if flags & 2 else None, table if flags & 4 else b"") and len(s.offsets) == 3


def test_vbri():
    body = b"VBRI" + struct.pack(">HHHII4H", 1, 0, 75, 4321, 3, 4, 1, 2, 1) + b"\0\1" * 4
    s = A.parse(frame(3, bitrate_index=9, body=body, at=32) + frame(3) * 3)
    assert s.vbr == (3, 4321, b"\0\1" * 4) and s.samples == 3 * 1152


def id3(version, frames, flags=0):
    return b"ID3" + bytes((version, 0, flags)) + struct.pack(">I", A._syncsafe(len(frames))) + frames


def test_tags():
    long = "t" * 300  # 301 bytes: a plain size of 0x12d, in groups of 7 bits 0x22d
    v3 = b"TIT2" + struct.pack(">I", 301) + b"\0\0\0" + long.encode() + b"TPE1" + struct.pack(">I", 7) + b"\0\0\1" + "ab".encode("utf-16")
    assert A.parse(id3(3, v3 + bytes(20)) + frame(3) * 2).tags == {"TIT2": long, "TPE1": "ab"}
    v4 = b"TIT2" + struct.pack(">I", A._syncsafe(301)) + b"\0\0\3" + long.encode()
    assert A.parse(id3(4, v4) + frame(3) * 2).tags == {"TIT2": long}
    v2 = b"TT2" + b"\0\0\3" + b"\0hi" + b"TXX" + b"\0\0\4" + b"\0k\0v"
    assert A.parse(id3(2, v2) + frame(3) * 2).tags == {"TT2": "hi", "k": "v"}
    old = (b"TAG" + b"song".ljust(30, b"\0") + b"who".ljust(30)).ljust(128, b"\0")
    for n in (1, 3):
        s = A.parse(frame(3) * n + old)
        assert s.tags == {"title": "song", "artist": "who"} and len(s.offsets) == n and s.skipped == 0
    assert A.parse(frame(3) * 3 + b"junk" + old).tags["title"] == "song"


@pytest.mark.parametrize("data", [b"ID3", b"ID3\4\0\0\0\0\0\x7f", b"ID3\3\0\x40\0\0\0\5TXXX\0", b"\xff" * 50, b"TAG".ljust(128, b"\0"), frame(3)[:20], id3(4, b"TXXX\0\0\0\x09\0\3\0")])
def test_broken_streams(data):
    assert A.parse(data).samples == 0


def test_streams_with_columns_of_any_name(spark):
    stream = A.write(A.pad(b"abc"))
    rows = [(None, stream, "y", "p", 1, 7), (1, None, "y", "p", 2, 7), (1, stream, "y", "p", 3, 7), (1, stream, "y", "p", 3, 7), (2, b"", None, None, None, 7)]
    d = spark.createDataFrame(rows, "doc_id long, media binary, `x.y` string, Payload string, n_frames int, MEDIA_ int")
    got = A.decode(d)
    assert got.columns[:4] == ["doc_id", "media", "x.y", "MEDIA_"] and len(got.columns) == 14
    out = sorted((r.doc_id or 0, bytes(r.payload or b"")[:3], r["x.y"], r.MEDIA_) for r in got.collect())
    assert out == sorted([(0, b"abc", "y", 7), (1, b"", "y", 7), (1, b"abc", "y", 7), (1, b"abc", "y", 7), (2, b"", None, 7)], key=lambda r: (r[0], r[1]))
    assert A.decode(d.where("false")).count() == 0
    ids = spark.createDataFrame([(None, "a"), (None, None), (3, "a"), (3, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes) for r in A.encode(ids).collect()) == [(0, 0), (0, 1), (3, 1), (3, 1)]
