"""Media columns: MPEG Layer III audio.

write() stores bytes losslessly as the ancillary data of silent, checksummed Layer III frames
behind an ID3v2 tag and a Xing frame with a table of contents; the last frames take smaller
bit rates, so the stream has a variable bit rate. parse() reads any Layer III stream of MPEG-1,
MPEG-2 or MPEG-2.5: it reads ID3v2.2 to v2.4 and ID3v1 tags and Xing, Info and VBRI tables,
resynchronises on chains of frame headers of one version and rate, verifies the checksums and
gives the exact duration in samples and the byte offset of every frame.

Defined cases: null is stored as an empty text, which is 64 zero bytes; equal texts give equal
streams; garbage before, between or after frames is skipped and counted; a column without any
frame has 0 samples and a null payload; an empty table gives an empty result. Rows without an id and repeated
rows are stored and read like any other; other columns of a table of streams stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import numbered
from .workspace import materialize, table

# Fixed values of the format: kbit/s by index (of MPEG-1, of MPEG-2 and 2.5), Hz by index.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_BITRATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
SAMPLES, LOW_SAMPLES = 1152, 576
SIDE_MONO, SIDE_STEREO = 17, 32
LOW_SIDE_MONO, LOW_SIDE_STEREO = 9, 17
#: Bits of the version in a frame header, and what its rates are divided by.
VERSIONS = {3: 1, 2: 2, 0: 4}
#: Text encodings of ID3v2 by their first byte.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
RATE_INDEX = 2
HEAD = 4 + 2 + SIDE_MONO  # header, checksum, side information of a mono frame
LENGTHS = [144 * b * 1000 // RATES[RATE_INDEX] for b in BITRATES]


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_TABLE = _crc_table()
_known: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The checksum of a frame: over the last two header bytes and the side information."""
    got = _known.get(data)
    if got is None:
        got = 0xFFFF
        for b in data:
            got = ((got << 8) & 0xFFFF) ^ _TABLE[(got >> 8) ^ b]
        if len(_known) < 4096:
            _known[data] = got
    return got


def _frame(index: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | RATE_INDEX << 2, 0xC0))  # protected, mono
    side = bytes(SIDE_MONO)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side + body.ljust(LENGTHS[index] - HEAD, b"\0")


def _id3(frames: dict[str, str]) -> bytes:
    body = b""
    for key, value in frames.items():
        text = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + struct.pack(">I", _syncsafe(len(text))) + b"\0\0" + text
    return b"ID3\x04\0\0" + struct.pack(">I", _syncsafe(len(body))) + body


def _syncsafe(n: int) -> int:
    return n & 0x7F | (n & 0x3F80) << 1 | (n & 0x1FC000) << 2 | (n & 0xFE00000) << 3


def _unsyncsafe(n: int) -> int:
    return n & 0x7F | (n >> 1) & 0x3F80 | (n >> 2) & 0x1FC000 | (n >> 3) & 0xFE00000


def write(payload: bytes) -> bytes:
    top = len(BITRATES) - 1
    step = LENGTHS[top] - HEAD
    frames = [_frame(top, payload[i : i + step]) for i in range(0, len(payload) - step, step)] if len(payload) > step else []
    rest = payload[len(frames) * step :]
    index = next(i for i in range(1, top + 1) if LENGTHS[i] - HEAD >= len(rest))
    frames.append(_frame(index, rest))
    size, marks, at = sum(map(len, frames)), [], 0
    for f in frames:
        marks.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * marks[len(marks) * i // 100] // size) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), size) + toc
    return _id3({"payload_bytes": str(len(payload))}) + _frame(next(i for i in range(1, top + 1) if LENGTHS[i] - HEAD >= len(xing)), xing) + b"".join(frames)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    vbr: tuple[int | None, int | None, bytes] | None = None  # frames, bytes, table of contents
    offsets: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)


def _header(data: bytes, at: int) -> tuple[int, int, int, bool, int] | None:
    """Length, rate, side information's length, protection and samples of a frame header at this place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE6 != 0xE2:
        return None
    by, b, r = VERSIONS.get(data[at + 1] >> 3 & 3), data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if by is None or not 0 < b < 15 or r == 3:
        return None
    mono, rate, guarded = data[at + 3] >> 6 == 3, RATES[r] // by, not data[at + 1] & 1
    bits, samples, sides = (BITRATES, SAMPLES, (SIDE_STEREO, SIDE_MONO)) if by == 1 else (LOW_BITRATES, LOW_SAMPLES, (LOW_SIDE_STEREO, LOW_SIDE_MONO))
    return samples * 125 * bits[b] // rate + (data[at + 2] >> 1 & 1), rate, sides[mono], guarded, samples


def _tags(data: bytes, at: int, end: int) -> tuple[dict[str, str], int]:
    """The text frames of an ID3v2 tag at this place, and where it ends. Frames of version 2 have short heads,
    those of 3 plain sizes and those of 4 sizes in groups of 7 bits; user texts go by their description."""
    version, flags, found = data[at + 3], data[at + 5], {}
    stop = min(at + 10 + _unsyncsafe(int.from_bytes(data[at + 6 : at + 10])), end)
    body = data[at + 10 : stop]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    wide, p = (4 if version > 2 else 3), 0
    head = 10 if version > 2 else 6
    number = (lambda raw: _unsyncsafe(int.from_bytes(raw))) if version == 4 else int.from_bytes
    if flags & 0x40 and version > 2:  # an extended header: version 4 counts its size field too
        p = number(body[:4]) + (4 if version == 3 else 0)
    while p + head <= len(body) and body[p : p + wide].strip(b"\0"):
        name, n = body[p : p + wide].decode("latin-1"), number(body[p + wide : p + 2 * wide])
        text = body[p + head : p + head + n]
        if version == 4 and body[p + 9] & 2:
            text = text.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[p + 9] & 1:
            text = text[4:]
        p += head + n
        packed = version > 2 and body[p - n - 1] & (0x0C if version == 4 else 0xC0)
        if name[0] != "T" or not text or text[0] >= len(ENCODINGS) or packed:
            continue
        parts = text[1:].decode(ENCODINGS[text[0]], "replace").split("\0")
        parts = [x.removeprefix("\ufeff") for x in parts]
        if name in ("TXXX", "TXX") and len(parts) > 1:
            found[parts[0]] = parts[1]
        else:
            found[name] = parts[0]
    return found, min(stop + (10 if flags & 0x10 and version == 4 else 0), end)


def _vbr(data: bytes, at: int, body: int, stop: int) -> tuple[int | None, int | None, bytes] | None:
    """Frames, bytes and table of contents of a frame that holds a variable bit rate table, with None for what its flags leave out."""
    if data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= stop:
        flags, p, told = data[body + 7], body + 8, []
        for bit in (1, 2):
            told.append(int.from_bytes(data[p : p + 4]) if flags & bit and p + 4 <= stop else None)
            p += 4 if flags & bit else 0
        return told[0], told[1], data[p : min(p + 100, stop)] if flags & 4 else b""
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= stop:
        entries, _, width, _ = struct.unpack(">4H", data[at + 54 : at + 62])
        return int.from_bytes(data[at + 50 : at + 54]), int.from_bytes(data[at + 46 : at + 50]), data[at + 62 : min(at + 62 + entries * width, stop)]
    return None


def parse(data: bytes, chain: int = 2) -> Stream:
    """chain: headers in a row that make a place a frame's start after garbage."""
    out, at, end, locked = Stream(), 0, len(data), False
    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            found, at = _tags(data, at, end)
            out.tags.update(found)
            continue
        if data[at : at + 3] == b"TAG" and end - at == 128:
            for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
                if text := data[at + a : at + b].partition(b"\0")[0].decode("latin-1").rstrip():
                    out.tags.setdefault(name, text)
            break
        first = h = _header(data, at)
        p, left = at, 1 if locked else chain
        while h and left:  # a frame counts if it ends in another header of its kind, a last tag or the end
            p, left = p + h[0], left - 1
            if p >= end or end - p == 128 and data[p : p + 3] == b"TAG":
                break
            h = _header(data, p) if left else h
            if h and (h[1], h[4]) != (first[1], first[4]):
                h = None
        if not h or p > end:
            nxt = data.find(b"\xff", at + 1)
            tag = data.find(b"ID3", at + 1, nxt if nxt > 0 else end)
            stop = tag if tag > 0 else nxt if nxt > 0 else end
            if 0 < end - 128 < stop and at < end - 128 and data[end - 128 : end - 125] == b"TAG":
                stop = end - 128
            out.skipped, at, locked = out.skipped + stop - at, stop, False
            continue
        length, rate, side, guarded, samples = first
        body = at + 4 + 2 * guarded + side
        if guarded and crc16(data[at + 2 : at + 4] + data[at + 6 : body]) != int.from_bytes(data[at + 4 : at + 6]):
            out.bad_checksums += 1
        if not out.offsets and not out.vbr and (vbr := _vbr(data, at, body, at + length)):
            out.vbr = vbr
        else:
            out.offsets.append(at)
            out.bodies.append(data[body : at + length])
            out.rate, out.samples = rate, out.samples + samples
        at, locked = at + length, True
    return out


def payload(stream: Stream) -> bytes | None:
    n = stream.tags.get("payload_bytes", "")
    return b"".join(stream.bodies)[: int(n)] if stream.bodies and n.isdigit() else None


def pad(raw: bytes, unit: int = 64) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (binary) of every whole text."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                raws = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raws), pa.int64()), pa.array([write(pad(x)) for x in raws], pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


DECODED = "payload binary, sample_rate int, n_frames long, n_samples long, duration_s double, bad_checksums long, skipped_bytes long, vbr_frames long, vbr_bytes long, seek_offsets array<long>"  # names in lower case


def decode(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's columns with the payload, exact duration, checksum failures and seek offsets of each stream. Columns that have one of
    these names, in any case, are replaced."""
    new = T.StructType.fromDDL(DECODED)
    taken = {f.name for f in new}
    keep = [i for i, f in enumerate(media.schema.fields) if f.name.lower() not in taken]
    schema = T.StructType([*(media.schema.fields[i] for i in keep), *new.fields])
    at = media.columns.index(media_col)
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4, pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for x in part.column(at).to_pylist():
                    s = parse(x or b"")
                    rows.append((payload(s), s.rate or None, len(s.offsets), s.samples, s.samples / s.rate if s.rate else 0.0, s.bad_checksums, s.skipped, s.vbr and s.vbr[0], s.vbr and s.vbr[1], s.offsets))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *cols], schema.names)

    return numbered(media).mapInArrow(run, schema)


def tail_crc32(raw: bytes | None) -> int | None:
    return None if raw is None else zlib.crc32(raw[-64:])


def op7_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    stored = materialize(encode(table(spark, sf_dir, "documents")), "mpeg-audio")
    got = decode(stored)
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(octet_length(payload) - 63, 1), 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string(
            "mpeg1-l3 rate=%d frames=%d samples=%d bad=%d skipped=%d vbr=%d/%d last_seek=%d", "sample_rate", "n_frames", "n_samples", "bad_checksums", "skipped_bytes", "vbr_frames", "vbr_bytes",
            F.element_at("seek_offsets", -1),
        ).alias("feature"),
    )


def brute_force(text: str | None) -> tuple:
    """n_bytes, payload_bytes, payload_sha256 and tail_crc32 that a text must give."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    p = pad(raw)
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), tail_crc32(p)
