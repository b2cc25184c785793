"""MPEG audio columns: building, resynchronising and verifying MPEG-1 layer III streams.

A payload is stored losslessly in the data areas of protected mono frames (their side information announces no
spectral data, so any decoder plays silence and skips the bytes). In front stand an ID3v2 tag, whose private frame
states the payload's length and CRC-32, and a variable-bitrate header frame with frame and byte counts and the table
of contents. All frames but the last use the largest bitrate; the last one uses the smallest that holds the rest.

The reader takes any stream of layer III (MPEG-1, 2 and 2.5): it reads ID3v2 (2.2 to 2.4, text frames and footer) and
ID3v1 tags, looks for two consistent headers in a row when it loses step, checks the CRC-16 of protected frames, and
returns exact durations (samples over rate) and the byte offset of every frame. Of a variable-bitrate table (Xing, Info
or VBRI) it reads frame and byte counts, quality and the table of contents, and holds them against the frames walked:
`vbr_ok` says whether counts agree and every entry of the table lies within a step of the frame it stands for (null
without a table). `seek_offset` looks up a time in the offsets walked, or in the table alone. Frames of free format are
no frames here: they are skipped bytes.

Defined results. Null text is an empty one; a payload has at least one unit of 192 bytes. Equal texts give equal
columns whatever their row. Null ids stay null. Damaged streams keep what frames remain, with `crc_errors`,
`skipped_bytes` and a null payload if the stated length or CRC is not met. Very long texts are one stream. Empty
tables give empty results; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import small_batches, written

# Fixed values of the format: bitrates in kbit/s (MPEG-1 layer III; MPEG-2 and 2.5 layer III) and sampling rates in Hz
RATES_1 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ_1 = (44100, 48000, 32000)

UNIT = 192
HZ = 32000
SIDE = 17  # bytes of side information of a mono MPEG-1 frame
OVERHEAD = 4 + 2 + SIDE
SIZES = [144 * r * 1000 // HZ for r in RATES_1]
OWNER = b"keyloom.payload\x00"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, samples long, sample_rate int, duration_ms double, crc_errors int, skipped_bytes long, seek_offsets array<int>, vbr_kind string, vbr_frames long, vbr_bytes long, vbr_quality int, vbr_ok boolean, tags map<string,string>, feature string"


def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, from 0xFFFF, most significant bit first."""
    c = 0xFFFF
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def header(rate_index: int, protected: bool) -> bytes:
    """Four header bytes: MPEG-1 layer III, 32 kHz, mono."""
    return bytes((0xFF, 0xFA if protected else 0xFB, (rate_index + 1) << 4 | 2 << 2, 3 << 6))


PREFIXES = [h + crc16(h[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) for h in (header(k, True) for k in range(14))]


@dataclass(frozen=True)
class Frame:
    size: int
    samples: int
    hertz: int
    side: int
    protected: bool
    kbps: int


_FRAMES: dict[bytes, Frame | None] = {}


def frame_of(head: bytes) -> Frame | None:
    """What a four-byte header says; None if it is not a layer III header."""
    if head in _FRAMES:
        return _FRAMES[head]
    out = None
    if len(head) == 4 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0:
        version, layer = head[1] >> 3 & 3, head[1] >> 1 & 3
        rate, hertz, padding, mono = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1, head[3] >> 6 == 3
        if version != 1 and layer == 1 and 0 < rate < 15 and hertz < 3:
            hz = HERTZ_1[hertz] >> {3: 0, 2: 1, 0: 2}[version]
            kbps = (RATES_1 if version == 3 else RATES_2)[rate - 1]
            samples = 1152 if version == 3 else 576
            side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
            out = Frame(samples // 8 * kbps * 1000 // hz + padding, samples, hz, side, not head[1] & 1, kbps)
    if len(_FRAMES) < 4096:
        _FRAMES[head] = out
    return out


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3(payload: bytes) -> bytes:
    body = OWNER + len(payload).to_bytes(8, "big") + zlib.crc32(payload).to_bytes(4, "big")
    frame = b"PRIV" + len(body).to_bytes(4, "big") + b"\x00\x00" + body
    return b"ID3\x03\x00\x00" + synchsafe(len(frame)) + frame


def encode(payload: bytes) -> bytes:
    """The stream that holds a payload."""
    top = len(SIZES) - 1
    room = SIZES[top] - OVERHEAD
    whole, rest = divmod(len(payload), room)
    parts = []
    if whole:
        grid = np.empty((whole, SIZES[top]), np.uint8)
        grid[:, :OVERHEAD] = np.frombuffer(PREFIXES[top], np.uint8)
        grid[:, OVERHEAD:] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
        parts.append(grid.tobytes())
    if rest:
        k = bisect_left(SIZES, rest + OVERHEAD)
        parts.append(PREFIXES[k] + payload[whole * room :] + bytes(SIZES[k] - OVERHEAD - rest))
    audio = b"".join(parts)
    frames = whole + bool(rest)
    total = SIZES[0] + len(audio)
    toc = bytes(min(255, 256 * (SIZES[0] + min(frames * p // 100 * SIZES[top], len(audio))) // total) for p in range(100))
    info = b"Xing" + (15).to_bytes(4, "big") + frames.to_bytes(4, "big") + total.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    first = header(0, False) + bytes(SIDE) + info
    return id3(payload) + first + bytes(SIZES[0] - len(first)) + audio


@dataclass
class Table:
    """A variable-bitrate table: counts are None where not stated; points are bytes from the table's frame at equal shares
    of the time."""

    kind: str
    frames: int | None = None
    size: int | None = None
    quality: int | None = None
    points: list[int] = field(default_factory=list)


@dataclass
class Stream:
    payload: bytes | None = None
    frames: int = 0
    samples: int = 0
    hertz: int = 0
    crc_errors: int = 0
    skipped: int = 0
    offsets: list[int] = field(default_factory=list)
    kbps: set[int] = field(default_factory=set)
    table: Table | None = None
    table_ok: bool | None = None
    tags: dict[str, str] = field(default_factory=dict)


def unsynchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3_text(body: bytes) -> str:
    """The text of a text frame: its first byte names the encoding."""
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return body[1:].decode(codec, "replace").rstrip("\x00")


def read_id3(data: bytes) -> tuple[int, list[tuple[str, bytes]]]:
    """(length of the ID3v2 tag, its frames) at the beginning of a stream; an unreadable frame ends them."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 0x7F:
        return 0, []
    version, flags, size = data[3], data[5], unsynchsafe(data[6:10])
    body, frames, at = data[10 : 10 + size], [], 0
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and len(body) >= 4:  # an extended header
        at = unsynchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        raw = body[at + name : at + 2 * name]
        n = unsynchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        if at + head + n > len(body):
            break
        frames.append((body[at : at + name].decode("latin-1"), body[at + head : at + head + n]))
        at += head + n
    return 10 + size + (10 if version == 4 and flags & 0x10 else 0), frames


def private(frames: list[tuple[str, bytes]]) -> tuple[int, int] | None:
    """Length and CRC-32 of the payload, from the private frame of that owner."""
    for name, body in frames:
        if name == "PRIV" and body.startswith(OWNER) and len(body) == len(OWNER) + 12:
            return int.from_bytes(body[-12:-4], "big"), int.from_bytes(body[-4:], "big")
    return None


def id3v1(tag: bytes) -> dict[str, str]:
    """Title, artist, album and year of the 128 bytes at the end of a stream."""
    fields = {"TIT2": tag[3:33], "TPE1": tag[33:63], "TALB": tag[63:93], "TYER": tag[93:97]}
    return {k: t for k, v in fields.items() if (t := v.split(b"\x00")[0].decode("latin-1").strip())}


def table_of(frame: bytes, f: Frame) -> Table | None:
    """The variable-bitrate table in a frame, if it holds one."""
    number = lambda at, n=4: int.from_bytes(frame[at : at + n], "big")
    at = 4 + 2 * f.protected + f.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out, flags, at = Table(frame[at : at + 4].decode()), number(at + 4), at + 8
        if flags & 1:
            out.frames, at = number(at), at + 4
        if flags & 2:
            out.size, at = number(at), at + 4
        if flags & 4:
            toc, at = frame[at : at + 100], at + 100
            out.points = [x * (out.size or 0) // 256 for x in toc] if out.size and len(toc) == 100 else []
        if flags & 8 and at + 4 <= len(frame):
            out.quality = number(at)
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out = Table("VBRI", number(50), number(46), number(44, 2))
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        if width in (1, 2, 4) and 62 + entries * width <= len(frame):
            steps = [number(62 + k * width, width) * scale for k in range(entries)]
            out.points = [f.size, *(f.size + x for x in accumulate(steps))][:entries]
        return out
    return None


def table_agrees(table: Table, start: int, end: int, offsets: list[int]) -> bool:
    """Whether a table's counts are those of the frames walked, and each of its points at most two steps of the table or
    two frames from its frame."""
    if table.frames is not None and table.frames != len(offsets) or table.size is not None and table.size not in (end - start, end - (offsets[0] if offsets else end)):
        return False
    if not table.points or not offsets:
        return True
    share = len(table.points)
    slack = 2 * max((end - start) // 256 + 1, *(b - a for a, b in pairwise([*offsets, end])))
    return all(abs(start + x - offsets[min(k * len(offsets) // share, len(offsets) - 1)]) <= slack for k, x in enumerate(table.points))


def seek_offset(ms: float, duration_ms: float, offsets: list[int] | None, table: Table | None = None, start: int = 0) -> int | None:
    """Byte to start reading at for a time: the frame that holds it, or the table's point at or before it."""
    points = offsets or (table and [start + x for x in table.points])
    if not points or duration_ms <= 0 or not 0 <= ms < duration_ms:
        return None
    return points[int(ms * len(points) / duration_ms)]


_CRCS: dict[bytes, int] = {}


def protected_ok(data: bytes, at: int, f: Frame) -> bool:
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + f.side]
    c = _CRCS.get(covered)
    if c is None:
        c = crc16(covered)
        if len(_CRCS) < 4096:
            _CRCS[covered] = c
    return c == int.from_bytes(data[at + 4 : at + 6], "big")


def followed(data: bytes, at: int, f: Frame, end: int) -> bool:
    """Whether a frame ends where the stream does, or where a header of its sampling rate stands."""
    after = at + f.size
    g = frame_of(data[after : after + 4])
    return after == end or g is not None and g.hertz == f.hertz


def decode(data: bytes) -> Stream:
    """Walk a stream from tag to tag. A header counts if its frame's checksum holds or another one follows the frame;
    lost step is found again at the next header that one follows."""
    out, stated, parts, end = Stream(), None, [], len(data)
    at, frames = read_id3(data)
    stated = private(frames)
    out.tags = {k: id3_text(v) for k, v in frames if k[0] == "T" and k[:3] != "TXX"}
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.tags = id3v1(data[end - 128 : end]) | out.tags
        end -= 128
    start = at
    first = True
    while at + 4 <= end:
        f = frame_of(data[at : at + 4])
        sound = f is not None and at + f.size <= end and f.protected and protected_ok(data, at, f)
        if f is None or at + f.size > end or not (sound or followed(data, at, f, end)):
            to = data.find(b"\xff", at + 1, end)
            while to >= 0:
                g = frame_of(data[to : to + 4])
                if g and followed(data, to, g, end):
                    break
                to = data.find(b"\xff", to + 1, end)
            out.skipped += (to if to >= 0 else end) - at
            at = to if to >= 0 else end
            continue
        body = at + 4 + 2 * f.protected + f.side
        if first and (table := table_of(data[at : at + f.size], f)):
            out.table, start = table, at
        else:
            out.crc_errors += f.protected and not sound
            out.frames += 1
            out.samples += f.samples
            out.hertz = f.hertz
            out.offsets.append(at)
            out.kbps.add(f.kbps)
            parts.append(data[body : at + f.size])
        first = False
        at += f.size
    out.skipped += max(0, end - at)
    if out.table:
        out.table_ok = table_agrees(out.table, start, end, out.offsets)
    if stated is not None:
        payload = b"".join(parts)[: stated[0]]
        if len(payload) == stated[0] and zlib.crc32(payload) == stated[1]:
            out.payload = payload
    return out


def padded(text: bytes) -> bytes:
    n = max(1, -(-len(text) // UNIT)) * UNIT
    return text.ljust(n, b" ")


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stored streams."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, held, start = [], [], 0, 0
            for k, t in enumerate(batch.column(1)):
                body = t.as_py() or b""
                sizes.append(len(body))
                media.append(encode(padded(body)))
                held += len(body)
                if held >= 16 << 20 or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    sizes, media, held, start = [], [], 0, k + 1

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def describe(media: bytes, n_bytes: int) -> tuple:
    s = decode(media)
    payload, t = s.payload, s.table or Table("none")
    ms = 1000 * s.samples / s.hertz if s.hertz else 0.0
    seek = zlib.crc32(np.array(s.offsets, "<u4").tobytes())
    feature = f"frames={s.frames};samples={s.samples};hz={s.hertz};kbps={min(s.kbps, default=0)}-{max(s.kbps, default=0)};vbr_frames={t.frames};vbr_ok={s.table_ok};crc_errors={s.crc_errors};skipped={s.skipped};seek={seek:08x}"
    sha = payload is not None and hashlib.sha256(payload).hexdigest() or None
    return (n_bytes, None if payload is None else len(payload), sha, None if payload is None else zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), s.frames, s.samples, s.hertz, ms, s.crc_errors, s.skipped, s.offsets, s.table and t.kind, t.frames, t.size, t.quality, s.table_ok, list(s.tags.items()), feature)


def features(media: DataFrame) -> DataFrame:
    """Columns FEATURES of stored streams (doc_id, n_bytes, media)."""
    small_batches(media)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in FEATURES.split(", "))]  # the map's type holds no space
        for batch in batches:
            rows = [describe(m.as_py() or b"", n) for m, n in zip(batch.column(2), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, {FEATURES}")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the streams in the shared folder and describe them as read back."""
    return features(written(store(docs, doc_id, text), "media"))
