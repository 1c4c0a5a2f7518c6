"""Media columns as MPEG transport streams: writing, and parsing with tables, continuity, timestamps and access points.

A stream is a sequence of 188-byte packets of ISO/IEC 13818-1: a program association table and a program map table,
then the elementary stream in PES packets. Each PES packet is an access unit of a fixed number of samples with a
presentation time stamp; its first transport packet carries the clock reference and the random-access flag. Eight-bit
samples at 8000 Hz are stored as private data, so that any bytes are kept as they are.

The media table holds the streams with their time stamps and random-access points as columns beside them, so that a
time is looked up without parsing, and parsing starts at its access point.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, STREAM_ID, STREAM_TYPE = 0x0000, 0x1000, 0x0100, 0xBD, 0x06
CLOCK, RATE = 90_000, 8_000
UNIT_BYTES = 8_000  # a second of samples
BODY = PACKET - 4


def _crc_table() -> np.ndarray:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, not reflected."""
    table = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        table = np.where(table & np.uint32(1 << 31), (table << np.uint32(1)) ^ np.uint32(0x04C11DB7), table << np.uint32(1)).astype(np.uint32)
    return table


CRC_TABLE = _crc_table().tolist()


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ CRC_TABLE[crc >> 24 ^ b]
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(
    PMT_PID,
    _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _time_stamp(t: int) -> bytes:
    """33 bits in five bytes with marker bits, after the prefix 0010."""
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def mux(payload: bytes, unit: int = UNIT_BYTES) -> bytes:
    """The transport stream of a payload; every unit of ``unit`` bytes can be reached at random."""
    out, counter = [PAT, PMT], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        part = payload[at : at + unit]
        pts = (at * CLOCK // RATE) % (1 << 33)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time_stamp(pts) + part
        # First packet: adaptation field of 7 bytes at least, with random access and clock reference.
        room = BODY - 8
        first, rest = pes[:room], pes[room:]
        field_bytes = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        stuffing = room - len(first)
        head = bytes([SYNC, 0x40 | MEDIA_PID >> 8, MEDIA_PID & 255, 0x30 | counter, 7 + stuffing])
        out.append(head + field_bytes + b"\xff" * stuffing + first)
        counter = counter + 1 & 15
        whole, left = divmod(len(rest), BODY)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, :3] = (SYNC, MEDIA_PID >> 8, MEDIA_PID & 255)
            packets[:, 3] = 0x10 | (counter + np.arange(whole) & 15)
            packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * BODY).reshape(whole, BODY)
            out.append(packets.tobytes())
            counter = counter + whole & 15
        if left:
            gap = BODY - left  # at least one byte: the field's length, then its flags and stuffing
            field_bytes = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
            out.append(bytes([SYNC, MEDIA_PID >> 8, MEDIA_PID & 255, 0x30 | counter]) + field_bytes + rest[whole * BODY :])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a parse finds of the first elementary stream of the first program."""

    packets: int = 0
    stream_pid: int = -1
    stream_type: int = -1
    streams: list[tuple[int, int]] = field(default_factory=list)  # (type, PID) of all programs
    gaps: int = 0  # places where the continuity counter doesn't go on
    duplicates: int = 0  # packets sent twice, which the standard allows; left out
    bad: int = 0  # packets and units that break the format
    payload: bytes = b""
    units: int = 0
    pts: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)  # (time stamp, packet number)


#: PES packets without optional header: program map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 type E, directory.
PLAIN_STREAMS, PADDING = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}, 0xBE


def _bodies(rows: np.ndarray, begin: np.ndarray) -> list[tuple[bool, bytes]]:
    return [(bool(r[1] & 0x40), r[b:].tobytes()) for r, b in zip(rows, begin.tolist())]


def sections(packets: list[tuple[bool, bytes]]) -> list[bytes]:
    """The whole sections with right checksums of one PID, whichever packets they are spread over; from (whether a
    section starts here, payload) of its packets."""
    found, held = [], b""

    def drain(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
            if len(data) < size:
                return data
            if size >= 12 and section_crc(data[:size]) == 0:
                found.append(data[:size])
            data = data[size:]
        return data if len(data) < 3 and data[:1] != b"\xff" else b""

    for starts, body in packets:
        if starts and body:
            pointer = body[0]
            if held:
                drain(held + body[1 : 1 + pointer])
            held = drain(body[1 + pointer :])
        elif held:
            held = drain(held + body)
    return found


def _programs(section: bytes) -> list[int]:
    body = section[8:-4]
    return [int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body) - 3, 4) if body[i : i + 2] != b"\0\0"]


def _streams(section: bytes) -> list[tuple[int, int]]:
    body, found = section[8:-4], []
    at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
    while at + 5 <= len(body):
        found.append((body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0x0FFF)
    return found


def demux(media: bytes, start: int = 0, pid: int | None = None) -> Stream:
    """Parses the tables, checks continuity counters, reassembles PES packets and lists time stamps and access points.

    Any bytes are taken. A trailing part of a packet counts as bad; so do packets without sync byte, with the error
    flag, without payload or adaptation field, or with a field longer than the packet, and all these are left out.
    Units that don't begin with a start code, or whose header doesn't fit, count as bad and are left out; units that
    are shorter or longer than they say count as bad, and what they have up to their length is kept. Of tables that
    are sent again the first whole ones count. With ``start`` and ``pid`` parsing begins at that packet, without tables.
    """
    found = Stream()
    n = len(media) // PACKET
    rows = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)[start:]
    control = rows[:, 3] >> 4 & 3
    field_size = np.where(control & 2 > 0, rows[:, 4].astype(np.int32) + 1, 0)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0) & (control > 0) & (field_size <= BODY)
    found.packets, found.bad = n, int((~good).sum()) + (len(media) % PACKET > 0)
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    begin = np.where(control & 1 > 0, 4 + field_size, PACKET)

    def of(p: int) -> list[bytes]:
        at = np.flatnonzero(good & (pids == p))
        return sections(_bodies(rows[at], begin[at])) if len(at) else []

    if pid is None:
        programs = dict.fromkeys(p for s in of(PAT_PID) if s[0] == 0 and s[5] & 1 for p in _programs(s))
        for p in programs:
            table = next((s for s in of(p) if s[0] == 2 and s[5] & 1), None)
            found.streams += _streams(table) if table else []
        if found.streams:
            found.stream_type, found.stream_pid = found.streams[0]
    else:
        found.stream_pid = pid
    at = np.flatnonzero(good & (pids == found.stream_pid))
    if found.stream_pid < 0 or not len(at):
        return found
    # A packet with payload may come twice, the clock reference apart.
    again = np.zeros(len(at), dtype=bool)
    maybe = np.flatnonzero((rows[at[1:], 3] == rows[at[:-1], 3]) & (control[at[1:]] & 1 > 0)) + 1
    again[maybe] = [bool((rows[at[k], begin[at[k]] :] == rows[at[k - 1], begin[at[k]] :]).all()) and begin[at[k]] == begin[at[k - 1]] for k in maybe.tolist()]
    found.duplicates = int(again.sum())
    at = at[~again]
    own, begin = rows[at], begin[at]
    flags = np.where(field_size[at] > 1, own[:, 5], 0)
    count = (own[:, 3] & 15).astype(np.int16)
    steps = (count[1:] - count[:-1] & 15) != (control[at[1:]] & 1)
    found.gaps = int((steps & (flags[1:] & 0x80 == 0)).sum())
    body = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    first = np.flatnonzero(own[:, 1] & 0x40 > 0)
    if len(first) == 0 or first[0] > 0 and ends[first[0] - 1] > 0:
        found.bad += 1  # what comes before the first unit
    parts = []
    for k, i in enumerate(first.tolist()):
        lo = int(ends[i - 1]) if i else 0
        hi = int(ends[first[k + 1] - 1]) if k + 1 < len(first) else int(ends[-1])
        pes = body[lo:hi]
        plain = len(pes) >= 6 and pes[3] in PLAIN_STREAMS
        skip = 6 if plain else 9 + pes[8] if len(pes) >= 9 else len(pes) + 1
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or skip > len(pes) or length and skip > 6 + length:
            found.bad += 1
            continue
        found.bad += length > 0 and len(pes) != 6 + length
        stamp = -1
        if not plain and pes[7] & 0x80 and pes[8] >= 5:
            stamp = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
            found.pts.append(stamp)
        if flags[i] & 0x40:
            found.access_points.append((stamp, start + int(at[i])))
        if pes[3] != PADDING:
            parts.append(pes[skip : 6 + length if length else len(pes)])
        found.units += 1
    found.payload = b"".join(parts)
    return found


def seek(points: list[tuple[int, int]], stamp: int) -> int:
    """The packet number of the last of the access points (time stamp, packet) at or before a time stamp; the first one
    if there is none before, 0 without points."""
    return max((p for p in points if p[0] <= stamp), default=min(points, default=(0, 0)))[1]


def seek_packet(stamp: Column, points: str = "points") -> Column:
    """seek() over the stored column of access points; streams need not be read for it."""
    before = F.array_sort(F.filter(F.col(points), lambda p: p["pts"] <= stamp))
    return F.coalesce(F.try_element_at(before, F.lit(-1))["packet"], F.try_element_at(F.array_sort(F.col(points)), F.lit(1))["packet"], F.lit(0))


def padded(text: bytes, multiple: int = 64) -> bytes:
    return text + b"\0" * (-len(text) % multiple if text else multiple)


MEDIA = "doc_id long, n_bytes long, media binary, stream_pid int, pts array<long>, points array<struct<pts:bigint,packet:int>>"


def _muxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int32())])))
    for batch in c.text_slices(batches):
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        media = [mux(padded(t)) for t in raw]
        parsed = [demux(m) for m in media]
        columns = ([*map(len, raw)], media, [s.stream_pid for s in parsed], [s.pts for s in parsed], [[{"pts": t, "packet": p} for t, p in s.access_points] for s in parsed])
        names = ("n_bytes", "media", "stream_pid", "pts", "points")
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {n: pa.array(v, k) for n, v, k in zip(names, columns, kinds)})


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the media column of every row of ``docs`` (doc_id, text), and the stream's PID, time stamps and
    access points; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_muxed, MEDIA)


def describe(s: Stream) -> str:
    """A short description: tables, continuity, time line, access points, level and spread of the samples."""
    samples = np.frombuffer(s.payload, np.uint8)
    level, spread = (float(samples.mean()), float(samples.std())) if len(samples) else (0.0, 0.0)
    last = s.pts[-1] if s.pts else 0
    return (
        f"packets={s.packets};pid={s.stream_pid};type={s.stream_type};gaps={s.gaps};bad={s.bad};duplicates={s.duplicates};units={s.units};first_pts={s.pts[0] if s.pts else -1};"
        f"last_pts={last};points={len(s.access_points)};last_point={s.access_points[-1][1] if s.access_points else -1};mean={level:.3f};std={spread:.3f}"
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.text_slices(batches, column="media"):
        media = batch.column("media").to_pylist()
        streams = [demux(m or b"") for m in media]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"),
                "payload_bytes": pa.array([len(s.payload) for s in streams], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(s.payload).hexdigest() for s in streams], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(s.payload[-64:]) for s in streams], pa.int64()),
                "media_bytes": pa.array([len(m or b"") for m in media], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m or b"").hexdigest() for m in media], pa.string()),
                "feature": pa.array(map(describe, streams), pa.string()),
            }
        )


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, n_bytes, media) say: payload, digests and a description of the stream."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)


def media_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores every text as a transport stream in a table, in the shared folder unless ``path`` is given, and reads the
    stored streams again; one row per row of ``docs``, no shuffle.

    Null and empty texts give a payload of 64 zero bytes. Repeated rows and null ids are handled like any other.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{c.shared_dir(spark)}/media"
    to_media(docs).write.option("compression", "zstd").parquet(path)
    return media_features(spark.read.schema(MEDIA).parquet(path))
