"""EXIF metadata of image bytes: a small reader of TIFF directories in JPEG, PNG, WebP and TIFF files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes per value of the TIFF types 1 to 12.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMAT = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}
MAKE, MODEL, ORIENTATION, EXIF_DIR, GPS_DIR = 0x010F, 0x0110, 0x0112, 0x8769, 0x8825
EXPOSURE, F_NUMBER, ISO, TAKEN, FOCAL, LENS = 0x829A, 0x829D, 0x8827, 0x9003, 0x920A, 0xA434
METADATA = "width int, height int, orientation int, taken_at double, camera_make string, camera_model string, lens string, iso int, f_number double, exposure double, focal_length double, gps_lat double, gps_lon double"


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure with the EXIF directories inside an image file."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                block = data[at + 8 : at + 8 + size]
                return block[6:] if block[:6] == b"Exif\0\0" else block
            at += 8 + size + size % 2
    elif data[:4] in (b"II*\0", b"MM\0*"):
        return data
    return None


def directory(block: bytes, offset: int) -> dict[int, object]:
    """Tag -> value (text, number or tuple of numbers) of one directory; damaged entries are left out."""
    order = "<" if block[:2] == b"II" else ">"
    out: dict[int, object] = {}
    try:
        (count,) = struct.unpack_from(order + "H", block, offset)
        for k in range(min(count, 512)):
            tag, kind, n = struct.unpack_from(order + "HHI", block, offset + 2 + 12 * k)
            size = TYPE_SIZE.get(kind, 0) * n
            if not size or size > len(block):
                continue
            at = offset + 10 + 12 * k
            if size > 4:
                (at,) = struct.unpack_from(order + "I", block, at)
            raw = block[at : at + size]
            if len(raw) < size:
                continue
            if kind == 2:
                out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
                values = tuple(a / b if b else None for a, b in zip(pairs[::2], pairs[1::2]))
                out[tag] = values[0] if n == 1 else values
            elif kind in FORMAT:
                values = struct.unpack(order + FORMAT[kind] * n, raw)
                out[tag] = values[0] if n == 1 else values
            else:
                out[tag] = raw
    except struct.error:
        pass
    return out


def image_size(data: bytes) -> tuple[int | None, int | None]:
    """(width, height) from the header of PNG, GIF, BMP and JPEG files."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) else None


def _whole(x: object) -> int | None:
    x = x[0] if isinstance(x, tuple) and x else x
    return int(x) if isinstance(x, (int, float)) else None


def _text(x: object) -> str | None:
    return (x.strip().strip("\0").strip() or None) if isinstance(x, str) else None


def _degrees(dms: object, ref: object) -> float | None:
    if not (isinstance(dms, tuple) and len(dms) >= 3 and all(isinstance(v, (int, float)) for v in dms[:3])):
        return None
    value = dms[0] + dms[1] / 60 + dms[2] / 3600
    return -value if isinstance(ref, str) and ref.upper() in ("S", "W") else value


def _epoch(x: object) -> float | None:
    try:
        return datetime.strptime(x.strip(), "%Y:%m:%d %H:%M:%S").replace(tzinfo=UTC).timestamp()
    except (AttributeError, ValueError):
        return None


def read_metadata(data: bytes) -> tuple:
    """The columns of METADATA; what can't be read is None, and no file is an error."""
    width, height = image_size(data)
    block = tiff_block(data)
    if not block or len(block) < 8:
        return (width, height) + (None,) * 11
    order = "<" if block[:2] == b"II" else ">"
    main = directory(block, struct.unpack_from(order + "I", block, 4)[0])
    sub = directory(block, main[EXIF_DIR]) if isinstance(main.get(EXIF_DIR), int) else {}
    gps = directory(block, main[GPS_DIR]) if isinstance(main.get(GPS_DIR), int) else {}
    return (
        width, height, _whole(main.get(ORIENTATION)), _epoch(sub.get(TAKEN)), _text(main.get(MAKE)), _text(main.get(MODEL)), _text(sub.get(LENS)), _whole(sub.get(ISO)),
        _number(sub.get(F_NUMBER)), _number(sub.get(EXPOSURE)), _number(sub.get(FOCAL)), _degrees(gps.get(2), gps.get(1)), _degrees(gps.get(4), gps.get(3)),
    )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "content_hash", *(f.split()[0] for f in METADATA.split(", "))]
    for b in batches:
        yield pd.DataFrame([(p, h, *read_metadata(bytes(c))) for p, h, c in zip(b["path"], b["content_hash"], b["content"])], columns=names).astype(object)


def file_metadata(files: DataFrame) -> DataFrame:
    """(path, content_hash, METADATA) of files (path, content): digest and EXIF from one read of each."""
    rows = files.select("path", F.sha2("content", 256).alias("content_hash"), "content")
    return rows.mapInPandas(_read, f"path string, content_hash string, {METADATA}")
