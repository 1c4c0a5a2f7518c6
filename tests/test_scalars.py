import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.functions import pixels
from shoebox.functions import scalars as fn
from shoebox.sources import exif


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_vectors(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(-1, 1) for _ in range(8)], [rng.uniform(-1, 1) for _ in range(8)]) for _ in range(20)] + [([0.0] * 8, [1.0] * 8), (None, [1.0])]
    for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", fn.dot("a", "b").alias("d"), fn.unit("a").alias("u")).collect():
        if r.a is None:
            assert r.d is None and r.u is None
            continue
        assert r.d == pytest.approx(np.dot(r.a, r.b))
        n = np.linalg.norm(r.a)
        assert r.u == pytest.approx(list(np.array(r.a) / (n or 1)))


def test_hamming_and_unsigned_order(spark):
    got = [one(spark, fn.hamming64(F.lit(a).cast("long"), F.lit(b).cast("long"))) for a, b in ((0, 0), (0, 1), (-1, 0))]
    assert got == [0, 1, 64]
    values = [0, 1, -1, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "h long").orderBy(fn.unsigned_key("h")).collect()
    assert [r.h for r in rows] == sorted(values, key=lambda v: v % (1 << 64))


def test_median_hash(spark):
    rng = np.random.default_rng(0)
    for v in rng.normal(size=(5, 64)):
        bits = v > np.median(v)
        want = int(np.packbits(bits).view(">i8")[0])
        assert one(spark, fn.median_hash(fn.literal_vector(v))) == want


def test_geography(spark):
    assert one(spark, fn.haversine_km(F.lit(48.8534), F.lit(2.3488), F.lit(51.5074), F.lit(-0.1278))) == pytest.approx(343.5, abs=1)
    assert one(spark, fn.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371)
    south, west, north, east = fn.bbox(89.9, 0, 25)
    assert east - west < 60 and north - south == pytest.approx(2 * math.degrees(25 / 6371))
    assert one(spark, fn.dms_to_degrees(F.array(F.lit(33), F.lit(30), F.lit(36.0)), F.lit("s"))) == pytest.approx(-33.51)
    assert one(spark, fn.dms_to_degrees(F.array(F.lit(33)), F.lit("N"))) is None


def test_dates_and_strings(spark):
    assert one(spark, fn.exif_epoch(F.lit(" 2020:05:17 10:00:01 "))) == 1589709601.0
    assert one(spark, fn.exif_epoch(F.lit("0000:00:00 00:00:00"))) is None and one(spark, fn.exif_epoch(F.lit("x"))) is None
    assert one(spark, fn.day_key(F.lit(86_399.9))) == "1970-01-01"
    assert one(spark, fn.clean_string(F.lit(" \x00a b\x00 "))) == "a b" and one(spark, fn.clean_string(F.lit(" \x00"))) is None
    assert [one(spark, f(F.lit("/a/b/C.x.JPG"))) for f in (fn.folder, fn.filename, fn.extension)] == ["/a/b", "C.x.JPG", ".jpg"]
    assert one(spark, fn.extension(F.lit("/a/.jpg"))) == ""
    assert one(spark, fn.shard_path(F.lit("abcdef"))) == "ab/cd/abcdef.webp"
    assert one(spark, fn.over_cap(F.lit(5), F.lit(None).cast("long"))) is False


def test_percentiles(spark):
    def ranks(*values):
        df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "id long, x double").withColumn("s", F.lit(0))
        return [r.p for r in df.withColumn("p", fn.percentile_rank("x", ["s"])).orderBy("id").collect()]

    assert ranks(10, 20, 30) == [0, 0.5, 1] and ranks(5, 5, 10) == [0.25, 0.25, 1] and ranks(7) == [0.5]


def test_frontalness(spark):
    assert one(spark, fn.frontalness(F.array(*map(F.lit, [0.0, 0.0, 8.0, 0.0, 4.0, 3.0])))) == 1.0
    assert one(spark, fn.frontalness(F.array(*map(F.lit, [0.0, 0.0, 8.0, 0.0, 8.0, 3.0])))) == 0.0
    assert one(spark, fn.frontalness(F.array(*map(F.lit, [1.0, 1.0, 1.0, 1.0, 8.0, 3.0])))) == 0.0


def test_image_scores():
    board = np.kron(np.indices((8, 8)).sum(axis=0) % 2, np.ones((8, 8)))[..., None].repeat(3, 2) * 255
    flat = np.full((64, 64, 3), 128)
    rainbow = np.stack([*np.meshgrid(np.linspace(0, 255, 64), np.linspace(0, 255, 64)), np.full((64, 64), 40.0)], axis=-1)
    s = {n: pixels.image_scores(i) for n, i in (("board", board), ("flat", flat), ("rainbow", rainbow), ("tiny", np.zeros((1, 1, 3))))}
    assert all(0 <= v <= 1 for pair in s.values() for v in pair)
    assert s["board"][0] > s["flat"][0] and s["rainbow"][1] > s["flat"][1]


def test_perceptual_hash_is_stable_under_resizing():
    rng = np.random.default_rng(1)
    image = pixels.resize(rng.uniform(0, 255, (8, 8)), 200, 200)
    a, b = pixels.perceptual_hash(image), pixels.perceptual_hash(pixels.resize(image, 100, 100))
    other = pixels.perceptual_hash(rng.uniform(0, 255, (64, 64)))
    assert ((a ^ b) & (2**64 - 1)).bit_count() <= 6 < ((a ^ other) & (2**64 - 1)).bit_count()
    assert np.allclose(pixels.BASIS @ pixels.BASIS.T, np.eye(32))
    assert pixels.fit_within(1000, 500, 256) == (256, 128) and pixels.fit_within(10, 5, 256) == (10, 5)
    assert pixels.preprocess(rng.uniform(0, 255, (300, 400, 3))).shape == (3, 224, 224)


def tiff(order="<"):
    """A TIFF block with one main, one EXIF and one GPS directory."""
    at = 8

    def directory(items, base):
        body, extra = b"", b""
        start = base + 2 + 12 * len(items) + 4
        for tag, kind, n, raw in items:
            if len(raw) <= 4:
                body += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
            else:
                body += struct.pack(order + "HHII", tag, kind, n, start + len(extra))
                extra += raw
        return struct.pack(order + "H", len(items)) + body + b"\0\0\0\0" + extra

    ratios = lambda *v: b"".join(struct.pack(order + "II", int(x * 1000), 1000) for x in v)
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, ratios(33, 30, 36)), (3, 2, 2, b"E\0"), (4, 5, 3, ratios(151, 12, 0))]
    sub = [(exif.TAKEN, 2, 20, b"2020:05:17 10:00:01\0"), (exif.ISO, 3, 1, struct.pack(order + "H", 200)), (exif.F_NUMBER, 5, 1, ratios(2.8))]
    main = [(exif.MAKE, 2, 5, b"Make\0"), (exif.MODEL, 2, 9, b" Model X\0"), (exif.ORIENTATION, 3, 1, struct.pack(order + "H", 6))]
    size = lambda items: len(directory(items, 0))
    main += [(exif.EXIF_DIR, 4, 1, b"\0" * 4), (exif.GPS_DIR, 4, 1, b"\0" * 4)]
    sub_at = at + size(main)
    gps_at = sub_at + size(sub)
    main[-2:] = [(exif.EXIF_DIR, 4, 1, struct.pack(order + "I", sub_at)), (exif.GPS_DIR, 4, 1, struct.pack(order + "I", gps_at))]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + directory(main, at) + directory(sub, sub_at) + directory(gps, gps_at)


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    block = tiff(order)
    jpeg = b"\xff\xd8\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block + b"\xff\xc0\x00\x0b\x08\x01\xe0\x02\x80\x03"
    got = dict(zip([f.split()[0] for f in exif.METADATA.split(", ")], exif.read_metadata(jpeg)))
    assert got == {"width": 640, "height": 480, "orientation": 6, "taken_at": 1589709601.0, "camera_make": "Make", "camera_model": "Model X", "lens": None, "iso": 200, "f_number": 2.8, "exposure": None, "focal_length": None, "gps_lat": pytest.approx(-33.51), "gps_lon": pytest.approx(151.2)}
    for cut in range(0, len(jpeg), 7):
        exif.read_metadata(jpeg[:cut])  # no damage is an error
