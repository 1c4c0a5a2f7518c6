"""Column expressions: vectors, hashes, geography, EXIF fields, scores. All run in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..config import EARTH_KM

Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- vectors -------------------------------------------------------------------------------------------------------


def dot(a: Name, b: Name) -> Column:
    """Dot product in double precision; null if either is null or lengths differ."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Name) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Name, floor: float | None = None) -> Column:
    """L2-normalised; a zero vector stays as it is, or is divided by ``floor`` if one is given."""
    n = norm(v)
    by = F.greatest(n, F.lit(floor)) if floor else F.when(n > 0, n).otherwise(1.0)
    return F.transform(col(v), lambda x: x.cast("double") / by)


def literal_vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


# --- 64-bit hashes ---------------------------------------------------------------------------------------------------


def hamming64(a: Name, b: Name) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b))).cast("int")


def unsigned_key(h: Name) -> Column:
    """Signed longs in the order of the unsigned numbers that they hold."""
    return col(h).bitwiseXOR(F.lit(-(1 << 63)))


def pack_bits(flags: Name) -> Column:
    """64 booleans as a signed long, the first one the most significant."""
    places = F.zip_with(col(flags), F.sequence(F.lit(63), F.lit(0)), lambda f, k: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(places, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def median_hash(v: Name) -> Column:
    """The perceptual hash's bit rule over any array of 64 numbers: a bit is 1 where the value is above the median."""
    s = F.array_sort(F.transform(col(v), lambda x: x.cast("double")))
    middle = (F.element_at(s, 32) + F.element_at(s, 33)) / 2
    return pack_bits(F.transform(col(v), lambda x: x.cast("double") > middle))


# --- geography -------------------------------------------------------------------------------------------------------


def haversine_km(lat1: Name, lon1: Name, lat2: Name, lon2: Name) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    # least() skips nulls, so that a missing coordinate has to be asked for.
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def bbox(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """(south, west, north, east) around a circle; the cosine has a floor of 0.01 and nothing wraps at the date line."""
    reach = math.degrees(radius_km / EARTH_KM)
    wide = math.degrees(radius_km / (EARTH_KM * max(0.01, math.cos(math.radians(lat)))))
    return lat - reach, lon - wide, lat + reach, lon + wide


def within(lat: Name, lon: Name, center: tuple[float, float], radius_km: float) -> Column:
    """Inside a circle: a box, which the scan can use, and the exact distance."""
    south, west, north, east = bbox(*center, radius_km)
    box = col(lat).between(south, north) & col(lon).between(west, east)
    return box & (haversine_km(F.lit(center[0]), F.lit(center[1]), lat, lon) <= radius_km)


def dms_to_degrees(dms: Name, ref: Name) -> Column:
    """Degrees, minutes and seconds (an array) with a hemisphere letter; S and W are negative."""
    value = F.get(col(dms), 0).cast("double") + F.get(col(dms), 1).cast("double") / 60 + F.get(col(dms), 2).cast("double") / 3600
    return F.when(F.upper(col(ref)).isin("S", "W"), -value).otherwise(value)


def place_label(name: Name, country: Name) -> Column:
    return F.when(F.coalesce(col(country), F.lit("")) != "", F.concat(col(name), F.lit(", "), col(country))).otherwise(col(name))


# --- dates -----------------------------------------------------------------------------------------------------------


def exif_epoch(text: Name) -> Column:
    """'YYYY:MM:DD HH:MM:SS' as UTC epoch seconds; null for anything else."""
    stamp = F.try_to_timestamp(F.trim(col(text)), F.lit("yyyy:MM:dd HH:mm:ss"))
    return stamp.cast("double")


def epoch(ts: Name) -> Column:
    """Epoch seconds with fractions of a timestamp of either kind; the session is in UTC."""
    return col(ts).cast("timestamp").cast("double")


def day_key(seconds: Name) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(col(seconds))), "yyyy-MM-dd")


# --- strings and paths -----------------------------------------------------------------------------------------------


def clean_string(s: Name) -> Column:
    """Blanks and NULs off both ends; an empty string is null."""
    return F.nullif(F.regexp_replace(col(s), r"^[\s\x00]+|[\s\x00]+$", ""), F.lit(""))


def filename(path: Name) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def folder(path: Name) -> Column:
    return F.regexp_replace(col(path), r"/[^/]*$", "")


def extension(path: Name) -> Column:
    return F.lower(F.regexp_extract(filename(path), r".(\.[^.]*)$", 1))


def shard_path(digest: Name, suffix: str = "webp") -> Column:
    """ab/cd/abcd....webp"""
    h = col(digest)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.concat(h, F.lit(f".{suffix}")))


# --- scores ----------------------------------------------------------------------------------------------------------


def saturating(x: Name, scale: float) -> Column:
    return 1 - F.exp(-F.greatest(col(x), F.lit(0.0)) / F.lit(float(scale)))


def resolution(width: Name, height: Name) -> Column:
    return F.coalesce(col(width), F.lit(0)).cast("long") * F.coalesce(col(height), F.lit(0)).cast("long")


def frontalness(points: Name) -> Column:
    """1 where the nose is midway between the eyes; points are (x, y) of left eye, right eye, nose, one after the other."""
    p = [F.get(col(points), k).cast("double") for k in range(6)]
    apart = F.sqrt(F.pow(p[2] - p[0], 2) + F.pow(p[3] - p[1], 2))
    off = F.abs(p[4] - (p[0] + p[2]) / 2) / (apart / 2)
    return F.when(apart < 1e-3, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.least(off, F.lit(1.0))))


def face_quality(det_score: Name, points: Name, blur_variance: Name, width: Name, height: Name) -> Column:
    """Detector score, pose, sharpness (500 counts as sharp) and size (112 pixels count as full)."""
    sharp = F.least(F.coalesce(col(blur_variance), F.lit(0.0)) / 500.0, F.lit(1.0))
    size = F.least(F.least(col(width), col(height)) / 112.0, F.lit(1.0))
    return 0.4 * col(det_score) + 0.2 * frontalness(points) + 0.2 * sharp + 0.2 * size


def percentile_rank(value: Name, scope: list[str]) -> Column:
    """Average rank scaled to 0..1 inside a scope: ties share the mean of their ranks; a lone row gets 0.5."""
    of_scope = Window.partitionBy(*scope)
    ties = F.count("*").over(Window.partitionBy(*scope, col(value)))
    rank = F.rank().over(of_scope.orderBy(col(value))) - 1 + (ties - 1) / 2
    n = F.count("*").over(of_scope)
    return F.when(n > 1, rank / (n - 1)).otherwise(F.lit(0.5))


def reasons(cases: list[tuple[Column, Column | str]], default: str) -> Column:
    """The texts of the cases that hold, joined by commas; the default if none does."""
    texts = F.array(*(F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in cases))
    return F.coalesce(F.nullif(F.array_join(F.array_compact(texts), ", "), F.lit("")), F.lit(default))


def over_cap(size: Name, cap: Name) -> Column:
    return F.coalesce(col(size) > col(cap), F.lit(False))


def best_first(quality: Name = "quality", aesthetic: Name = "aesthetic", width: Name = "width", height: Name = "height", key: Name = "id") -> Column:
    """The rank of a group's representative: quality, aesthetic score, resolution, then the smallest id."""
    return F.struct(F.coalesce(col(quality), F.lit(0.0)), F.coalesce(col(aesthetic), F.lit(0.0)), resolution(width, height), -col(key))
