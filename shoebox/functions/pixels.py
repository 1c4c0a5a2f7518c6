"""Features of decoded images: perceptual hash, quality and aesthetic scores, resizing. Arrow batches of whole images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_SIDE, DCT_SIDE = 8, 32
SHARP_SCALE, COLOUR_SCALE, CONTRAST_SCALE = 150.0, 50.0, 64.0
LUMA = np.array([0.299, 0.587, 0.114])


def dct_basis(n: int = DCT_SIDE) -> np.ndarray:
    """The orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos(np.pi * k * (x + 0.5) / n)


BASIS = dct_basis()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means when smaller, nearest pixels when larger, along one axis after the other."""

    def axis(a: np.ndarray, size: int) -> np.ndarray:
        n = a.shape[0]
        if n <= size:
            return a[np.minimum((np.arange(size) + 0.5) * n // size, n - 1).astype(int)]
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        edge = np.linspace(0, n, size + 1)
        low = np.floor(edge).astype(int)
        part = (edge - low).reshape(-1, *([1] * (a.ndim - 1)))
        at = sums[low] + part * (sums[np.minimum(low + 1, n)] - sums[low])
        return np.diff(at, axis=0) * size / n

    out = axis(np.asarray(image, float), height)
    return np.swapaxes(axis(np.swapaxes(out, 0, 1), width), 0, 1)


def fit_within(height: int, width: int, longest: int) -> tuple[int, int]:
    """The size with the longest edge at most ``longest``; smaller images stay."""
    scale = min(1.0, longest / max(height, width))
    return max(1, round(height * scale)), max(1, round(width * scale))


def perceptual_hash(gray: np.ndarray) -> int:
    """The signs of the 64 lowest frequencies against their median, as a signed 64-bit number."""
    low = (BASIS @ resize(gray, DCT_SIDE, DCT_SIDE) @ BASIS.T)[:HASH_SIDE, :HASH_SIDE]
    bits = np.packbits((low > np.median(low)).ravel())
    return int(bits.view(">i8")[0])


def laplacian_variance(gray: np.ndarray) -> float:
    """The variance of the four-neighbour Laplacian inside the border; 0 below 3 x 3."""
    if min(gray.shape) < 3:
        return 0.0
    g = gray
    inner = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(inner.var())


def colourfulness(rgb: np.ndarray) -> float:
    """Hasler and Suesstrunk's measure."""
    one = rgb[..., 0] - rgb[..., 1]
    two = (rgb[..., 0] + rgb[..., 1]) / 2 - rgb[..., 2]
    return float(np.hypot(one.std(), two.std()) + 0.3 * np.hypot(one.mean(), two.mean()))


def saturation(rgb: np.ndarray) -> float:
    top = rgb.max(axis=-1)
    return float(np.where(top > 0, (top - rgb.min(axis=-1)) / np.maximum(top, 1e-12), 0).mean())


def _knee(x: float, scale: float) -> float:
    return 1 - np.exp(-max(x, 0.0) / scale)


def image_scores(rgb: np.ndarray) -> tuple[float, float]:
    """(quality, aesthetic), each from 0 to 1 with six digits: sharpness, exposure and contrast; colour, saturation and
    contrast."""
    rgb = np.asarray(rgb, float)
    luma = rgb @ LUMA
    clipped = (luma < 8).mean() + (luma > 247).mean()
    exposure = max(0.0, 1 - clipped - abs(luma.mean() / 255 - 0.5))
    contrast = min(1.0, luma.std() / CONTRAST_SCALE)
    quality = 0.5 * _knee(laplacian_variance(luma), SHARP_SCALE) + 0.3 * exposure + 0.2 * contrast
    aesthetic = 0.45 * _knee(colourfulness(rgb), COLOUR_SCALE) + 0.3 * saturation(rgb) + 0.25 * contrast
    return round(float(np.clip(quality, 0, 1)), 6), round(float(np.clip(aesthetic, 0, 1)), 6)


def _pixels(row) -> np.ndarray:
    """RGB from BGR, BGRA or grey bytes."""
    a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
    return np.repeat(a, 3, axis=2) if row.channels == 1 else a[..., 2::-1]


def preprocess(rgb: np.ndarray, side: int = 224, mean: tuple = (0.48145466, 0.4578275, 0.40821073), std: tuple = (0.26862954, 0.26130258, 0.27577711)) -> np.ndarray:
    """Shortest side to ``side``, centre crop, normalised, channels first: the input of an image encoder."""
    h, w = rgb.shape[:2]
    scale = side / min(h, w)
    out = resize(rgb, max(side, round(h * scale)), max(side, round(w * scale)))
    top, left = (out.shape[0] - side) // 2, (out.shape[1] - side) // 2
    out = out[top : top + side, left : left + side] / 255
    return ((out - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype(np.float32)


FEATURES = "path string, width int, height int, phash long, quality double, aesthetic double, blur double"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples():
            rgb = _pixels(row)
            gray = rgb @ LUMA
            rows.append((row.path, row.width, row.height, perceptual_hash(gray), *image_scores(rgb), laplacian_variance(rgb.astype(float).mean(axis=2))))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])


def image_features(images: DataFrame) -> DataFrame:
    """All pixel features of decoded images in one pass over each."""
    return images.select("path", "height", "width", "channels", "data").mapInPandas(_features, FEATURES)


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned and mirrored the way its EXIF orientation (1 to 8) says; others leave it as it is."""
    turns, mirrored = {2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (3, False), 7: (1, True), 8: (1, False)}.get(orientation, (0, False))
    out = np.rot90(image[:, ::-1] if mirrored and orientation in (2, 4) else image, turns)
    return out[:, ::-1] if mirrored and orientation in (5, 7) else out


def png(rgb: np.ndarray) -> bytes:
    """A PNG of 8-bit RGB."""
    rows = np.concatenate([np.zeros((len(rgb), 1), np.uint8), rgb.reshape(len(rgb), -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


RENDERED = "path string, width int, height int, content binary"


def _rendered(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples():
            rgb = oriented(_pixels(row), int(row.orientation))
            small = resize(rgb, *fit_within(*rgb.shape[:2], longest))
            small = np.clip(np.round(small), 0, 255).astype(np.uint8)
            rows.append((row.path, small.shape[1], small.shape[0], png(small)))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in RENDERED.split(", ")])


def rendered(images: DataFrame, longest: int) -> DataFrame:
    """(path, width, height, content): decoded images (and their orientation, 1 if there is none) as PNG with a longest
    edge of at most ``longest``: 256 for thumbnails, 1024 for previews."""
    if "orientation" not in images.columns:
        images = images.withColumn("orientation", F.lit(1))
    rows = images.select("path", "height", "width", "channels", "data", F.coalesce("orientation", F.lit(1)).alias("orientation"))
    return rows.mapInPandas(partial(_rendered, longest=longest), RENDERED)
