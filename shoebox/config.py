"""Defaults of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    """Fixed values that results depend on, and the sizes up to which a tier is chosen."""

    embed_dim: int = 512
    brute_max: int = 2_000
    filtered_max: int = 50_000
    overfetch: int = 5
    rrf_k: int = 60
    face_min_size: int = 32
    face_min_score: float = 0.5
    assign_threshold: float = 0.42
    edge_threshold: float = 0.35
    cluster_k: int = 20
    pool_threshold: int = 200
    event_gap_seconds: float = 14_400
    event_gps_km: float = 50.0
    burst_gap_seconds: float = 2.0
    near_dup_hamming: int = 6
    near_dup_cosine: float = 0.95
    near_dup_window: int = 20
    theme_k: int = 20
    theme_edge: float = 0.75
    theme_min_size: int = 5
    ocr_min_conf: float = 0.3
    radius_km: float = 25.0
    min_population: int = 1_000
    max_page: int = 500


DEFAULTS = Defaults()
EARTH_KM = 6371.0
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".tif", ".tiff", ".bmp", ".gif")
GROUP_KINDS = ("event", "burst", "near_dup", "semantic")
