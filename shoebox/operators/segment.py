"""Events and bursts: gap segmentation of a timeline.

A new event starts where the time since the previous row is over the gap, or where the distance is over ``gps_km``; a
distance is unknown, and splits nothing, if either row lacks coordinates. ``by`` cuts independent timelines, such as
one per user; without it there is one global timeline, which still runs in many tasks (see ordering).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scalars as fn
from .ordering import positions, running_sum, with_previous


def segment_events(photos: DataFrame, gap_seconds: float = DEFAULTS.event_gap_seconds, gps_km: float = DEFAULTS.event_gps_km, by: list[str] | None = None) -> DataFrame:
    """Adds event_no, from 1 along each timeline of (sort_at, id)."""
    rows = with_previous(photos, ["sort_at", "gps_lat", "gps_lon"], "sort_at", "id", by)
    jump = fn.haversine_km("prev_gps_lat", "prev_gps_lon", "gps_lat", "gps_lon")
    new = ~F.col("has_prev") | (F.col("sort_at") - F.col("prev_sort_at") > gap_seconds) | F.coalesce(jump > gps_km, F.lit(False))
    rows = rows.withColumn("__new", F.coalesce(new, F.lit(False)).cast("long")).drop("prev_sort_at", "prev_gps_lat", "prev_gps_lon", "has_prev")
    return running_sum(rows, "__new", "sort_at", "id", by, "event_no").drop("__new")


def detect_bursts(events: DataFrame, gap_seconds: float = DEFAULTS.burst_gap_seconds, by: list[str] | None = None) -> DataFrame:
    """Adds burst_no inside each event; rows of one burst follow each other within the gap, with the same camera or none."""
    scope = [*(by or []), "event_no"]
    rows = with_previous(events, ["sort_at", "camera_model"], "sort_at", "id", scope)
    goes_on = (F.col("sort_at") - F.col("prev_sort_at") <= gap_seconds) & F.col("camera_model").eqNullSafe(F.col("prev_camera_model"))
    rows = rows.withColumn("__new", (~F.coalesce(F.col("has_prev") & goes_on, F.lit(False))).cast("long")).drop("prev_sort_at", "prev_camera_model", "has_prev")
    return running_sum(rows, "__new", "sort_at", "id", scope, "burst_no").drop("__new")


def _specs(rows: DataFrame, keys: list[str], min_size: int) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("size"), F.min("sort_at").alias("start_at"), F.max("sort_at").alias("end_at"), F.max_by("id", fn.best_first()).alias("rep_photo_id"))
        .where(F.col("size") >= min_size)
    )


def event_groups(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events of two or more: size, span, best photo and the UTC day of the start."""
    return _specs(events, [*(by or []), "event_no"], 2).withColumn("key", fn.day_key("start_at"))


def burst_groups(bursts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bursts of two or more; they are looked for in events of any size."""
    return _specs(bursts, [*(by or []), "event_no", "burst_no"], 2)


def members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, photo_id, rank): each member with its place from 0 along the timeline."""
    return positions(rows, "sort_at", "id", keys, "rank").select(*keys, F.col("id").alias("photo_id"), F.col("rank").cast("double").alias("rank"))
