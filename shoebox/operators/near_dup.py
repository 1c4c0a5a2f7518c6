"""Near-duplicate photos by perceptual hash, and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scalars as fn
from .graph import connected_components
from .ordering import positions


def near_dup_pairs(photos: DataFrame, max_hamming: int = DEFAULTS.near_dup_hamming, min_cosine: float = DEFAULTS.near_dup_cosine, window: int = DEFAULTS.near_dup_window) -> DataFrame:
    """(a, b, hamming, cosine): each photo against the next ``window`` in the unsigned order of phash.

    A pair needs at most ``max_hamming`` differing bits, and the cosine where both have an embedding. The join is on
    positions, an equality, so that it never becomes a nested loop.
    """
    rows = photos.where(F.col("phash").isNotNull()).withColumn("__key", fn.unsigned_key("phash"))
    rows = positions(rows, "__key", "id").select("pos", "id", "phash", "embedding")
    after = rows.select(F.col("id").alias("a"), F.col("phash").alias("h"), F.col("embedding").alias("v"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window)).alias("pos"))
    pairs = after.join(rows, "pos").withColumn("hamming", fn.hamming64("h", "phash")).where(F.col("hamming") <= max_hamming)
    pairs = pairs.withColumn("cosine", fn.dot("v", "embedding")).where(F.coalesce(F.col("cosine") >= min_cosine, F.lit(True)))
    return pairs.select("a", F.col("id").alias("b"), "hamming", "cosine")


def near_dup_components(pairs: DataFrame) -> DataFrame:
    """(id, component) of photos with at least one near-duplicate."""
    found = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("node").alias("id"), "component")


def near_dup_groups(photos: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (component, size, rep_photo_id, score) and members (component, photo_id, rank), best photo first."""
    rows = photos.join(components, "id")
    groups = rows.groupBy("component").agg(F.count("*").alias("size"), F.max_by("id", fn.best_first()).alias("rep_photo_id")).withColumn("score", F.col("size").cast("double"))
    w = Window.partitionBy("component").orderBy(F.desc(fn.best_first()))
    return groups, rows.select("component", F.col("id").alias("photo_id"), (F.row_number().over(w) - 1).cast("double").alias("rank"))


def exact_duplicates(photos: DataFrame, digest: str = "content_hash") -> DataFrame:
    """(digest, copies, ids) of contents that several photos have. The ids of a hot content are not gathered: first and last stand for them."""
    return photos.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("copies > 1")
