"""The four layers of groups of a library, made anew: events, bursts, near-duplicates, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from ..sources.tables import Library
from . import near_dup, people, segment


def layers(photos: DataFrame, vectors: DataFrame | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """kind -> (groups with key, items with key) of the photos that aren't missing.

    ``vectors`` (id, embedding) may lack photos or be None: near-duplicates then go by their hashes alone, and there are
    no themes.
    """
    rows = photos.where("missing = 0")
    rows = rows.join(vectors.select("id", "embedding"), "id", "left") if vectors is not None else rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    rows = stored(rows)
    timeline = stored(segment.detect_bursts(segment.segment_events(rows.where("sort_at IS NOT NULL").drop("embedding"))))
    found = {}
    for kind, keys, groups in (("event", ["event_no"], segment.event_groups(timeline).drop("key")), ("burst", ["event_no", "burst_no"], segment.burst_groups(timeline))):
        key = F.concat_ws("-", F.lit(kind), *keys)
        items = segment.members(timeline, keys).join(groups.select(*keys), keys)
        if kind == "event":
            groups = segment.event_groups(timeline).withColumn("key", F.concat_ws("-", F.col("key"), "event_no"))
            items = items.join(groups.select("event_no", "key"), "event_no")
        else:
            groups, items = groups.withColumn("key", key), items.withColumn("key", key)
        found[kind] = groups.withColumn("score", F.lit(None).cast("double")), items.select("key", "photo_id", "rank")
    parts = near_dup.near_dup_components(near_dup.near_dup_pairs(rows))
    groups, items = near_dup.near_dup_groups(rows, parts)
    key = F.concat(F.lit("near-dup-"), F.col("component").cast("string"))
    found["near_dup"] = groups.withColumns({"key": key, "start_at": F.lit(None).cast("double"), "end_at": F.lit(None).cast("double")}), items.select(key.alias("key"), "photo_id", "rank")
    if vectors is not None:
        members = stored(people.themes(rows))
        groups = members.groupBy("key").agg(F.max("size").alias("size"), F.max("cohesion").alias("score"), F.max("rep_photo_id").alias("rep_photo_id"))
        groups = groups.withColumns({"start_at": F.lit(None).cast("double"), "end_at": F.lit(None).cast("double")})
        found["semantic"] = groups, members.select("key", F.col("id").alias("photo_id"), "rank")
    return found


def rebuild(library: Library, vectors: DataFrame | None, now: float) -> dict[str, int]:
    """Replaces all groups of every kind; how many there are of each. Kinds that can't be made become empty."""
    photos = library.read("photos")
    found = layers(photos, vectors)
    none = library.spark.createDataFrame([], "key string, rep_photo_id long, size long, score double, start_at double, end_at double")
    items = library.spark.createDataFrame([], "key string, photo_id long, rank double")
    counts = {}
    for kind in ("event", "burst", "near_dup", "semantic"):
        own_groups, own_items = found.get(kind, (none, items))
        own_groups = stored(own_groups.select("key", "rep_photo_id", F.col("size").cast("long").alias("size"), "score", "start_at", "end_at"))
        library.replace_groups(kind, own_groups, own_items, now)
        counts[kind] = own_groups.count()
    return counts
