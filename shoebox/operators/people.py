"""Clusters of items (people of faces, themes of photos) and their life: assign, re-cluster, merge, split, reset.

Tables: faces (face_id, photo_id, quality, embedding, cluster_id, assigned), clusters (cluster_id, label, pinned,
rep_face_id, size, centroid). Operators return new versions of both, stored in the shared folder so that a chain of
steps is not computed again and again; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scalars as fn
from ..sources.storage import stored
from .graph import by_size, chinese_whispers
from .ordering import positions
from .vector import assign_nearest, centroids, knn_graph

CLUSTER_COLUMNS = ["cluster_id", "label", "pinned", "rep_face_id", "size", "centroid"]


def kept_detections(detections: DataFrame, min_size: int = DEFAULTS.face_min_size, min_score: float = DEFAULTS.face_min_score) -> DataFrame:
    """Detections (x1, y1, x2, y2 in pixels, det_score, width, height) that are large and certain enough, with the box
    bx, by, bw, bh in shares of the image."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = detections.where((F.least(w, h) >= min_size) & (F.col("det_score") >= min_score))
    return rows.withColumns({"bx": F.col("x1") / F.col("width"), "by": F.col("y1") / F.col("height"), "bw": w / F.col("width"), "bh": h / F.col("height")}).drop("x1", "y1", "x2", "y2")


def cluster_vectors(rows: DataFrame, k: int = DEFAULTS.cluster_k, threshold: float = DEFAULTS.edge_threshold, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, cluster): neighbour graph, Chinese Whispers, and numbers by size."""
    nodes = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("node"))
    labels = chinese_whispers(nodes, stored(knn_graph(rows, k, threshold, key, vector)))
    return stored(by_size(stored(labels)).select(F.col("node").alias(key), "cluster"))


def themes(photos: DataFrame, k: int = DEFAULTS.theme_k, threshold: float = DEFAULTS.theme_edge, min_size: int = DEFAULTS.theme_min_size) -> DataFrame:
    """(theme, key, id, cosine, rank, size, cohesion, rep_photo_id) of the members of themes of at least ``min_size``,
    ordered by their cosine to the theme's centroid."""
    rows = photos.where(F.col("embedding").isNotNull())
    rows = rows.join(cluster_vectors(rows, k, threshold), "id").withColumn("size", F.count("*").over(Window.partitionBy("cluster"))).where(F.col("size") >= min_size)
    rows = rows.join(centroids(rows, ["cluster"]).select("cluster", "centroid"), "cluster").withColumn("cosine", fn.dot("embedding", "centroid"))
    order = Window.partitionBy("cluster").orderBy(F.desc("cosine"), "id")
    rows = rows.withColumns({"rank": (F.row_number().over(order) - 1).cast("double"), "cohesion": F.avg("cosine").over(Window.partitionBy("cluster")), "rep_photo_id": F.first("id").over(order)})
    return rows.select(F.col("cluster").alias("theme"), F.concat(F.lit("theme-"), F.col("cluster").cast("string")).alias("key"), "id", "cosine", "rank", "size", "cohesion", "rep_photo_id")


def cluster_stats(faces: DataFrame) -> DataFrame:
    """(cluster_id, size, rep_face_id, centroid): counts, the face of the best quality (the first of equal ones) and the
    normalised mean. Clusters without faces aren't there."""
    rows = faces.where(F.col("cluster_id").isNotNull())
    stats = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.max_by("face_id", F.struct(F.coalesce("quality", F.lit(0.0)), -F.col("face_id"))).alias("rep_face_id"))
    return stats.join(centroids(rows, ["cluster_id"]).select("cluster_id", "centroid"), "cluster_id", "left")


def recompute(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """The clusters with their figures made anew from the faces; empty ones go."""
    return stored(clusters.select("cluster_id", "label", "pinned").join(cluster_stats(faces), "cluster_id").select(*CLUSTER_COLUMNS))


def _with_cluster(faces: DataFrame, found: DataFrame) -> DataFrame:
    """Faces take the cluster of ``found`` (face_id, new_cluster) where there is one."""
    rows = faces.join(found.select("face_id", "new_cluster"), "face_id", "left")
    taken = F.col("new_cluster").isNotNull()
    return rows.withColumns({"cluster_id": F.coalesce("new_cluster", "cluster_id"), "assigned": F.when(taken, 1).otherwise(F.col("assigned"))}).select(faces.columns)


def assign_pending(faces: DataFrame, clusters: DataFrame, threshold: float = DEFAULTS.assign_threshold) -> tuple[DataFrame, DataFrame]:
    """Pending faces join the nearest centroid that is near enough; centroids are made anew after the batch."""
    found = assign_nearest(faces.where("assigned = 0"), clusters.where(F.col("centroid").isNotNull()), threshold)
    faces = stored(_with_cluster(faces, found.select("face_id", F.col("cluster_id").alias("new_cluster"))))
    return faces, recompute(faces, clusters)


def recluster_pending(faces: DataFrame, clusters: DataFrame, k: int = DEFAULTS.cluster_k, threshold: float = DEFAULTS.edge_threshold, protect_pinned: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clusters the pending faces together with the representatives of the clusters.

    A group with one representative joins its cluster; one that bridges several merges them into the largest (with
    ``protect_pinned`` into the largest pinned one, and other pinned ones stay apart); one without makes a cluster.
    """
    pending = faces.where("assigned = 0").select("face_id", "embedding", "quality")
    reps = clusters.where(F.col("rep_face_id").isNotNull()).select("cluster_id", "pinned", "size", F.col("rep_face_id").alias("face_id"))
    reps = reps.join(faces.select("face_id", "embedding"), "face_id")
    nodes = stored(pending.select("face_id", "embedding").unionByName(reps.select("face_id", "embedding")))
    group = cluster_vectors(nodes, k, threshold, "face_id")
    of_rep = reps.join(group, "face_id")
    first = F.struct(F.col("pinned") if protect_pinned else F.lit(0), F.col("size"), -F.col("cluster_id"))
    of_rep = stored(of_rep)
    target = of_rep.groupBy("cluster").agg(F.max_by("cluster_id", first).alias("target"))
    moves = of_rep.join(target, "cluster").where("cluster_id <> target")
    if protect_pinned:
        moves = moves.where("pinned = 0")
    moves = moves.select("cluster_id", "target")
    rows = faces.join(moves, "cluster_id", "left").withColumn("cluster_id", F.coalesce("target", "cluster_id")).select(faces.columns)
    top = (clusters.agg(F.max("cluster_id")).first()[0] or 0) + 1
    fresh = pending.join(group, "face_id").join(target, "cluster", "left_anti").groupBy("cluster").agg(F.min("face_id").alias("least"))
    fresh = positions(fresh, "cluster", "least", name="place").select("cluster", (F.col("place") + top).cast("long").alias("target"))
    found = pending.select("face_id").join(group, "face_id").join(target.unionByName(fresh), "cluster").select("face_id", F.col("target").alias("new_cluster"))
    rows = stored(_with_cluster(rows, found))
    kept = clusters.join(moves, "cluster_id", "left_anti").select("cluster_id", "label", "pinned")
    new = fresh.select(F.col("target").alias("cluster_id"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("pinned"))
    return rows, recompute(rows, kept.unionByName(new))


def reset_unpinned(faces: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces of clusters that aren't pinned go back to the pending pool, and these clusters go."""
    loose = clusters.where("pinned = 0").select("cluster_id", F.lit(True).alias("__loose"))
    rows = faces.join(loose, "cluster_id", "left")
    free = F.coalesce("__loose", F.lit(False))
    rows = rows.withColumns({"assigned": F.when(free, 0).otherwise(F.col("assigned")), "cluster_id": F.when(~free, F.col("cluster_id"))}).select(faces.columns)
    return stored(rows), stored(clusters.where("pinned <> 0"))


def update_people(faces: DataFrame, clusters: DataFrame, force: bool = False, pool: int = DEFAULTS.pool_threshold) -> tuple[DataFrame, DataFrame]:
    """Assigns, then re-clusters if forced, if the pool is large, or if there are pending faces and no clusters yet."""
    if force:
        faces, clusters = reset_unpinned(faces, clusters)
    faces, clusters = assign_pending(faces, clusters)
    waiting = faces.where("assigned = 0").limit(pool).count()
    if waiting and (force or waiting >= pool or not clusters.limit(1).count()):
        faces, clusters = recluster_pending(faces, clusters)
    return faces, clusters


def merge_clusters(faces: DataFrame, clusters: DataFrame, target: int, others: list[int]) -> tuple[DataFrame, DataFrame]:
    """The others' faces go to the target, which keeps its label."""
    gone = [o for o in others if o != target]
    rows = stored(faces.withColumn("cluster_id", F.when(F.col("cluster_id").isin(gone), F.lit(target).cast("long")).otherwise(F.col("cluster_id"))))
    return rows, recompute(rows, clusters.where(~F.col("cluster_id").isin(gone)))


def split_cluster(faces: DataFrame, clusters: DataFrame, cluster_id: int, k: int = DEFAULTS.cluster_k, edge: float = DEFAULTS.edge_threshold) -> tuple[DataFrame, DataFrame]:
    """Clusters one cluster's faces again with a stricter edge; its label is lost. One face or none: nothing changes."""
    own = faces.where(F.col("cluster_id") == cluster_id)
    if own.limit(2).count() < 2:
        return faces, clusters
    parts = cluster_vectors(own, k, min(0.75, edge + 0.15), "face_id")
    top = clusters.agg(F.max("cluster_id")).first()[0] + 1
    rows = stored(_with_cluster(faces, parts.select("face_id", (F.col("cluster") + top).cast("long").alias("new_cluster"))))
    new = parts.select((F.col("cluster") + top).cast("long").alias("cluster_id")).distinct().select("cluster_id", F.lit(None).cast("string").alias("label"), F.lit(0).alias("pinned"))
    kept = clusters.where(F.col("cluster_id") != cluster_id).select("cluster_id", "label", "pinned")
    return rows, recompute(rows, kept.unionByName(new))


def set_label(clusters: DataFrame, cluster_id: int, label: str) -> DataFrame:
    """A label that isn't blank pins its cluster."""
    own = F.col("cluster_id") == cluster_id
    return clusters.withColumns({"label": F.when(own, F.lit(label)).otherwise(F.col("label")), "pinned": F.when(own, F.lit(int(bool(label.strip())))).otherwise(F.col("pinned"))})


def reassign_face(faces: DataFrame, clusters: DataFrame, face_id: int, cluster_id: int | None) -> tuple[DataFrame, DataFrame]:
    """One face goes to another cluster, or back to the pool (None); figures of the clusters are made anew."""
    own = F.col("face_id") == face_id
    target = F.lit(cluster_id).cast("long")
    rows = faces.withColumns({"cluster_id": F.when(own, target).otherwise(F.col("cluster_id")), "assigned": F.when(own, F.lit(int(cluster_id is not None))).otherwise(F.col("assigned"))})
    rows = stored(rows.select(faces.columns))
    return rows, recompute(rows, clusters)


def cluster_from(faces: DataFrame, clusters: DataFrame, face_ids: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The faces of ``face_ids`` (face_id) make a new cluster; a label that isn't blank pins it."""
    new_id = (clusters.agg(F.max("cluster_id")).first()[0] or 0) + 1
    rows = stored(_with_cluster(faces, face_ids.select("face_id").distinct().withColumn("new_cluster", F.lit(new_id).cast("long"))))
    own = clusters.sparkSession.createDataFrame([(new_id, label, int(bool((label or "").strip())))], "cluster_id long, label string, pinned int")
    return rows, recompute(rows, clusters.select("cluster_id", "label", "pinned").unionByName(own))


def insert_faces(faces: DataFrame, new: DataFrame) -> DataFrame:
    """New faces get the next ids and wait for a cluster."""
    top = faces.agg(F.coalesce(F.max("face_id"), F.lit(0)).alias("top"))
    rows = positions(new, "photo_id", "photo_id", name="place").crossJoin(F.broadcast(top))  # one row
    rows = rows.withColumns({"face_id": F.col("top") + F.col("place") + 1, "assigned": F.lit(0), "cluster_id": F.lit(None).cast("long")})
    return stored(faces.unionByName(rows.select([n for n in rows.columns if n in faces.columns]), allowMissingColumns=True))
