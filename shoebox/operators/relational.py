"""The library's plain queries: pages, ranges, pending work, tags, people, groups, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, GROUP_KINDS

LIST_COLUMNS = ["id", "filename", "content_hash", "sort_at", "taken_at", "width", "height", "thumb_at"]
#: Stage -> what a photo that waits for it lacks, and what it must have besides to be taken up and to be counted.
PENDING = {
    "metadata": ("hashed_at IS NULL OR exif_at IS NULL", "true", "true"),
    "thumbs": ("thumb_at IS NULL", "content_hash IS NOT NULL", "true"),
    "score": ("scored_at IS NULL", "phash IS NOT NULL AND content_hash IS NOT NULL", "phash IS NOT NULL"),
    "embed": ("embed_at IS NULL", "phash IS NOT NULL", "true"),
    "faces": ("faces_at IS NULL", "phash IS NOT NULL", "true"),
    "ocr": ("ocr_at IS NULL", "phash IS NOT NULL", "true"),
}


def clamp_limit(n: int) -> int:
    return max(1, min(n, DEFAULTS.max_page))


def by_id(table: DataFrame, key: int, column: str = "id") -> DataFrame:
    return table.where(F.col(column) == key)


def encode_cursor(sort_at: float, id_: int) -> str:
    return f"{sort_at}:{id_}"


def decode_cursor(cursor: str) -> tuple[float, int]:
    at, _, id_ = cursor.partition(":")
    return float(at), int(id_)


def timeline_page(photos: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """Newest first, after the cursor: a predicate and a top-n, whatever the depth of the page."""
    rows = photos.where("missing = 0")
    if cursor:
        at, id_ = decode_cursor(cursor)
        rows = rows.where((F.col("sort_at") < at) | ((F.col("sort_at") == at) & (F.col("id") < id_)))
    return rows.orderBy(F.desc("sort_at"), F.desc("id")).limit(clamp_limit(limit))


def next_cursor(page: list, limit: int) -> str | None:
    """Only a full page has a next one."""
    return encode_cursor(page[-1]["sort_at"], page[-1]["id"]) if page and len(page) == clamp_limit(limit) else None


def in_range(photos: DataFrame, date_from: float | None = None, date_to: float | None = None) -> DataFrame:
    rows = photos.where("missing = 0")
    rows = rows.where(F.col("sort_at") >= date_from) if date_from is not None else rows
    return rows.where(F.col("sort_at") <= date_to) if date_to is not None else rows


def in_folder(photos: DataFrame, folder: str) -> DataFrame:
    """Photos right in the folder, none of its subfolders'."""
    return photos.where((F.col("missing") == 0) & (F.col("dir") == folder))


def with_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def is_pending(stage: str, counted: bool = False) -> Column:
    lacks, needs, counts = PENDING[stage]
    return F.expr(f"missing = 0 AND ({lacks}) AND ({counts if counted else needs})")


def pending(photos: DataFrame, stage: str, limit: int) -> DataFrame:
    return photos.where(is_pending(stage)).orderBy("id").limit(limit)


def pending_counts(photos: DataFrame) -> DataFrame:
    """One row: how many photos wait for each stage, in one pass. Photos that a stage can't take up yet count too, but
    for scoring, where one without a thumbnail would wait for ever."""
    return photos.agg(*(F.count_if(is_pending(s, counted=True)).alias(s) for s in PENDING))


def embedded_pairs(photos: DataFrame) -> DataFrame:
    """(id, embed_row) of photos with a vector, missing ones too, in the order of the vectors."""
    return photos.where("embed_at IS NOT NULL AND embed_row IS NOT NULL").select("id", "embed_row").orderBy("embed_row")


def thumb_hash(photos: DataFrame, photo_id: int) -> DataFrame:
    """The content hash of a photo that has a thumbnail."""
    return photos.where((F.col("id") == photo_id) & F.col("thumb_at").isNotNull() & F.col("content_hash").isNotNull()).select("content_hash")


def latest_per(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    others = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def tag_counts(tags: DataFrame, photo_tags: DataFrame) -> DataFrame:
    """Every tag with the number of its photos; unused ones have 0. Counted before the join."""
    uses = photo_tags.groupBy("tag_id").agg(F.count("*").alias("count"))
    return tags.join(uses, tags["id"] == uses["tag_id"], "left").select("id", "name", "kind", F.coalesce("count", F.lit(0)).alias("count")).orderBy("name")


def tags_of(photo_tags: DataFrame, tags: DataFrame, photo_id: int) -> DataFrame:
    own = photo_tags.where(F.col("photo_id") == photo_id)
    return own.join(tags, own["tag_id"] == tags["id"]).select("id", "name", "kind", "source", "confidence").orderBy("name")


def photos_with_tag(photo_tags: DataFrame, tag_id: int) -> DataFrame:
    return photo_tags.where(F.col("tag_id") == tag_id).select("photo_id").orderBy("photo_id")


def people(clusters: DataFrame, faces: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Clusters with their representative's photo, the largest first."""
    rep = faces.select(F.col("face_id").alias("rep_face_id"), F.col("photo_id").alias("rep_photo_id"))
    return clusters.join(rep, "rep_face_id", "left").select("cluster_id", "label", "pinned", "size", "rep_face_id", "rep_photo_id").orderBy(F.desc("size"), "cluster_id").offset(offset).limit(limit)


def photos_of_person(faces: DataFrame, cluster_id: int, limit: int = 500) -> DataFrame:
    return faces.where(F.col("cluster_id") == cluster_id).select("photo_id").distinct().orderBy(F.desc("photo_id")).limit(limit)


def faces_with_person(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    named = F.coalesce(F.trim("label") != "", F.lit(False))
    rows = faces.join(clusters.select("cluster_id", "label"), "cluster_id", "left")
    return rows.select("photo_id", "face_id", F.coalesce("quality", F.lit(0.0)).alias("quality"), named.alias("named"))


def roots(table: DataFrame) -> DataFrame:
    """The scanned folders in the order of their paths."""
    return table.orderBy("path")


def faces_of(faces: DataFrame, photo_id: int) -> DataFrame:
    return faces.where(F.col("photo_id") == photo_id).orderBy("face_id")


def pending_faces(faces: DataFrame) -> DataFrame:
    """The pool: faces that no run has assigned yet."""
    return faces.where("assigned = 0").orderBy("face_id")


def faces_in_cluster(faces: DataFrame, cluster_id: int) -> DataFrame:
    """A cluster's faces, the best first."""
    return faces.where(F.col("cluster_id") == cluster_id).orderBy(F.desc("quality"), "face_id")


def anchors(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """Clusters with their representative face's row; those without one are left out."""
    rep = faces.withColumnsRenamed({"face_id": "rep_face_id", "cluster_id": "face_cluster_id"})
    return clusters.where(F.col("rep_face_id").isNotNull()).join(rep, "rep_face_id")


def text_of(ocr: DataFrame, regions: DataFrame, photo_id: int) -> DataFrame:
    """(photo_id, text, regions) of one photo, always one row: '' and no regions where nothing was read."""
    one = ocr.sparkSession.range(1).select(F.lit(photo_id).cast("long").alias("photo_id"))
    text = ocr.where(F.col("photo_id") == photo_id).groupBy("photo_id").agg(F.max("text").alias("text"))
    names = [n for n in regions.columns if n != "photo_id"]
    own = regions.where(F.col("photo_id") == photo_id).groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("ord", *(n for n in names if n != "ord")))).alias("regions"))
    rows = one.join(text, "photo_id", "left").join(own, "photo_id", "left")
    empty = F.array().cast(own.schema["regions"].dataType)
    return rows.select("photo_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("regions", empty).alias("regions"))


def group_list(groups: DataFrame, photos: DataFrame, kind: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Groups of a kind with their cover photo's columns, the largest first; ValueError for an unknown kind."""
    if kind not in GROUP_KINDS:
        raise ValueError(f"unknown kind {kind}")
    cover = photos.select(F.col("id").alias("rep_photo_id"), F.col("thumb_at").alias("cover_thumb_at"))
    rows = groups.where(F.col("kind") == kind).join(cover, "rep_photo_id", "left")
    return rows.orderBy(F.desc("size"), "id").offset(offset).limit(limit)


def group_members(items: DataFrame, group_id: int) -> DataFrame:
    return items.where(F.col("group_id") == group_id).orderBy("rank", "photo_id")


def member_groups(items: DataFrame, groups: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """(photo_id, group_id) of photos in groups of a kind; if there were several the last one."""
    own = groups.where(F.col("kind") == kind).select(F.col("id").alias("group_id"))
    return with_ids(items.join(own, "group_id", "left_semi"), ids, "photo_id").groupBy("photo_id").agg(F.max("group_id").alias("group_id"))


def groups_of(items: DataFrame, groups: DataFrame, photo_id: int) -> DataFrame:
    own = items.where(F.col("photo_id") == photo_id).select(F.col("group_id").alias("id"))
    return groups.join(own, "id", "left_semi").orderBy("kind", "id")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()))


def newest(log: DataFrame, limit: int = 50, key: str = "id") -> DataFrame:
    return log.orderBy(F.desc(key)).limit(limit)


def hydrate(ranked: DataFrame, photos: DataFrame) -> DataFrame:
    """Hits (id, rank, ...) with the photos' columns, in rank order; ids that are gone are left out."""
    return ranked.join(photos, "id").withColumn("has_thumb", F.col("thumb_at").isNotNull()).orderBy("rank")


def quantiles(log: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    names = [f"p{round(100 * q)}" for q in at]
    return log.groupBy(*by).agg(*(F.percentile(value, F.lit(q)).alias(n) for n, q in zip(names, at)))


def pairwise_f1(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision, recall and F1 of pairs in one group, and purity; pair counts come from group sizes, never from pairs."""
    both = rows.groupBy(truth, found).agg(F.count("*").alias("n"))

    def pairs(by: str | None) -> DataFrame:
        sizes = both.select("n") if by is None else both.groupBy(by).agg(F.sum("n").alias("n"))
        return sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))

    tp, t, f = (F.broadcast(pairs(b).withColumnRenamed("p", n)) for b, n in ((None, "tp"), (truth, "t"), (found, "f")))
    pure = both.groupBy(found).agg(F.max("n").alias("top"), F.sum("n").alias("all")).agg((F.sum("top") / F.sum("all")).alias("purity"))
    out = tp.crossJoin(t).crossJoin(f).crossJoin(F.broadcast(pure))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.select(ratio("tp", "f").alias("precision"), ratio("tp", "t").alias("recall"), "purity")
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))

