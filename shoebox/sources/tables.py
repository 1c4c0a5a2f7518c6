"""The library's tables as Parquet folders: schemas, versions, reading, appending, replacing.

A table is a folder of version folders with a pointer row to the current one. Changing a table writes a new version and
then the pointer, so that readers always see a whole version; old versions stay until they are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "meta": "key string, value string",
    "roots": "id long, path string, added_at double",
    "photos": "id long, path string, dir string, filename string, ext string, size_bytes long, mtime double, content_hash string, width int, height int, orientation int, taken_at double, tz_offset int, camera_make string, camera_model string, lens string, iso int, f_number double, exposure double, focal_length double, gps_lat double, gps_lon double, phash long, aesthetic double, quality double, embed_row long, hashed_at double, exif_at double, thumb_at double, embed_at double, phash_at double, faces_at double, ocr_at double, missing int, created_at double, updated_at double, sort_at double, scored_at double",
    "clusters": "cluster_id long, label string, pinned int, rep_face_id long, size long, centroid array<double>, updated_at double",
    "faces": "face_id long, photo_id long, bx double, by double, bw double, bh double, det_score double, landmarks array<float>, quality double, embed_row long, cluster_id long, assigned int, created_at double",
    "groups": "id long, kind string, key string, rep_photo_id long, size long, score double, start_at double, end_at double, created_at double",
    "group_items": "group_id long, photo_id long, rank double, kind string",
    "ocr": "photo_id long, text string",
    "ocr_regions": "id long, photo_id long, bx double, by double, bw double, bh double, conf double, text string",
    "tags": "id long, name string, kind string",
    "photo_tags": "photo_id long, tag_id long, source string, confidence double",
    "jobs": "id long, kind string, state string, target string, total long, done long, errored long, checkpoint string, error_msg string, started_at double, updated_at double, finished_at double",
    "benchmarks": "id long, job_id long, name string, value double, unit string, n long, phase string, git_sha string, context string, created_at double",
}

#: Forward-only migrations: version, table, change of its rows.
MIGRATIONS: list[tuple[int, str, Callable[[DataFrame], DataFrame]]] = [
    (2, "photos", lambda t: t.withColumn("sort_at", F.coalesce("taken_at", "mtime")) if "sort_at" not in t.columns else t),
    (3, "photos", lambda t: t.withColumn("scored_at", F.lit(None).cast("double")) if "scored_at" not in t.columns else t),
]
LATEST = max(v for v, _, _ in MIGRATIONS)


def migrate(tables: dict[str, DataFrame], version: int) -> tuple[dict[str, DataFrame], int]:
    """The tables at the latest version; steps up to ``version`` are left out, so that a second run changes nothing."""
    out = dict(tables)
    for number, name, step in sorted(MIGRATIONS, key=lambda m: m[0]):
        if number > version and name in out:
            out[name] = step(out[name])
    return out, max(version, LATEST)


class Library:
    """Tables below a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str | None:
        try:
            rows = self.spark.read.schema("seq long, version string").parquet(f"{self.root}/{name}/_current").orderBy(F.desc("seq")).limit(1).collect()
        except AnalysisException:
            return None
        return rows[0].version if rows else None

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table if it was never written."""
        schema, version = SCHEMAS[name], self._pointer(name)
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """A new version of the table; ``rows`` may be made from the old one."""
        version = uuid.uuid4().hex
        declared = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in declared))
        rows.write.parquet(f"{self.root}/{name}/{version}")
        self._set(name, version)
        return self.read(name)

    def _set(self, name: str, version: str) -> None:
        try:
            n = self.spark.read.schema("seq long, version string").parquet(f"{self.root}/{name}/_current").count()
        except AnalysisException:
            n = 0
        self.spark.createDataFrame([(n + 1, version)], "seq long, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/{name}/_current")

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Adds rows to the current version's folder; for logs."""
        version = self._pointer(name)
        if version is None:
            return self.write(name, rows)
        rows.select(*(F.col(c) for c in self.read(name).columns)).write.mode("append").parquet(f"{self.root}/{name}/{version}")
        return self.read(name)

    def replace_groups(self, kind: str, groups: DataFrame, items: DataFrame, now: float) -> None:
        """All groups of a kind and their members, replaced; other kinds stay. Groups have ``key`` to name them and get
        new ids; items refer to them by it."""
        old, old_items = self.read("groups"), self.read("group_items")
        top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        from .numbering import numbered

        new = numbered(groups, "key").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("n") + 1)
        ids = new.select("id", "key")
        new = new.withColumns({"kind": F.lit(kind), "created_at": F.lit(now)})
        rows = items.join(ids, "key").select(F.col("id").alias("group_id"), "photo_id", "rank", F.lit(kind).alias("kind"))
        rows = old_items.where(F.col("kind") != kind).unionByName(rows)
        self.write("group_items", rows)
        self.write("groups", old.where(F.col("kind") != kind).unionByName(new.select(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in old.columns))))

    def schema_version(self) -> int:
        """0 where nothing was initialised."""
        row = self.read("meta").where("key = 'schema_version'").first()
        return int(row.value) if row else 0
