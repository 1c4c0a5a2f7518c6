"""Storage upkeep: compaction of vectors, cache eviction, storage report, metrics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .ordering import positions, running_sum


def compact(vectors: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Vectors (embed_row, embedding) of photos that are still there, numbered from 0 in the old order; the photos with
    their new rows, null where missing; and how many vectors there were, are and went."""
    live = photos.where("missing = 0 AND embed_row IS NOT NULL").select("embed_row").distinct()
    kept = positions(vectors.join(live, "embed_row", "left_semi"), "embed_row", "embed_row", name="new_row")
    place = kept.select("embed_row", "new_row")
    rows = photos.join(place, "embed_row", "left").withColumn("embed_row", F.when(F.col("missing") == 0, F.col("new_row"))).select(photos.columns)
    before, after = vectors.count(), kept.count()
    return kept.select(F.col("new_row").alias("embed_row"), *(c for c in vectors.columns if c != "embed_row")), rows, {"before": before, "after": after, "reclaimed": before - after}


def compact_faces(vectors: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for face vectors, whatever the state of the photos."""
    live = faces.where("embed_row IS NOT NULL").select("embed_row").distinct()
    kept = positions(vectors.join(live, "embed_row", "left_semi"), "embed_row", "embed_row", name="new_row")
    rows = faces.join(kept.select("embed_row", "new_row"), "embed_row", "left").withColumn("embed_row", F.col("new_row")).select(faces.columns)
    return kept.select(F.col("new_row").alias("embed_row"), *(c for c in vectors.columns if c != "embed_row")), rows


def eviction_plan(files: DataFrame, cap: int, keep: str | None = None) -> DataFrame:
    """Of (path, size, mtime) those to delete, oldest first, until the total is at most ``cap``; ``keep`` is never one."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    rows = files.where(F.col("path") != keep) if keep else files
    rows = running_sum(rows, "size", "mtime", "path", name="gone").crossJoin(F.broadcast(total))  # one row
    return rows.where(F.col("total") - (F.col("gone") - F.col("size")) > cap).select("path", "size", "mtime")


def preview_requests(cache: DataFrame, wanted: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """The cache (path, size, mtime) with the files that are asked for touched, and the paths that have to be rendered."""
    asked = wanted.select("path").distinct()
    touched = cache.join(asked.withColumn("__asked", F.lit(True)), "path", "left")
    touched = touched.withColumn("mtime", F.when(F.coalesce("__asked", F.lit(False)), F.lit(now)).otherwise(F.col("mtime"))).select(cache.columns)
    return touched, asked.join(cache, "path", "left_anti")


def ensure_idle(jobs: DataFrame) -> None:
    """RuntimeError while a job runs: compaction has to wait for it."""
    if jobs.where("state IN ('running', 'queued')").limit(1).count():
        raise RuntimeError("a job is running")


def storage_report(files: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """(area, bytes, files, cap, over_cap) of (area, size); areas without files have 0 bytes."""
    areas = files.sparkSession.createDataFrame(sorted(caps.items()), "area string, cap long")
    sums = files.groupBy("area").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
    rows = F.broadcast(areas).join(sums, "area", "left")
    return rows.select("area", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("files", F.lit(0)).alias("files"), "cap", fn.over_cap(F.coalesce("bytes", F.lit(0)), "cap").alias("over_cap"))


BENCHMARKS = "id long, job_id long, name string, value double, unit string, n long, phase string, git_sha string, context string, created_at double"


def benchmark_row(spark: SparkSession, name: str, value: float, unit: str, n: int | None = None, phase: str | None = None, job_id: int | None = None, git_sha: str | None = None, context: dict | None = None, now: float | None = None) -> DataFrame:
    """A row for the benchmark log; its id is the time in microseconds."""
    now = time.time() if now is None else now
    return spark.createDataFrame([(int(now * 1e6), job_id, name, float(value), unit, n, phase, git_sha, json.dumps(context or {}, sort_keys=True), now)], BENCHMARKS)


SUITES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def suite(name: str):
    def register(f: Callable[[SparkSession], DataFrame]):
        SUITES[name] = f
        return f

    return register


def run_suite(spark: SparkSession, name: str) -> DataFrame:
    """ValueError for an unknown suite."""
    if name not in SUITES:
        raise ValueError(f"unknown suite {name}")
    return SUITES[name](spark)


@suite("smoke")
def _smoke(spark: SparkSession) -> DataFrame:
    """The time of a trivial query."""
    start = time.perf_counter()
    for _ in range(5):
        spark.sql("SELECT 1").collect()
    return benchmark_row(spark, "smoke_query", (time.perf_counter() - start) / 5 * 1000, "ms/op", 5)
