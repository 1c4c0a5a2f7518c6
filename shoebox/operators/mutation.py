"""Changes of tables as joins: upserts, inserts, deletes, replacements, cascades. All return the whole new table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import positions

#: What a changed file makes stale; the later stages keep their old results.
RESET = ("content_hash", "hashed_at", "exif_at", "thumb_at", "phash_at")


def upsert_scanned(photos: DataFrame, scan: DataFrame, now: float, reset: tuple[str, ...] = RESET) -> DataFrame:
    """A scan (path, dir, filename, ext, size_bytes, mtime) merged into the photos by path.

    A new path gets the next id. A known one takes size and time, and is no longer missing; if either of these changed,
    the columns of ``reset`` become null and sort_at starts again from the time. Paths that the scan lacks stay as
    they are.
    """
    new = scan.select(*(F.col(c).alias(f"__{c}") for c in scan.columns))
    rows = photos.join(new, photos["path"] == new["__path"], "full")
    known, seen = F.col("path").isNotNull(), F.col("__path").isNotNull()
    changed = known & seen & ~(F.col("size_bytes").eqNullSafe(F.col("__size_bytes")) & F.col("mtime").eqNullSafe(F.col("__mtime")))
    rows = rows.withColumns({"__changed": changed, "__known": known, "__seen": seen})
    top = photos.agg(F.max("id").alias("__top"))
    fresh = positions(rows.where("NOT __known"), "__path", "__path", name="__n").withColumn("__n", F.col("__n") + 1)
    rows = rows.where("__known").withColumn("__n", F.lit(0).cast("long")).unionByName(fresh).crossJoin(F.broadcast(top))

    def value(c: str) -> Column:
        if c == "id":
            return F.coalesce("id", F.coalesce("__top", F.lit(0)) + F.col("__n"))
        if c == "missing":
            return F.when(F.col("__seen"), 0).otherwise(F.col("missing"))
        if c == "sort_at":
            return F.when(F.col("__changed") | ~F.col("__known"), F.col("__mtime")).otherwise(F.col("sort_at"))
        if c in ("created_at", "updated_at"):
            touched = ~F.col("__known") if c == "created_at" else F.col("__seen")
            return F.when(touched, F.lit(now)).otherwise(F.col(c))
        if c in reset:
            return F.when(~F.col("__changed"), F.col(c))
        return F.coalesce(f"__{c}", c) if c in scan.columns else F.col(c)

    return rows.select(*(value(f.name).cast(f.dataType).alias(f.name) for f in photos.schema))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: rows whose key is there already are left out; of equal new ones one stays."""
    return table.unionByName(rows.dropDuplicates(keys).join(table, keys, "left_anti"), allowMissingColumns=True)


def get_or_create(table: DataFrame, names: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """The table with a row for every name; new ones get the next keys in the order of their names."""
    fresh = names.select(name).distinct().join(table, name, "left_anti")
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    fresh = positions(fresh, name, name, name="__n").crossJoin(F.broadcast(top))  # one row
    return table.unionByName(fresh.select((F.col("__top") + F.col("__n") + 1).cast("long").alias(key), name), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with their keys."""
    return table.join(rows, keys, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti").select(table.columns)


def replace_children(table: DataFrame, parents: DataFrame, rows: DataFrame, parent: str, keep: Column | None = None) -> DataFrame:
    """The parents' rows go and the new ones come; ``keep`` leaves out new rows that shouldn't be stored."""
    new = rows if keep is None else rows.where(keep)
    return delete(table, parents, [parent]).unionByName(new.select(table.columns))


def set_ocr(ocr: DataFrame, done: DataFrame, texts: DataFrame) -> DataFrame:
    """Text rows of the photos in ``done`` are replaced; blank texts are not stored."""
    return replace_children(ocr, done, texts, "photo_id", F.trim(F.coalesce("text", F.lit(""))) != "")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is gone go too."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").select(children.columns)


def set_null(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """References to parents that are gone become null."""
    live = parents.select(F.col(parent_key).alias("__live")).distinct()
    rows = children.join(live, children[child_key] == live["__live"], "left")
    return rows.select(*(F.col("__live").alias(c) if c == child_key else F.col(c) for c in children.columns))


def apply_updates(table: DataFrame, updates: DataFrame, key: str = "id", rule: Callable[[Column, Column], Column] = lambda new, old: F.coalesce(new, old)) -> DataFrame:
    """A stage's output joined in: by default its values where they aren't null."""
    names = [c for c in updates.columns if c != key]
    rows = table.join(updates.select(key, *(F.col(c).alias(f"__{c}") for c in names)), key, "left")
    return rows.select(*(rule(F.col(f"__{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def mark_missing(photos: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id", F.lit(1).alias("missing")).distinct()
    return apply_updates(photos, gone)


def fail_running_jobs(jobs: DataFrame, kind: str, now: float) -> DataFrame:
    """Jobs of a kind that a crash left running become errors."""
    running = (F.col("state") == "running") & (F.col("kind") == kind)
    new = {"error_msg": F.lit("interrupted"), "updated_at": F.lit(now), "finished_at": F.lit(now), "state": F.lit("error")}
    return jobs.select(*(F.when(running, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns))
