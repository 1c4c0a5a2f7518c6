"""The incremental pipeline: stages that work on what lacks their mark, and set it.

A stage is done for a photo when its mark is set; running the pipeline again takes up what is left, so that a stopped
run goes on where it was. Stages work in batches of bounded size and load the batch's files alone. A batch that fails
is left out for this run and stays waiting; a run can be cancelled between batches. Models (embedding, faces, text
recognition) are given by the caller as functions of a DataFrame; a stage without a model is left out.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.pixels import image_features, rendered
from ..sources.exif import file_metadata
from ..sources.files import read_files, read_image_files, scan_images
from ..sources.numbering import numbered
from ..sources.storage import stored
from ..sources.tables import Library
from .grouping import rebuild
from .mutation import apply_updates, fail_running_jobs, replace_children, set_ocr, upsert_scanned
from .relational import is_pending

#: Stage -> mark.
MARKS = {"metadata": "exif_at", "thumbs": "thumb_at", "score": "scored_at", "embed": "embed_at", "faces": "faces_at", "ocr": "ocr_at"}
THUMB_EDGE = 256
Model = Callable[[DataFrame], DataFrame]


@dataclass
class Progress:
    job_id: int
    total: int = 0
    done: dict[str, int] = field(default_factory=dict)
    errored: int = 0
    state: str = "running"
    groups: dict[str, int] = field(default_factory=dict)


class Pipeline:
    """scan -> metadata -> thumbs -> score -> embed -> faces -> ocr -> grouping over a library.

    ``embed``: (id, path) -> (id, embedding). ``faces``: (id, path) -> (photo_id, bx, by, bw, bh, det_score, quality,
    embedding). ``ocr``: (id, path) -> (photo_id, ord, bx, by, bw, bh, conf, text). ``group``: whether the groups are made
    anew at the end. ``batch``: photos in a batch, whose paths the driver holds.
    """

    def __init__(self, library: Library, roots: list[str], embed: Model | None = None, faces: Model | None = None, ocr: Model | None = None, group: bool = False, batch: int = 5_000):
        self.library, self.roots, self.models = library, roots, {"embed": embed, "faces": faces, "ocr": ocr}
        self.group, self.batch = group, batch
        self.cancelled, self.current = False, None
        self._lock = threading.Lock()

    def cancel(self) -> None:
        """The run ends before its next batch."""
        self.cancelled = True

    def scan(self, now: float) -> None:
        found = scan_images(self.library.spark, self.roots)
        self.library.write("photos", upsert_scanned(self.library.read("photos"), found, now))

    def pending(self, stage: str) -> DataFrame:
        return self.library.read("photos").where(is_pending(stage)).select("id", "path")

    def stages(self) -> list[str]:
        return [s for s in MARKS if s not in self.models or self.models[s] is not None]

    def _paths(self, waiting: DataFrame) -> list[str]:
        """A batch's paths; those of a local scan get their scheme again."""
        local = any(root.startswith("file:") for root in self.roots)
        return [f"file://{r.path}" if local and r.path.startswith("/") else r.path for r in waiting.select("path").collect()]

    def _thumbs(self, images: DataFrame, photos: DataFrame, waiting: DataFrame) -> None:
        """Thumbnails as rows of a table, named by their photo's digest; written again they are the same."""
        of = photos.join(waiting.select("id"), "id", "left_semi").select("path", "content_hash", F.coalesce("orientation", F.lit(1)).alias("orientation"))
        small = rendered(images.join(of, "path"), THUMB_EDGE).join(of.select("path", "content_hash"), "path")
        name = fn.shard_path("content_hash", "png").alias("file")
        small.select("content_hash", name, "width", "height", "content").write.mode("append").parquet(f"{self.library.root}/thumbs")

    def thumbnails(self) -> DataFrame:
        """(content_hash, file, width, height, content), one row per photo content."""
        return self.library.spark.read.parquet(f"{self.library.root}/thumbs").dropDuplicates(["content_hash"])

    def _stage(self, stage: str, now: float, waiting: DataFrame) -> None:
        spark, photos = self.library.spark, self.library.read("photos")
        marks = waiting.select("id", F.lit(now).alias(MARKS[stage]), F.lit(now).alias("updated_at"))
        if stage == "metadata":
            found = file_metadata(read_files(spark, self._paths(waiting))).join(waiting, "path").withColumn("sort_at", F.col("taken_at")).drop("path")
            marks = marks.withColumn("hashed_at", F.lit(now)).join(found, "id", "left")
            # A file that can't be read any more is missing.
            marks = marks.withColumn("missing", F.when(F.col("content_hash").isNull(), 1))
        elif stage in ("thumbs", "score"):
            images = read_image_files(spark, self._paths(waiting))
            if stage == "thumbs":
                self._thumbs(images, photos, waiting)
            names = ["phash"] if stage == "thumbs" else ["quality", "aesthetic"]
            marks = marks.join(image_features(images).join(waiting, "path").select("id", *names), "id", "left")
            if stage == "thumbs":
                marks = marks.withColumn("phash_at", F.when(F.col("phash").isNotNull(), F.lit(now)))
        else:
            rows = stored(self.models[stage](waiting))
            if stage == "embed":
                marks = marks.join(rows.select("id", F.col("id").alias("embed_row")), "id", "left")
                rows.write.mode("append").parquet(f"{self.library.root}/embeddings")
            elif stage == "faces":
                old = self.library.read("faces")
                top = old.agg(F.coalesce(F.max("face_id"), F.lit(0))).first()[0]
                new = numbered(rows, "photo_id").withColumns({"face_id": F.col("n") + top + 1, "assigned": F.lit(0), "created_at": F.lit(now)})
                rest = old.join(waiting.select(F.col("id").alias("photo_id")), "photo_id", "left_anti")
                self.library.write("faces", rest.unionByName(new.drop("n", "embedding"), allowMissingColumns=True))
                new.select("face_id", "embedding").write.mode("append").parquet(f"{self.library.root}/face_vectors")
            else:
                done = waiting.select(F.col("id").alias("photo_id"))
                texts = rows.groupBy("photo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n").alias("text"))
                self.library.write("ocr", set_ocr(self.library.read("ocr"), done, texts))
                regions = self.library.read("ocr_regions")
                new = rows.withColumn("id", F.xxhash64("photo_id", "ord")).select(regions.columns)
                self.library.write("ocr_regions", replace_children(regions, done, new, "photo_id"))
        self.library.write("photos", apply_updates(photos, marks))

    def _batches(self, stage: str, now: float, progress: Progress) -> None:
        """A stage over all that waits, in the order of ids; a batch that fails is passed over."""
        done, last = 0, None
        while not self.cancelled:
            waiting = self.pending(stage)
            waiting = stored((waiting if last is None else waiting.where(F.col("id") > last)).orderBy("id").limit(self.batch))
            n, top = waiting.agg(F.count("*"), F.max("id")).first()
            if not n:
                break
            try:
                self._stage(stage, now, waiting)
                done += n
            except Exception as e:
                progress.errored += n
                self.last_error = str(e)[:500]
            last = top
        progress.done[stage] = done

    def _vectors(self) -> DataFrame | None:
        if self.models["embed"] is None:
            return None
        rows = self.library.read("photos").where("embed_row IS NOT NULL").select("id", "embed_row")
        if not rows.limit(1).count():
            return None
        return rows.join(self.library.spark.read.parquet(f"{self.library.root}/embeddings").select(F.col("id").alias("embed_row"), "embedding").dropDuplicates(["embed_row"]), "embed_row").select("id", "embedding")

    def run(self, now: float | None = None) -> Progress:
        """One pass over all stages; the job log tells how it went. While one runs, the running one is given. Lingering
        jobs of a crashed run become errors."""
        if not self._lock.acquire(blocking=False):
            return self.current
        try:
            return self._run(time.time() if now is None else now)
        finally:
            self._lock.release()

    def _run(self, now: float) -> Progress:
        jobs = stored(fail_running_jobs(self.library.read("jobs"), "ingest", now))
        progress = self.current = Progress(int(jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1)
        self.cancelled, self.last_error = False, None

        def log() -> None:
            ended = None if progress.state == "running" else now
            row = [(progress.job_id, "ingest", progress.state, ",".join(self.roots), progress.total, sum(progress.done.values()), progress.errored, None, self.last_error, now, now, ended)]
            self.library.write("jobs", jobs.unionByName(self.library.spark.createDataFrame(row, self.library.read("jobs").schema)))

        try:
            self.scan(now)
            waits = self.library.read("photos").agg(*(F.count_if(is_pending(s, counted=True)) for s in self.stages())).first()
            progress.total = sum(waits)
            log()
            for stage in self.stages():
                if not self.cancelled:
                    self._batches(stage, now, progress)
            if self.group and not self.cancelled:
                progress.groups = rebuild(self.library, self._vectors(), now)
            progress.state = "canceled" if self.cancelled else "done"
            if progress.state == "done":
                progress.total = sum(progress.done.values()) + progress.errored
            log()
        except Exception as e:
            progress.state, self.last_error = "error", str(e)[:500]
            log()
            raise
        return progress


def open_library(spark: SparkSession, root: str) -> Library:
    """A library with its schema version written."""
    library = Library(spark, root)
    if not library.schema_version():
        library.write("meta", spark.createDataFrame([("schema_version", "3")], "key string, value string"))
    return library
