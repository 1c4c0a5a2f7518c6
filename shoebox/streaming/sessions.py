"""Structured Streaming: sessions of events, incremental scans, incremental assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS
from ..operators.people import assign_pending
from ..operators.mutation import upsert_scanned
from ..sources.tables import Library


def sessions(events: DataFrame, gap_seconds: float = DEFAULTS.event_gap_seconds, late: str | None = None) -> DataFrame:
    """(user_id, start_at, end_at, size) of an events table or stream (user_id, ts): a gap over ``gap_seconds`` ends a
    session, one of just that length doesn't. On a stream ``late`` is how long late rows are waited for; rows later than
    that are dropped."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late) if late else rows
    # A session window ends at its last row plus the gap, exclusively, so that a gap of just that length goes on.
    grouped = rows.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds"))
    out = grouped.agg(F.count("*").alias("size"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("session_window.start").cast("double").alias("start_at"), F.col("last").cast("double").alias("end_at"), "size")


def run_sessions(events: DataFrame, target: str, checkpoint: str, gap_seconds: float = DEFAULTS.event_gap_seconds, late: str = "1 hour") -> StreamingQuery:
    """Appends the closed sessions of all that is there now, and ends; a later call goes on from the checkpoint."""
    out = sessions(events, gap_seconds, late)
    return out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_scans(scans: DataFrame, library: Library, checkpoint: str, now: float) -> StreamingQuery:
    """Merges a stream of scanned files (path, dir, filename, ext, size_bytes, mtime) into the photos, batch by batch; the
    newest of several rows of a path holds. A batch that is repeated after a failure changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        names = [c for c in batch.columns if c != "path"]
        last = batch.groupBy("path").agg(F.max_by(F.struct(*names), "mtime").alias("r")).select("path", "r.*")
        library.write("photos", upsert_scanned(library.read("photos"), last.select(batch.columns), now))

    return scans.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_assignment(pending: DataFrame, state: Library, vectors: DataFrame, checkpoint: str, threshold: float = DEFAULTS.assign_threshold) -> StreamingQuery:
    """Faces that arrive join the nearest cluster; the clusters are the state and are made anew after each batch."""

    def assign(batch: DataFrame, _: int) -> None:
        old = state.read("faces")
        every = old.unionByName(batch.join(old, "face_id", "left_anti"), allowMissingColumns=True).select(old.columns)
        faces, clusters = assign_pending(every.join(vectors, "face_id", "left"), state.read("clusters"), threshold)
        state.write("clusters", clusters)
        state.write("faces", faces.drop("embedding"))

    return pending.writeStream.foreachBatch(assign).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
