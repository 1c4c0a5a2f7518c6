"""Substring deduplication over a log-structured index of window fingerprints.

A window is 50 consecutive words. Every window is represented by its anchor: the least hash of the 10-word grams
inside it, which depends on the window's words alone, so that equal windows have equal anchors wherever they
stand. Consecutive windows with one anchor form a segment, about twenty windows on average, and the index keeps
one row per distinct segment: (anchor, 128-bit BLAKE2 digest of the segment's words in two halves, first document).
Anchors only gather candidates; what counts as equal is verified by the digests of the words themselves.

- Runs of the index are immutable tables, bucketed and sorted by (anchor, segment, check), listed in a manifest of which
  the newest version counts, so that an index can be opened again. A batch is merge-joined with
  each run; only fingerprints that no run has go into the batch's own run; runs are compacted when there are more
  than ``fanout``.
- A segment whose word sequence starts in an earlier document goes entirely. Where an anchor has several
  different segments, the windows of the first holder of each are compared one by one by 128 bits of hash.
- Groups are never gathered: first documents are minima with partial aggregation; the joins have one row per
  key on the index side, so that a hot key on the other side can be split.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

WINDOW, GRAM = 50, 10
SEGMENTS = "doc_id long, row long, anchor long, segment long, check long, start int, windows int"
KEYS = ["anchor", "segment", "check"]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Word ranges per text, valid window starts and each window's anchor, and the words as single-spaced bytes with
    the start of each of them and one more."""
    starts, ends, words = c.word_spans(data, offsets)
    n = len(starts)
    size = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts + 1, out=size[1:])
    inside = np.repeat(starts - size[:-1], ends - starts + 1) + np.arange(size[-1])
    plain = np.append(data, np.uint8(0x20))[np.minimum(inside, len(data))]
    plain[size[1:] - 1] = 0x20
    if n < window:
        return words, np.zeros(0, np.int64), np.zeros(0, np.uint64), plain, size
    sums = c.prefix_sums(c.word_keys(data, starts, ends, 1))
    at = np.arange(n - gram + 1)
    anchors = _sliding_min(c.span_hash(sums, at, at + gram), window - gram + 1)
    text = np.repeat(np.arange(len(words) - 1), np.diff(words))
    valid = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    return words, valid, anchors[valid], plain, size


def _digests(plain: np.ndarray, size: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of stretches of words."""
    raw = plain.tobytes()
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(size[starts].tolist(), (size[ends] - 1).tolist())])
    halves = np.frombuffer(found, "<i8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _segments(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in c.text_slices(batches):
        data, offsets = c.byte_view(batch.column("text"))
        words, valid, anchors, plain, size = _anchors(data, offsets, window, gram)
        if not len(valid):
            continue
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (np.diff(valid) != 1) | (anchors[1:] != anchors[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(valid)))
        start = valid[first]
        text = np.searchsorted(words, start, side="right") - 1
        segment, check = _digests(plain, size, start, start + count + window - 1)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").take(pa.array(text)),
                "row": batch.column("row").take(pa.array(text)),
                "anchor": anchors[first].view(np.int64),
                "segment": pa.array(segment),
                "check": pa.array(check),
                "start": (start - words[text]).astype(np.int32),
                "windows": count.astype(np.int32),
            }
        )


class FingerprintIndex:
    """Immutable sorted runs of (anchor, segment, check, first_doc) in a folder; one index for any number of batches.

    Each version of the manifest is a folder ``manifest/<number>`` with a row per run; it is written after the run, so
    that a lost job leaves the version before it as it was. Opening a folder goes on with the newest version.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 2):
        self.spark, self.root, self.fanout = spark, root or c.shared_dir(spark), fanout
        self.version, self.runs = 0, []  # each run with its folder
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place):
            done = [s.getPath() for s in files.listStatus(place) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
            self.version = max((int(p.getName()) for p in done), default=0)
        if self.version:
            listed = spark.read.parquet(f"{self.root}/manifest/{self.version}").orderBy("place").collect()
            self.runs = [(self._open(r.path, r.buckets), r.path, r.buckets) for r in listed]

    def _open(self, path: str, buckets: int) -> DataFrame:
        """A run as a bucketed, sorted table; the session's catalogue keeps nothing of it."""
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        keys = ", ".join(f"`{k}`" for k in KEYS)
        self.spark.sql(f"CREATE TABLE {name} (`anchor` BIGINT, `segment` BIGINT, `check` BIGINT, `first_doc` BIGINT) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay
        return run

    def _run(self, rows: DataFrame) -> tuple[DataFrame, str, int]:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        path, buckets = f"{self.root}/{name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.select(*KEYS, "first_doc").write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run, path, buckets

    def _record(self) -> None:
        self.version += 1
        listed = [(k, path, buckets) for k, (_, path, buckets) in enumerate(self.runs)]
        self.spark.createDataFrame(listed, "place int, path string, buckets int").coalesce(1).write.parquet(f"{self.root}/manifest/{self.version}")

    def add(self, segments: DataFrame) -> None:
        """Merge-joins a batch's segments with every run; what they lack becomes a run of its own."""
        new = segments.groupBy(*KEYS).agg(F.min("doc_id").alias("first_doc"))
        for run, _, _ in self.runs:
            old = run.withColumnRenamed("first_doc", "known")
            same = (new.anchor == old.anchor) & (new.segment == old.segment) & (new.check == old.check) & (old.known <= new.first_doc)
            new = new.join(old, same, "left_anti")
        self.runs.append(self._run(new))
        self._record()
        if len(self.runs) > self.fanout:
            self.compact()

    def rows(self) -> DataFrame:
        """One row per fingerprint over all runs."""
        run = self.runs[0][0]
        if len(self.runs) == 1:
            return run
        # Read as plain files: a union of bucketed scans may count as partitioned by key when it isn't.
        every = self.spark.read.schema(run.schema).parquet(*(path for _, path, _ in self.runs))
        return every.groupBy(*KEYS).agg(F.min("first_doc").alias("first_doc"))

    def compact(self) -> None:
        """Makes one run of all; the former ones are deleted when the manifest no longer lists them."""
        if len(self.runs) > 1:
            old = [path for _, path, _ in self.runs]
            self.runs = [self._run(self.rows())]
            self._record()
            c.discard(self.spark, *old)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in c.text_slices(batches):
        packed = [squeeze(t.encode()) if t else b"" for t in batch.column("text").to_pylist()]
        same = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        yield pa.RecordBatch.from_pydict(same | {"packed": pa.array(packed, pa.binary())})


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    open_ = zstandard.ZstdDecompressor().decompress
    for i, p in enumerate(batch.column("packed").to_pylist()):
        yield i, open_(p) if p else b""


def _checked_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of the segments that have to be looked at one by one."""
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        for i, raw in _unpacked(batch):
            spans = [(m["start"], m["windows"]) for m in marks[i] or () if not m["whole"]]
            if not spans:
                continue
            words = raw.split()
            size = np.zeros(len(words) + 1, np.int64)
            np.cumsum([len(w) + 1 for w in words], out=size[1:])
            at = np.unique(np.concatenate([np.arange(s, s + n) for s, n in spans]))
            one, two = _digests(np.frombuffer(b" ".join(words) + b" ", np.uint8), size, at, at + window)
            same = lambda name: pa.repeat(batch.column(name)[i], len(at))  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict({"doc_id": same("doc_id"), "row": same("row"), "one": pa.array(one), "two": pa.array(two), "start": at.astype(np.int32)})


def _cut(batches: Iterator[pa.RecordBatch], window: int, with_text: bool, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, singles = batch.column("marks").to_pylist(), batch.column("singles").to_pylist()
        total, removed, digest, kept_texts = [], [], [], []
        for i, raw in _unpacked(batch):
            words = raw.split()
            spans = [(m["start"], m["windows"]) for m in marks[i] or () if m["whole"]] + [(s, 1) for s in singles[i] or ()]
            gone = 0
            if spans:
                change = np.zeros(len(words) + 1, np.int32)
                for s, n in spans:
                    change[s] += 1
                    change[s + n + window - 1] -= 1
                keep = np.cumsum(change[:-1]) == 0
                gone = int(len(words) - keep.sum())
            total.append(len(words))
            removed.append(gone)
            kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k] if gone else words)
            digest.append(hashlib.sha256(kept).hexdigest())
            # A text of which nothing goes stays as it is, with its own white space.
            kept_texts.append((kept if gone else raw).decode())
        out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept_texts, pa.string())
        out |= {n: batch.column(n) for n in carry}
        yield pa.RecordBatch.from_pydict(out)


def substring_dedup(docs: DataFrame, batches: int = 3, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256; on demand kept_text, and with ``carry`` the
    other columns, each with the prefix ``in_``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    Documents come in ``batches`` ranges of doc_id, as an incremental run would bring them.
    Null or empty text: no words. Texts shorter than a window lose nothing. Null doc_id: the row loses nothing and
    takes nothing from others. Rows that repeat a doc_id are texts of one document: they don't take from each
    other. Other columns are ignored.
    """
    spark = docs.sparkSession
    root = c.shared_dir(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    low, high = texts.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    batch = F.lit(0)
    for k in range(1, batches):  # Python's whole numbers: ids may be as far apart as longs can be
        batch = batch + (F.col("doc_id") >= low + (high - low + 1) * k // batches).cast("int")
    found = texts.where("doc_id IS NOT NULL").mapInArrow(partial(_segments, window=window, gram=gram), SEGMENTS)
    found = c.written(found.withColumn("batch", batch), f"{root}/segments", ["batch"])
    index = FingerprintIndex(spark, f"{root}/index")
    for b in range(batches):
        index.add(found.where(F.col("batch") == b))
    index.compact()
    known = index.rows()
    several = known.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("several"))
    seen = found.drop("batch").join(known, KEYS).withColumn("whole", F.expr("first_doc < doc_id"))
    marks = seen.where("whole").select("doc_id", "row", "start", "windows", "whole").unionByName(
        seen.where("NOT whole").join(several, "anchor").select("doc_id", "row", "start", "windows", "whole")
    )
    marks = c.written(marks.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "windows", "whole")).alias("marks")), f"{root}/marks")
    # What marks were made from is read no more; its shuffle files go with it.
    del found, index, known, several, seen
    c.discard(spark, f"{root}/segments", f"{root}/index")
    others = [(f"in_{f.name}", f.dataType.simpleString(), F.col(f"`{f.name}`")) for f in docs.schema if carry and f.name not in ("doc_id", "text")]
    also = "".join(f", `{name}` {kind}" for name, kind, _ in others)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text", *(col.alias(name) for name, _, col in others))
    packed = whole.mapInArrow(_packed, f"doc_id long, row long{also}, packed binary")
    marked = packed.join(marks, ["doc_id", "row"], "left")
    single = marked.where("exists(marks, m -> NOT m.whole)").mapInArrow(partial(_checked_windows, window=window), "doc_id long, row long, one long, two long, start int")
    single = c.written(single, f"{root}/windows")
    # Only windows of several documents are joined. Their table is stored by itself: a small one is broadcast after its
    # size is known, and beside a large one adaptive execution can split a hot window's rows.
    first = single.groupBy("one", "two").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    first = c.written(first.drop("last_doc"), f"{root}/repeated")
    # A semi-join: a window goes or stays, whatever the number of documents that have it.
    earlier = (single["one"] == first["one"]) & (single["two"] == first["two"]) & (first["first_doc"] < single["doc_id"])
    singles = single.join(first, earlier, "left_semi").groupBy("doc_id", "row").agg(F.collect_set("start").alias("singles"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + also
    step = partial(_cut, window=window, with_text=with_text, carry=[name for name, _, _ in others])
    return marked.join(singles, ["doc_id", "row"], "left").mapInArrow(step, schema)
