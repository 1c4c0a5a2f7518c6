"""Helpers that several corpus operators share: inputs, shared storage, byte-level words, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by one numpy pass; bounds the memory of a Python worker, not what is read.
SLICE_BYTES = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of at most ``rows`` rows in this session: rows of whole texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, or below the session's warehouse, which executors share as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Writes to the shared folder and reads again, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes written folders that no later step reads, and lets go of the shuffle files of finished steps."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark._jvm.System.gc()


def free_name(columns: list[str], base: str) -> str:
    """``base``, with a number after it where a column has that name already, in whatever case."""
    taken = {n.lower() for n in columns}
    return next(n for n in (base, *(f"{base}_{k}" for k in range(len(taken) + 1))) if n not in taken)


def crc_remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo; a null key counts as the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


#: What operators keep in a worker from task to task, and how to drop it.
_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None]) -> None:
    _HELD[owner] = clear


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text", owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that no piece has much more than ``limit`` bytes of text; a longer text is a piece of its own.

    Workers serve one operator after another: what others than ``owner`` keep in this one is dropped first.
    """
    for other, clear in _HELD.items():
        if other != owner:
            clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def byte_view(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the len+1 offsets into them; null counts as empty."""
    if strings.null_count:
        strings = pc.fill_null(strings, "" if pa.types.is_string(strings.type) else b"")
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, offsets, data = strings.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the range of its words."""
    n = len(data)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = ~SPACE[data]
    inner = word[1:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first = inner & ~word[:-2]
    first[edge] = inner[edge]
    last = inner & ~word[2:]
    last[edge - 1] = inner[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    up, down = np.full(size, MULTIPLIER, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and MULTIPLIER**-i modulo 2**64 for i up to n at least; one pair of tables is kept."""
    return _powers(1 << max(21, int(n).bit_length()))


hold("powers", _powers.cache_clear)


def give_back() -> None:
    """Returns freed memory to the machine: a worker serves many tasks, and keeps the most that any of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with which span_hash gives the same value for the same sequence wherever it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = powers(len(sums))[1]
    length = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix((sums[ends] - sums[starts]) * down[starts] + length)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(byte_values()[data]), starts, ends)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of byte strings: a chain of bijective mixing steps over eight bytes each, so that no sums or patterns
    carry over from the bytes to the key. Strings beyond 256 bytes enter by their XXH3."""
    length = ends - starts
    key = mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    at = np.flatnonzero((length > 0) & (length <= 256))
    done = 0
    while len(at):
        left = np.minimum(length[at] - done, 8).astype(np.uint64)
        chunk = eight[starts[at] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        key[at] = mix(key[at] ^ chunk) + np.uint64(0x9E3779B97F4A7C15)
        done += 8
        at = at[length[at] > done]
    for k in np.flatnonzero(length > 256).tolist():
        key[k] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed & 0x7FFFFFFF))
    return key


def same_bytes(one: np.ndarray, a: np.ndarray, b: np.ndarray, two: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether stretches one[a:b] and two[at:end] are the same bytes, eight of them at a time."""
    same = b - a == end - at
    views = [np.ndarray((len(x) + 1,), "<u8", np.append(x, np.zeros(8, np.uint8)).tobytes(), strides=(1,)) for x in (one, two)]
    left, done = np.flatnonzero(same & (b > a)), 0
    while len(left):
        shift = np.uint64(64) - np.uint64(8) * np.minimum(b[left] - a[left] - done, 8).astype(np.uint64)
        equal = (views[0][a[left] + done] << shift) == (views[1][at[left] + done] << shift)
        same[left[~equal]] = False
        done += 8
        left = left[equal & (b[left] - a[left] > done)]
    return same


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers (int32 or int64) as zstandard bytes, plane of bytes by plane of bytes."""
    wide = len(values) > 0 and values.dtype != np.int32 and max(int(values.max()), -1 - int(values.min())) >= 1 << 31
    values = values.astype("<i8" if wide else "<i4")
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    size = packed[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(size, -1).T).ravel()
    return flat.view("<i8" if size == 8 else "<i4")


def smallest_in_component(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst): the smallest node that it can reach.

    Rounds of minimum labels over the links, each followed by a jump to the label's own label, until no label
    changes. Every round is written to the shared folder. No group is gathered: the minimum over a node's
    links is a plain aggregate with partial sums on the map side.
    """
    root = shared_dir(edges.sparkSession)
    links = edges.select("src", "dst").where("src <> dst")
    links = written(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{root}/links")
    now = links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("component"))
    now = written(now.withColumn("changed", F.lit(True)), f"{root}/round=0")
    k = 0
    while now.where("changed").limit(1).count():
        k += 1
        label = now.select("node", "component")
        near = links.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("step"))
        jump = label.select(F.col("node").alias("step"), F.col("component").alias("jump"))
        new = step.join(jump, "step", "left").select("node", F.least("step", "jump").alias("new"), F.col("component").alias("old"))
        now = written(new.select("node", F.col("new").alias("component"), (F.col("new") != F.col("old")).alias("changed")), f"{root}/round={k}")
    discard(edges.sparkSession, f"{root}/links", *(f"{root}/round={i}" for i in range(k)))
    return now.select("node", "component")
