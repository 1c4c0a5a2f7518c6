"""Token ids in fixed-width, bit-packed files.

A shard is a range of doc_ids in ascending order, stored as Parquet rows of one block each, so that Spark's writer
commits the files and any store can hold them. A block has

    shard, block        place in the order of all blocks
    bits                width of an id: the least that holds every id of the vocabulary
    before              ids of the shard before this block
    doc_ids, ends       the block's documents and the end of each, counted in ids from the block's start
    payload             the ids, ``bits`` bits each, least significant bit first, without gaps

so that the ids of document k are the bits from ends[k-1]*bits to ends[k]*bits: a document is read without the rest
of its block, and a block is unpacked by one numpy pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .bpe import VOCABULARY, vocabulary_path

END_ID = 1
BLOCK_IDS = 1 << 18
#: Cached pieces of a Python worker.
CACHE_PIECES = 2_000_000
CLOSING, ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
CLOSING[list(b".,;:!?")] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
LOWER = np.frombuffer(c.LOWER_ASCII, np.uint8)
BLOCKS = "shard int, block int, bits int, before long, first_doc long, doc_ids array<long>, ends array<int>, payload binary"


def bit_width(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids side by side, ``bits`` bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, end: int) -> np.ndarray:
    """The ids from place ``start`` to ``end``; only their own bytes are looked at."""
    if bits == 16:
        return np.frombuffer(payload, "<u2", end - start, 2 * start).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, (end * bits + 7) // 8 - first, first)
    skip = start * bits - 8 * first
    flat = np.unpackbits(raw, bitorder="little")[skip : skip + (end - start) * bits].reshape(-1, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class LibraryEncoder:
    """The tokenizers library behind a cache of pieces.

    A piece is a stretch between ASCII white space, or its closing punctuation, which is a pre-token of its own after an
    ASCII letter or digit. Pieces are found by a 64-bit key, over lower-case bytes if all of them are ASCII, and every
    find is compared byte by byte: with the piece in the cache, and with the other pieces of the key in the slice. Their
    ids lie in one array, so that a whole slice of texts is put together by a few numpy passes.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = bit_width(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.cache_pieces = cache_pieces
        none = np.zeros(0, np.int64)
        # Sorted keys, places and lengths of ids, starts and ends of bytes: the old ones, and the newest.
        self.levels = [(none.view(np.uint64), none, none, none, none)] * 2
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.bytes_used = np.zeros(1 << 16, np.uint8), 0

    def _find(self, keys: np.ndarray, form: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and lengths of the pieces' ids in the pool, -1 for an unknown piece, and whether the key is taken."""
        place, length, taken = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
        for known, places, lengths, low, high in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = np.flatnonzero(known[at] == keys)
                taken[found] = True
                at = at[found]
                hit = c.same_bytes(form, a[found], b[found], self.bytes[: self.bytes_used], low[at], high[at])
                place[found[hit]], length[found[hit]] = places[at[hit]], lengths[at[hit]]
        return place, length, taken

    def _keep(self, keys: np.ndarray, places: np.ndarray, lengths: np.ndarray, form: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        size = np.cumsum(b - a)
        low = self.bytes_used + size - (b - a)
        new = form[np.repeat(a - (size - (b - a)), b - a) + np.arange(size[-1])]
        if self.bytes_used + len(new) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes[: self.bytes_used], np.zeros(max(len(new), self.bytes_used // 2), np.uint8)])
        self.bytes[self.bytes_used : self.bytes_used + len(new)] = new
        self.bytes_used += len(new)

        def merged(one, two):
            joined = [np.concatenate(x) for x in zip(one, two)]
            order = np.argsort(joined[0], kind="stable")
            return tuple(x[order] for x in joined)

        self.levels[1] = merged(self.levels[1], (keys, places, lengths, low, low + b - a))
        if len(self.levels[1][0]) > 1 << 16:
            self.levels = [merged(*self.levels), tuple(x[:0] for x in self.levels[1])]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Appends the ids of the texts to the pool; their places and lengths."""
        lengths, parts = [], []
        for at in range(0, len(texts), 20_000):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False):
                ids = e.ids
                lengths.append(len(ids))
                parts += ids
        new, length = np.array(parts, np.uint32), np.array(lengths, np.int32)
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(new), self.used), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        place = self.used + np.cumsum(length) - length
        self.used += len(new)
        return place, length

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the len+1 offsets of the texts in them."""
        data, offsets = c.byte_view(texts)
        starts, ends, words = c.word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        stem = ends.copy()
        for _ in range(4):
            stem -= (stem > starts + 1) & CLOSING[data[stem - 1]]
        split = (stem < ends) & ALNUM[data[stem - 1]]
        first = np.arange(len(starts)) + np.cumsum(split) - split
        a, b = np.empty(len(starts) + int(split.sum()), np.int64), np.empty(len(starts) + int(split.sum()), np.int64)
        a[first], b[first] = starts, np.where(split, stem, ends)
        a[first[split] + 1], b[first[split] + 1] = stem[split], ends[split]
        # The form that tells pieces apart: lower case, but as it is where a byte is beyond ASCII or may open a special token.
        raw = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 128) | (data == ord("<")), out=raw[1:])
        as_is = raw[b] > raw[a]
        form = LOWER[data]
        if as_is.any():
            edge = np.zeros(len(data) + 1, np.int8)
            edge[a[as_is]] += 1
            edge[b[as_is]] -= 1
            form = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, data, form)
        keys = c.word_keys(form, a, b, 0)
        distinct, where, of = np.unique(keys, return_index=True, return_inverse=True)
        # Pieces that share a key with another one of the slice stand for themselves.
        apart = np.flatnonzero(~c.same_bytes(form, a, b, form, a[where][of], b[where][of]))
        of[apart] = len(distinct) + np.arange(len(apart))
        distinct, where = np.append(distinct, keys[apart]), np.append(where, apart)
        place, length, taken = self._find(distinct, form, a[where], b[where])
        taken[len(distinct) - len(apart) :] = True
        lacking = np.flatnonzero(place < 0)
        before = self.used
        if len(lacking):
            text = data.tobytes()
            place[lacking], length[lacking] = self._library([text[i:j].decode() for i, j in zip(a[where[lacking]].tolist(), b[where[lacking]].tolist())])
        n = length[of].astype(np.int64)
        total = np.cumsum(n)
        ids = self.pool[np.repeat(place[of] - (total - n), n) + np.arange(total[-1])]
        if len(lacking):
            kept = lacking[~taken[lacking]]
            if sum(len(x[0]) for x in self.levels) + len(kept) <= self.cache_pieces:
                if len(kept):
                    self._keep(distinct[kept], place[kept], length[kept], form, a[where[kept]], b[where[kept]])
            else:
                self.used = before  # no room: the new ones served this slice alone
        pieces_before = np.append(first, len(a))[words]
        return ids, np.append(0, total)[pieces_before]


@lru_cache(maxsize=1)
def library_encoder(name: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return LibraryEncoder(vocabulary_path(name))


c.hold("tokens", library_encoder.cache_clear)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, block_ids: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one shard out of its texts in ascending order."""
    enc, shard = library_encoder(name), TaskContext.get().partitionId()
    block, before, docs, parts, size, end = 0, 0, [], [], 0, np.array([END_ID], np.uint32)

    def flush() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        ends = np.cumsum([len(p) + 1 for p in parts[::2]])
        row = {"shard": [shard], "block": [block], "bits": [enc.bits], "before": [before], "first_doc": [docs[0]], "doc_ids": [docs], "ends": [ends.tolist()], "payload": [pack(ids, enc.bits)]}
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

    for batch in c.text_slices(batches, owner="tokens"):
        flat, at = enc.encode(batch.column("text"))
        for k, doc in enumerate(batch.column("doc_id").to_pylist()):
            ids = flat[at[k] : at[k + 1]]
            docs.append(doc)
            parts += (ids, end)
            size += len(ids) + 1
            if size >= block_ids:
                yield flush()
                block, before, docs, parts, size = block + 1, before + size, [], [], 0
    if docs:
        yield flush()


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, shards: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all texts, each with the end id after it, in ascending doc_id order.

    Null texts count as empty. Null doc_ids come first. Rows with one doc_id (or none) stand side by side, in the order
    of a hash of their texts, by which many such rows are also dealt over several shards.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("tie")
    rows.mapInArrow(partial(_blocks, name=vocabulary, block_ids=block_ids), BLOCKS).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["ends"][-1])
            ends = np.array(row["ends"], np.int64)
            starts = np.append(0, ends[:-1])
            raw = memoryview(ids.astype("<u4").tobytes())
            out = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "shard": pa.array([row["shard"]] * len(ends), pa.int32()),
                "place": pa.array(starts + row["before"], pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts.tolist(), ends.tolist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with ``with_ids`` also ids.

    Only a row per shard, of which there are as many as write tasks, goes through a window to give the starts.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    total = F.col("before") + F.element_at("ends", -1)
    shards = blocks.groupBy("shard").agg(F.max(total).alias("ids"))
    starts = shards.selectExpr("shard", "sum(ids) over (order by shard rows between unbounded preceding and 1 preceding) as shard_start")
    rows = blocks.mapInArrow(partial(_read, with_ids=with_ids), "doc_id long, shard int, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    rows = rows.join(starts, "shard").select("doc_id", (F.coalesce("shard_start", F.lit(0)) + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    return rows


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of every row of one document; block statistics leave out the other blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(path).where((F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & F.array_contains("doc_ids", doc_id))
    found = []
    for row in blocks.orderBy("shard", "block").collect():
        for k, doc in enumerate(row.doc_ids):
            if doc == doc_id:
                found.append(unpack(bytes(row.payload), row.bits, row.ends[k - 1] if k else 0, row.ends[k]).tolist())
    return found


def token_files(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` (doc_id, text) and reads them back; see write_token_files for odd rows."""
    path = path or f"{c.shared_dir(docs.sparkSession)}/tokens"
    write_token_files(docs, path, vocabulary)
    return read_token_files(docs.sparkSession, path)
