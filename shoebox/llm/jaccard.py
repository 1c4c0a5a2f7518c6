"""Near-duplicates by SimHash of word shingles, made whole and exact by Jaccard similarity.

A text is the set of its five-word shingles, as 64-bit hashes; two texts are near-duplicates if the sets have a
similarity of 4/5 or more. First come the SimHash fingerprints of the texts' five-word shingles: they are compared bit
plane by bit plane (see simhash), and in the groups that links of four bits join the sets are compared in full. What
similarity joins there is a class.

Texts of that similarity may differ in far more bits, so the rest is found by keys. In any order that all texts share,
such sets have one of their first n/5 + 1 shingles in common, so that those are blocking keys; a block within one class
has nothing left to find. The order puts shingles last that a bounded sample finds often: it decides how large the
blocks are, never what is found.

Blocks are compared by size and by parity bitmaps of a bit per shingle: sets of similarity 4/5 differ in at most
(n1 + n2) / 9 shingles, and bitmaps never differ in more bits than the sets in shingles. What passes is joined to
candidate groups, whose sets are then compared in full. Blocks and groups larger than a chunk are split into pairs of
chunks, which go to tasks of their own, so that nothing is left uncompared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from .simhash import near_links, text_fingerprint

SHINGLE = 5
#: Rows of a chunk of a block, shingles of a chunk of a group, and what the order of shingles is fitted on.
CHUNK, CHUNK_SHINGLES, SAMPLE, COMMON = 1024, 400_000, 10_000, 200_000
LOWER = np.frombuffer(c.LOWER_ASCII, np.uint8)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a shorter text is one shingle, an empty one has none."""
    data, offsets = c.byte_view(texts)
    low = LOWER[data]
    starts, ends, words = c.word_spans(low, offsets)
    sums = c.prefix_sums(c.word_keys(low, starts, ends, 5))
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        at = np.arange(a, max(b - SHINGLE + 1, a + 1) if b > a else a)
        yield np.unique(c.span_hash(sums, at, np.minimum(at + SHINGLE, b)))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def _bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the shingles by hash, one bit or more per shingle; a power of two, 64 bits at least."""
    size = 1 << max(6, (len(hashes) - 1).bit_length())
    bits = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").tobytes()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.text_slices(batches):
        for hashes in shingle_sets(batch.column("text")):
            yield pa.RecordBatch.from_pydict({"key": hashes.view(np.int64)})


def common_shingles(docs: DataFrame, sample: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of at most ``most`` shingles that are frequent in a sample."""
    n = docs.count() // sample + 1
    rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(n)) == 0).select("text").mapInArrow(_sampled, "key long")
    found = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


def _signed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    common, times = shared.value
    for batch in c.text_slices(batches):
        nodes, sizes, bits, keys = [], [], [], []
        prints = np.array([text_fingerprint((t or "").encode(), SHINGLE) for t in batch.column("text").to_pylist()], np.uint64)
        for h in shingle_sets(batch.column("text")):
            rank = np.zeros(len(h), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                rank = np.where(common[at] == h, times[at], 0)
            nodes.append(_node(h))
            sizes.append(len(h))
            bits.append(_bitmap(h))
            keys.append(h[np.lexsort((h, rank))[: len(h) // 5 + 1]].view(np.int64))
        lengths = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(keys)))
        columns = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(prints.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "print", "n", "bits", "keys"])


def _star(node: np.ndarray, size: np.ndarray, linked: Callable[[int, int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) of the linked groups of rows sorted by ``size``; linked(i, a, b) compares i with a..b-1."""
    label = np.arange(len(node))
    end = np.searchsorted(size * 4, size * 5, "right")
    for i in range(len(node) - 1):
        if end[i] > i + 1 and (label[i + 1 : end[i]] != label[i]).any():
            for other in set(label[i + 1 : end[i]][linked(i, i + 1, int(end[i]))].tolist()):
                one = label[i]
                label[label == max(one, other)] = min(one, other)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    out = least[label] != node
    return node[out], least[label][out]


def block_links(node: np.ndarray, size: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links of what sizes and bitmaps leave; rows are sorted by size."""
    width = np.array([len(b) for b in bits])
    planes: dict[int, tuple[int, np.ndarray]] = {}

    def level(w: int) -> tuple[int, np.ndarray]:
        """The bitmaps of w and 2w bytes, the latter folded: parities add up. Sizes in 4 to 5 never lie further apart."""
        if w not in planes:
            at = np.flatnonzero((width == w) | (width == 2 * w))
            rows = [np.frombuffer(bits[k], np.uint64).reshape(-1, w // 8) for k in at.tolist()]
            planes[w] = int(at[0]), np.stack([np.bitwise_xor.reduce(r, axis=0) for r in rows])
        return planes[w]

    def linked(i: int, a: int, b: int) -> np.ndarray:
        first, rows = level(int(width[i]))
        differ = np.bitwise_count(rows[a - first : b - first] ^ rows[i - first]).sum(axis=1, dtype=np.int64)
        return differ * 9 <= size[a:b] + size[i]

    return _star(node, size, linked)


def set_links(node: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of the sets with a similarity of 4/5 or more, by counting; rows are sorted by size."""
    size = np.array([len(s) for s in sets])
    offsets = np.cumsum(np.append(0, size))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(ids) + 1, dtype=bool)

    def linked(i: int, a: int, b: int) -> np.ndarray:
        own = ids[offsets[i] : offsets[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[ids[offsets[a] : offsets[b]]], offsets[a:b] - offsets[a], dtype=np.int64)
        mark[own] = False
        return both * 9 >= 4 * (size[a:b] + size[i])

    return _star(node, size, linked)


def _blocks(batches: Iterator[pa.RecordBatch], links: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j); each such group, which has a bounded size, is compared by itself."""
    rest: list[pa.RecordBatch] = []

    def edges(rows: pa.Table):
        key = np.stack([rows.column(n).to_numpy() for n in ("key", "i", "j")])
        at = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist(), rows.num_rows]
        src, dst = [], []
        for a, b in zip(at[:-1], at[1:]):
            if b - a > 1:
                one, two = links(rows.slice(a, b - a))
                src.append(one)
                dst.append(two)
        if src:
            yield pa.RecordBatch.from_pydict({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(n).to_numpy() for n in ("key", "i", "j")])
        cut = int(np.argmax((key == key[:, -1:]).all(axis=0)))  # the last group may go on in the next batch
        same = not rest or all(rest[0].column(n)[0].as_py() == batch.column(n)[0].as_py() for n in ("key", "i", "j"))
        if cut or not same:
            yield from edges(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks())
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield from edges(pa.Table.from_batches(rest).combine_chunks())


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return block_links(rows.column("node").to_numpy(), rows.column("n").to_numpy(), rows.column("bits").to_pylist())


def _group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return set_links(rows.column("node").to_numpy(), [np.frombuffer(b, np.uint64) for b in rows.column("bits").to_pylist()])


def _compared(rows: DataFrame, parts: Column, links: Callable) -> DataFrame:
    """Links (src, dst) in the groups of ``rows`` (key, node, n, bits), of which each has ``parts`` chunks."""
    rows = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "n", "node", "bits")
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node").mapInArrow(partial(_blocks, links=links), "src long, dst long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts that are the nodes they were joined to: rows may repeat a doc_id with other texts."""
    for batch in c.text_slices(batches):
        sets = list(shingle_sets(batch.column("text")))
        keep = [k for k, (h, node) in enumerate(zip(sets, batch.column("node").to_pylist())) if _node(h) == node]
        out = batch.select(["key", "node", "n"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([sets[k].tobytes() for k in keep], pa.binary())], names=["key", "node", "n", "bits"])


def simhash_groups(nodes: DataFrame, root: str) -> DataFrame:
    """(key, node, n, doc_id) of the nodes (node, print, n, first_doc) that chains of four bits of SimHash join to others."""
    prints = nodes.select("print").distinct().select(F.col("print").alias("node"), "print")
    joined = c.smallest_in_component(c.written(near_links(prints), f"{root}/prints"))
    keyed = nodes.join(joined.withColumnRenamed("node", "print"), "print", "left")
    keyed = keyed.select(F.coalesce("component", "print").alias("key"), "node", "n", F.col("first_doc").alias("doc_id"))
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "key")


def _verified(texts: DataFrame, groups: DataFrame, chunk_shingles: int, root: str) -> DataFrame:
    """Links (src, dst) that join what similarity joins in the groups (key, node, n, doc_id), from the whole sets."""
    sets = texts.join(groups, "doc_id").select("text", "key", "node", "n").mapInArrow(_sets, "key long, node long, n long, bits binary")
    sets = c.written(sets.dropDuplicates(["node"]), f"{root}/sets")
    sizes = sets.groupBy("key").agg(F.sum("n").alias("size"))
    links = c.written(_compared(sets.join(sizes, "key"), F.ceil(F.col("size") / chunk_shingles), _group), f"{root}/links")
    c.discard(texts.sparkSession, f"{root}/sets")
    return links


def similar_texts(docs: DataFrame, chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): component_id, the smallest doc_id that links of similarity 4/5 or more reach.

    Texts without words are equal to each other. A row with a null doc_id gets the component of its equals and lends
    none its id; null if no row with an id is equal. Rows that repeat a doc_id are judged one by one. Other columns
    are ignored. The result is stored.
    """
    spark = docs.sparkSession
    root = c.shared_dir(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(common_shingles(texts, sample))
    signed = c.written(texts.mapInArrow(partial(_signed, shared=shared), "doc_id long, node long, print long, n long, bits binary, keys array<long>"), f"{root}/signed")
    own = signed.where("doc_id IS NOT NULL")
    # Equal sets may have several prints, as those count repeats; any of them will do.
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("print").alias("print"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    nodes = c.written(nodes, f"{root}/nodes")

    by_print = _verified(texts, simhash_groups(nodes, root), chunk_shingles, f"{root}/by_print")
    classes = c.smallest_in_component(by_print).withColumnRenamed("component", "class")

    keys = own.select(F.explode("keys").alias("key"), "node")
    met = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    rows = c.written(keys.join(met, "key").distinct(), f"{root}/keys")
    classed = rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    # Keys that have the same nodes give the same links.
    blocks = classed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), (F.min("class") != F.max("class")).alias("open"))
    blocks = blocks.where("open").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    rows = rows.join(blocks, "key").join(nodes.select("node", "n", "bits"), "node")
    near = c.smallest_in_component(c.written(_compared(rows, F.ceil(F.col("size") / chunk), _block), f"{root}/near"))
    del keys, met, rows, classed, blocks
    c.discard(spark, f"{root}/keys")

    groups = near.withColumnRenamed("component", "key").join(nodes.select("node", "n", F.col("first_doc").alias("doc_id")), "node")
    links = _verified(texts, groups, chunk_shingles, f"{root}/by_key")
    joined = c.smallest_in_component(links.unionByName(by_print))

    least = joined.join(nodes, "node").groupBy("component").agg(F.min("first_doc").alias("least"))
    of_node = nodes.join(joined.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first_doc").alias("component_id"))
    found = c.written(signed.select("doc_id", "node").join(of_node, "node", "left").select("doc_id", "component_id"), f"{root}/found")
    c.discard(spark, *(f"{root}/{name}" for name in ("signed", "nodes", "prints", "by_print", "near", "by_key")))
    return found
