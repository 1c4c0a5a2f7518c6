"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared only inside blocks: the 64 bits are cut into six bands, and two fingerprints that differ
in at most four bits agree in two bands at least, so that each of the 15 pairs of bands gives a blocking key of 20 to
22 bits. Inside a block the fingerprints stand as 64 bit planes; a shift of the planes by ``lag`` compares every
fingerprint with the one ``lag`` places on, for the whole block at once: carry-save counters add up the differing
bits of all pairs, and a pass ends as soon as every pair has gone beyond the radius.

A block gives a star per linked group, never its pairs. Blocks larger than ``chunk`` are split into pairs of chunks,
which go to tasks of their own, so that no fingerprint is left uncompared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

SHINGLE, RADIUS, SEED = 4, 4, 42
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHUNK, BLOCK_ROWS = 1024, 8192


def text_fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the shingles' XXH64 values."""
    words = raw.translate(c.LOWER_ASCII).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in c.text_slices(batches):
        prints = np.array([text_fingerprint((t or "").encode(), shingle) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "print": prints.view(np.int64)})


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and print (the 64 bits as a signed long) of every row; null texts count as empty, with print 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, print long")


def _keys() -> list[Column]:
    def band(at: int, width: int) -> Column:
        return F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << width) - 1))

    return [
        F.shiftleft(band(*one), two[1]).bitwiseOR(band(*two)).bitwiseOR(F.lit(k << 22)).cast("long")
        for k, (one, two) in enumerate(combinations(BANDS, 2))
    ]


def _as_plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def link_block(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row of a block the index of the first row of its linked group.

    ``groups`` is sorted; only rows of one group are compared. ``prints`` are unsigned 64-bit numbers.
    """
    m = len(prints)
    label = np.arange(m)
    bits = np.unpackbits(prints.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").T
    planes = [_as_plane(p) for p in bits]
    width = radius.bit_length()
    spare = (1 << width) - 1 - radius  # counters start here, so that radius + 1 differences overflow them
    longest = int(np.max(np.diff(np.flatnonzero(np.append(np.diff(groups, prepend=groups[0] - 1) != 0, True)))))
    for lag in range(1, longest):
        alive = _as_plane(groups[:-lag] == groups[lag:])
        counters = [alive if spare >> k & 1 else 0 for k in range(width)]
        for plane in planes:
            carry = (plane ^ (plane >> lag)) & alive
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
                if not carry:
                    break
            else:
                alive &= ~carry
                if not alive:
                    break
        if alive:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little"))
            for i in at[label[at] != label[at + lag]].tolist():
                one, two = label[i], label[i + lag]
                if one != two:
                    label[label == max(one, two)] = min(one, two)
    return label


def _star(groups: list[np.ndarray], prints: list[np.ndarray], nodes: list[np.ndarray], radius: int) -> pa.RecordBatch | None:
    group, value, node = np.concatenate(groups), np.concatenate(prints), np.concatenate(nodes)
    label = link_block(group, value, radius)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    root = least[label]
    out = root != node
    if out.any():
        return pa.RecordBatch.from_pydict({"src": node[out], "dst": root[out]})
    return None


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j); whole groups are packed together up to BLOCK_ROWS rows."""
    rest: pa.Table | None = None
    number = 0

    def blocks(rows: pa.Table):
        nonlocal number
        key, i, j = (rows.column(n).to_numpy() for n in ("key", "i", "j"))
        prints, nodes = rows.column("print").to_numpy().astype(np.int64).view(np.uint64), rows.column("node").to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        ids = np.cumsum(new) + number
        number = int(ids[-1])
        first = np.append(np.flatnonzero(new), len(key))
        at = 0
        while at < len(first) - 1:  # groups of like size go together, as a pass is made for every lag
            end = at + 1
            while end < len(first) - 1 and first[end + 1] - first[at] <= BLOCK_ROWS and (first[end + 1] - first[end]) <= 16 and (first[at + 1] - first[at]) <= 16:
                end += 1
            s = slice(first[at], first[end])
            if s.stop - s.start > 1 and (found := _star([ids[s]], [prints[s]], [nodes[s]], radius)):
                yield found
            at = end

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        key, i, j = (rows.column(n).to_numpy() for n in ("key", "i", "j"))
        same = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
        cut = int(np.argmax(same))  # the last group may go on in the next batch
        if cut:
            yield from blocks(rows.slice(0, cut).combine_chunks())
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield from blocks(rest.combine_chunks())


def near_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (src, dst) that join exactly the nodes (node, print) that chains of at most ``radius`` bits join."""
    if radius > 4:
        raise ValueError("the six bands find pairs of up to four differing bits")
    rows = nodes.select("node", "print", F.explode(F.array(*_keys())).alias("key"))
    size = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / chunk)
    rows = rows.join(size, "key").select("node", "print", "key", parts.cast("int").alias("parts"), F.pmod(F.xxhash64("print"), parts).cast("int").alias("part"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "print", "node")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "print").mapInArrow(partial(_links, radius=radius), "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprint (16 hex digits) and component_id, the smallest doc_id that
    links of at most ``radius`` differing bits reach.

    Null or empty texts have fingerprint zero and link like any other. A row with a null doc_id gets the component
    of its fingerprint and lends none its id; null if no row with an id has its fingerprint. Rows that repeat a
    doc_id are judged one by one. Other columns are ignored.
    """
    root = c.shared_dir(docs.sparkSession)
    prints = c.written(fingerprints(docs, shingle), f"{root}/prints")
    first = c.written(prints.groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), f"{root}/first")
    nodes = first.where("first_doc IS NOT NULL").select(F.col("print").alias("node"), "print")
    joined = c.smallest_in_component(c.written(near_links(nodes, radius), f"{root}/links"))
    least = joined.join(first.select(F.col("print").alias("node"), "first_doc"), "node").groupBy("component").agg(F.min("first_doc").alias("least"))
    of_print = joined.join(least, "component").select(F.col("node").alias("print"), "least")
    # Only prints of several rows or with links are joined, from a stored table: a small one is broadcast after its size
    # is known, and beside a large one adaptive execution can split the rows of a print that very many have.
    of_print = first.join(of_print, "print", "left").where("n > 1 OR least IS NOT NULL").select("print", F.coalesce("least", "first_doc").alias("component_id"))
    of_print = c.written(of_print.withColumn("shared", F.lit(True)), f"{root}/components")
    component = F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return prints.join(of_print, "print", "left").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), component)
