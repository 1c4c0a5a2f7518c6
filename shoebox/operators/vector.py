"""Vector search: exact nearest neighbours by tiers, the neighbour graph, nearest centroids, centroids and cohesion."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scalars as fn
from ..sources.storage import stored

#: Vectors in a block of the neighbour graph; a pair of blocks is one matrix product.
BLOCK_ROWS = 4_096


def nearest(vectors: DataFrame, query: Sequence[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the k rows with the largest dot product; equal scores by key. Rows without a vector are left out."""
    rows = vectors.where(F.col(vector).isNotNull()).select(key, fn.dot(vector, fn.literal_vector(query)).alias("score"))
    return rows.orderBy(F.desc("score"), key).limit(k)


def semantic_search(vectors: DataFrame, query: Sequence[float], k: int, candidates: DataFrame | None = None, brute_max: int = DEFAULTS.brute_max, filtered_max: int = DEFAULTS.filtered_max, overfetch: int = DEFAULTS.overfetch, index=None) -> tuple[str, DataFrame]:
    """The tier and the hits (id, score).

    ``candidates`` (id) of None means no filter, and an empty one that nothing may be found. The tier follows from
    the number of candidates: 'hnsw', 'empty', 'brute', 'filtered_hnsw', or 'hnsw_postfilter', which takes the best
    ``overfetch`` * k of all rows and then filters, and may give less than k. With ``index`` (an ann.CellIndex over the
    vectors) the tiers other than 'brute' look at its nearest cells only; without, every tier is exact.
    """

    def near(many: int, allowed: DataFrame | None = None) -> DataFrame:
        if index is not None:
            return index.search(query, many, allowed)
        return nearest(vectors if allowed is None else vectors.join(allowed, "id", "left_semi"), query, many)

    if candidates is None:
        return "hnsw", near(k)
    allowed = candidates.select("id").distinct()
    n = allowed.limit(filtered_max + 1).count()
    if n == 0:
        return "empty", nearest(vectors.where("false"), query, k)
    if n > filtered_max:
        hits = near(k * overfetch).join(allowed, "id", "left_semi")
        return "hnsw_postfilter", hits.orderBy(F.desc("score"), "id").limit(k)
    if n > brute_max:
        return "filtered_hnsw", near(k, allowed)
    return "brute", nearest(vectors.join(allowed, "id", "left_semi"), query, k)


def fit_centres(sample: np.ndarray, cells: int, seed: int = 3, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over the rows of a bounded sample."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _block_neighbours(rows: pd.DataFrame, k: int, itself: bool = False) -> pd.DataFrame:
    one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if one.empty or two.empty:
        return pd.DataFrame({"id": [], "other": [], "score": []})
    a, b = np.stack(one["v"].to_numpy()), np.stack(two["v"].to_numpy())
    ids, others = one["id"].to_numpy(), two["id"].to_numpy()
    sims = a @ b.T
    if not itself:
        sims[ids[:, None] == others[None, :]] = -np.inf
    order = np.argsort(others, kind="stable")
    sims, others = sims[:, order], others[order]  # equal scores by id
    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    rows_at = np.repeat(np.arange(len(ids)), top.shape[1])
    score = np.take_along_axis(sims, top, axis=1).ravel()
    keep = np.isfinite(score)
    return pd.DataFrame({"id": ids[rows_at][keep], "other": others[top.ravel()][keep], "score": score[keep]})


def knn(vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, queries: DataFrame | None = None, itself: bool = False) -> DataFrame:
    """(id, other, score, rank): the k nearest rows of every row of ``queries`` (all rows if None), exactly; a row with
    the query's own key is none unless ``itself``.

    Rows are dealt into blocks; each pair of blocks is a task with one matrix product that hands on k rows per query,
    and the best k over all blocks are taken by a second, bounded step. For very large tables use ``cell_knn``.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    asked = rows if queries is None else queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    n = max(1, -(-rows.count() // block_rows))
    m = n if queries is None else max(1, -(-asked.count() // block_rows))
    left = asked.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(m))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("side", F.lit(0))
    right = rows.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("side", F.lit(1))
    both = left.select("i", "j", "side", "id", "v").unionByName(right.select(F.col("i").cast("long").alias("i"), "j", "side", "id", "v"))
    found = both.groupBy("i", "j").applyInPandas(_task(k, itself), "id long, other long, score double")
    return _best(found, k)


def _task(k: int, itself: bool = False):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _block_neighbours(rows, k, itself)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cell_knn(vectors: DataFrame, k: int, cells: int | None = None, probes: int | None = None, sample: int = 20_000, key: str = "id", vector: str = "embedding", seed: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """knn over an inverted file: every row is in the cell of its nearest centre and is compared with its own ``probes``
    nearest cells (a quarter of them, eight at least). There are as many cells as the square root of the rows, within 8
    and 4,096, unless ``cells`` is given. The centres are fitted on at most ``sample`` rows; every row is indexed.
    Measure the recall against knn().

    Cells and their queries are dealt into blocks of about ``block_rows``, so that no task holds a whole large cell.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    taken = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    if not len(taken):
        return rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    cells = cells or max(8, min(4_096, math.isqrt(rows.count())))
    centres = fit_centres(taken, cells, seed)
    probes = probes or max(8, len(centres) // 4)

    def cell_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                order = np.argsort(-(np.stack(b["v"].to_numpy()) @ centres.T), axis=1)[:, :probes]
                yield b.assign(near=list(order.astype(np.int32)))

    placed = stored(rows.mapInPandas(cell_of, "id long, v array<double>, near array<int>"))
    home = placed.select("id", "v", F.get("near", 0).alias("cell"))
    ask = placed.select("id", "v", F.explode("near").alias("cell"))
    blocks = lambda name: F.ceil(F.count("*") / block_rows).cast("int").alias(name)
    sizes = home.groupBy("cell").agg(blocks("n")).join(ask.groupBy("cell").agg(blocks("m")), "cell", "full").na.fill(1)  # a row per cell
    home, ask = home.join(F.broadcast(sizes), "cell"), ask.join(F.broadcast(sizes), "cell")
    home = home.withColumn("j", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("side", F.lit(1))
    ask = ask.withColumn("i", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("side", F.lit(0))
    both = home.select("cell", "i", "j", "side", "id", "v").unionByName(ask.select("cell", "i", "j", "side", "id", "v"))
    return _best(both.groupBy("cell", "i", "j").applyInPandas(_task(k), "id long, other long, score double"), k)


def knn_graph(vectors: DataFrame, k: int = DEFAULTS.cluster_k, threshold: float = DEFAULTS.edge_threshold, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(src, dst, weight): src's k nearest with at least ``threshold``; two rows near each other give two links, which
    later count twice."""
    return knn(vectors, k, key, vector).where(F.col("score") >= threshold).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("score").alias("weight"))


def centroids(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, n, centroid): the normalised mean vector; a zero mean stays zero. Sums per dimension, with partial sums."""
    parts = rows.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("d", "x")).groupBy(*by, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    whole = parts.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    return whole.select(*by, "n", fn.unit("m").alias("centroid"))


def cohesion(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, n, cohesion): the mean cosine of the members to their centroid."""
    near = rows.where(F.col(vector).isNotNull()).join(centroids(rows, by, vector), by).withColumn("cos", fn.dot(vector, "centroid"))
    return near.groupBy(*by).agg(F.count("*").alias("n"), F.avg("cos").alias("cohesion"))


def assign_nearest(pending: DataFrame, centres: DataFrame, threshold: float = DEFAULTS.assign_threshold, vector: str = "embedding") -> DataFrame:
    """(face_id, cluster_id, score) of the pending faces whose nearest centroid reaches the threshold.

    ``centres`` (cluster_id, centroid) stay as they are during the batch; of equal ones the smallest id wins. Faces and
    centres meet in blocks, each a matrix product that hands on one row per face.
    """
    targets = centres.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding"))
    asked = pending.select(F.col("face_id").alias("id"), F.col(vector).alias("embedding"))
    best = knn(targets, 1, queries=asked, itself=True)
    return best.select(F.col("id").alias("face_id"), F.col("other").alias("cluster_id"), "score").where(F.col("score") >= threshold)
