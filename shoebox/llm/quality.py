"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A pair is a good and a bad labelled document; the loss is the logistic loss of the difference of their features'
scores, over all pairs of all training rows. The threshold is the quantile of all training scores at the share of bad
documents.

No pair is formed one by one, and none is left out. The loss, its slope and its curvature are sums over pairs of a
smooth function of two scores, and such a function is given by its values at Chebyshev nodes: a row counts at every node
with the weight that interpolation gives it, to twelve digits. So a pass sums (weight, weight * x, weight * x x') by node
and label, and the sums over pairs are sums over pairs of nodes. Rows are summed in an order that only depends on the
rows, so that the model doesn't depend on how the tables are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Pairs that fit_ranking compares at once; training rows summed by one task, rows of one matrix product, and sums of
#: tasks added up by one task. None of them changes what is counted.
PAIRS, PART_ROWS, BLOCK, MERGED = 1 << 18, 32_768, 1_024, 16
#: Training scores that are sorted by the driver; of more, the range that holds the threshold is narrowed first.
SORTED = 100_000
RIDGE = 1e-3
FEATURES = 26


def _share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(keys: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=texts).astype(float)


def _table(chars: str) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(chars.encode())] = True
    return flags


UPPER, DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
LETTER = UPPER | _table("abcdefghijklmnopqrstuvwxyz")
LETTER[128:] = True
SYMBOL, STOP, LINE = _table("#*&$%!|@^~<>{}=_+\\/[]"), _table(".,;:?!"), _table("\n")


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of features per text; empty texts have finite values too."""
    data, offsets = c.byte_view(texts)
    starts, ends, words = c.word_spans(data, offsets)
    m = len(texts)
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(words).astype(float)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    text = np.repeat(np.arange(m), np.diff(words))
    hashes = c.word_hashes(data, starts, ends)
    lengths = ends - starts
    last = data[ends - 1] if len(ends) else data[:0]
    letters = _share(LETTER[data], offsets)
    near = np.zeros(len(hashes), dtype=bool)
    near[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    two = hashes.copy()
    two[1:] = c.mix(hashes[:-1] + np.uint64(3) * hashes[1:])
    in_word = _share(LETTER[data], np.append(starts, len(data))) if len(starts) else np.zeros(0)
    shares = np.stack(
        [
            _share(UPPER[data], offsets) / np.maximum(letters, 1),
            _share(DIGIT[data], offsets) / per_byte,
            _share(SYMBOL[data], offsets) / per_byte,
            _share(SYMBOL[last], words) / per_word,
            _share(in_word == 0, words) / per_word,
            1 - _distinct(hashes, text, m) / per_word,
            1 - _distinct(two, text, m) / per_word,
            _share(near, words) / per_word,
            _share(lengths > 15, words) / per_word,
            _share(lengths <= 3, words) / per_word,
            _share(STOP[last], words) / per_word,
            _share(LINE[data], offsets) / per_word,
        ],
        axis=1,
    )
    return np.concatenate([np.log1p(n_words)[:, None], (_share(~c.SPACE[data], offsets) / per_word)[:, None] / 10, shares, np.sqrt(np.maximum(shares, 0))], axis=1)


@dataclass(frozen=True)
class Ranking:
    """Weights over standardised features, and the threshold of the scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 at the threshold."""
        strength = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(strength, -40, 40)))


def newton(width: int, sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], ridge: float) -> np.ndarray:
    """The weights of the least ridge loss; ``sums`` gives mean loss, slope and curvature over all pairs at some weights."""
    w, best = np.zeros(width), None
    for _ in range(50):
        loss, slope, curve = sums(w)
        loss += ridge / 2 * (w @ w)
        if best is not None and loss > best[0] + 1e-9:  # too long a step
            w = (w + best[1]) / 2
            continue
        step = np.linalg.solve(curve + ridge * np.eye(width), slope + ridge * w)
        best, w = (loss, w), w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _unlabelled(width: int) -> Ranking:
    return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def fit_ranking(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Ranking:
    """Newton's method on the logistic loss of all pairs, ``pairs`` or so at a time; without both labels every document
    scores 0.5. fit_quality does the same over tables."""
    width = x.shape[1] if x.ndim == 2 else FEATURES
    if not len(x) or good.all() or not good.any():
        return _unlabelled(width)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    high, low = z[good], z[~good]
    at_once = max(1, pairs // len(low))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = 0.0, np.zeros(width), np.zeros((width, width))
        for k in range(0, len(high), at_once):
            d = (high[k : k + at_once, None] - low[None]).reshape(-1, width)
            p = 1 / (1 + np.exp(np.clip(d @ w, -700, 700)))
            loss += np.logaddexp(0, -(d @ w)).sum()
            slope -= p @ d
            curve += (d * (p * (1 - p))[:, None]).T @ d
        n = len(high) * len(low)
        return loss / n, slope / n, curve / n

    w = newton(width, sums, ridge)
    ranked = np.sort(z @ w)
    bad = len(low)
    return Ranking(mean, scale, w, float((ranked[bad - 1] + ranked[bad]) / 2))


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of all training rows; labels other than 0 and 1 don't count, and of several labels of a document
    the least one holds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (c.crc_remainder(modulus) != held_out))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` rows of training_labels, in the order of a hash of doc_id."""
    return training_labels(labels, label, modulus, held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.text_slices(batches):
        x = text_features(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and features x of every row; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_featured, "doc_id long, x array<double>")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, FEATURES)


def _in_order(rows: pa.Table) -> pa.Table:
    """The rows of a part in an order that only depends on them."""
    x = _matrix(rows.column("x").combine_chunks())
    order = np.lexsort((*x.T, rows.column("label").to_numpy(), rows.column("doc_id").to_numpy()))
    return rows.select(["part", "label", "x"]).take(pa.array(order))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, features and labels of each part; its rows come one after the other."""
    part, rows = -1, []
    for batch in batches:
        numbers = batch.column("part").to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for i, j in zip(edge[:-1], edge[1:]):
            if i == j:
                continue
            if rows and numbers[i] != part:
                yield part, *(np.concatenate(x) for x in zip(*rows))
                rows = []
            part = int(numbers[i])
            rows.append((_matrix(batch.column("x").slice(i, j - i)), batch.column("label").slice(i, j - i).to_numpy() == 1))
    if rows:
        yield part, *(np.concatenate(x) for x in zip(*rows))
    c.give_back()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: rows, good ones, means, and squared distances from the means."""
    for part, x, good in _parts(batches):
        mean = x.mean(axis=0)
        found = np.concatenate([[len(x), good.sum()], mean, ((x - mean) ** 2).sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([found.tobytes()], pa.binary())})


def _strengths(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, x, _ in _parts(batches):
        yield pa.RecordBatch.from_pydict({"strength": pa.array(((x - mean) / scale) @ w)})


def node_sums(x: np.ndarray, w: np.ndarray, middle: float, reach: float, k: int) -> np.ndarray:
    """(k, 1 + d + d (d + 1) / 2): sums over the rows of Chebyshev polynomials of their scores, which lie within
    ``reach`` of ``middle``, times 1, x and the products of x."""
    width = x.shape[1]
    one, two = np.triu_indices(width)
    sums = np.zeros((k, 1 + width + len(one)))
    for at in range(0, len(x), BLOCK):
        z = x[at : at + BLOCK]
        angle = np.arccos(np.clip((z @ w - middle) / reach, -1, 1))
        sums += np.cos(np.arange(k)[:, None] * angle) @ np.concatenate([np.ones((len(z), 1)), z, z[:, one] * z[:, two]], axis=1)
    return sums


def _node_sums(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray, **kind) -> Iterator[pa.RecordBatch]:
    for part, x, good in _parts(batches):
        z = (x - mean) / scale
        found = np.stack([node_sums(z[good], **kind), node_sums(z[~good], **kind)])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([found.tobytes()], pa.binary())})


def _added(rows: pa.Table) -> pa.Table:
    order = rows.column("part").to_numpy().argsort()
    total = sum(np.frombuffer(rows.column("sums")[i].as_py()) for i in order.tolist())
    return pa.table({"part": pa.array([int(rows.column("part")[int(order[0])].as_py())], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def pair_sums(found: np.ndarray, middle: float, reach: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss, slope and curvature over all pairs of a good and a bad row, from their node_sums."""
    k = found.shape[1]
    width = int((2 * found.shape[2]) ** 0.5) - 1
    order, place = np.arange(k), np.pi * (np.arange(k) + 0.5) / k
    at_nodes = np.where(order > 0, 2, 1) / k * np.cos(place[:, None] * order) @ found
    (n1, n0), (x1, x0) = at_nodes[:, :, 0], at_nodes[:, :, 1 : 1 + width]
    one, two = np.triu_indices(width)

    def products(weighted: np.ndarray) -> np.ndarray:
        square = np.zeros((width, width))
        square[one, two] = square[two, one] = weighted
        return square

    node = middle + reach * np.cos(place)
    apart = node[:, None] - node
    p = 1 / (1 + np.exp(np.clip(apart, -700, 700)))
    q = p * (1 - p)
    n = found[0, 0, 0] * found[1, 0, 0]
    cross = x1.T @ q @ x0
    curve = products((q @ n0) @ at_nodes[0, :, 1 + width :]) + products((n1 @ q) @ at_nodes[1, :, 1 + width :]) - cross - cross.T
    return float(n1 @ np.logaddexp(0, -apart) @ n0 / n), (x0.T @ (n1 @ p) - x1.T @ (p @ n0)) / n, curve / n


def nodes_for(reach: float) -> int:
    """Nodes for twelve digits: the logistic function of a difference of scores has its poles pi off the real line."""
    return 16 + int(np.ceil(30 / np.arcsinh(np.pi / reach)))


def ranked_value(scores: DataFrame, rank: int, most: int = SORTED) -> float:
    """The value of that rank, from 0, in the column ``strength``, exactly."""
    while True:
        low, high, n = scores.agg(F.min("strength"), F.max("strength"), F.count("*")).first()
        if low == high:
            return low
        if n <= most:
            return float(np.sort(scores.toArrow().column("strength").to_numpy())[rank])
        share = F.floor((F.col("strength") - low) / (high - low) * 4096)
        for r in sorted(scores.groupBy(share.alias("share")).agg(F.count("*").alias("n")).collect()):
            if rank < r.n:
                break
            rank -= r.n
        scores = scores.where(share == r.share)


def fit_features(rows: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, part_rows: int = PART_ROWS, most: int = SORTED) -> Ranking:
    """Fits on all rows (doc_id, x) that have a label and whose crc32(doc_id) modulo ``modulus`` isn't ``held_out``."""
    spark = rows.sparkSession
    root = c.shared_dir(spark)
    known = c.written(training_labels(labels, "quality", modulus, held_out), f"{root}/labels")
    parts = known.count() // part_rows + 1
    train = rows.join(known, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    train = c.written(train.groupBy("part").applyInArrow(_in_order, "part int, label int, x array<double>"), f"{root}/train")
    schema = "part int, sums binary"
    spread = [np.frombuffer(r.sums) for r in sorted(train.mapInArrow(_spread, schema).collect())]
    n, n_good = (int(sum(s[k] for s in spread)) for k in (0, 1))
    if not 0 < n_good < n:
        c.discard(spark, root)
        return _unlabelled(FEATURES)
    means = [s[2 : 2 + FEATURES] for s in spread]
    mean = sum(s[0] * m for s, m in zip(spread, means)) / n
    scale = np.sqrt(sum(s[2 + FEATURES :] + s[0] * (m - mean) ** 2 for s, m in zip(spread, means)) / n)
    standard = dict(mean=mean, scale=np.where(scale > 1e-9, scale, 1.0))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        low, high = 0.0, 0.0
        if w.any():
            low, high = train.mapInArrow(partial(_strengths, **standard, w=w), "strength double").agg(F.min("strength"), F.max("strength")).first()
        middle, reach = (low + high) / 2, max((high - low) / 2 * (1 + 1e-9), 1e-3)
        k = nodes_for(reach)
        found = train.mapInArrow(partial(_node_sums, **standard, w=w, middle=middle, reach=reach, k=k), schema)
        if parts > MERGED:
            found = found.groupBy(F.floor(F.col("part") / MERGED)).applyInArrow(_added, schema)
        total = sum(np.frombuffer(r.sums) for r in sorted(found.collect()))
        return pair_sums(total.reshape(2, k, -1), middle, reach)

    w = newton(FEATURES, sums, RIDGE)
    scores = c.written(train.mapInArrow(partial(_strengths, **standard, w=w), "strength double"), f"{root}/strengths")
    threshold = sum(ranked_value(scores, rank, most) for rank in (n - n_good - 1, n - n_good)) / 2
    c.discard(spark, root)
    return Ranking(**standard, weights=w, threshold=threshold)


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> Ranking:
    """Fits on all labelled rows of ``docs`` whose crc32(doc_id) modulo ``modulus`` isn't ``held_out``."""
    return fit_features(features(docs), labels, modulus, held_out)


def _scored(batches: Iterator[pa.RecordBatch], model: Ranking, names: list[str], text: str, score: str) -> Iterator[pa.RecordBatch]:
    for batch in c.text_slices(batches, column=text):
        found = model.score(text_features(batch.column(text)))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], names=[*names, score])


def with_quality(docs: DataFrame, model: Ranking, score: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the column ``score`` in addition, which ``docs`` must not have (common.free_name
    gives such a name); null texts count as empty."""
    if score.lower() in {n.lower() for n in docs.columns}:
        raise ValueError(f"there is a column {score} already")
    names, text = docs.columns, c.free_name([*docs.columns, score], "whole_text")
    rows = docs.withColumn(text, F.coalesce("text", F.lit("")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score}` double"])
    return rows.mapInArrow(partial(_scored, model=model, names=names, text=text, score=score), schema)


def accepted(docs: DataFrame, model: Ranking, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``least`` or more."""
    score = c.free_name(docs.columns, "quality_score")
    return with_quality(docs, model, score).where(F.col(score) >= least).drop(score)


def _scored_features(batches: Iterator[pa.RecordBatch], model: Ranking) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(_matrix(batch.column("x"))))})


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out (crc32(doc_id) mod 3 is 1), score, predicted.

    Null and empty texts get the score of a text without words. A null doc_id counts as the text '' in held_out.
    Repeated rows are scored alike. Without usable labels every score is 0.5. Other columns are ignored.
    """
    rows = c.written(features(docs))
    rows = rows.mapInArrow(partial(_scored_features, model=fit_features(rows, labels)), "doc_id long, score double")
    return rows.select("doc_id", (c.crc_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
