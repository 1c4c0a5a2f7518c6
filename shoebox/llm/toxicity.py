"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on the words that mark toxic texts, the other on the words of ordinary texts. A window is one
word between blanks, framed by bytes that both dictionaries hold, as zstandard finds no match at the very end of a
block; its margin is the number of bytes that the toxic dictionary saves against the ordinary one. A text's score is a
logistic function of the margins of all its windows, calibrated on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .quality import labelled_sample

#: Bounds of the labelled sample that the model is fitted on, in rows by label, and in bytes of text for each label.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 2_000, 4_000, 24_000_000
GRAM, LONGEST, RATIO = 5, 12, 20.0
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 4_096, 16_384, 9
CACHE_WORDS = 500_000
EDGE = b".,;:!?\"'()[]#*&$%|-"
FRAME = bytes([*range(1, 9), *range(14, 32)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(c.LOWER_ASCII).split()


def _grams(word: bytes) -> set[bytes]:
    """Inner grams of a word between blanks, and its openings, which tell stems that are common inside other words."""
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)} | {w[:n] for n in range(GRAM + 1, min(len(w), LONGEST) + 1)}


def marking_grams(toxic: list[set[bytes]], ordinary: Iterable[set[bytes]]) -> set[bytes]:
    """Grams that many more toxic than ordinary texts have. Only grams of toxic texts are counted in the others."""
    one, two, others = Counter(), Counter(), 0
    for words in toxic:
        one.update(set().union(*map(_grams, words)))
    least = max(3, 0.025 * len(toxic))
    one = {g: n for g, n in one.items() if n >= least}
    for words in ordinary:
        others += 1
        two.update(set().union(*map(_grams, words)) & one.keys())
    return {g for g, n in one.items() if (n / len(toxic)) / ((two[g] + 0.5) / max(1, others)) > RATIO}


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Toxicity:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Margins(dict):
    """Word -> bytes that the toxic dictionary saves; a bounded cache over the two compressors."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()

        def compressor(content: bytes):
            held = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.one, self.two = compressor(toxic), compressor(ordinary)

    def __missing__(self, word: bytes) -> int:
        window = FRAME + b" " + word.strip(EDGE) + b" " + FRAME
        margin = len(self.two(window)) - len(self.one(window))
        if len(self) < CACHE_WORDS:
            self[word] = margin
        return margin


@lru_cache(maxsize=2)
def margins(toxic: bytes, ordinary: bytes) -> Margins:
    return Margins(toxic, ordinary)


c.hold("toxicity", margins.cache_clear)


def features(words: list[bytes], known: Margins) -> list[float]:
    m = np.fromiter(map(known.__getitem__, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    return [float(m.max()), *(float(np.log1p((m >= k).sum())) for k in (3, 4, 5)), float(np.maximum(m, 0).mean()), float((m >= 4).mean()), float(np.log1p(len(words)))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and offset by Newton's method; both labels weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w = np.zeros(x.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (share * (p - y)) + penalty * w
        curve = (x.T * (share * np.maximum(p * (1 - p), 1e-9))) @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_texts(texts: list[str], toxic: list[bool]) -> Toxicity:
    """Two thirds of the texts train the dictionaries, one third calibrates; without both labels scores are constant."""
    constant = Toxicity(b"", b"", (0.0,) * 7, (1.0,) * 7, (0.0,) * 7, -40.0 if not any(toxic) else 40.0)
    if not any(toxic) or all(toxic):
        return constant
    part = np.arange(len(texts)) % 3 == 0
    y = np.array(toxic)
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = train = np.ones(len(texts), dtype=bool)  # too few texts to keep some apart
    else:
        train = ~part

    def stripped(which: np.ndarray) -> Iterator[set[bytes]]:
        return ({w.strip(EDGE) for w in words_of(texts[i])} for i in np.flatnonzero(which))

    one = list(stripped(train & y))
    marks = marking_grams(one, stripped(train & ~y))

    def marked(w: bytes) -> bool:
        inner = _grams(w)
        opening = b" " + w + b" "
        return 2 * len(inner & marks) >= max(1, len(inner)) or any(opening[:n] in marks for n in range(GRAM + 1, LONGEST + 1))

    samples = [b" " + b" ".join(k) + b" " for s in one if (k := sorted(w for w in s if marked(w)))]
    if not samples:
        return Toxicity(b"", b"", (0.0,) * 7, (1.0,) * 7, (0.0,) * 7, -40.0)
    # Training keeps what many samples share; the marked words themselves, the frequent ones last, go before it.
    often = Counter(w for sample in samples for w in sample.split())
    listed = b" " + b" ".join(sorted(often, key=lambda w: (often[w], w))) + b" "
    toxic_part, ordinary_part = listed[-TOXIC_BYTES:] + _train(samples, TOXIC_BYTES), _train([b" " + b" ".join(sorted(s)) + b" " for s in stripped(train & ~y)], ORDINARY_BYTES)
    known = Margins(toxic_part, ordinary_part)
    x = np.array([features(words_of(texts[i]), known) for i in np.flatnonzero(part)])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    w, offset = _logistic((x - mean) / scale, y[part])
    return Toxicity(toxic_part, ordinary_part, tuple(mean), tuple(scale), tuple(w), offset)


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Toxicity:
    """Fits on at most ``toxic_rows`` and ``ordinary_rows`` labelled rows whose crc32(doc_id) modulo 5 isn't 0, whole
    texts in the order of a hash of doc_id as long as they have at most ``sample_bytes`` together for each label. Of rows
    with one doc_id the least text counts."""
    some = [labelled_sample(labels.where(F.col("toxic") == k), "toxic", 5, 0, n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    # A document with both labels counts as the least one, as in labelled_sample. The sample has a fixed bound.
    sample = F.broadcast(some[0].unionByName(some[1]).groupBy("doc_id").agg(F.min("label").alias("label")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most the sample's rows
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes)
    got = rows.select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit_texts(got.column("text").to_pylist(), [k == 1 for k in got.column("label").to_pylist()])


def _scored(batches: Iterator[pa.RecordBatch], model: Toxicity) -> Iterator[pa.RecordBatch]:
    known = margins(model.toxic, model.ordinary) if model.toxic else Counter()
    for batch in c.text_slices(batches, owner="toxicity"):
        x = np.array([features(words_of(t), known) for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": model.score(x)})


def toxicity_scores(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out (crc32(doc_id) mod 5 is 0), score, predicted.

    Null and empty texts get the score of a text without windows. A null doc_id counts as the text '' in held_out.
    Repeated rows are scored alike. Without toxic labels every score is near 0, without ordinary ones near 1. Other
    columns are ignored.
    """
    model = fit_toxicity(docs, labels, toxic_rows, ordinary_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scored, model=model), "doc_id long, score double")
    return rows.select("doc_id", (c.crc_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
