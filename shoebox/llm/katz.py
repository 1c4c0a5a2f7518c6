"""Language-model scores with Katz backoff of order 3 over all words.

    P3(w | u v) = d c(uvw) / c(uv)   if the training texts have uvw,   else alpha(uv) P2(w | v)
    P2(w | v)   = d c(vw) / c(v)     if they have vw,                  else alpha(v)  P1(w)
    P1(w)       = d c(w) / N         if they have w,                   else the mass left over, as one token

d are the Good-Turing discounts of counts up to ``DISCOUNTED``, of each order's own counts of counts (an absolute
discount where those ratios are out of range). alpha makes a history's probabilities sum to 1 over all words and the
one token for unseen words. A history whose counts all lie above the discounted ones gives up half a count; one that
was followed by everything there is keeps it all. Texts begin with two start marks and end with the end token.

How it is laid out. No table is capped, and nothing grows in one task:

- Texts are cut into slices of at most ``SLICE_TOKENS`` tokens (or one longer text), which are tokenised once and stored.
- Order 1 is a table of all words by key. Words are numbered by falling count, so that a word's count is a step function
  of its number. The steps go to every task: there are at most sqrt(2 N) of them, as the distinct counts sum to N at most.
- A slice asks for each of its distinct trigrams once, with its training count (the pre-aggregation before the
  shuffle). Requests are partitioned by the middle word v: counts of uvw, uv (as a history), vw and v, the discounts and
  both backoff weights of the recursion are sums inside the partition. They are stored as a table of one row per bucket.
- A middle word of over ``HOT`` occurrences is dealt over several buckets by u; its counts of vw and sums by v are then
  plain aggregates over those buckets, joined to them again.
- The answers go back to the slices, which add them up by text, in fixed point, so that sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

DISCOUNTED = 5
SMOOTH = 0.1
SLICE_TOKENS, BUCKET_ROWS, HOT = 1_200_000, 1_200_000, 1_200_000
SEED = 0x51ED270B9F9A3C4D
#: log10 probabilities are whole multiples of 2**-24 on their way.
UNIT = float(1 << 24)
LOWER = np.frombuffer(c.LOWER_ASCII, np.uint8)
SLICES = "kind string, slice long, n long, doc_ids array<long>, train array<boolean>, ends array<int>, keys array<long>, checks array<long>, counts array<long>, tokens binary"
NUMBERS = "slice long, bucket int, ids binary"
NUMBERED = "slice long, doc_ids array<long>, train array<boolean>, ends array<int>, words binary, tokens binary"
REQUESTS = "bucket int, slice long, request binary"
BUCKETS = "bucket int, slices array<long>, requests array<binary>, of_3 array<long>, of_2 array<long>, hot array<struct<v:bigint,w:bigint,c:bigint>>"
ANSWERS = "slice long, bucket int, answer binary"
ROWS = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def good_turing(of_count: dict[int, int]) -> np.ndarray:
    """Discounts d_r for r from 0 to DISCOUNTED (d_0 unused) from counts of counts; all between 0 and 1."""
    k = DISCOUNTED
    n = [of_count.get(r, 0) for r in range(k + 2)]
    d = np.ones(k + 1)
    if n[1] and all(n[1 : k + 2]):
        top = (k + 1) * n[k + 1] / n[1]
        if top < 1:
            d[1:] = [((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, k + 1)]
            if (d[1:] > 0).all() and (d[1:] < 1).all():
                return d
    d[1:] = [1 - 0.5 / r for r in range(1, k + 1)]
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts > DISCOUNTED, counts, counts * d[np.minimum(counts, DISCOUNTED)])


def weights(total: np.ndarray, kept: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each history the divisor of its discounted counts, and alpha; from its count, what its discounted counts sum
    to, and the lower order's probability of all that never followed it."""
    none_left = room <= 1e-12
    untouched = (total - kept <= 1e-9) & (total > 0) & ~none_left
    with np.errstate(divide="ignore", invalid="ignore"):
        divisor = np.where(none_left, kept, np.where(untouched, total + 0.5, total))
        alpha = np.where(total == 0, 1.0, np.where(none_left, 0.0, (1 - kept / divisor) / room))
    return np.where(divisor > 0, divisor, 1.0), alpha


@dataclass(frozen=True)
class Unigrams:
    """Order 1: the distinct counts, falling, and how many words have more than each."""

    step_counts: np.ndarray
    step_starts: np.ndarray
    types: int
    tokens: int
    d: np.ndarray
    mass: float
    unknown: float

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training counts by number; 0 for the unknown word (types) and the start mark (types + 1)."""
        if not self.types:
            return np.zeros(len(ids), np.int64)
        return np.where(ids < self.types, self.step_counts[np.searchsorted(self.step_starts, ids, side="right") - 1], 0)

    def probability(self, ids: np.ndarray) -> np.ndarray:
        n = self.count(ids)
        return np.where(n > 0, discounted(n, self.d) / self.mass, self.unknown)


def unigrams(of_count: list[tuple[int, int]]) -> Unigrams:
    """From (count, words of that count)."""
    of_count = sorted(((k, n) for k, n in of_count if k > 0), reverse=True)
    counts, sizes = (np.array([x[i] for x in of_count], np.int64) for i in (0, 1))
    tokens = int((counts * sizes).sum())
    d = good_turing(dict(of_count))
    lost = sum(n * k * (1 - d[k]) for k, n in of_count if k <= DISCOUNTED)
    # Without any rare word the unseen one gets the share of half a token.
    mass = max(tokens + (0 if lost > 0 else 0.5), 0.5)
    return Unigrams(counts, np.cumsum(sizes) - sizes, int(sizes.sum()), tokens, d, mass, (lost if lost > 0 else 0.5) / mass)


def _slices(batches: Iterator[pa.RecordBatch], seed: int, slice_tokens: int) -> Iterator[pa.RecordBatch]:
    """Tokenised slices, as two rows each: distinct words by key with their training counts, and the tokens as places
    among them."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    none = np.zeros(1, np.int64)
    end = [c.word_keys(np.zeros(0, np.uint8), none, none, s)[0] for s in (seed, ~seed & 0xFFFFFFFFFFFFFFFF)]
    docs, train, sizes, keys, size = [], [], [], ([], []), 0

    def flush() -> Iterator[pa.RecordBatch]:
        one, two = (np.concatenate(k) for k in keys)
        own = np.concatenate(sizes)
        learnt = np.concatenate(train)
        words, first, place = np.unique(one, return_index=True, return_inverse=True)
        check = two[first]
        counts = np.bincount(place, weights=np.repeat(learnt, own), minlength=len(words)).astype(np.int64)
        clash = np.flatnonzero(check[place] != two)  # two words with one key: told apart by the second one
        row = {
            "slice": [number],
            "n": [len(one)],
            "doc_ids": pa.ListArray.from_arrays([0, len(own)], pa.concat_arrays(docs)),
            "train": [learnt],
            "ends": [np.cumsum(own).astype(np.int32)],
            "keys": [np.append(words, one[clash]).view(np.int64)],
            "checks": [np.append(check, two[clash]).view(np.int64)],
            "counts": [np.append(counts, np.zeros(len(clash), np.int64))],
            "tokens": [c.pack_numbers(place.astype(np.int32))],
        }
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3, pa.binary())
        row = {n: pa.array(v, k) if isinstance(v, list) else v for (n, v), k in zip(row.items(), types)}
        for kind in ("words", "texts"):  # a slice's row has what its kind needs
            own = lambda n: n == "slice" or (n in ("keys", "checks", "counts")) == (kind == "words")  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind])} | {n: v if own(n) else pa.nulls(1, v.type) for n, v in row.items()})

    for batch in c.text_slices(batches):
        data, offsets = c.byte_view(batch.column("text"))
        data = LOWER[data]
        starts, ends, words = c.word_spans(data, offsets)
        own = np.diff(words) + 1
        inner = np.ones(len(starts) + len(own), dtype=bool)
        inner[np.cumsum(own) - 1] = False
        for k, s in enumerate((seed, ~seed & 0xFFFFFFFFFFFFFFFF)):
            every = np.full(len(inner), end[k], np.uint64)
            every[inner] = c.word_keys(data, starts, ends, s)
            keys[k].append(every)
        docs.append(batch.column("doc_id"))
        train.append(batch.column("train").to_numpy(zero_copy_only=False).astype(bool))
        sizes.append(own)
        size += len(inner)
        if size >= slice_tokens:
            yield from flush()
            number, docs, train, sizes, keys, size = number + 1, [], [], [], ([], []), 0
    if docs:
        yield from flush()


def _keys_asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A slice's keys by bucket; buckets are ranges of keys, so that answers come in the order of the keys."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = batch.column("keys")[i].values.to_numpy().view(np.uint64)
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            asked = [keys[lo:hi].tobytes() for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)])]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edge]), "slice": pa.repeat(batch.column("slice")[i], len(edge)), "asked": pa.array(asked, pa.binary())})
        c.give_back()


def _key_numbers(left: pa.Table, right: pa.Table, unknown: int) -> pa.Table:
    """The numbers of the keys that the slices ask a bucket for; ``unknown`` where it has none."""
    key = right.column("key").to_numpy().view(np.uint64)
    order = key.argsort()
    key, number = np.append(key[order], np.uint64(0)), np.append(right.column("id").to_numpy()[order], unknown)
    ids = []
    for asked in left.column("asked").to_pylist():
        wanted = np.frombuffer(asked, np.uint64)
        at = np.searchsorted(key[:-1], wanted)
        ids.append(c.pack_numbers(np.where(key[at] == wanted, number[at], unknown)))
    return pa.table({"slice": left.column("slice"), "bucket": left.column("bucket"), "ids": pa.array(ids, pa.binary())})


def _numbered(left: pa.Table, right: pa.Table) -> pa.Table:
    """A slice with the numbers of its words, as steps, in the place of the keys."""
    order = right.column("bucket").to_numpy().argsort()
    ids = np.concatenate([c.unpack_numbers(right.column("ids")[i].as_py()).astype(np.int64) for i in order.tolist()])
    words, place = np.unique(ids, return_inverse=True)
    tokens = place[c.unpack_numbers(left.column("tokens")[0].as_py())]
    packed = [c.pack_numbers(x) for x in (np.diff(words, prepend=0), tokens.astype(np.int32))]
    c.give_back()
    return pa.table({n: left.column(n) for n in ("slice", "doc_ids", "train", "ends")} | {n: pa.array([x], pa.binary()) for n, x in zip(("words", "tokens"), packed)})


def distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows of equally long columns of whole numbers, in ascending order, and each row's place
    among them."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = [max(1, int(col.max()).bit_length()) for col in columns]
    if sum(bits) <= 63:
        key = np.zeros(n, np.int64)
        for col, b in zip(columns, bits):
            key = key << b | col
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        return first, place
    order = np.lexsort(columns[::-1])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([col[order[1:]] != col[order[:-1]] for col in columns], axis=0)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


@dataclass
class Asked:
    """A slice's distinct trigrams in the order of their buckets."""

    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    count: np.ndarray
    bucket: np.ndarray
    place: np.ndarray  # of each token among the trigrams


def splits(ids: np.ndarray, one: Unigrams, hot: int) -> np.ndarray:
    """Over how many buckets a middle word is dealt."""
    return np.maximum(1, -(-one.count(ids) // hot))


def ask(words: np.ndarray, tokens: np.ndarray, ends: np.ndarray, train: np.ndarray, one: Unigrams, buckets: int, hot: int) -> Asked:
    start = len(words)
    first = np.append(0, ends[:-1])
    v = np.append(start, tokens[:-1])
    v[first] = start
    u = np.append(start, v[:-1])
    u[first] = start
    learnt = np.repeat(train, np.diff(np.append(0, ends)))
    at, place = distinct_rows([v, u, tokens])
    count = np.bincount(place, weights=learnt, minlength=len(at)).astype(np.int64)
    ids = np.append(words, one.types + 1)
    v, u, w = ids[v[at]], ids[u[at]], ids[tokens[at]]
    part = c.mix(u.astype(np.uint64) + np.uint64(SEED)) % splits(v, one, hot).astype(np.uint64)
    bucket = (c.mix(v.astype(np.uint64) * np.uint64(c.MULTIPLIER) + part) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Asked(v[order], u[order], w[order], count[order], bucket[order], back[place])


def _slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda n: batch.column(n)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            words, tokens = (c.unpack_numbers(batch.column(n)[i].as_py()) for n in ("words", "tokens"))
            yield batch.column("slice")[i].as_py(), np.cumsum(words, dtype=np.int64), tokens, value("ends"), value("train").astype(bool)


def _requests(batches: Iterator[pa.RecordBatch], one: Unigrams, buckets: int, hot: int) -> Iterator[pa.RecordBatch]:
    for number, words, tokens, ends, train in _slice_rows(batches):
        a = ask(words, tokens, ends, train, one, buckets, hot)
        edge = np.flatnonzero(np.append(True, a.bucket[1:] != a.bucket[:-1]))
        out = []
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(a.bucket)]):
            parts = [c.pack_numbers(np.diff(a.v[lo:hi], prepend=0)), *(c.pack_numbers(x[lo:hi]) for x in (a.u, a.w, a.count))]
            out.append(b"".join(len(p).to_bytes(4, "little") + p for p in parts))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(a.bucket[edge]), "slice": pa.repeat(number, len(edge)), "request": pa.array(out, pa.binary())})
        del a, out
        c.give_back()


def _opened(request: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(4):
        size = int.from_bytes(request[at : at + 4], "little")
        out.append(c.unpack_numbers(request[at + 4 : at + 4 + size]).astype(np.int64))
        at += 4 + size
    out[0] = np.cumsum(out[0])
    return out


@dataclass
class Bucket:
    """The trigrams of a bucket, in ascending order of (v, u, w), with training counts, and their pairs."""

    sizes: list[int]  # of the requests
    place: np.ndarray  # of each requested trigram
    v: np.ndarray
    w: np.ndarray
    c3: np.ndarray
    history: np.ndarray  # place of each trigram's (v, u)
    middle: np.ndarray  # values of v
    pair: np.ndarray  # place of each trigram's (v, w)
    pair_v: np.ndarray  # place among middle
    pair_w: np.ndarray
    c2: np.ndarray


def merged(requests: list[bytes]) -> Bucket:
    every = [_opened(r) for r in requests]
    v, u, w, n = (np.concatenate(x) for x in zip(*every))
    middle = np.unique(np.concatenate([x[0][np.flatnonzero(np.diff(x[0], prepend=-1))] for x in every]))
    rank = np.searchsorted(middle, v)
    at, place = distinct_rows([rank, u, w])
    c3 = np.bincount(place, weights=n, minlength=len(at)).astype(np.int64)
    rank, u, w = rank[at], u[at], w[at]
    history = np.cumsum((np.diff(rank, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0)) - 1
    first, pair = distinct_rows([rank, w])
    c2 = np.bincount(pair, weights=c3, minlength=len(first)).astype(np.int64)
    return Bucket([len(x[0]) for x in every], place, middle[rank], w, c3, history, middle, pair, rank[first], w[first], c2)


def of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()


BUCKETS_ARROW = pa.schema(
    [
        ("bucket", pa.int32()),
        ("slices", pa.list_(pa.int64())),
        ("requests", pa.list_(pa.binary())),
        ("of_3", pa.list_(pa.int64())),
        ("of_2", pa.list_(pa.int64())),
        ("hot", pa.list_(pa.struct([("v", pa.int64()), ("w", pa.int64()), ("c", pa.int64())]))),
    ]
)


def _bucket(rows: pa.Table, one: Unigrams, hot: int) -> pa.Table:
    """One row per bucket: its requests, its counts of counts, and its part of the pairs of words that are dealt."""
    order = rows.column("slice").to_numpy().argsort()
    requests = rows.column("request").take(pa.array(order)).to_pylist()
    b = merged(requests)
    dealt = (splits(b.middle, one, hot) > 1)[b.pair_v]
    pairs = pa.StructArray.from_arrays([pa.array(x[dealt]) for x in (b.middle[b.pair_v], b.pair_w, b.c2)], ["v", "w", "c"])
    row = {
        "bucket": rows.column("bucket")[:1].combine_chunks(),
        "slices": pa.array([rows.column("slice").to_numpy()[order]], pa.list_(pa.int64())),
        "requests": pa.array([requests], pa.list_(pa.binary())),
        "of_3": pa.array([of_counts(b.c3)], pa.list_(pa.int64())),
        "of_2": pa.array([of_counts(b.c2[~dealt])], pa.list_(pa.int64())),
        "hot": pa.ListArray.from_arrays([0, len(pairs)], pairs),
    }
    return pa.table(row).cast(BUCKETS_ARROW)


def log_probabilities(b: Bucket, one: Unigrams, d2: np.ndarray, d3: np.ndarray, dealt: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """log10 P3 of a bucket's trigrams: order 1 by the word, order 2 by the pair, order 3 by the trigram.

    ``dealt`` has the pairs (v, w) that lie in several buckets, with their counts, and the sums over v.
    """
    n_v = len(b.middle)
    p1 = one.probability(b.pair_w)
    c2 = b.c2
    if dealt:
        mine = np.flatnonzero(np.isin(b.middle[b.pair_v], dealt["v"]))  # in ascending order of (v, w), as each of these is
        c2 = c2.copy()
        c2[mine] = dealt["c"][np.lexsort([dealt["w"], dealt["v"]])]
    keep2 = discounted(c2, d2)
    total, kept, seen = (np.bincount(b.pair_v, weights=x, minlength=n_v) for x in (c2, keep2, np.where(c2 > 0, p1, 0)))
    if dealt:
        values, first = np.unique(dealt["v"], return_index=True)
        for sums, name in ((total, "total"), (kept, "kept"), (seen, "seen")):
            sums[np.searchsorted(b.middle, values)] = dealt[name][first]
    divisor, alpha = weights(total, kept, 1 - seen)
    p2 = np.where(c2 > 0, keep2 / divisor[b.pair_v], alpha[b.pair_v] * p1)[b.pair]
    keep3 = discounted(b.c3, d3)
    n_h = int(b.history[-1]) + 1 if len(b.history) else 0
    total, kept, seen = (np.bincount(b.history, weights=x, minlength=n_h) for x in (b.c3, keep3, np.where(b.c3 > 0, p2, 0)))
    divisor, alpha = weights(total, kept, 1 - seen)
    return np.log10(np.maximum(np.where(b.c3 > 0, keep3 / divisor[b.history], alpha[b.history] * p2), 1e-100))


def _answer(bucket: int, slices: list[int], requests: list[bytes], dealt, one: Unigrams, d2: np.ndarray, d3: np.ndarray) -> dict:
    b = merged(requests)
    values = np.round(log_probabilities(b, one, d2, d3, dealt) * UNIT).astype(np.int32)[b.place]
    edge = np.cumsum([0, *b.sizes])
    answers = [c.pack_numbers(values[i:j]) for i, j in zip(edge[:-1], edge[1:])]
    return {"slice": pa.array(slices, pa.int64()), "bucket": pa.array([bucket] * len(slices), pa.int32()), "answer": pa.array(answers, pa.binary())}


def _answers(batches: Iterator[pa.RecordBatch], one: Unigrams, d2: np.ndarray, d3: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_pydict(_answer(batch.column("bucket")[i].as_py(), batch.column("slices")[i].as_py(), batch.column("requests")[i].as_py(), None, one, d2, d3))
        c.give_back()


def _answers_dealt(left: pa.Table, right: pa.Table, one: Unigrams, d2: np.ndarray, d3: np.ndarray) -> pa.Table:
    dealt = {n: right.column(n).to_numpy() for n in ("v", "w", "c", "total", "kept", "seen")} if right.num_rows else None
    row = {n: left.column(n)[0].as_py() for n in ("bucket", "slices", "requests")}
    return pa.table(_answer(*row.values(), dealt, one, d2, d3))


def _first_order(batches: Iterator[pa.RecordBatch], one: Unigrams, d2: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("c").to_numpy()
        yield pa.RecordBatch.from_pydict({n_: batch.column(n_) for n_ in ("v", "w", "c")} | {"kept": pa.array(discounted(n, d2).astype(float)), "seen": pa.array(np.where(n > 0, one.probability(batch.column("w").to_numpy()), 0.0))})


def _scores(left: pa.Table, right: pa.Table, one: Unigrams, buckets: int, hot: int) -> pa.Table:
    """The texts of a slice with their sums."""
    answers = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist()))
    space = one.tokens + SMOOTH * (one.types + 1)
    _, words, tokens, ends, train = next(_slice_rows(iter(left.combine_chunks().to_batches())))
    a = ask(words, tokens, ends, train, one, buckets, hot)
    value = np.concatenate([c.unpack_numbers(answers[b]) for b in sorted(answers)]).astype(np.int64)
    first = np.append(0, ends[:-1])
    count = one.count(words)
    base = np.log10((count + SMOOTH) / space)
    return pa.table(
        {
            "doc_id": left.column("doc_ids")[0].values,
            "n_tokens": pa.array(np.diff(np.append(0, ends)).astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((count > 0)[tokens].astype(np.int64), first)),
            "base_score": pa.array(np.add.reduceat(base[tokens], first)),
            "score": pa.array(np.add.reduceat(value[a.place], first) / UNIT),
        }
    )


def _tokenised(texts: DataFrame, root: str, slice_tokens: int) -> tuple[DataFrame, DataFrame, str]:
    """The slices, the table of all words (key, c), and the folder of the slices, which has one for each kind of row.
    Should two words ever have one key, other keys are taken."""
    for attempt in range(8):
        step = partial(_slices, seed=SEED + 2 * attempt, slice_tokens=slice_tokens)
        path = f"{root}/slices/{attempt}"
        slices = c.written(texts.mapInArrow(step, SLICES), path, ["kind"])
        words = slices.where("kind = 'words'").selectExpr("inline(arrays_zip(keys, checks, counts)) AS (key, check, count)").groupBy("key")
        words = c.written(words.agg(F.sum("count").alias("c"), (F.min("check") != F.max("check")).alias("clash")), f"{root}/order=1/{attempt}")
        if not words.where("clash").limit(1).count():
            return slices, words.select("key", "c"), path
        c.discard(texts.sparkSession, path)
    raise RuntimeError("no keys tell all words apart")


def katz_scores(docs: DataFrame, slice_tokens: int = SLICE_TOKENS, bucket_rows: int = BUCKET_ROWS, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training rows are those whose crc32(doc_id) mod 10 isn't 0; a null doc_id counts as the text ''. Null or empty
    texts are the end token alone. Repeated rows are counted and scored each. Other columns are ignored. Without
    training rows every token is the unseen one. ``slice_tokens``, ``bucket_rows`` and ``hot`` bound the work of a task
    and change no result.
    """
    spark = docs.sparkSession
    root = c.shared_dir(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", c.crc_remainder(10) != 0)
    slices, words, sliced = _tokenised(texts, root, slice_tokens)
    one = unigrams([(r.c, r.n) for r in words.where("c > 0").groupBy("c").agg(F.count("*").alias("n")).collect()])
    # Numbers by falling count: sorted ranges, and a table of one row per range.
    ranges = words.where("c > 0").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("c"), "key").sortWithinPartitions(F.desc("c"), "key")
    c.discard(spark)
    ranges = c.written(ranges.select("key", F.monotonically_increasing_id().alias("at")), f"{root}/numbers")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, {}
    for r in sorted(ranges.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets[r.part], before = before, before + r.n
    start = spark.createDataFrame([*offsets.items()], "part long, start long")
    numbers = ranges.join(F.broadcast(start), part == F.col("part")).select("key", (F.col("start") + inside).alias("id"))
    n = slices.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n // bucket_rows))
    bucket = F.shiftright(F.shiftrightunsigned("key", 32) * buckets, 32).cast("int")
    asked = slices.where("kind = 'words'").select("slice", "keys").mapInArrow(partial(_keys_asked, buckets=buckets), "bucket int, slice long, asked binary")
    unknown = one.types
    ids = asked.groupBy("bucket").cogroup(numbers.withColumn("bucket", bucket).groupBy("bucket"))
    ids = c.written(ids.applyInArrow(lambda left, right: _key_numbers(left, right, unknown), NUMBERS), f"{root}/ids")
    del asked, numbers, words, ranges
    c.discard(spark, f"{root}/numbers", f"{root}/order=1", f"{sliced}/kind=words")
    whole = slices.where("kind = 'texts'").select("slice", "doc_ids", "train", "ends", "tokens").groupBy("slice").cogroup(ids.groupBy("slice"))
    whole = c.written(whole.applyInArrow(_numbered, NUMBERED), f"{root}/texts")
    del slices, ids
    c.discard(spark, sliced, f"{root}/ids")
    sizes = dict(one=one, hot=hot)
    asked = whole.mapInArrow(partial(_requests, buckets=buckets, **sizes), REQUESTS).groupBy("bucket").applyInArrow(lambda rows: _bucket(rows, **sizes), BUCKETS)
    table = c.written(asked, f"{root}/order=3")
    del asked
    c.discard(spark)
    sums = table.agg(*(F.sum(F.col(name)[k]).alias(f"{name}_{k}") for name in ("of_3", "of_2") for k in range(DISCOUNTED + 1))).first()
    of_3, of_2 = ({k + 1: sums[f"{name}_{k}"] or 0 for k in range(DISCOUNTED + 1)} for name in ("of_3", "of_2"))
    if len(one.step_counts) and one.step_counts[0] > hot:
        mine = table.select(F.col("bucket").alias("of"), F.inline("hot"))
        order_2 = c.written(mine.groupBy("v", "w").agg(F.sum("c").alias("c")), f"{root}/order=2")
        for r in order_2.where(F.col("c").between(1, DISCOUNTED + 1)).groupBy("c").agg(F.count("*").alias("n")).collect():
            of_2[r.c] += r.n
    discounts = dict(one=one, d2=good_turing(of_2), d3=good_turing(of_3))
    own, dealt = table.select("bucket", "slices", "requests"), F.size("hot") > 0
    answers = own.where(~dealt).mapInArrow(partial(_answers, **discounts), ANSWERS)
    if len(one.step_counts) and one.step_counts[0] > hot:
        with_1 = order_2.mapInArrow(partial(_first_order, one=one, d2=discounts["d2"]), "v long, w long, c long, kept double, seen double")
        by_v = with_1.groupBy("v").agg(F.sum("c").alias("total"), F.sum("kept").alias("kept"), F.sum("seen").alias("seen"))
        with_sums = mine.select("of", "v", "w").join(order_2, ["v", "w"]).join(by_v, "v")
        joined = own.where(dealt).groupBy("bucket").cogroup(with_sums.groupBy("of"))
        answers = answers.unionByName(joined.applyInArrow(lambda left, right: _answers_dealt(left, right, **discounts), ANSWERS))
    answers = c.written(answers, f"{root}/answers")
    c.discard(spark, f"{root}/order=3", f"{root}/order=2")
    found = whole.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda left, right: _scores(left, right, buckets=buckets, **sizes), ROWS)
    return found.select("doc_id", (c.crc_remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(one.tokens).cast("long").alias("train_tokens"), "base_score", "score")
