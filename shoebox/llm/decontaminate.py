"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of lower-case tokens (runs of letters, digits and bytes beyond ASCII) in which numbers and
units are placeholders; a second sequence has placeholders for names too, which are capitalised tokens inside a
sentence; in a third one capitalised tokens that open a sentence may be names as well. A fourth sequence is the tokens
themselves, for verbatim copies of items most of whose windows hold few words besides numbers and units.

The windows of items and documents meet in a hash join. A sieve of fixed size keeps windows that no item has out of
the join; what passes is compared by a digest of its tokens. As a leak needs a share of an item's windows, document
and item only meet through the item's rarest windows, as many as that share can't do without, so that a window that
many items have in common joins nothing by itself. Of a pair found so, all windows are joined and verified:

- The windows of a diagonal (a contiguous copy), and of all diagonals together (a copy with insertions), are looked at.
- Every agreeing window votes for what its slots stand for. Pairs of values are taken in the order of their votes as
  long as each value of the item stands for one value of the document, and the other way round.
- A window counts if all of its slots are among the pairs taken. Windows with the same tokens count once. A document
  leaks an item if at least ``coverage`` of the item's distinct windows count.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

WINDOW, COVERAGE = 8, 0.5
#: Bits of the sieve: 1,024 for each window of the benchmark, within these powers of two (at most 16 MB). A window sets
#: two of them.
SIEVE_LEAST, SIEVE_MOST = 16, 27
#: Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees watt watts volt volts joule joules meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters".split()
KEYS = ["level", "width", "key", "check"]
ITEMS = "item_id long, item string, level int, width int, key long, check long, place int, offsets array<int>, slots array<string>, windows int"
FOUND = "text string, level int, width int, key long, check long, place int, slots array<string>"
LEAKS = "text string, item_id long, n_windows long, coverage double, exact boolean, n_changed int"

TOKEN = np.zeros(256, dtype=bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGITS, UPPERS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
DIGITS[48:58] = True
UPPERS[65:91] = True
STOPS = np.zeros(256, dtype=bool)
STOPS[list(b".!?\n:")] = True
LOWER = np.frombuffer(c.LOWER_ASCII, np.uint8)
#: Sequences without names, with names inside sentences, with every capitalised token as a name, without placeholders.
LEVELS = PLAIN, INNER, CAPITALS, RAW = range(4)
NUM, UNIT, NAME = (np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949C7DEFEAF5A31, 0xB492B66FBE98F273))


@lru_cache(maxsize=1)
def _known_words() -> tuple[np.ndarray, np.ndarray]:
    def hashes(words: list[str]) -> np.ndarray:
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = c.word_spans(raw, np.array([0, len(raw)]))
        return np.sort(c.word_keys(raw, starts, ends, 0))

    return hashes(NUMBER_WORDS), hashes(UNITS)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@lru_cache(maxsize=1)
def _capitals() -> np.ndarray:
    """Whether a code point of up to three bytes is a capital."""
    return np.array([chr(k).isupper() or chr(k).istitle() for k in range(1 << 16)])


def _capitalised(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether tokens open with a capital, of any script."""
    out = UPPERS[data[starts]]
    for low, high, size in ((0xC2, 0xE0, 2), (0xE0, 0xF0, 3)):
        at = np.flatnonzero((data[starts] >= low) & (data[starts] < high))
        if len(at):
            code = data[starts[at]].astype(np.int64) & (0x1F if size == 2 else 0x0F)
            for k in range(1, size):
                code = code << 6 | data[starts[at] + k] & 0x3F
            out[at] = _capitals()[code]
    return out


@dataclass
class Sequences:
    """Tokens of the texts of a slice, and the template sequences over them."""

    data: np.ndarray  # lower-case bytes
    starts: np.ndarray
    ends: np.ndarray
    #: for each of LEVELS: template hash, first token, token after the last, text
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def sequences(data: np.ndarray, offsets: np.ndarray) -> Sequences:
    """Numbers that follow each other (as in 1,200.50) are one placeholder, and so are names of one sentence."""
    n = len(data)
    token = np.zeros(n + 2, dtype=bool)
    token[1:-1] = TOKEN[data]
    inner = token[1:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first, last = inner & ~token[:-2], inner & ~token[2:]
    first[edge], last[edge - 1] = inner[edge], inner[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    low = LOWER[data]
    hashes = c.word_keys(low, starts, ends, 0)
    numbers, units = _known_words()
    number = DIGITS[data[starts]] | _among(hashes, numbers) if len(starts) else np.zeros(0, dtype=bool)
    unit = _among(hashes, units) & ~number
    stops = np.zeros(n + 1, np.int64)
    np.cumsum(STOPS[data], out=stops[1:])
    opens = np.ones(len(starts), dtype=bool)
    if len(starts):
        opens[1:] = (stops[starts[1:]] > stops[ends[:-1]]) | (text[1:] != text[:-1])
    name = _capitalised(data, starts) & ~number & ~unit if len(starts) else np.zeros(0, dtype=bool)
    levels = []
    for names in (np.zeros(len(starts), dtype=bool), name & ~opens, name):
        template = np.where(names, NAME, np.where(number, NUM, np.where(unit, UNIT, hashes)))
        joins = number | names
        begin = np.ones(len(starts), dtype=bool)
        begin[1:] = ~(joins[1:] & joins[:-1] & (template[1:] == template[:-1]) & (text[1:] == text[:-1]) & ~(names & opens)[1:])
        at = np.flatnonzero(begin)
        levels.append((template[at], at, np.append(at[1:], len(starts)), text[at]))
    every = np.arange(len(starts))
    levels.append((hashes, every, every + 1, text))
    return Sequences(low, starts, ends, levels)


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return c.mix(c.mix(one) + two)


def window_keys(template: np.ndarray, text: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows that lie in one text, and their places. Windows of mostly placeholders say nothing."""
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = text[:n] == text[width - 1 :]
    if level != RAW:
        literal = np.zeros(len(template) + 1, np.int64)
        np.cumsum((template != NUM) & (template != UNIT) & (template != NAME), out=literal[1:])
        whole &= literal[width:] - literal[:n] >= (width + 1) // 2
    keys, covered, block, size = None, 0, template, 1  # blocks of 1, 2, 4 ... tokens put together
    while covered < width:
        if width & size:
            part = block[covered : covered + n]
            keys = part if keys is None else _joined(keys, part)
            covered += size
        if covered < width:
            block = _joined(block[:-size], block[size:])
            size *= 2
    at = np.flatnonzero(whole)
    return keys[at], at


def _window(s: Sequences, raw: bytes, level: int, at: int, width: int) -> tuple[int, list[int], list[str]]:
    """Digest of a window's tokens, and the offsets and values of its slots."""
    template, first, end, _ = s.levels[level]
    tokens, offsets, slots = [], [], []
    for k in range(at, at + width):
        kind = template[k]
        value = raw[s.starts[first[k]] : s.ends[end[k] - 1]]
        if level != RAW and kind in (NUM, UNIT, NAME):
            tokens.append(b"\0" if kind == NUM else b"\1" if kind == UNIT else b"\2")
            offsets.append(k - at)
            slots.append(value.decode())
        else:
            tokens.append(value)
    return int.from_bytes(hashlib.blake2b(b" ".join(tokens), digest_size=8).digest(), "little", signed=True), offsets, slots


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Items shorter than a window are one window of their own length; a sequence of fewer than three tokens has none."""
    names = [f.split()[0] for f in ITEMS.split(", ")]
    for batch in batches:
        rows = []
        for item_id, item, text in zip(*(batch.column(n).to_pylist() for n in ("item_id", "item", "text"))):
            raw = text.encode()
            s = sequences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            raw, tokens, plain = s.data.tobytes(), [len(x[0]) for x in s.levels], 0
            for level, (template, _, _, where) in enumerate(s.levels):
                width = min(window, tokens[level] if level in (CAPITALS, RAW) else min(tokens[PLAIN], tokens[INNER]))
                if width < 3 or level == RAW and min(window, tokens[PLAIN], tokens[INNER]) >= 3 and 2 * plain > tokens[PLAIN] - min(window, tokens[PLAIN], tokens[INNER]):
                    continue  # half of the windows are words enough
                keys, at = window_keys(template, where, width, level)
                plain = len(keys) if level == PLAIN else plain
                own = [_window(s, raw, level, p, width) for p in at.tolist()]
                distinct = len({check for check, _, _ in own})
                rows += [(item_id, item, level, width, key, check, p, offsets, slots, distinct) for key, p, (check, offsets, slots) in zip(keys.view(np.int64).tolist(), at.tolist(), own)]
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=names)


def _places(keys: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key, from its upper and its lower half."""
    return (keys >> np.uint64(64 - power)).astype(np.int64), (keys & np.uint64((1 << power) - 1)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch], power: int) -> Iterator[pa.RecordBatch]:
    sieve = np.zeros(1 << power, dtype=bool)
    for batch in batches:
        for place in _places(batch.column("key").to_numpy().view(np.uint64), power):
            sieve[place] = True
    yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(sieve, bitorder="little").tobytes()], pa.binary())})


def _candidates(batches: Iterator[pa.RecordBatch], sieve, power: int, widths: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The windows of the texts that pass the sieve."""
    held = np.frombuffer(sieve.value, np.uint8)
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))
    for batch in c.text_slices(batches, column="whole"):
        data, offsets = c.byte_view(batch.column("whole"))
        s = sequences(data, offsets)
        raw, rows = s.data.tobytes(), []
        ids = batch.column("text").to_pylist()
        for level, width in widths:
            template, _, _, text = s.levels[level]
            keys, at = window_keys(template, text, width, level)
            near = np.arange(len(keys))
            for place in _places(keys, power):
                place = place[near]
                near = near[(held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
            begin = np.searchsorted(text, np.arange(len(ids)))
            for key, p in zip(keys[near].view(np.int64).tolist(), at[near].tolist()):
                check, _, slots = _window(s, raw, level, p, width)
                rows.append((ids[text[p]], level, width, key, check, p - int(begin[text[p]]), slots))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=names)


def agreeing(windows: list[tuple[int, int, list[int], list[str], list[str]]]) -> tuple[set[int], bool, int]:
    """Of windows (check, place in the item, slot offsets, the item's values, the document's) those that agree: their
    checks, whether no slot differs, and how many of the item's slots do."""
    votes = Counter()
    bearers = defaultdict(set)
    for check, place, _, mine, theirs in windows:
        for pair in zip(mine, theirs):
            bearers[pair].add((check, place))
    votes = sorted(bearers, key=lambda pair: (-len(bearers[pair]), pair[0] != pair[1], pair))
    there, back = {}, {}
    for a, b in votes:
        if a not in there and b not in back:
            there[a], back[b] = b, a
    counted, changed, exact = set(), set(), True
    for check, place, offsets, mine, theirs in windows:
        if all(there.get(a) == b for a, b in zip(mine, theirs)):
            counted.add(check)
            changed |= {place + k for k, a, b in zip(offsets, mine, theirs) if a != b}
            exact &= mine == theirs
    return counted, exact, len(changed)


def leak_of(found: list[dict], coverage: float) -> tuple | None:
    """(n_windows, coverage, exact, n_changed) of an item's windows in a document, or None if it doesn't leak."""
    best = None
    for level in sorted({f["level"] for f in found}):
        own = [f for f in found if f["level"] == level]
        total = own[0]["windows"]
        by_diagonal = defaultdict(list)
        for f in own:
            by_diagonal[f["at"] - f["place"]].append((f["check"], f["place"], f["offsets"], f["mine"], f["theirs"]))
        every = [w for windows in by_diagonal.values() for w in windows]
        for windows in [every] if len(by_diagonal) == 1 else [every, *by_diagonal.values()]:
            if len({w[0] for w in windows}) < coverage * total:
                continue
            counted, exact, changed = agreeing(sorted(windows))
            share = len(counted) / total
            if share >= coverage and (best is None or (share, exact and level != RAW) > (best[1], best[2])):
                best = len(counted), share, exact, changed
    return best


def _verified(batches: Iterator[pa.RecordBatch], coverage: float) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32())
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            leak = leak_of(batch.column("found")[i].as_py(), coverage)
            if leak:
                rows.append((batch.column("text")[i].as_py(), batch.column("item_id")[i].as_py(), *leak))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=[f.split()[0] for f in LEAKS.split(", ")])


def text_key() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


def leaks_by_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, sieve_most: int = SIEVE_MOST) -> DataFrame:
    """(text, item_id, n_windows, coverage, exact, n_changed) for every distinct text (by its SHA-256) that leaks."""
    spark, root = docs.sparkSession, c.shared_dir(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_key().alias("item"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    items = c.written(items.mapInArrow(partial(_item_windows, window=window), ITEMS), f"{root}/items")
    widths = sorted((r.level, r.width) for r in items.select("level", "width").distinct().collect())  # at most four times six
    if not widths:
        return spark.createDataFrame([], LEAKS)
    power = max(SIEVE_LEAST, min(sieve_most, (1024 * items.count()).bit_length()))
    parts = items.select("key").coalesce(4).mapInArrow(partial(_bits, power=power), "bits binary").collect()
    sieve = spark.sparkContext.broadcast(np.bitwise_or.reduce([np.frombuffer(p.bits, np.uint8) for p in parts]).tobytes())
    texts = docs.select(text_key().alias("text"), F.col("text").alias("whole")).where("whole <> ''")
    found = texts.mapInArrow(partial(_candidates, sieve=sieve, power=power, widths=widths), FOUND)
    found = c.written(found.dropDuplicates(["text", "level", "width", "place"]), f"{root}/found")
    # The rarest windows of each item and sequence, of which at least one agrees in every leak.
    often = found.groupBy(*KEYS).agg(F.count("*").alias("n"))
    own = items.groupBy("item_id", "item", *KEYS).agg(F.first("windows").alias("windows")).join(often, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item_id", "item", "level").orderBy("n", "key", "check"))  # one item's windows
    rarest = own.withColumn("rank", rank).where((F.col("n") > 0) & (F.col("rank") <= F.col("windows") - F.ceil(F.lit(coverage) * F.col("windows")) + 1))
    pairs = found.select("text", *KEYS).join(rarest.select("item_id", "item", *KEYS), KEYS).select("text", "item_id", "item", "level").distinct()
    both = pairs.join(items, ["item_id", "item", "level"]).withColumnRenamed("slots", "mine")
    both = both.join(found.withColumnsRenamed({"place": "at", "slots": "theirs"}), ["text", *KEYS])
    one = F.struct("level", "check", "windows", "place", "offsets", "mine", "at", "theirs")
    both = both.groupBy("text", "item_id", "item").agg(F.collect_list(one).alias("found"))  # one item's windows in one text
    return c.written(both.mapInArrow(partial(_verified, coverage=coverage), LEAKS), f"{root}/leaks")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, sieve_most: int = SIEVE_MOST) -> DataFrame:
    """A row per leak: doc_id, item_id, n_windows, coverage, exact (no slot differs), n_changed (slots that differ).

    Null and empty texts leak nothing; items without text or id count as none. Rows that repeat a doc_id, or items
    that repeat an item_id with other texts, give a row each. An empty benchmark gives no rows. Other columns are
    ignored.
    """
    leaks = leaks_by_text(docs, benchmark, window, coverage, sieve_most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text")).join(leaks, "text").drop("text")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts leak nothing. Rows without text stay."""
    own = c.free_name(docs.columns, "text_key")
    leaks = leaks_by_text(docs, benchmark, window, coverage).select(F.col("text").alias(own)).distinct()
    return docs.withColumn(own, text_key()).join(leaks, own, "left_anti").select([F.col(f"`{n}`") for n in docs.columns])
