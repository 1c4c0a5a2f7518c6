"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token exactly one token can be the last of its encoding. The candidates are the vocabulary
entries that end there, which the automaton of all entries gives as suffix matches. A candidate is right if it may
stand beside the last token of the prefix before it, that is if the merges would never have joined the two across
their border; this is looked up among the merges of their touching parts. Back-pointers from the whole pre-token
give the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common as c

VOCABULARY = "word_bpe_49k.json"
#: Cached pieces, and as many words, of a Python worker; what doesn't fit is encoded anew.
CACHE_PIECES = 120_000
#: Below this character all versions of Unicode agree on letters and digits.
PLAIN_BELOW = "\u0250"
END = "Ā"  # the mark of a word's end, beyond the 256 byte values
END_RANK = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The vocabulary's place on this machine; a path that exists is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of the byte-level alphabet: visible Latin-1 characters stand for themselves, the others follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixEncoder:
    """Encoder of one vocabulary file of the tokenizers library: byte-level BPE with ends of words."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        spec = json.load(open(path, encoding="utf-8"))
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        to_byte = _byte_of_char()

        def plain(token: str) -> str:
            ended = token.endswith(suffix)
            body = token[: len(token) - len(suffix)] if ended else token
            return "".join(chr(to_byte[x]) for x in body) + END * ended

        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.merge: dict[tuple[int, int], int] = {}  # pair of ids -> rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            one, two, both = vocab[a], vocab[b], vocab[a + b]
            self.merge[one, two] = r
            if both in self.parts:
                raise ValueError("two merges make one token; prefixes have no unique last token then")
            self.parts[both], self.rank[both] = (one, two), r
        for t, i in vocab.items():
            self.rank.setdefault(i, -1)
        if any(max(self.rank[a], self.rank[b]) >= self.rank[i] for i, (a, b) in self.parts.items()):
            raise ValueError("a merge comes before the merges of its parts")
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            body = plain(t)
            # The end mark is part of a word's last symbol, not a symbol of its own.
            if self.rank[i] >= 0 or len(body.rstrip(END)) == 1:
                self.automaton.add_word(body, (i, len(body)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[str, str, int]] = {}
        self.words: dict[str, tuple[str, str, int]] = {}
        self.cache_pieces, self.to_byte = cache_pieces, to_byte
        self.library = Tokenizer.from_file(path)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between the two tokens alone.

        Time runs back through the merges: at each moment the border lies between a last part of ``left`` and a
        first part of ``right``; if the merge of these two comes before what in fact became of them, they join.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        one, two, until_one, until_two = left, right, END_RANK, END_RANK
        rank, parts, merge = self.rank, self.parts, self.merge
        good = True
        while True:
            r = merge.get((one, two))
            if r is not None and r < until_one and r <= until_two:  # of equal merges the left one comes first
                good = False
                break
            if rank[one] < 0 and rank[two] < 0:
                break
            if rank[one] > rank[two]:
                until_one, one = rank[one], parts[one][1]
            else:
                until_two, two = rank[two], parts[two][0]
        if len(self.pairs) < 500_000:
            self.pairs[left, right] = good
        return good

    def word_ids(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        text = word.encode().decode("latin-1") + END
        n = len(text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        pairs, may_follow = self.pairs, self.may_follow
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue  # one last token per prefix
            before = end - length
            if before:
                left = last[before]
                if left < 0:
                    continue
                good = pairs.get((left, token))
                if not (may_follow(left, token) if good is None else good):
                    continue
            last[end], back[end] = token, before
        if last[n] < 0:
            raise ValueError(f"no encoding of {word!r}")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _words(self, part: str) -> list[str]:
        """The pre-tokens of a stretch without special tokens."""
        if part.isascii():
            return self.split.findall(part.lower())
        if max(part) < PLAIN_BELOW:
            # Lower case goes character by character.
            return self.split.findall(unicodedata.normalize("NFC", part).lower())
        # Which code points are letters depends on the library's version of Unicode: it splits the others.
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.to_byte.__getitem__, w)).decode() for w, _ in pieces]

    def _piece(self, piece: str) -> tuple[str, str, int]:
        """Ids as text, tokens as text and number of ids of a stretch without white space between words."""
        parts: list[tuple[str, str, int]] = []
        for part in self.specials.split(piece) if self.specials and "<|" in piece else (piece,):
            if part in self.special:
                parts.append((str(self.special[part]), part, 1))
                continue
            for word in self._words(part):
                found = self.words.get(word)
                if found is None:
                    ids = self.word_ids(word)
                    found = (" ".join(map(str, ids)), " ".join([self.token_of[i] for i in ids]), len(ids))
                    if len(self.words) < self.cache_pieces:
                        self.words[word] = found
                parts.append(found)
        if len(parts) == 1:
            found = parts[0]
        else:
            found = (" ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum(x[2] for x in parts))
        if len(self.cache) < self.cache_pieces:
            self.cache[piece] = found
        return found

    def encode_text(self, text: str) -> tuple[str, str, int]:
        """Ids joined by spaces, decoded text (the library's decode joins the tokens by spaces), number of ids."""
        get, make = self.cache.get, self._piece
        found = [get(p) or make(p) for p in pieces(text)]
        total = sum([x[2] for x in found])
        return " ".join([x[0] for x in found if x[2]]), " ".join([x[1] for x in found if x[2]]), total

    def encode(self, text: str) -> list[int]:
        ids, _, n = self.encode_text(text)
        return list(map(int, ids.split())) if n else []

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token_of[i] for i in ids)


#: Python splits at these too, but they are no white space to the library.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """The stretches between white space, on which no pre-token ever stands."""
    return text.split() if not _SEPARATORS.search(text) else [p for p in re.split(r"[ \t\n\r\f\v]+", text) if p]


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> PrefixEncoder:
    return PrefixEncoder(vocabulary_path(name))


c.hold("bpe", encoder.cache_clear)


def _encoded(batches: Iterator[pa.RecordBatch], name: str, ids: bool, decoded: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(name)
    for batch in c.text_slices(batches, owner="bpe"):
        rows = [enc.encode_text(t or "") for t in batch.column("text").to_pylist()]
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([n for _, _, n in rows], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _, _ in rows], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d, _ in rows], pa.string()),
        }
        if ids:
            out["ids"] = pa.array([np.fromstring(i, np.int32, sep=" ") for i, _, _ in rows], pa.list_(pa.int32()))
        if decoded:
            out["decoded"] = pa.array([d for _, d, _ in rows], pa.string())
        yield pa.RecordBatch.from_pydict(out)


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = False, decoded: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256 and decoded_sha256; on demand also ids and decoded.

    ``vocabulary`` is a file name among the public tokenizers or a path that every machine has. Null or empty text:
    no ids, digests of the empty string. Repeated rows and null ids are encoded like any other. Other columns are
    ignored. One pass without a shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_encoded, name=vocabulary, ids=ids, decoded=decoded), schema)
