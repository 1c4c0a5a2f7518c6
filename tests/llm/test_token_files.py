import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoebox.llm import common as c
from shoebox.llm.bpe import vocabulary_path
from shoebox.llm.token_files import LibraryEncoder, bit_width, pack, read_document, read_token_files, token_files, unpack, write_token_files


def want(docs):
    """Rows of one id come in the order of a hash of their texts."""
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS tie").collect()
    library, out, start = Tokenizer.from_file(vocabulary_path()), [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return Counter(out)


def test_equals_the_library(spark, sf):
    docs = c.documents(spark, sf)
    assert Counter(map(tuple, token_files(docs).collect())) == want(docs)


def test_odd_rows(odd_docs, no_docs):
    assert Counter(map(tuple, token_files(odd_docs).collect())) == want(odd_docs)
    assert token_files(no_docs).collect() == []


def test_pieces_with_one_key(spark, monkeypatch):
    """Finds are compared byte by byte: even where all pieces have one key, and for patterns that sums don't tell apart."""
    pattern = [0]
    while len(pattern) < 1024:
        pattern += [1 - x for x in pattern]
    words = ["".join(letters[x] for x in pattern) for letters in ("ab", "ba")]
    docs = spark.createDataFrame(list(enumerate([*words, *words, "Ab ab aB <b <B é É", "x" * 300 + " " + "x" * 299])), "doc_id long, text string")
    for shards in (1, 4):
        assert Counter(map(tuple, token_files(docs.repartition(shards)).collect())) == want(docs)
    library = Tokenizer.from_file(vocabulary_path())
    texts = ["one two, one!", "two three é É <b", "", "one three. É"]
    monkeypatch.setattr(c, "word_keys", lambda data, a, b, seed: (b - a > 3).astype(np.uint64))
    enc = LibraryEncoder(vocabulary_path())
    for _ in range(2):
        ids, at = enc.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_rows_without_id(spark):
    docs = spark.createDataFrame([(None if k % 3 else 5, f"text {k} {k * k}") for k in range(300)], "doc_id long, text string")
    assert Counter(map(tuple, token_files(docs).collect())) == want(docs)


def test_blocks_and_random_access(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_token_files(odd_docs, path, block_ids=300, shards=3)
    rows = read_token_files(spark, path, with_ids=True).collect()
    assert spark.read.parquet(path).count() > 3
    for doc in (1, 5, 10, 12):
        assert Counter(map(tuple, read_document(spark, path, doc))) == Counter(tuple(r.ids) for r in rows if r.doc_id == doc)
    assert read_document(spark, path, 999) == []


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=60), st.data())
def test_any_width(bits, values, data):
    ids = np.array(values, np.uint64) % (1 << bits)
    raw = pack(ids.astype(np.uint32), bits)
    assert len(raw) == (len(ids) * bits + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert unpack(raw, bits, a, b).tolist() == ids[a:b].tolist()


def test_width():
    assert [bit_width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
