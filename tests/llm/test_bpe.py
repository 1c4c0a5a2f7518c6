import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoebox.llm import common as c
from shoebox.llm.bpe import bpe_round_trip, encoder, vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(library, d, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_equals_the_library(spark, sf, library):
    docs = c.documents(spark, sf)
    assert Counter(map(tuple, bpe_round_trip(docs).collect())) == Counter(want(library, r.doc_id, r.text) for r in docs.collect())


def test_odd_rows(odd_docs, no_docs, library):
    assert Counter(map(tuple, bpe_round_trip(odd_docs).collect())) == Counter(want(library, r.doc_id, r.text) for r in odd_docs.collect())
    assert bpe_round_trip(no_docs).collect() == []


def test_outputs(odd_docs, library):
    for r in bpe_round_trip(odd_docs, ids=True, decoded=True).collect():
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinrst ' <|>endoftext.ÉéΣß́　\x1c")), max_size=40))
def test_any_text(text):
    lib = Tokenizer.from_file(vocabulary_path()) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert encoder().encode(text) == ids
    assert encoder().encode_text(text)[1] == lib.decode(ids, skip_special_tokens=False)
