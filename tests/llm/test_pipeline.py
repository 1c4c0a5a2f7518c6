import pytest

import corpus_pipeline as p
from shoebox.llm import common as c

from .test_bpe import want as bpe_want
from .test_jaccard import brute as similar
from .test_substring_dedup import WORD, brute


def run_stage(name, spark, docs, sf):
    return dict(p.STAGES)[name](spark, docs, sf)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "substring_dedup", "decontaminate", "bpe"]


def test_quality(spark, sf):
    docs = c.documents(spark, sf)
    kept = run_stage("quality", spark, docs, sf)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    known = {r.doc_id: r.quality for r in c.labels(spark, sf).collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(d in ids for d, q in known.items() if q) > 0.9 * sum(known.values())
    assert sum(d in ids for d, q in known.items() if not q) < 0.3 * sum(not q for q in known.values())


def test_near_duplicates(spark, sf):
    docs = c.documents(spark, sf)
    kept = run_stage("near_duplicates", spark, docs, sf)
    want = {d for d, k in similar([(r.doc_id, r.text) for r in docs.collect()]) if d == k}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and len(want) < docs.count()


def test_substring_dedup(spark, sf):
    docs = c.documents(spark, sf)
    kept = {r.doc_id: r for r in run_stage("substring_dedup", spark, docs, sf).collect()}
    old = {r.doc_id: r for r in docs.collect()}
    changed = 0
    for d, n, gone, _ in brute([(r.doc_id, r.text) for r in old.values()]):
        assert (d in kept) == (not gone or gone < n)
        if d in kept:
            changed += gone > 0
            assert len(WORD.findall(kept[d].text)) == n - gone and kept[d].n_chars == (len(kept[d].text) if gone else old[d].n_chars)
            assert (kept[d].text == old[d].text) == (gone == 0) and kept[d].source == old[d].source
    assert changed


def test_decontaminate(spark, sf):
    docs = c.documents(spark, sf)
    kept = {r.doc_id for r in run_stage("decontaminate", spark, docs, sf).collect()}
    items = [" ".join(r.text.split()).lower() for r in c.benchmark(spark, sf).collect()]
    want = {r.doc_id for r in docs.collect() if not any(i in " ".join(r.text.split()).lower() for i in items)}
    assert kept == want and len(want) < docs.count()


def test_bpe(spark, sf):
    from tokenizers import Tokenizer

    from shoebox.llm.bpe import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    docs = c.documents(spark, sf)
    got = run_stage("bpe", spark, docs, sf)
    assert sorted(map(tuple, got.drop("ids").collect())) == sorted(bpe_want(library, r.doc_id, r.text) for r in docs.collect())
    assert all(len(r.ids) == r.n_tokens for r in got.collect())


def test_run_is_the_stages_one_after_the_other(spark, sf):
    docs = c.documents(spark, sf)
    for _, stage in p.STAGES:
        docs = c.written(stage(spark, docs, sf))
    assert rows(p.run(spark, sf)) == rows(docs) and docs.count() > 50


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_odd_rows(spark, sf, name, odd_docs, no_docs):
    out = run_stage(name, spark, odd_docs, sf)
    got = out.collect()
    assert run_stage(name, spark, no_docs, sf).collect() == []
    if name != "bpe":
        assert out.columns == odd_docs.columns and out.schema.simpleString() == odd_docs.schema.simpleString() and 0 < len(got) <= odd_docs.count()
