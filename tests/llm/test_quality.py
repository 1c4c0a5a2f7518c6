import zlib

import numpy as np
import pyarrow as pa
import pytest

from shoebox.llm import common as c
from shoebox.llm.quality import accepted, features, fit_features, fit_quality, fit_ranking, quality_scores, text_features, with_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_scores(c.documents(spark, sf), c.labels(spark, sf)).join(c.labels(spark, sf), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r.predicted == r.quality for r in got if r.held_out]
    assert len(held) > 50 and np.mean(held) > 0.93


def test_odd_rows(spark, sf, odd_docs, no_docs):
    labels = c.labels(spark, sf)
    got = quality_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(no_docs, labels).collect() == []
    assert {r.score for r in quality_scores(odd_docs, labels.where("false")).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    docs, labels = c.documents(spark, sf), c.labels(spark, sf)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    one, two = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_all_columns_stay(odd_docs):
    model = fit_ranking(np.random.default_rng(0).normal(size=(40, 26)), np.arange(40) % 2 == 0, pairs=100)
    out = with_quality(odd_docs, model)
    assert out.columns == [*odd_docs.columns, "quality_score"] and out.drop("quality_score").exceptAll(odd_docs).count() == 0


def test_clashing_names(spark, sf, odd_docs):
    docs = odd_docs.withColumnsRenamed({"score": "quality_score", "start": "whole_text", "row": "__text"})
    kept = accepted(docs, fit_quality(c.documents(spark, sf), c.labels(spark, sf)))
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    with pytest.raises(ValueError):
        with_quality(docs, None)

def _brute_model(docs, labels, modulus=3, held_out=1):
    known = {}
    for r in labels.collect():
        if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % modulus != held_out:
            known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    rows = [(r.text, known[r.doc_id] == 1) for r in docs.collect() if r.doc_id in known]
    return fit_ranking(text_features(pa.array([t for t, _ in rows], pa.string())), np.array([g for _, g in rows]))


def _same(one, two):
    for name in ("mean", "scale", "weights", "threshold"):
        assert np.allclose(getattr(one, name), getattr(two, name), rtol=1e-6, atol=1e-6), name


def test_model_is_that_of_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = c.documents(spark, sf), c.labels(spark, sf)
    want = _brute_model(docs, labels)
    _same(fit_quality(docs, labels), want)
    _same(fit_features(features(docs), labels, part_rows=7, most=5), want)  # many parts, and a threshold that is narrowed down


def test_no_training_row_is_left_out(spark):
    # More rows than the 20,000 that the model was fitted on once; few of them are good.
    docs = spark.range(33_000).selectExpr("id AS doc_id", "concat('Row ', id, repeat(' word', int(id % 9)), if(id % 800 = 0, ' GOOD GOOD.', ' bad, ##')) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 800 = 0 OR doc_id % 4001 = 0) AS quality")
    _same(fit_quality(docs, labels), _brute_model(docs, labels))
