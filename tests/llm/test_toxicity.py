import zlib

import numpy as np
import pytest

from shoebox.llm import common as c
from shoebox.llm.toxicity import Margins, features, fit_texts, fit_toxicity, toxicity_scores


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def test_held_out(spark, larger):
    docs, labels = c.documents(spark, larger), c.labels(spark, larger)
    got = toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    found = [r.predicted for r in held if r.toxic]
    assert len(found) > 50 and np.mean(found) > 0.9
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.05


def test_odd_rows(spark, sf, odd_docs, no_docs):
    labels = c.labels(spark, sf)
    got = toxicity_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity_scores(no_docs, labels).collect() == []
    assert all(r.score < 0.01 for r in toxicity_scores(odd_docs, labels.where("false")).collect())


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    docs, labels = c.documents(spark, sf), c.labels(spark, sf)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = ({r.doc_id: r.score for r in toxicity_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_small_fits():
    assert fit_texts([], []).score(np.zeros((1, 7)))[0] < 0.01
    assert fit_texts(["a"], [True]).score(np.zeros((1, 7)))[0] > 0.99
    texts = [f"some plain words number {k} here" for k in range(60)] + [f"you blithering{'' if k % 2 else 'ly'} person {k}" for k in range(30)]
    model = fit_texts(texts, [k >= 60 for k in range(90)])
    known = Margins(model.toxic, model.ordinary)
    assert model.score(np.array([features([b"so", b"blithering,"], known)]))[0] > 0.5
    assert model.score(np.array([features([b"plain", b"words"], known)]))[0] < 0.5


def test_the_sample_has_a_bound_in_bytes(spark):
    rows = [(k, f"some plain words number {k}" * 10) for k in range(40)] + [(100 + k, "you idiot" * 10) for k in range(40)]
    docs = spark.createDataFrame(rows + [(0, "a" * 500)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _ in rows], "doc_id long, toxic int")
    assert fit_toxicity(docs, labels, sample_bytes=10).weights == (0.0,) * 7
    assert fit_toxicity(docs, labels, sample_bytes=5000).weights != (0.0,) * 7
