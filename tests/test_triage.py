import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import triage

V = {1: [1.0, 0.0, 0.0], 2: [1.0, 0.05, 0.0], 3: [0.9, 0.3, 0.0], 4: [0.0, 0.0, 1.0], 5: None}
QUALITY = {1: 0.9, 2: 0.3, 3: 0.5, 4: 0.6, 5: 0.2}


@pytest.fixture(scope="module")
def scope(spark):
    photos = spark.createDataFrame([(k, QUALITY[k], 0.5, V[k]) for k in V], "id long, quality double, aesthetic double, embedding array<double>")
    rows = spark.createDataFrame([(7, k, k - 1) for k in V], "scope_id long, photo_id long, scope_pos long")
    faces = spark.createDataFrame([(1, 1, 0.4, 10), (2, 1, 0.4, 10), (3, 4, 0.5, None)], "face_id long, photo_id long, quality double, cluster_id long")
    clusters = spark.createDataFrame([(10, "Ann")], "cluster_id long, label string")
    near = spark.createDataFrame([(1, 100), (2, 100)], "photo_id long, group_id long")
    return rows, photos, triage.subject_scores(faces, clusters), near, near.where("false")


def test_keep(scope):
    got = triage.triage(*scope, triage.get_preset("story-ready"), 50).orderBy("pick").collect()
    assert [r.considered for r in got] == [4] * 4 and got[0].scope_size == 5
    assert got[0].photo_id == 1 and 2 not in {r.photo_id for r in got}
    assert "best of 2 similar" in got[0].reason and "people" in got[0].reason and "sharp" in got[0].reason
    assert [r.photo_id for r in triage.triage(*scope, triage.get_preset(), 2).orderBy("pick").collect()] == [1, 4]


def test_delete(scope):
    got = triage.triage(*scope, triage.get_preset("delete-candidates"), 50).orderBy("pick").collect()
    assert got[0].photo_id == 2 and got[0].redundant and got[0].reason.startswith("near-duplicate")
    assert 1 not in {r.photo_id for r in got} and all(r.considered == len(got) for r in got)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_subject_is_capped(scope):
    assert {r.photo_id: r.subject for r in scope[2].collect()} == {1: 1.0, 4: 0.5}


def test_missing_vectors_get_the_median(spark, scope):
    rows = scope[0].join(scope[1].select(F.col("id").alias("photo_id"), "embedding"), "photo_id")
    got = {r.photo_id: r.repr for r in triage.representativeness(rows).collect()}
    assert got[5] == pytest.approx(np.median([got[k] for k in (1, 2, 3, 4)]))
    none = triage.representativeness(rows.withColumn("embedding", F.lit(None).cast("array<double>"))).collect()
    assert {r.repr for r in none} == {0.0}


def test_presets_and_scopes(spark):
    assert triage.get_preset().name == "story-ready"
    with pytest.raises(KeyError):
        triage.get_preset("x")
    with pytest.raises(ValueError):
        triage.scope_of_range(spark.range(1))
    items = spark.createDataFrame([(1, 5, 1.0), (1, 6, 0.0)], "group_id long, photo_id long, rank double")
    assert [r.photo_id for r in triage.scope_of_group(items, 1).orderBy("scope_pos").collect()] == [6, 5]
    with pytest.raises(LookupError):
        triage.scope_of_group(items, 2)


def test_mmr_equals_the_plain_loop():
    rng = random.Random(0)
    for _ in range(20):
        n = rng.randrange(1, 25)
        base = sorted((rng.random() for _ in range(n)), reverse=True)
        vectors = [None if rng.random() < 0.2 else np.array([rng.gauss(0, 1) for _ in range(4)]) for _ in range(n)]
        unit = [None if v is None else v / np.linalg.norm(v) for v in vectors]
        left, picked = list(range(n)), []
        while left and len(picked) < 10:
            def value(k):
                sims = [float(unit[k] @ unit[s]) for s in picked if unit[s] is not None] if unit[k] is not None else []
                return 0.6 * base[k] - 0.4 * (max(sims) if sims else 0.0)

            best = max(left, key=lambda k: (value(k), -k))
            left.remove(best)
            picked.append(best)
        assert triage.mmr_order(np.array(base), vectors, 0.6, 10) == picked
