import math
import random

import pytest

from shoebox.operators import search, text, vector
from shoebox.operators.search import Filters, SearchEngine

E = [[1.0 if i == k else 0.0 for i in range(3)] for k in range(3)]
T2024, T2020 = 1_717_000_000.0, 1_590_000_000.0


@pytest.fixture(scope="module")
def engine(spark):
    photos = spark.createDataFrame(
        [(1, "/a", T2024, 48.86, 2.35, 0, E[0]), (2, "/a/b", T2020, 48.80, 2.30, 0, E[1]), (3, "/a", T2024 + 5, 51.5, -0.1, 0, E[2]), (4, "/a", T2024 + 9, 48.86, 2.35, 1, None)],
        "id long, dir string, sort_at double, gps_lat double, gps_lon double, missing int, embedding array<double>",
    )
    ocr = spark.createDataFrame([(2, "Boarding gate #22 (boarding)!"), (3, "  ")], "photo_id long, text string")
    places = spark.createDataFrame(
        [(1, "Paris", "FR", 48.8534, 2.3488, 2_000_000, ["paris", "lutetia"]), (2, "Paris", "US", 33.66, -95.55, 25_000, ["paris"]), (3, "Tokyo", "JP", 35.7, 139.7, 9_000_000, ["tokyo"])],
        "place_id long, name string, country string, lat double, lon double, population long, keys array<string>",
    )
    return SearchEngine(photos, ocr, places, lambda q: E[0])


def ids(r):
    return [h.id for h in sorted(r.hits.collect(), key=lambda h: h.rank)]


def test_tiers(spark, engine):
    rows = engine.photos
    some = rows.where("id <= 2").select("id")
    tier = lambda c, *sizes: vector.semantic_search(rows, E[0], 2, c, *sizes)[0]
    assert [tier(None), tier(rows.where("false")), tier(some), tier(some, 1), tier(some, 0, 1)] == ["hnsw", "empty", "brute", "filtered_hnsw", "hnsw_postfilter"]
    assert [h.id for h in vector.semantic_search(rows, E[0], 2, some, 0, 1, 1)[1].collect()] == [1, 2]


def test_fusion(engine):
    r = engine.search("boarding")
    assert r.tier == "fused" and ids(r)[:2] == [2, 1]
    scores = {h.id: h.score for h in r.hits.collect()}
    assert scores[1] == pytest.approx(1 / 61) and scores[2] == pytest.approx(1 / 62 + 1 / 61)


def test_semantic_alone(engine):
    r = engine.search("zebra")
    assert r.tier == "hnsw" and ids(r)[0] == 1 and r.hits.collect()[0].score == pytest.approx(1.0)


def test_filters(engine):
    assert ids(engine.search("2024")) == [3, 1] and engine.search("2024").tier == "filter"
    assert ids(engine.search("2024", Filters(place="Paris"))) == [1]
    assert ids(engine.search("", Filters(place="paris, france"))) == [1, 2]
    assert ids(engine.search("", Filters(near_photo=1, radius_km=0))) == [1, 2]  # 0 is the default radius
    assert ids(engine.search("", Filters(folder="/a"))) == [3, 1]
    assert ids(engine.search("", Filters(has_text=True))) == [2]
    unknown = engine.search("2024", Filters(place="Nowhere"))
    assert "Nowhere" in unknown.place_error and ids(unknown) == [3, 1]
    assert engine.search("2024", Filters(date_from=0.0)).label is None
    assert ids(engine.search("zebra", Filters(folder="/none"))) == [] and engine.search("zebra", Filters(folder="/none")).tier == "empty"
    with pytest.raises(ValueError):
        engine.search("  ")
    with pytest.raises(ValueError):
        engine.search("", Filters(place="Nowhere"))


def test_geocoding(engine):
    assert search.geocode(engine.places, "PARIS").first().country == "FR"
    assert search.geocode(engine.places, "lutetia").first().place_id == 1
    assert search.geocode(engine.places, "x").count() == search.geocode(engine.places, " ").count() == 0
    near = {r.id: r for r in search.reverse_geocode(engine.photos, engine.places).collect()}
    assert near[1].place_id == 1 and near[1].km < 5


def test_bm25_formula(spark):
    docs = {1: "a b a", 2: "b c", 3: "c c c d", 4: "É été", 5: " "}
    rows = spark.createDataFrame(list(docs.items()), "photo_id long, text string")
    got = {r.photo_id: r.score for r in text.bm25(rows, "a b b").collect()}
    tokens = {k: v.split() for k, v in docs.items() if v.strip()}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)

    def score(t):
        out = 0.0
        for w in "a b b".split():
            df = sum(w in x for x in tokens.values())
            idf = math.log((n - df + 0.5) / (df + 0.5))
            tf = t.count(w)
            out -= (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        return out

    assert got == pytest.approx({k: score(t) for k, t in tokens.items() if set(t) & {"a", "b"}})
    assert [r.photo_id for r in text.bm25(rows, "ete").collect()] == [4]
    assert text.bm25(rows, "?!").count() == 0
    assert text.query_words("foo_bar x") == [["foo", "bar"], ["x"]] and text.query_words(" - ") is None


def test_phrases_from_underscores(spark):
    rows = spark.createDataFrame([(1, "foo bar"), (2, "bar foo"), (3, "foo x bar foo-bar foo bar")], "photo_id long, text string")
    assert {r.photo_id for r in text.bm25(rows, "foo_bar").collect()} == {1, 3}


def test_regions(spark):
    rows = spark.createDataFrame([(1, 2, "b", 0.9, 0.1, 0.2), (1, 1, "a", 0.9, 0.5, 0.1), (1, 3, "c", 0.1, 0.1, 0.1), (2, 1, " ", 0.9, 0.0, 0.1)], "photo_id long, ord int, text string, conf double, by double, bh double")
    kept = text.kept_regions(rows)
    assert {r.ord: round(r.by, 6) for r in kept.collect()} == {1: 0.4, 2: 0.7}
    assert [tuple(r) for r in text.combined_text(kept).collect()] == [(1, "a\nb")]


def test_cells_against_exact_neighbours(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, embedding array<double>")
    exact = {(r.id, r.other) for r in vector.knn(rows, 10, block_rows=150).collect()}
    sims = v @ v.T - 9 * np.eye(400)
    assert exact == {(i, int(j)) for i in range(400) for j in np.argsort(-sims[i], kind="stable")[:10]}
    near = {(r.id, r.other) for r in vector.cell_knn(rows, 10, cells=16, probes=8).collect()}
    assert len(near & exact) / len(exact) > 0.9
    asked = vector.knn(rows, 3, queries=rows.where("id % 100 = 0")).collect()
    assert len(asked) == 12 and {(r.id, r.other) for r in asked} <= exact


def test_the_nearest_place_by_cells_equals_all_pairs(spark):
    rng = random.Random(2)
    places = [(k, f"p{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(40)]
    places += [(100, "pole", 89.9, 10.0), (101, "east of the date line", 0.0, -179.9), (102, "west of it", 0.0, 179.5), (103, "same", 10.0, 10.0), (104, "same", 10.0, 10.0)]
    spots = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)]
    spots += [(500, 0.1, 179.99), (501, 0.1, -179.6), (502, 89.0, -170.0), (503, -90.0, 0.0), (504, 10.0, 10.5), (505, 90.0, 180.0), (506, None, 1.0)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = {i: min((round(km(a, b, c, d), 6), p) for p, _, c, d in places) for i, a, b in spots if a is not None}
    photos = spark.createDataFrame(spots, "id long, gps_lat double, gps_lon double")
    found = search.reverse_geocode(photos, spark.createDataFrame(places, "place_id long, name string, lat double, lon double"))
    assert {r.id: (round(r.km, 6), r.place_id) for r in found.collect()} == want
