import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import people, relational, text
from shoebox.operators.ann import CellIndex
from shoebox.operators.fulltext import FullTextIndex
from shoebox.operators.grouping import rebuild
from shoebox.operators.vector import nearest, semantic_search
from shoebox.sources.tables import Library


def vectors_of(spark, n, seed=1, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    rows = centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, dims))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "id long, embedding array<float>")


def test_cell_index(spark, tmp_path):
    rows = vectors_of(spark, 3000).cache()
    index = CellIndex(spark, f"file://{tmp_path}/ann").build(rows.where("id < 2500"))
    again = CellIndex(spark, index.root)  # as stored
    assert again.size() == 2500 and (again.centres == index.centres).all() and len(index.centres) == 50
    again.add(rows)  # only what is new
    assert again.size() == 3000 and not again.sync(rows) and CellIndex(spark, index.root).size() == 3000
    found = total = 0
    for q in rows.where("id % 300 = 0").collect():
        want = {r.id for r in nearest(rows, q.embedding, 10).collect()}
        got = [r.id for r in again.search(q.embedding, 10).collect()]
        found, total = found + len(want & set(got)), total + 10
        assert got[0] == q.id
    assert found / total >= 0.9
    q = rows.first().embedding
    every = {r.id for r in again.search(q, 10, rows.where("id % 2 = 1").select("id"), probes=50).collect()}
    assert every == {r.id for r in nearest(rows.where("id % 2 = 1"), q, 10).collect()}
    tier, hits = semantic_search(rows, q, 10, rows.where("id % 2 = 1").select("id"), 10, 5000, index=again)
    assert tier == "filtered_hnsw" and all(r.id % 2 for r in hits.collect())
    assert again.sync(rows.where("id < 100")) and CellIndex(spark, index.root).size() == 100
    empty = CellIndex(spark, f"file://{tmp_path}/none")
    assert empty.size() == 0 and empty.search(q, 5).collect() == [] and empty.add(rows.limit(20)).size() == 20


def test_full_text_index_equals_the_scan(spark, tmp_path):
    texts = [(1, "Red car, red house"), (2, "foo bar and bar foo"), (3, "Été au château; red"), (4, "  "), (5, "bar foo_bar red foo bar")]
    rows = spark.createDataFrame(texts, "photo_id long, text string")
    index = FullTextIndex(spark, f"file://{tmp_path}/fts")
    assert index.search("red").collect() == []
    index.add(rows)

    def same(now):
        for q in ("red", "ete", "foo_bar", "red RED house", "bar foo", "absent", "?!"):
            got, want = ([(r.photo_id, round(r.score, 9)) for r in x.collect()] for x in (index.search(q), text.bm25(now, q)))
            assert got == want, q

    same(rows)
    index.replace(spark.createDataFrame([(1,), (2,)], "photo_id long"), spark.createDataFrame([(1, "blue boat"), (9, "red boat")], "photo_id long, text string"))
    now = {k: t for k, t in texts if k not in (1, 2)} | {1: "blue boat", 9: "red boat"}
    same(spark.createDataFrame(list(now.items()), "photo_id long, text string"))
    assert [r.photo_id for r in FullTextIndex(spark, index.root).search("boat", 1).collect()] == [1]


def test_rebuilt_groups(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib")
    day = 86_400.0
    at = [0, 1, 2, 5000, 10 * day, 10 * day + 9000, 20 * day, 30 * day, 30 * day + 1]
    photos = [(k, float(t), 0 if k != 8 else 1, 0 if k < 2 else k << 40 | 0xFFFFF << (k % 3) * 20) for k, t in enumerate(at)]
    library.write("photos", spark.createDataFrame(photos, "id long, sort_at double, missing int, phash long"))
    vectors = spark.createDataFrame([(k, [1.0, 0.01 * k] if k < 6 else [0.0, 1.0]) for k in range(8)], "id long, embedding array<float>")
    first = rebuild(library, vectors, 1.0)
    assert first == {"event": 2, "burst": 1, "near_dup": 2, "semantic": 1}
    again = rebuild(library, vectors, 2.0)
    assert again == first
    groups = {r.id: r for r in library.read("groups").collect()}
    items = library.read("group_items").collect()
    assert len(groups) == 6 and {r.created_at for r in groups.values()} == {2.0}
    members = lambda kind: sorted(sorted(i.photo_id for i in items if i.group_id == g) for g, r in groups.items() if r.kind == kind)
    assert members("event") == [[0, 1, 2, 3], [4, 5]] and members("burst") == [[0, 1, 2]] and members("near_dup") == [[0, 1], [2, 5]] and members("semantic") == [[0, 1, 2, 3, 4, 5]]
    assert rebuild(library, None, 3.0)["semantic"] == 0


def test_text_of_one_photo(spark):
    ocr = spark.createDataFrame([(1, "a\nb")], "photo_id long, text string")
    regions = spark.createDataFrame([(1, 2, 0.5, "b"), (1, 1, 0.5, "a")], "photo_id long, ord int, conf double, text string")
    one, none = (relational.text_of(ocr, regions, k).first() for k in (1, 2))
    assert one.text == "a\nb" and [r.text for r in one.regions] == ["a", "b"] and none.text == "" and none.regions == []


def test_faces_of_new_clusters(spark):
    faces = spark.createDataFrame([(1, 1, 0.5, [1.0, 0.0], 7, 1), (2, 1, 0.9, [0.0, 1.0], 7, 1), (3, 2, 0.1, [0.0, 1.0], None, 0)], "face_id long, photo_id long, quality double, embedding array<double>, cluster_id long, assigned int")
    clusters = people.recompute(faces, spark.createDataFrame([(7, None, 0)], "cluster_id long, label string, pinned int"))
    rows, made = people.cluster_from(faces, clusters, spark.createDataFrame([(2,), (3,)], "face_id long"), "Ann")
    assert {(r.cluster_id, r.label, r.pinned, r["size"], r.rep_face_id) for r in made.collect()} == {(7, None, 0, 1, 1), (8, "Ann", 1, 2, 2)}
    rows, made = people.reassign_face(rows, made, 1, 8)
    assert [(r.cluster_id, r["size"]) for r in made.collect()] == [(8, 3)]
    rows, made = people.reassign_face(rows, made, 1, None)
    assert {r.face_id for r in relational.pending_faces(rows).collect()} == {1} and made.first()["size"] == 2
    grown = people.insert_faces(rows, spark.createDataFrame([(5, 0.2, [1.0, 0.0]), (6, 0.3, [1.0, 0.0])], "photo_id long, quality double, embedding array<double>"))
    assert sorted(r.face_id for r in grown.collect()) == [1, 2, 3, 4, 5] and grown.where("assigned = 0").count() == 3
    assert [r.face_id for r in relational.faces_in_cluster(grown, 8).collect()] == [2, 3]


@pytest.mark.parametrize("blank", [None, "", "  "])
def test_a_blank_label_pins_nothing(spark, blank):
    faces = spark.createDataFrame([(1, 1, 0.5, [1.0], None, 0)], "face_id long, photo_id long, quality double, embedding array<double>, cluster_id long, assigned int")
    clusters = spark.createDataFrame([], "cluster_id long, label string, pinned int, rep_face_id long, size long, centroid array<double>")
    assert people.cluster_from(faces, clusters, faces.select("face_id"), blank)[1].select(F.max("pinned")).first()[0] == 0
