import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoebox.functions import pixels
from shoebox.operators import maintenance, mutation, relational
from shoebox.operators.ingest import MARKS, Pipeline, open_library
from shoebox.sources import files, tables
from shoebox.sources.vectors import VectorStore
from shoebox.streaming import sessions


@pytest.fixture
def library(spark, tmp_path):
    return open_library(spark, f"file://{tmp_path}/lib")


def photos(spark, rows):
    """(id, path, size, mtime, missing)."""
    full = [(i, p, s, m, miss, "h", 1.0, 1.0, 1.0, 7, m, 0.5) for i, p, s, m, miss in rows]
    return spark.createDataFrame(full, "id long, path string, size_bytes long, mtime double, missing int, content_hash string, hashed_at double, exif_at double, thumb_at double, phash_at long, sort_at double, embed_at double")


def test_upsert(spark):
    old = photos(spark, [(1, "/a", 10, 1.0, 1), (2, "/b", 10, 1.0, 0), (3, "/c", 10, 1.0, 0)])
    scan = spark.createDataFrame([("/a", 10, 1.0), ("/b", 11, 2.0), ("/n", 5, 9.0), ("/m", 5, 9.0)], "path string, size_bytes long, mtime double")
    got = {r.path: r for r in mutation.upsert_scanned(old, scan, 50.0).collect()}
    assert (got["/a"].missing, got["/a"].content_hash) == (0, "h")
    assert (got["/b"].content_hash, got["/b"].thumb_at, got["/b"].sort_at, got["/b"].embed_at) == (None, None, 2.0, 0.5)  # embeddings go stale
    assert got["/c"].content_hash == "h" and {got["/m"].id, got["/n"].id} == {4, 5}
    again = mutation.upsert_scanned(mutation.upsert_scanned(old, scan, 50.0), scan, 60.0)
    assert {(r.path, r.id, r.sort_at) for r in again.collect()} == {(r.path, r.id, r.sort_at) for r in got.values()}


def test_small_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    names = spark.createDataFrame([("b",), ("d",), ("c",), ("d",)], "name string")
    assert {tuple(r) for r in mutation.get_or_create(t, names).collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}
    assert mutation.insert_missing(t, t.unionByName(spark.createDataFrame([(9, "z")], t.schema)), ["id"]).count() == 3
    assert {tuple(r) for r in mutation.upsert(t, spark.createDataFrame([(2, "x")], t.schema), ["id"]).collect()} == {(1, "a"), (2, "x")}
    child = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "k long, parent long")
    assert {r.k for r in mutation.cascade(child, t, "parent").collect()} == {1}
    assert {tuple(r) for r in mutation.set_null(child, t, "parent").collect()} == {(1, 1), (2, None), (3, None)}
    ocr = spark.createDataFrame([(1, "old"), (2, "keep")], "photo_id long, text string")
    new = spark.createDataFrame([(1, " "), (3, "new")], ocr.schema)
    assert {tuple(r) for r in mutation.set_ocr(ocr, new.select("photo_id"), new).collect()} == {(2, "keep"), (3, "new")}


def test_versions_and_groups(spark, library):
    library.write("tags", spark.createDataFrame([(1, "a")], "id long, name string"))
    library.write("tags", library.read("tags").unionByName(spark.createDataFrame([(2, "b", None)], tables.SCHEMAS["tags"])))
    assert library.read("tags").count() == 2 and library.schema_version() == tables.LATEST
    groups = spark.createDataFrame([("x", 1, 2), ("y", 3, 2)], "key string, rep_photo_id long, size long")
    items = spark.createDataFrame([("x", 1, 0.0), ("x", 2, 1.0), ("y", 3, 0.0)], "key string, photo_id long, rank double")
    library.replace_groups("event", groups, items, 1.0)
    library.replace_groups("burst", groups.where("key = 'x'"), items, 1.0)
    library.replace_groups("event", groups.where("key = 'y'"), items, 2.0)
    assert {(r.kind, r.key) for r in library.read("groups").collect()} == {("burst", "x"), ("event", "y")}
    assert library.read("group_items").count() == 3 and library.read("group_items").join(library.read("groups").withColumnRenamed("id", "group_id"), "group_id").count() == 3


def test_migrations(spark):
    old = spark.createDataFrame([(1, None, 5.0), (2, 3.0, 9.0)], "id long, taken_at double, mtime double")
    new, version = tables.migrate({"photos": old}, 1)
    assert version == tables.LATEST and {r.id: r.sort_at for r in new["photos"].collect()} == {1: 5.0, 2: 3.0} and "scored_at" in new["photos"].columns
    assert tables.migrate(new, version)[0]["photos"].columns == new["photos"].columns


def test_vector_store(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    store = VectorStore(spark, root, "m", 2)
    rows = lambda *ids: spark.createDataFrame([(i, [float(i), 0.0]) for i in ids], "id long, embedding array<double>")
    assert {r.embed_row for r in store.append(rows(1, 2), "id").collect()} == {0, 1}
    store.append(rows(3), "id")
    assert sorted(r.embed_row for r in store.read().collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), "id")
    with pytest.raises(ValueError):
        VectorStore(spark, root, "other", 2)


def test_compaction(spark):
    vectors = spark.createDataFrame([(k, [float(k)]) for k in range(4)], "embed_row long, embedding array<double>")
    rows = spark.createDataFrame([(k, k, int(k == 1)) for k in range(4)], "id long, embed_row long, missing int")
    kept, new, stats = maintenance.compact(vectors, rows)
    assert stats == {"before": 4, "after": 3, "reclaimed": 1}
    assert {r.id: r.embed_row for r in new.collect()} == {0: 0, 1: None, 2: 1, 3: 2}
    assert {r.embed_row: r.embedding[0] for r in kept.collect()} == {0: 0.0, 1: 2.0, 2: 3.0}


def test_eviction(spark):
    rows = spark.createDataFrame([(f"/{k}", 1000, float(k)) for k in range(5)], "path string, size long, mtime double")
    plan = lambda *a: sorted(r.path for r in maintenance.eviction_plan(rows, *a).collect())
    assert plan(3000) == ["/0", "/1"] and plan(3000, "/0") == ["/1", "/2"] and plan(5000) == [] and plan(0) == [f"/{k}" for k in range(5)]
    report = maintenance.storage_report(rows.withColumn("area", F.lit("thumbs")), {"thumbs": 4000, "previews": None})
    assert {r.area: (r.bytes, r.over_cap) for r in report.collect()} == {"thumbs": (5000, True), "previews": (0, False)}
    assert maintenance.run_suite(spark, "smoke").count() == 1
    with pytest.raises(ValueError):
        maintenance.run_suite(spark, "x")


def test_previews_and_idle(spark):
    cache = spark.createDataFrame([("/a", 1, 1.0), ("/b", 1, 2.0)], "path string, size long, mtime double")
    touched, missing = maintenance.preview_requests(cache, spark.createDataFrame([("/a",), ("/c",), ("/c",)], "path string"), 9.0)
    assert {r.path: r.mtime for r in touched.collect()} == {"/a": 9.0, "/b": 2.0} and [r.path for r in missing.collect()] == ["/c"]
    jobs = spark.createDataFrame([(1, "ingest", "running"), (2, "other", "running")], "id long, kind string, state string")
    with pytest.raises(RuntimeError):
        maintenance.ensure_idle(jobs)
    assert {r.id: r.state for r in mutation.fail_running_jobs(jobs, "ingest", 1.0).collect()} == {1: "error", 2: "running"}


def test_streamed_assignment(spark, tmp_path, library):
    base = [(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])]
    vectors = spark.createDataFrame([*((f, v) for f, _, v in base), (3, [0.9, 0.1]), (4, [-1.0, 0.0])], "face_id long, embedding array<double>")
    library.write("faces", spark.createDataFrame([(f, f, 0.5, c, 1) for f, c, _ in base], "face_id long, photo_id long, quality double, cluster_id long, assigned int"))
    library.write("clusters", spark.createDataFrame([(c, f"p{c}", 1, f, 1, v) for f, c, v in base], "cluster_id long, label string, pinned int, rep_face_id long, size long, centroid array<double>"))
    new = spark.createDataFrame([(3, 3, 0.4, 0), (4, 4, 0.4, 0)], "face_id long, photo_id long, quality double, assigned int")
    new.write.parquet(f"file://{tmp_path}/faces")
    stream = spark.readStream.schema(new.schema).parquet(f"file://{tmp_path}/faces")
    sessions.run_assignment(stream, library, vectors, f"file://{tmp_path}/cp").awaitTermination()
    assert {r.face_id: r.cluster_id for r in library.read("faces").collect()} == {1: 1, 2: 2, 3: 1, 4: None}
    assert {r.cluster_id: r["size"] for r in library.read("clusters").collect()} == {1: 2, 2: 1}


def test_paging(spark):
    rows = spark.createDataFrame([(k, float(k // 2), 0) for k in range(5)], "id long, sort_at double, missing int")
    seen, cursor = [], None
    while True:
        page = relational.timeline_page(rows, 2, cursor).collect()
        seen += [r.id for r in page]
        if (cursor := relational.next_cursor(page, 2)) is None:
            break
    assert seen == [4, 3, 2, 1, 0] and [relational.clamp_limit(n) for n in (0, 7, 900)] == [1, 7, 500]


def png(height, width, seed):
    """An uncompressed-deflate PNG."""
    import struct
    import zlib

    pixels = np.random.default_rng(seed).integers(0, 255, (height, width, 3), dtype=np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pipeline(spark, tmp_path, library):
    root = tmp_path / "pictures"
    (root / ".hidden").mkdir(parents=True)
    (root / "sub").mkdir()
    for name, seed in (("a.png", 1), ("sub/b.PNG", 2), (".hidden/c.png", 3), (".d.png", 4)):
        (root / name).write_bytes(png(40, 60, seed))
    (root / "bad.jpg").write_bytes(b"not an image")
    (root / "note.txt").write_text("x")

    def embed(rows):
        return rows.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))

    def ocr(rows):
        return rows.select(F.col("id").alias("photo_id"), F.lit(1).alias("ord"), *(F.lit(0.1).alias(c) for c in ("bx", "by", "bw", "bh", "conf")), F.lit("words").alias("text"))

    run = Pipeline(library, [f"file://{root}", f"file://{root}/none"][:1], embed=embed, ocr=ocr)
    first = run.run(100.0)
    rows = {r.filename: r for r in library.read("photos").collect()}
    assert sorted(rows) == ["a.png", "b.PNG", "bad.jpg"] and first.state == "done"
    assert rows["a.png"].width == 60 and rows["a.png"].phash is not None and 0 <= rows["a.png"].quality <= 1 and len(rows["a.png"].content_hash) == 64
    assert rows["bad.jpg"].phash is None and rows["bad.jpg"].scored_at is None and rows["bad.jpg"].thumb_at == 100.0
    assert first.done == {"metadata": 3, "thumbs": 3, "score": 2, "embed": 2, "ocr": 2} and library.read("ocr").count() == 2
    assert sum(run.run(200.0).done.values()) == 0
    # one mark taken away: one piece of work
    again = library.read("photos").withColumn("scored_at", F.when(F.col("filename") != "a.png", F.col("scored_at")))
    library.write("photos", again)
    assert run.run(300.0).total == 1
    assert {r.state for r in library.read("jobs").collect()} == {"done"} and "faces" in MARKS


def test_batches_that_fail_are_passed_over(spark, tmp_path, library):
    root = tmp_path / "some [pictures]"
    root.mkdir()
    for k in range(5):
        (root / f"{k}.png").write_bytes(png(300 + 100 * k, 40, k))
    seen = []

    def embed(rows):
        ids = sorted(r.id for r in rows.collect())
        seen.append(ids)
        if 3 in ids and len(seen) < 9:
            raise RuntimeError("a worker died")
        return rows.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))

    run = Pipeline(library, [f"file://{tmp_path}"], embed=embed, group=True, batch=2)
    first = run.run(10.0)
    assert seen == [[1, 2], [3, 4], [5]] and first.done["embed"] == 3 and first.errored == 2 and first.state == "done"
    assert set(first.groups) == {"event", "burst", "near_dup", "semantic"}
    thumbs = {r.file: r for r in run.thumbnails().collect()}
    assert len(thumbs) == 5 and all(max(r.width, r.height) == 256 and r.file.endswith(".png") for r in thumbs.values())
    decoded = files.read_image_files(spark, [f"file://{root}/0.png", f"file://{root}/gone.png"]).collect()
    assert [(r.width, r.height) for r in decoded] == [(40, 300)]
    seen += [[]] * 9
    second = run.run(20.0)
    assert second.done["embed"] == 2 and second.errored == 0 and library.read("photos").where("embed_at IS NULL").count() == 0

    def stop(rows):
        run.cancel()
        assert run.run(30.0) is run.current  # a second start gives the run that is going on
        return rows.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))

    library.write("photos", library.read("photos").withColumn("embed_at", F.lit(None).cast("double")))
    run.models["embed"] = stop
    third = run.run(30.0)
    assert third.state == "canceled" and third.done["embed"] == 2 and third.groups == {}


def test_orientation():
    image = np.arange(6, dtype=np.uint8).reshape(2, 3, 1).repeat(3, axis=2)
    top = {k: pixels.oriented(image, k)[0, :, 0].tolist() for k in range(1, 9)}
    assert top == {1: [0, 1, 2], 2: [2, 1, 0], 3: [5, 4, 3], 4: [3, 4, 5], 5: [0, 3], 6: [3, 0], 7: [5, 2], 8: [2, 5]}


def test_scan_of_nothing(spark, tmp_path):
    assert files.scan_images(spark, [f"file://{tmp_path}/none"]).count() == 0


def test_gazetteer(spark):
    cities = spark.createDataFrame([(1, "Köln", "DE", 50.9, 6.9, 1_000_000, ["Cologne", "Кёльн"]), (2, "Hamlet", "", 0.0, 0.0, 10, None)], "place_id long, name string, country string, lat double, lon double, population long, alternates array<string>")
    assert [r["keys"] for r in files.read_gazetteer(cities).collect()] == [["köln", "cologne"]]
    assert files.place_names(files.read_gazetteer(cities)).count() == 2


def test_sessions_of_stream_and_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    sessions.run_sessions(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    last = events.agg(F.max("ts").cast("double")).first()[0]
    want = {tuple(r) for r in sessions.sessions(events).collect()}
    closed = {r for r in want if r[2] + 14400 <= last - 3600}
    assert got <= want and closed <= got and closed


def test_streamed_scans(spark, tmp_path, library):
    scans = spark.createDataFrame([("/a", "/", "a", ".png", 1, 1.0), ("/a", "/", "a", ".png", 2, 2.0), ("/b", "/", "b", ".png", 1, 1.0)], "path string, dir string, filename string, ext string, size_bytes long, mtime double")
    scans.write.parquet(f"file://{tmp_path}/scans")
    stream = spark.readStream.schema(scans.schema).parquet(f"file://{tmp_path}/scans")
    sessions.run_scans(stream, library, f"file://{tmp_path}/cp", 5.0).awaitTermination()
    assert {(r.path, r.size_bytes) for r in library.read("photos").collect()} == {("/a", 2), ("/b", 1)}


def test_f1(spark):
    rows = pd.DataFrame({"t": [0, 0, 0, 1, 1], "f": [0, 0, 1, 1, 1]})
    r = relational.pairwise_f1(spark.createDataFrame(rows), "t", "f").first()
    assert math.isclose(r.precision, 2 / 4) and math.isclose(r.recall, 2 / 4) and math.isclose(r.f1, 0.5) and math.isclose(r.purity, 4 / 5)
