import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shoebox.operators import graph, near_dup, people
from shoebox.operators.vector import centroids


def frame(spark, edges):
    return spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in graph.connected_components(frame(spark, edges)).collect()} == want
    assert graph.connected_components(frame(spark, edges).where("false")).count() == 0


def whispers(nodes, edges, iterations=20):
    """The same rounds over dictionaries."""
    near = defaultdict(Counter)
    for a, b, w in edges:
        if a != b:
            near[a][b] += round(w * 1_000_000)
            near[b][a] += round(w * 1_000_000)
    label = {n: n for n in near}
    for turn in range(iterations):
        best = {}
        for n in near:
            votes = Counter()
            for other, w in near[n].items():
                votes[label[other]] += w
            best[n] = max(votes, key=lambda x: (votes[x], x == label[n], -x))
        turns = {n: (n % (1 << 30) + turn * 7_919) * 2_654_435_761 // 65_536 % 2 for n in near}
        done = best == label
        label = {n: best[n] if turns[n] else label[n] for n in near}
        if done:
            break
    return {n: n for n in nodes} | label


def test_two_triangles(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 1), (11, 12), (12, 13), (13, 11)])
    nodes = edges.select(F.col("src").alias("node")).unionByName(spark.createDataFrame([(99,)], "node long"))
    labels = {r.node: r.label for r in graph.chinese_whispers(nodes, edges).collect()}
    assert labels[1] == labels[2] == labels[3] != labels[11] == labels[12] == labels[13] and labels[99] == 99
    assert {r.node: r.cluster for r in graph.by_size(graph.chinese_whispers(nodes, edges)).collect()} == {1: 0, 2: 0, 3: 0, 11: 1, 12: 1, 13: 1, 99: 2}


def test_whispers_equal_rounds_over_dictionaries(spark):
    rng = random.Random(9)
    links = [(rng.randrange(20 * k, 20 * k + 20), rng.randrange(20 * k, 20 * k + 20), rng.random()) for k in range(5) for _ in range(60)]
    links += [(rng.randrange(100), rng.randrange(100), 0.2 * rng.random()) for _ in range(30)]
    links += [(1000, 1001, 1.0), *((2000, 2001 + k, 1.0) for k in range(8)), (-5, 2**60, 0.5)]  # a pair, a star, wide ids
    nodes = sorted({n for a, b, _ in links for n in (a, b)} | {777})
    edges = spark.createDataFrame(links, "src long, dst long, weight double")
    got = {r.node: r.label for r in graph.chinese_whispers(spark.createDataFrame([(n,) for n in nodes], "node long"), edges).collect()}
    assert got == whispers(nodes, links)
    assert got[1000] == got[1001] and len({got[2000 + k] for k in range(9)}) == 1  # these settle
    again = graph.chinese_whispers(edges.select(F.col("src").alias("node")), edges.repartition(7, "weight"))
    assert {r.node: r.label for r in again.collect()}.items() <= got.items()


def test_the_heaviest_label_wins(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.4), (3, 4, 2.0)], "src long, dst long, weight double")
    got = {r.node: r.label for r in graph.chinese_whispers(edges.select(F.col("src").alias("node")), edges).collect()}
    assert got[1] == got[2] != got[3] == got[4]


def blobs(spark, n=12, noise=0.05, dims=16, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(3):
        for _ in range(n):
            rows.append((len(rows), [(1.0 if d == k else 0.0) + rng.gauss(0, noise) for d in range(dims)], 0.5))
    return spark.createDataFrame(rows, "id long, embedding array<double>, quality double")


def test_blobs_and_themes(spark):
    rows = blobs(spark)
    got = {r.id: r.cluster for r in people.cluster_vectors(rows, 5, 0.5).collect()}
    assert [len({got[i] for i in range(12 * k, 12 * k + 12)}) for k in range(3)] == [1, 1, 1] and set(got.values()) == {0, 1, 2}
    themes = people.themes(rows, 5, 0.5, 3).collect()
    assert len(themes) == 36 and {r["size"] for r in themes} == {12} and all(r.cohesion > 0.9 for r in themes)
    assert {r.rep_photo_id for r in themes} == {r.id for r in themes if r["rank"] == 0}
    assert people.themes(rows, 5, 0.5, 13).count() == 0


@pytest.mark.parametrize("with_vectors,expected", [(None, {0, 1}), ("same", {0, 1}), ("apart", set())])
def test_near_duplicates(spark, with_vectors, expected):
    v = {None: [None] * 3, "same": [[1.0, 0.0]] * 3, "apart": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]}[with_vectors]
    rows = spark.createDataFrame([(0, 0, v[0]), (1, 1, v[1]), (2, 0xFFFFFF, v[2]), (3, None, None)], "id long, phash long, embedding array<double>")
    pairs = near_dup.near_dup_pairs(rows, 2)
    assert {r.id for r in near_dup.near_dup_components(pairs).collect()} == expected


def test_near_duplicate_groups(spark):
    rows = spark.createDataFrame([(1, 0.2, 0.1, 10, 10), (2, 0.9, 0.1, 10, 10), (3, 0.9, 0.1, 20, 10), (4, 0.9, 0.1, 20, 10)], "id long, quality double, aesthetic double, width int, height int")
    comp = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)], "id long, component long")
    groups, members = near_dup.near_dup_groups(rows, comp)
    assert [(r["size"], r.rep_photo_id, r.score) for r in groups.collect()] == [(4, 3, 4.0)]
    assert [r.photo_id for r in members.orderBy("rank").collect()] == [3, 4, 2, 1]


FACES = "face_id long, photo_id long, quality double, embedding array<double>, cluster_id long, assigned int"
CLUSTERS = "cluster_id long, label string, pinned int, rep_face_id long, size long, centroid array<double>"


def pool(spark, n=8):
    rows = blobs(spark, n).collect()
    return spark.createDataFrame([(r.id, r.id, r.id / 100, r.embedding, None, 0) for r in rows], FACES)


def groups_of(faces):
    out = {}
    for r in faces.collect():
        out.setdefault(r.cluster_id, set()).add(r.face_id)
    return out


def test_people_lifecycle(spark):
    none = spark.createDataFrame([], CLUSTERS)
    faces, clusters = people.update_people(pool(spark), none)
    found = {c: set(m) for c, m in groups_of(faces).items()}
    assert sorted(map(sorted, found.values())) == [list(range(k, k + 8)) for k in (0, 8, 16)]
    stats = {r.cluster_id: r for r in clusters.collect()}
    assert {c: (r["size"], r.rep_face_id) for c, r in stats.items()} == {c: (8, max(m)) for c, m in found.items()}
    # a new face joins by its centroid
    first = next(c for c, m in found.items() if 0 in m)
    new = spark.createDataFrame([(100, 100, 0.1, [1.0] + [0.0] * 15, None, 0)], FACES)
    faces, clusters = people.assign_pending(faces.unionByName(new), clusters)
    assert 100 in groups_of(faces)[first] and {r.cluster_id: r["size"] for r in clusters.collect()}[first] == 9
    # pinned clusters live through a forced run
    clusters = people.set_label(clusters, first, "Ann")
    faces2, clusters2 = people.update_people(faces, clusters, force=True)
    kept = {r.cluster_id: r for r in clusters2.collect()}
    assert kept[first].label == "Ann" and groups_of(faces2)[first] == groups_of(faces)[first] and len(kept) == 3


def test_merge_split_and_bridge(spark):
    faces, clusters = people.update_people(pool(spark), spark.createDataFrame([], CLUSTERS))
    a, b, c = sorted(groups_of(faces))
    merged, left = people.merge_clusters(faces, people.set_label(clusters, a, "A"), a, [b, a])
    assert sorted(groups_of(merged)) == [a, c] and {r.cluster_id: (r.label, r["size"]) for r in left.collect()} == {a: ("A", 16), c: (None, 8)}
    parts, after = people.split_cluster(merged, left, a)
    assert sorted(len(m) for m in groups_of(parts).values()) == [8, 8, 8] and "A" not in {r.label for r in after.collect()}
    assert people.split_cluster(merged.where("face_id = 0"), left, a)[1] is left
    # two clusters of one person, bridged by the pool, become the larger one
    one = faces.where(F.col("cluster_id") == a)
    split = one.withColumn("cluster_id", F.when(F.col("face_id") % 4 == 0, 50).otherwise(60).cast("long"))
    two = people.cluster_stats(split).withColumns({"label": F.lit("L"), "pinned": F.lit(1)}).select(*people.CLUSTER_COLUMNS)
    waiting = split.withColumns({"assigned": F.when(F.col("face_id") % 4 == 1, 0).otherwise(1)}).withColumn("cluster_id", F.when(F.col("assigned") == 1, F.col("cluster_id")))
    again, kept = people.recluster_pending(waiting, two)
    assert {r.cluster_id for r in kept.collect()} == {60} and set(groups_of(again)) == {60}
    _, both = people.recluster_pending(waiting, two, protect_pinned=True)
    assert {r.cluster_id for r in both.collect()} == {50, 60}


def test_centroid_of_nothing_is_nothing(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (1, None), (2, None)], "k long, embedding array<double>")
    assert [(r.k, r.n, r.centroid) for r in centroids(rows, ["k"]).collect()] == [(1, 1, [0.0, 0.0])]
