"""The registered queries of the media library and the SQL that gives the same rows.

Every query runs over its whole tables. Computed doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import mutation, near_dup, people, relational, search, segment, text, triage, vector
from ..operators.dates import parse_dates
from ..operators.graph import connected_components
from ..operators.maintenance import eviction_plan
from ..operators.ordering import positions
from ..sources.storage import scratch
from ..streaming import sessions as streaming
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY, KM, PARIS, RADIUS = 86_400, 50.0, (48.8534, 2.3488), 25.0
WORDS = "the nation unter"
SIX = 6


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, SIX)


# --- timeline ------------------------------------------------------------------------------------------------------

SQL_EVENTS = f"""lagged AS (SELECT *, lag(sort_at) OVER w AS p_at, lag(gps_lat) OVER w AS p_lat, lag(gps_lon) OVER w AS p_lon, row_number() OVER w AS n
 FROM photos WHERE missing = 0 WINDOW w AS (PARTITION BY user_id ORDER BY sort_at, id)),
flagged AS (SELECT *, CASE WHEN n = 1 OR sort_at - p_at > {DAY} OR coalesce({v.sql_haversine("p_lat", "p_lon", "gps_lat", "gps_lon")} > {KM}, false) THEN 1 ELSE 0 END AS new FROM lagged),
events_v AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY sort_at, id) AS BIGINT) AS event_no FROM flagged)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_events(v.photos(spark, sf_dir, vectors=False).where("missing = 0"), DAY, KM, ["user_id"])


@query(f"{v.sql('photos')}, {SQL_EVENTS} SELECT user_id, event_no, count(*) AS size, min(sort_at) AS start_at, max(sort_at) AS end_at FROM events_v GROUP BY ALL")
def event_timeline(spark, sf_dir):
    """Per user: a day's gap or a jump of 50 km starts an event."""
    rows = _events(spark, sf_dir)
    return rows.groupBy("user_id", "event_no").agg(F.count("*").alias("size"), F.min("sort_at").alias("start_at"), F.max("sort_at").alias("end_at"))


SQL_BEST = "arg_max(id, [quality, aesthetic, (width*height)::DOUBLE, -id::DOUBLE])"


@query(f"""{v.sql('photos')}, {SQL_EVENTS} SELECT user_id, event_no, count(*) AS size, min(sort_at) AS start_at, max(sort_at) AS end_at, {SQL_BEST} AS rep_photo_id,
strftime(make_timestamp((floor(min(sort_at))*1000000)::BIGINT), '%Y-%m-%d') AS key FROM events_v GROUP BY ALL HAVING count(*) >= 2""")
def event_specs(spark, sf_dir):
    return segment.event_groups(_events(spark, sf_dir), ["user_id"])


@query(f"""{v.sql('photos')}, {SQL_EVENTS} SELECT user_id, event_no, id AS photo_id, CAST(row_number() OVER (PARTITION BY user_id, event_no ORDER BY sort_at, id) - 1 AS DOUBLE) AS rank FROM events_v""")
def event_members(spark, sf_dir):
    return segment.members(_events(spark, sf_dir), ["user_id", "event_no"])


SQL_GLOBAL = """g1 AS (SELECT *, lag(sort_at) OVER w AS p_at, row_number() OVER w AS n FROM photos WHERE missing = 0 WINDOW w AS (ORDER BY sort_at, id)),
g2 AS (SELECT *, CAST(sum(CASE WHEN n = 1 OR sort_at - p_at > 900 THEN 1 ELSE 0 END) OVER (ORDER BY sort_at, id) AS BIGINT) AS event_no FROM g1)"""


@query(f"{v.sql('photos')}, {SQL_GLOBAL} SELECT event_no, count(*) AS size, min(sort_at) AS start_at, max(sort_at) AS end_at FROM g2 GROUP BY ALL")
def global_events(spark, sf_dir):
    """One timeline of the whole library, by time alone; it runs by ranges, not in one task."""
    rows = segment.segment_events(v.photos(spark, sf_dir, vectors=False).where("missing = 0"), 900, 1e9)
    return rows.groupBy("event_no").agg(F.count("*").alias("size"), F.min("sort_at").alias("start_at"), F.max("sort_at").alias("end_at"))


@query(f"""{v.sql('photos')}, {SQL_GLOBAL}, b1 AS (SELECT *, lag(sort_at) OVER w AS q_at, lag(camera_model) OVER w AS q_cam, row_number() OVER w AS k FROM g2 WINDOW w AS (PARTITION BY event_no ORDER BY sort_at, id)),
b2 AS (SELECT *, CAST(sum(CASE WHEN k > 1 AND sort_at - q_at <= 60 AND camera_model IS NOT DISTINCT FROM q_cam THEN 0 ELSE 1 END) OVER (PARTITION BY event_no ORDER BY sort_at, id) AS BIGINT) AS burst_no FROM b1)
SELECT event_no, burst_no, count(*) AS size, min(sort_at) AS start_at, max(sort_at) AS end_at, {SQL_BEST} AS rep_photo_id FROM b2 GROUP BY ALL HAVING count(*) >= 2""")
def bursts_60s(spark, sf_dir):
    rows = segment.segment_events(v.photos(spark, sf_dir, vectors=False).where("missing = 0"), 900, 1e9)
    return segment.burst_groups(segment.detect_bursts(rows, 60))


@query("WITH s AS (SELECT user_id, epoch(ts) AS t, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), n AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(t) AS start_at, max(t) AS end_at, count(*) AS size FROM n GROUP BY user_id, k")
def session_window_user(spark, sf_dir):
    return streaming.sessions(v.table(spark, sf_dir, "events"))


# --- plain queries -------------------------------------------------------------------------------------------------

PAGE = "id, sort_at, dir, camera_model"


@query(f"{v.sql('photos')} SELECT {PAGE} FROM photos WHERE missing = 0 ORDER BY sort_at DESC, id DESC LIMIT 50")
def timeline_page(spark, sf_dir):
    return relational.timeline_page(v.photos(spark, sf_dir, False), 50).select(*PAGE.split(", "))


@query(f"{v.sql('photos')} SELECT {PAGE} FROM photos WHERE missing = 0 ORDER BY sort_at DESC, id DESC LIMIT 50 OFFSET 50")
def timeline_page2(spark, sf_dir):
    """The page after the first one, by its cursor."""
    photos = v.photos(spark, sf_dir, False)
    first = relational.timeline_page(photos, 50).select("sort_at", "id").collect()
    return relational.timeline_page(photos, 50, relational.next_cursor(first, 50)).select(*PAGE.split(", "))


@query(f"{v.sql('photos')}, m AS (SELECT min(sort_at) AS lo, max(sort_at) AS hi FROM photos) SELECT id, sort_at FROM photos, m WHERE missing = 0 AND sort_at >= lo + (hi-lo)*0.25 AND sort_at <= lo + (hi-lo)*0.5")
def date_range_scan(spark, sf_dir):
    photos = v.photos(spark, sf_dir, False)
    lo, hi = photos.agg(F.min("sort_at"), F.max("sort_at")).first()
    return relational.in_range(photos, lo + (hi - lo) * 0.25, lo + (hi - lo) * 0.5).select("id", "sort_at")


@query(f"{v.sql('photos')} SELECT id, dir FROM photos WHERE missing = 0 AND dir = '/lib/7'")
def folder_filter(spark, sf_dir):
    return relational.in_folder(v.photos(spark, sf_dir, False), "/lib/7").select("id", "dir")


SQL_STAGES = """staged AS (SELECT id, missing, CASE WHEN id % 3 > 0 THEN 1 END AS hashed_at, CASE WHEN id % 3 > 0 THEN 1 END AS exif_at, CASE WHEN id % 3 > 0 THEN 'h' END AS content_hash,
 CASE WHEN id % 4 > 0 THEN 1 END AS thumb_at, CASE WHEN id % 8 > 0 THEN 1 END AS phash, CASE WHEN id % 5 = 0 THEN 1 END AS scored_at, CASE WHEN embedding IS NOT NULL THEN 1 END AS embed_at,
 CASE WHEN id % 6 = 0 THEN 1 END AS faces_at, CASE WHEN id % 7 = 0 THEN 1 END AS ocr_at FROM photos)"""


def _staged(spark, sf_dir):
    when = lambda test, value=1: F.expr(f"CASE WHEN {test} THEN {value} END")
    return v.photos(spark, sf_dir).withColumns(
        {
            "hashed_at": when("id % 3 > 0"), "exif_at": when("id % 3 > 0"), "content_hash": when("id % 3 > 0", "'h'"), "thumb_at": when("id % 4 > 0"), "phash": when("id % 8 > 0"),
            "scored_at": when("id % 5 = 0"), "embed_at": when("embedding IS NOT NULL"), "faces_at": when("id % 6 = 0"), "ocr_at": when("id % 7 = 0"),
        }
    )


@query(f"""{v.sql('photos')}, {SQL_STAGES} SELECT count(*) FILTER (missing = 0 AND (hashed_at IS NULL OR exif_at IS NULL)) AS metadata, count(*) FILTER (missing = 0 AND thumb_at IS NULL) AS thumbs,
count(*) FILTER (missing = 0 AND scored_at IS NULL AND phash IS NOT NULL) AS score, count(*) FILTER (missing = 0 AND embed_at IS NULL) AS embed, count(*) FILTER (missing = 0 AND faces_at IS NULL) AS faces, count(*) FILTER (missing = 0 AND ocr_at IS NULL) AS ocr FROM staged""")
def pending_counts(spark, sf_dir):
    return relational.pending_counts(_staged(spark, sf_dir))


@query(f"{v.sql('photos')}, {SQL_STAGES} SELECT id FROM staged WHERE missing = 0 AND scored_at IS NULL AND phash IS NOT NULL AND content_hash IS NOT NULL ORDER BY id LIMIT 256")
def pending_batch(spark, sf_dir):
    return relational.pending(_staged(spark, sf_dir), "score", 256).select("id")


@query("SELECT event_type AS name, count(*) AS count FROM events GROUP BY 1 UNION ALL SELECT 'unused', 0")
def tag_counts(spark, sf_dir):
    return relational.tag_counts(v.tags(spark, sf_dir), v.photo_tags(spark, sf_dir)).select("name", "count")


@query("SELECT DISTINCT event_type AS name, 'user' AS kind, 'rule' AS source, 1.0::DOUBLE AS confidence FROM events WHERE event_id = 42")
def photo_tags(spark, sf_dir):
    return relational.tags_of(v.photo_tags(spark, sf_dir), v.tags(spark, sf_dir), 42).select("name", "kind", "source", "confidence")


@query(f"{v.sql('faces', 'clusters')} SELECT c.cluster_id, c.label, c.pinned, c.size, c.rep_face_id, f.photo_id AS rep_photo_id FROM clusters c LEFT JOIN faces f ON f.face_id = c.rep_face_id ORDER BY c.size DESC, c.cluster_id LIMIT 100")
def people_list(spark, sf_dir):
    return relational.people(v.clusters(spark, sf_dir), v.faces(spark, sf_dir))


@query(f"{v.sql('faces')} SELECT DISTINCT photo_id FROM faces WHERE cluster_id = 3 ORDER BY photo_id DESC LIMIT 500")
def person_photos(spark, sf_dir):
    return relational.photos_of_person(v.faces(spark, sf_dir), 3)


@query(f"{v.sql('faces', 'clusters')} SELECT f.photo_id, f.face_id, round(f.quality, 6) AS quality, coalesce(trim(c.label) <> '', false) AS named FROM faces f LEFT JOIN clusters c USING (cluster_id)")
def faces_named(spark, sf_dir):
    return relational.faces_with_person(v.faces(spark, sf_dir), v.clusters(spark, sf_dir)).withColumn("quality", six("quality"))


@query(f"""{v.sql('photos')}, {SQL_EVENTS}, g AS (SELECT user_id*100000 + event_no AS id, 'event' AS kind, count(*) AS size, {SQL_BEST} AS rep_photo_id FROM events_v GROUP BY user_id, event_no HAVING count(*) >= 2)
SELECT g.id, g.size, g.rep_photo_id, p.sort_at AS cover_at FROM g LEFT JOIN photos p ON p.id = g.rep_photo_id ORDER BY g.size DESC, g.id LIMIT 20 OFFSET 5""")
def group_covers(spark, sf_dir):
    groups = segment.event_groups(_events(spark, sf_dir), ["user_id"]).select((F.col("user_id") * 100000 + F.col("event_no")).alias("id"), F.lit("event").alias("kind"), "size", "rep_photo_id")
    covers = v.photos(spark, sf_dir, False).select("id", F.col("sort_at").alias("thumb_at"))
    return relational.group_list(groups, covers, "event", 20, 5).select("id", "size", "rep_photo_id", F.col("cover_thumb_at").alias("cover_at"))


@query("SELECT 'photos' AS \"table\", count(*) AS rows FROM events UNION ALL SELECT 'faces', count(*) FROM embeddings UNION ALL SELECT 'ocr', count(*) FROM documents UNION ALL SELECT 'tags', count(DISTINCT event_type) + 1 FROM events UNION ALL SELECT 'places', count(*) FROM nation")
def table_counts(spark, sf_dir):
    return relational.table_counts({"photos": v.photos(spark, sf_dir, False), "faces": v.faces(spark, sf_dir), "ocr": v.ocr(spark, sf_dir), "tags": v.tags(spark, sf_dir), "places": v.places(spark, sf_dir)})


@query("SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    rows = v.ocr(spark, sf_dir).select(F.col("photo_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    return near_dup.exact_duplicates(rows)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def metric_quantiles(spark, sf_dir):
    return relational.quantiles(v.table(spark, sf_dir, "events"), "value", ["event_type"]).withColumns({"p50": six("p50"), "p95": six("p95")})


@query("""WITH r AS (SELECT label AS t, vec_id % 10 AS f FROM embeddings), b AS (SELECT t, f, count(*)::DOUBLE AS n FROM r GROUP BY ALL), tp AS (SELECT sum(n*(n-1)/2) AS p FROM b),
tt AS (SELECT sum(n*(n-1)/2) AS p FROM (SELECT sum(n) AS n FROM b GROUP BY t)), ff AS (SELECT sum(n*(n-1)/2) AS p FROM (SELECT sum(n) AS n FROM b GROUP BY f)), pu AS (SELECT sum(m)/sum(a) AS purity FROM (SELECT max(n) AS m, sum(n) AS a FROM b GROUP BY f)),
x AS (SELECT tp.p/ff.p AS prec, tp.p/tt.p AS rec, purity FROM tp, tt, ff, pu) SELECT round(prec, 6) AS precision, round(rec, 6) AS recall, round(purity, 6) AS purity, round(2*prec*rec/(prec+rec), 6) AS f1 FROM x""")
def pairwise_f1(spark, sf_dir):
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("label").alias("t"), (F.col("vec_id") % 10).alias("f"))
    return relational.pairwise_f1(rows, "t", "f").select(*(six(c).alias(c) for c in ("precision", "recall", "purity", "f1")))


# --- places --------------------------------------------------------------------------------------------------------

SQL_NEAR = v.sql_haversine(str(PARIS[0]) + "E0", str(PARIS[1]) + "E0", "gps_lat", "gps_lon")


@query(f"{v.sql('photos')} SELECT id, round({SQL_NEAR}, 6) AS km FROM photos WHERE missing = 0 AND {SQL_NEAR} <= {RADIUS}")
def geo_radius(spark, sf_dir):
    photos = v.photos(spark, sf_dir, False)
    found = search.build_candidates(photos, center=PARIS, radius_km=RADIUS)
    return relational.with_ids(photos, found).select("id", six(fn.haversine_km(F.lit(PARIS[0]), F.lit(PARIS[1]), "gps_lat", "gps_lon")).alias("km"))


@query(f"""{v.sql('photos', 'places')}, d AS (SELECT id, place_id, name, {v.sql_haversine("gps_lat", "gps_lon", "lat", "lon")} AS km FROM photos, places WHERE gps_lat IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, place_id) AS n FROM d) SELECT id, place_id, name, round(km, 6) AS km FROM r WHERE n = 1""")
def reverse_geocode(spark, sf_dir):
    return search.reverse_geocode(v.photos(spark, sf_dir, False), v.places(spark, sf_dir)).withColumn("km", six("km"))


@query(f"{v.sql('places')} SELECT place_id, name, population FROM places WHERE lower(name) = (SELECT lower(name) FROM places WHERE place_id = 5) ORDER BY population DESC LIMIT 1")
def geocode_population(spark, sf_dir):
    """A name with a country behind a comma falls back to its head."""
    places = v.places(spark, sf_dir)
    name = places.where("place_id = 5").first().name
    return search.geocode(places, f" {name}, Somewhere").select("place_id", "name", "population")


# --- vectors -------------------------------------------------------------------------------------------------------

SQL_QUERY = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7)"
SQL_SCORED = f"scored AS (SELECT vec_id AS id, {v.sql_dot('embedding', 'qv')} AS score FROM embeddings, q)"


def _vectors(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query(spark, sf_dir):
    return list(_vectors(spark, sf_dir).where("id = 7").first().embedding)


@query(f"WITH {SQL_QUERY}, {SQL_SCORED} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 10")
def knn_exact(spark, sf_dir):
    return vector.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), 10).withColumn("score", six("score"))


@query(f"WITH {SQL_QUERY}, {SQL_SCORED} SELECT id, round(score, 6) AS score FROM scored WHERE id % 3 = 0 ORDER BY scored.score DESC, id LIMIT 10")
def knn_filtered(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vector.semantic_search(rows, _query(spark, sf_dir), 10, rows.where("id % 3 = 0").select("id"))[1].withColumn("score", six("score"))


@query(f"WITH {SQL_QUERY}, {SQL_SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 50) SELECT id, round(score, 6) AS score FROM t WHERE id % 3 = 0 ORDER BY t.score DESC, id LIMIT 10")
def knn_postfilter(spark, sf_dir):
    """Five times as many of all rows, then the filter: may give fewer."""
    rows = _vectors(spark, sf_dir)
    return vector.semantic_search(rows, _query(spark, sf_dir), 10, rows.where("id % 3 = 0").select("id"), 10, 20)[1].withColumn("score", six("score"))


@query("SELECT * FROM (VALUES ('none', 'hnsw'), ('empty', 'empty'), ('few', 'brute'), ('some', 'filtered_hnsw'), ('many', 'hnsw_postfilter')) AS x(candidates, tier)")
def tier_router(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir), _query(spark, sf_dir)
    sets = {"none": None, "empty": rows.where("false"), "few": rows.where("id < 20"), "some": rows.where("id < 60"), "many": rows}
    tiers = [(name, vector.semantic_search(rows, q, 5, c, 30, 100)[0]) for name, c in sets.items()]
    return spark.createDataFrame(tiers, "candidates string, tier string")


SQL_KNN = f"""pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, {v.sql_dot('a.embedding', 'b.embedding')} AS weight FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM pairs), graph AS (SELECT src, dst, weight FROM near WHERE n <= 20 AND weight >= 0.35)"""


@query(f"WITH {SQL_KNN} SELECT src, dst, round(weight, 6) AS weight FROM graph")
def knn_graph_edges(spark, sf_dir):
    return vector.knn_graph(_vectors(spark, sf_dir)).withColumn("weight", six("weight"))


SQL_MEAN = """parts AS (SELECT {by} AS k, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM {t}), means AS (SELECT k, d, avg(x) AS m FROM parts GROUP BY ALL),
norms AS (SELECT k, sqrt(sum(m*m)) AS s FROM means GROUP BY k), cents AS (SELECT k, list(m/CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY d) AS centroid FROM means JOIN norms USING (k) GROUP BY k)"""
SQL_LABEL_MEAN = SQL_MEAN.format(by="label", t="embeddings")


@query(f"WITH {SQL_LABEL_MEAN} SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = l.label) AS n, d::BIGINT AS d, round(x, 6) AS x FROM (SELECT k AS label, generate_subscripts(centroid, 1) - 1 AS d, unnest(centroid) AS x FROM cents) AS l")
def cluster_centroids(spark, sf_dir):
    rows = vector.centroids(_vectors(spark, sf_dir), ["label"])
    return rows.select("label", "n", F.posexplode("centroid").alias("d", "x")).select("label", "n", F.col("d").cast("long").alias("d"), six("x").alias("x"))


@query(f"WITH {SQL_LABEL_MEAN} SELECT label, count(*) AS n, round(avg({v.sql_dot('embedding', 'centroid')}), 6) AS cohesion FROM embeddings JOIN cents ON k = label GROUP BY label")
def cluster_cohesion(spark, sf_dir):
    return vector.cohesion(_vectors(spark, sf_dir), ["label"]).withColumn("cohesion", six("cohesion"))


@query(f"""WITH {SQL_LABEL_MEAN}, s AS (SELECT vec_id AS face_id, k AS cluster_id, {v.sql_dot('embedding', 'centroid')} AS score FROM embeddings, cents),
r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, cluster_id) AS n FROM s) SELECT face_id, cluster_id::BIGINT AS cluster_id, round(score, 6) AS score FROM r WHERE n = 1 AND score >= 0.1""")
def assign_nearest_centroid(spark, sf_dir):
    """All faces against the centroids of all labels."""
    faces = v.faces(spark, sf_dir)
    return vector.assign_nearest(faces, vector.centroids(faces, ["cluster_id"]), 0.1).withColumn("score", six("score"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice/100000.0E0 AS det_score, round(8/640.0E0, 6) AS bx, round(l_quantity*2/640.0E0, 6) AS bw, round(l_quantity/480.0E0, 6) AS bh FROM lineitem WHERE least(l_quantity*2, l_quantity) >= 32 AND l_extendedprice/100000.0E0 >= 0.5""")
def face_detections(spark, sf_dir):
    """Line items as detections: the box grows with the quantity, the score with the price."""
    q = F.col("l_quantity")
    rows = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100_000.0).alias("det_score"), F.lit(8.0).alias("x1"), F.lit(4.0).alias("y1"), (8.0 + 2 * q).alias("x2"), (4.0 + q).alias("y2"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"))
    return people.kept_detections(rows).select("l_orderkey", "l_linenumber", "det_score", six("bx").alias("bx"), six("bw").alias("bw"), six("bh").alias("bh"))


@query(f"{v.sql('photos')} SELECT id, id*2 AS embed_row FROM photos WHERE embedding IS NOT NULL")
def embedded_pairs(spark, sf_dir):
    rows = v.photos(spark, sf_dir).withColumns({"embed_at": F.when(F.col("embedding").isNotNull(), 1.0), "embed_row": F.col("id") * 2})
    return relational.embedded_pairs(rows)


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_user(spark, sf_dir):
    rows = v.table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("o", F.struct("ts", "event_id"))
    return relational.latest_per(rows, ["user_id"], "o").select("user_id", "ts", "event_id")


def _sql_whispers(rounds: int = 20) -> str:
    """The rounds of label propagation, one after another."""
    out = f"""{SQL_KNN}, units AS (SELECT src, dst, round(weight*1000000)::BIGINT AS weight FROM graph),
links AS MATERIALIZED (SELECT src, dst, sum(weight)::BIGINT AS weight FROM (SELECT * FROM units UNION ALL SELECT dst, src, weight FROM units) WHERE src <> dst GROUP BY ALL), l0 AS (SELECT DISTINCT src AS node, src AS label FROM links)"""
    for t in range(rounds):
        turn = f"(((node % {1 << 30} + {t * 7_919}) * 2654435761) >> 16) & 1"
        out += f""",
v{t} AS (SELECT k.src AS node, o.label AS label, n.label AS near, sum(k.weight) AS weight FROM links k JOIN l{t} n ON n.node = k.dst JOIN l{t} o ON o.node = k.src GROUP BY ALL),
l{t + 1} AS MATERIALIZED (SELECT node, CASE WHEN {turn} = 1 THEN near ELSE label END AS label FROM v{t} QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, near = label DESC, near) = 1)"""
    return out + f""",
labels AS (SELECT vec_id AS id, coalesce(l{rounds}.label, vec_id) AS label FROM embeddings LEFT JOIN l{rounds} ON node = vec_id),
sizes AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS cluster FROM labels GROUP BY label),
communities AS MATERIALIZED (SELECT id, cluster::BIGINT AS cluster FROM labels JOIN sizes USING (label))"""


SQL_WHISPERS = _sql_whispers()


@query(f"WITH {SQL_WHISPERS} SELECT id, cluster FROM communities")
def communities(spark, sf_dir):
    """Label propagation over the neighbour graph, numbered by size."""
    return people.cluster_vectors(_vectors(spark, sf_dir), 20, 0.35)


SQL_THEME = f"""own AS (SELECT id, cluster, embedding, count(*) OVER (PARTITION BY cluster) AS size FROM communities JOIN embeddings ON vec_id = id),
members AS (SELECT * FROM own WHERE size >= 3), {SQL_MEAN.format(by="cluster", t="members")}, near AS (SELECT m.*, {v.sql_dot("embedding", "centroid")} AS cosine FROM members m JOIN cents ON k = cluster)"""


@query(f"""WITH {SQL_WHISPERS}, {SQL_THEME.replace("near AS", "close AS").replace("parts AS", "t_parts AS").replace("FROM parts", "FROM t_parts")} SELECT cluster AS theme, concat('theme-', cluster) AS "key", id, round(cosine, 6) AS cosine, (row_number() OVER w - 1)::DOUBLE AS rank, size,
 round(avg(cosine) OVER (PARTITION BY cluster), 6) AS cohesion, first(id) OVER w AS rep_photo_id FROM close WINDOW w AS (PARTITION BY cluster ORDER BY cosine DESC, id)""")
def theme_members(spark, sf_dir):
    return people.themes(_vectors(spark, sf_dir).drop("label"), 20, 0.35, 3).withColumns({"cosine": six("cosine"), "cohesion": six("cohesion")})


# --- near-duplicates -----------------------------------------------------------------------------------------------

SQL_ND = f"""placed AS (SELECT *, row_number() OVER (ORDER BY u, id) AS pos FROM hashes), nd AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.phash, b.phash))::BIGINT AS hamming, {v.sql_dot('a.embedding', 'b.embedding')} AS cosine
 FROM placed a JOIN placed b ON b.pos > a.pos AND b.pos <= a.pos + 20), nd_pairs AS (SELECT * FROM nd WHERE hamming <= 20 AND coalesce(cosine >= -1, true))"""


def _pairs(spark, sf_dir):
    """The hashes are stored first, as a library has them, and not computed again for each use."""
    path = scratch(spark)
    v.hashes(spark, sf_dir).write.parquet(path)
    return near_dup.near_dup_pairs(spark.read.parquet(path), 20, -1.0)


@query(f"{v.sql('hashes')} SELECT id, phash FROM hashes")
def phash_bits(spark, sf_dir):
    return v.hashes(spark, sf_dir).select("id", "phash")


@query(f"{v.sql('hashes')}, {SQL_ND} SELECT a, b, hamming, round(cosine, 6) AS cosine FROM nd_pairs")
def near_dup_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.col("hamming").cast("long").alias("hamming"), six("cosine").alias("cosine"))


@query(f"{v.sql('hashes').replace('WITH ', 'WITH RECURSIVE ', 1)}, {SQL_ND}, e AS (SELECT a AS x, b AS y FROM nd_pairs UNION SELECT b, a FROM nd_pairs), reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x) SELECT x AS id, least(x, min(y)) AS component FROM reach GROUP BY x")
def near_dup_components(spark, sf_dir):
    return near_dup.near_dup_components(_pairs(spark, sf_dir))


# --- text ----------------------------------------------------------------------------------------------------------

SQL_BM25 = """terms AS (SELECT * FROM (VALUES {terms}) AS t(w)), toks AS (SELECT photo_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM ocr WHERE trim(text) <> ''),
lens AS (SELECT photo_id, len(t) AS dl FROM toks), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), tfs AS (SELECT photo_id, w, count(*) AS tf FROM (SELECT photo_id, unnest(t) AS w FROM toks) WHERE w IN (SELECT w FROM terms) GROUP BY ALL),
dfs AS (SELECT w, count(*) AS df FROM tfs GROUP BY w), idfs AS (SELECT w, CASE WHEN ln((n-df+0.5)/(df+0.5)) > 0 THEN ln((n-df+0.5)/(df+0.5)) ELSE 1e-6 END AS idf FROM dfs, corpus),
bm AS (SELECT photo_id, -sum(idf*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))) AS score FROM terms JOIN tfs USING (w) JOIN idfs USING (w) JOIN lens USING (photo_id), corpus GROUP BY photo_id)"""
SQL_TERMS = SQL_BM25.format(terms=", ".join(f"('{w}')" for w in WORDS.split()))


@query(f"{v.sql('ocr')}, {SQL_TERMS} SELECT photo_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf_dir):
    return text.bm25(v.ocr(spark, sf_dir), WORDS).withColumn("score", six("score"))


SQL_TOP = SQL_BM25.format(terms="('being'), ('ouer'), ('ouer')")


@query(f"{v.sql('ocr')}, {SQL_TOP} SELECT photo_id, round(score, 6) AS score FROM bm ORDER BY bm.score, photo_id LIMIT 25")
def bm25_top(spark, sf_dir):
    """A word given twice counts twice."""
    return text.bm25(v.ocr(spark, sf_dir), "being ouer ouer", 25).withColumn("score", six("score"))


@query("SELECT DISTINCT doc_id AS photo_id FROM documents WHERE trim(coalesce(text, '')) <> ''")
def has_text(spark, sf_dir):
    return v.ocr(spark, sf_dir).where(F.trim(F.coalesce("text", F.lit(""))) != "").select("photo_id").distinct()


@query("SELECT c.doc_id AS photo_id, string_agg(turn_text, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id AS doc_id, turn, text AS turn_text FROM conversations) AS c GROUP BY c.doc_id")
def combined_text(spark, sf_dir):
    return text.combined_text(v.table(spark, sf_dir, "conversations"), "conv_id", "turn").select(F.col("conv_id").alias("photo_id"), "text")


SQL_FUSED = f"""sem AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM scored ORDER BY score DESC, id LIMIT 20),
txt AS (SELECT photo_id AS id, row_number() OVER (ORDER BY score, photo_id) - 1 AS r FROM bm ORDER BY score, photo_id LIMIT 100)"""


@query(f"{v.sql('ocr')}, {SQL_QUERY}, {SQL_SCORED}, {SQL_TERMS}, {SQL_FUSED} SELECT id, round(sum(1.0E0/(60+r+1)), 6) AS score FROM (SELECT * FROM sem UNION ALL SELECT * FROM txt) AS u GROUP BY id")
def rrf_fused(spark, sf_dir):
    semantic = search.ranked(vector.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), 20), F.desc("score"), "id")
    words = search.ranked(text.bm25(v.ocr(spark, sf_dir), WORDS, 100).select(F.col("photo_id").alias("id"), "score"), "score", "id")
    return search.rrf([semantic, words]).select("id", six("score").alias("score"))


@query(f"{v.sql('photos')} SELECT id, sort_at AS score, row_number() OVER (ORDER BY sort_at DESC, id DESC) - 1 AS rank FROM photos WHERE missing = 0 AND {SQL_NEAR} <= {RADIUS} ORDER BY sort_at DESC, id DESC LIMIT 50")
def search_filter_only(spark, sf_dir):
    """No words: the newest photos near a place."""
    place = spark.createDataFrame([(1, "Paris", "FR", PARIS[0], PARIS[1], 2_000_000, ["paris"])], "place_id long, name string, country string, lat double, lon double, population long, keys array<string>")
    engine = search.SearchEngine(v.photos(spark, sf_dir), v.ocr(spark, sf_dir), place)
    return engine.search("", search.Filters(place="Paris", radius_km=RADIUS)).hits


# --- triage --------------------------------------------------------------------------------------------------------

SQL_SUBJECT = "subj AS (SELECT f.photo_id, least(1.0E0, sum(coalesce(f.quality, 0)*CASE WHEN trim(coalesce(c.label, '')) <> '' THEN 1.6E0 ELSE 1.0E0 END)) AS subject FROM faces f LEFT JOIN clusters c USING (cluster_id) GROUP BY 1)"


@query(f"{v.sql('faces', 'clusters')}, {SQL_SUBJECT} SELECT photo_id, round(subject, 6) AS subject FROM subj")
def subject_score(spark, sf_dir):
    return triage.subject_scores(v.faces(spark, sf_dir), v.clusters(spark, sf_dir)).withColumn("subject", six("subject"))


@query("SELECT event_id, user_id, round(CASE WHEN n > 1 THEN (r - 1 + (t - 1)/2.0E0)/(n - 1) ELSE 0.5E0 END, 6) AS percentile FROM (SELECT event_id, user_id, rank() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id, value) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events) AS x")
def avg_rank_percentile(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select("event_id", "user_id", six(fn.percentile_rank("value", ["user_id"])).alias("percentile"))


#: Scopes are the photos of a user id modulo 25; near-duplicates are pairs of neighbours by id.
SQL_SCOPE = f"""scope AS (SELECT * REPLACE (list_transform(embedding, lambda x: x::DOUBLE/sqrt({v.sql_dot('embedding', 'embedding')})) AS embedding), user_id % 25 AS scope_id, row_number() OVER (PARTITION BY user_id % 25 ORDER BY sort_at, id) - 1 AS scope_pos FROM photos WHERE missing = 0),
{SQL_MEAN.format(by="scope_id", t="scope")}, cosines AS (SELECT s.*, CASE WHEN s.embedding IS NOT NULL THEN {v.sql_dot('s.embedding', 'c.centroid')} END AS cos FROM scope s LEFT JOIN cents c ON c.k = s.scope_id),
fills AS (SELECT scope_id, median(cos) AS fill FROM cosines GROUP BY 1), raw AS (SELECT c.id, c.scope_id, c.scope_pos, c.quality, c.aesthetic, coalesce(cos, fill, 0) AS repr, coalesce(subject, 0) AS subject FROM cosines c JOIN fills USING (scope_id) LEFT JOIN subj ON subj.photo_id = c.id)"""
SQL_PCT = "CASE WHEN count(*) OVER (PARTITION BY scope_id) > 1 THEN (rank() OVER (PARTITION BY scope_id ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY scope_id, {c}) - 1)/2.0E0)/(count(*) OVER (PARTITION BY scope_id) - 1) ELSE 0.5E0 END"
SQL_NORM = "norm AS (SELECT *, " + ", ".join(f"{SQL_PCT.format(c=c)} AS n_{c}" for c in ("quality", "aesthetic", "repr", "subject")) + """, CASE WHEN id % 10 IN (4, 5) THEN 'near_dup' WHEN id % 10 IN (7, 8, 9) THEN 'burst' ELSE 'single' END AS kind,
 CASE WHEN id % 10 IN (4, 5, 7, 8, 9) THEN id // 10 ELSE id END AS key FROM raw)"""
SQL_TRIAGE = f"{v.sql('photos', 'faces', 'clusters')}, {SQL_SUBJECT}, {SQL_SCOPE}, {SQL_NORM}"


def _scope(spark, sf_dir):
    """Every photo is in a scope, the near-duplicate and burst groups come from the ids."""
    photos = v.photos(spark, sf_dir)
    w = Window.partitionBy("scope_id").orderBy("sort_at", "id")
    scope = photos.where("missing = 0").withColumn("scope_id", F.col("user_id") % 25).select("scope_id", F.col("id").alias("photo_id"), (F.row_number().over(w) - 1).alias("scope_pos"))
    group = photos.select(F.col("id").alias("photo_id"), F.expr("id div 10").alias("group_id"), (F.col("id") % 10).alias("d"))
    subjects = triage.subject_scores(v.faces(spark, sf_dir), v.clusters(spark, sf_dir))
    return scope, photos, subjects, group.where("d IN (4, 5)").drop("d"), group.where("d IN (7, 8, 9)").drop("d")


def _collapsed(spark, sf_dir):
    scope, photos, subjects, near, bursts = _scope(spark, sf_dir)
    return triage.collapse_keys(triage.scores(scope, photos, subjects), near, bursts)


@query(f"{SQL_TRIAGE} SELECT scope_id, id AS photo_id, round(repr, 6) AS repr FROM norm")
def representativeness(spark, sf_dir):
    scope, photos, _, _, _ = _scope(spark, sf_dir)
    rows = scope.join(photos.select(F.col("id").alias("photo_id"), "embedding"), "photo_id")
    return triage.representativeness(rows).select("scope_id", "photo_id", six("repr").alias("repr"))


@query(f"{SQL_TRIAGE} SELECT scope_id, id AS photo_id, " + ", ".join(f"round(n_{c}, 6) AS n_{c}" for c in ("quality", "aesthetic", "subject")) + " FROM norm")
def triage_scores(spark, sf_dir):
    scope, photos, subjects, _, _ = _scope(spark, sf_dir)
    return triage.scores(scope, photos, subjects).select("scope_id", "photo_id", *(six(f"n_{c}").alias(f"n_{c}") for c in ("quality", "aesthetic", "subject")))


SQL_BASE = "0.35E0*n_quality + 0.45E0*n_aesthetic + 0.10E0*0 + 0.10E0*n_subject"


@query(f"{SQL_TRIAGE}, b AS (SELECT *, {SQL_BASE} AS base, count(*) OVER (PARTITION BY scope_id, kind, key) AS key_size FROM norm), r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, kind, key ORDER BY base DESC, scope_pos) AS n FROM b) SELECT scope_id, id AS photo_id, kind, key_size, round(base, 6) AS base FROM r WHERE n = 1")
def triage_collapse(spark, sf_dir):
    """The best of each near-duplicate group or burst, without representativeness, whose last digits differ by engine."""
    preset = triage.Preset("custom", 0.35, 0.45, 0.0, 0.10, 0.85, False)
    rows = triage.collapse_best(_collapsed(spark, sf_dir), preset)
    return rows.select("scope_id", "photo_id", "kind", "key_size", six("base").alias("base"))


@query(f"""{SQL_TRIAGE}, k AS (SELECT *, kind <> 'single' AND row_number() OVER (PARTITION BY scope_id, kind, key ORDER BY n_quality DESC, scope_pos) > 1 AS redundant FROM norm),
d AS (SELECT *, round(0.5E0*(1-n_quality) + 0.2E0*(1-n_aesthetic) + CASE WHEN redundant THEN 0.5E0 ELSE 0.0E0 END, 6) AS score FROM k WHERE redundant OR n_quality < 0.5)
SELECT scope_id, id AS photo_id, score, redundant, CASE WHEN r = '' THEN 'weaker than the kept frame' ELSE r END AS reason FROM (SELECT *, concat_ws(', ', CASE WHEN redundant THEN 'near-duplicate of a kept shot' END, CASE WHEN n_quality < 0.34 THEN 'soft / low quality' END, CASE WHEN n_aesthetic < 0.34 THEN 'flat' END) AS r FROM d) AS x""")
def delete_candidates(spark, sf_dir):
    return triage.delete_candidates(_collapsed(spark, sf_dir)).select("scope_id", "photo_id", six("score").alias("score"), "redundant", "reason")


@query()
def triage_mmr(spark, sf_dir):
    """The whole triage of every scope, with diversity selection."""
    return triage.triage(*_scope(spark, sf_dir), triage.get_preset(), 20)


# --- changes and upkeep --------------------------------------------------------------------------------------------


def _scans(spark, sf_dir):
    """The part table as an old and a new scan: every seventh file changed, every thirteenth gone, ten new."""
    p = v.table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("/lib/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("size_bytes"), F.col("p_retailprice").alias("mtime"), F.lit("h").alias("content_hash"), F.lit(0).alias("missing"), F.col("p_retailprice").alias("sort_at"))
    changed = F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)
    new = p.where("p_partkey % 13 > 0").select(F.concat(F.lit("/lib/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("size_bytes"), (F.col("p_retailprice") + changed).alias("mtime"))
    return old, new.unionByName(spark.range(10).select(F.concat(F.lit("/new/"), "id").alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.lit(5.0).alias("mtime")))


SQL_UPSERT = """SELECT p_partkey AS id, concat('/lib/', p_partkey) AS path, p_size::BIGINT AS size_bytes, p_retailprice + CASE WHEN ch THEN 1 ELSE 0 END AS mtime, CASE WHEN NOT ch THEN 'h' END AS content_hash, 0 AS missing, p_retailprice + CASE WHEN ch THEN 1 ELSE 0 END AS sort_at
FROM (SELECT *, p_partkey % 7 = 0 AND p_partkey % 13 > 0 AS ch FROM part) AS x UNION ALL SELECT (SELECT max(p_partkey) FROM part) + 1 + i, concat('/new/', i), 1, 5.0, NULL, 0, 5.0 FROM range(10) AS r(i)"""


@query(SQL_UPSERT)
def upsert_changed(spark, sf_dir):
    old, new = _scans(spark, sf_dir)
    return mutation.upsert_scanned(old, new, 9.0)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def delete_cascade(spark, sf_dir):
    """Customers with debts go, and their orders with them."""
    left = mutation.delete(v.table(spark, sf_dir, "customer"), v.table(spark, sf_dir, "customer").where("c_acctbal < 0"), ["c_custkey"])
    return mutation.cascade(v.table(spark, sf_dir, "orders"), left, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT vec_id AS old_row, row_number() OVER (ORDER BY vec_id) - 1 AS embed_row FROM embeddings WHERE vec_id % 97 <> 0")
def compact_renumber(spark, sf_dir):
    rows = _vectors(spark, sf_dir).where("id % 97 <> 0")
    return positions(rows, "id", "id", name="embed_row").select(F.col("id").alias("old_row"), "embed_row")


@query("WITH f AS (SELECT p_name || p_partkey AS path, p_size::BIGINT AS size, p_retailprice AS mtime FROM part), t AS (SELECT sum(size) AS total FROM f), r AS (SELECT *, sum(size) OVER (ORDER BY mtime, path ROWS UNBOUNDED PRECEDING) AS gone FROM f, t) SELECT path, size FROM r WHERE total - (gone - size) > total * 0.6")
def lru_evict_plan(spark, sf_dir):
    files = v.table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("mtime"))
    total = files.agg(F.sum("size")).first()[0]
    return eviction_plan(files, total * 6 // 10 if total * 6 % 10 == 0 else total * 0.6).select("path", "size")


# --- scalars -------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(sqrt(list_sum([x::DOUBLE*x::DOUBLE for x in embedding])), 6) AS norm, round(embedding[1]::DOUBLE/sqrt(list_sum([x::DOUBLE*x::DOUBLE for x in embedding])), 6) AS first FROM embeddings")
def unit_vectors(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select("vec_id", six(fn.norm("embedding")).alias("norm"), six(F.get(fn.unit("embedding"), 0)).alias("first"))


@query("SELECT o_orderkey, epoch(o_orderdate) AS taken_at, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def exif_dates(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", fn.exif_epoch(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).alias("taken_at"))
    return o.withColumn("day", fn.day_key("taken_at"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_quantity + l_discount*100/60.0E0 + l_tax*100/3600.0E0), 6) AS degrees FROM lineitem")
def dms_degrees(spark, sf_dir):
    ref = F.when(F.col("l_returnflag") == "R", "s").otherwise("n")
    rows = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("dms"), ref.alias("ref"))
    return rows.select("l_orderkey", "l_linenumber", six(fn.dms_to_degrees("dms", "ref")).alias("degrees"))


@query("SELECT page_id, md5(url) AS h, substr(md5(url), 1, 2) || '/' || substr(md5(url), 3, 2) || '/' || md5(url) || '.webp' AS shard FROM pages")
def shard_paths(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select("page_id", F.md5(F.col("url").cast("binary")).alias("h")).withColumn("shard", fn.shard_path("h"))


@query("SELECT event_id, round(1-exp(-greatest(value, 0)/50.0E0), 6) AS knee, round(0.4E0*(value/(value+50)) + 0.2E0*least(value/500.0E0, 1) + 0.2E0*least((event_id % 200)/112.0E0, 1) + 0.2E0*greatest(0, 1-least(abs((event_id % 9) - 4)/4.0E0, 1)), 6) AS quality FROM events")
def score_expressions(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    points = F.array(F.lit(0.0), F.lit(0.0), F.lit(8.0), F.lit(0.0), (F.col("event_id") % 9).cast("double"), F.lit(3.0))
    side = (F.col("event_id") % 200).cast("double")
    return e.select("event_id", six(fn.saturating("value", 50)).alias("knee"), six(fn.face_quality(F.col("value") / (F.col("value") + 50), points, "value", side, side)).alias("quality"))


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10")
def graph_components_input(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    b = e.select((F.col("vec_id") - 10).alias("a"), F.col("vec_id").alias("b"), F.col("label").alias("lb"))
    return e.join(b, (e.vec_id == b.a) & (e.label == b.lb)).select("a", "b")


@query("WITH RECURSIVE e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10), s AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x, y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x) SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x")
def graph_components(spark, sf_dir):
    edges = graph_components_input(spark, sf_dir)
    return connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("""WITH g AS (SELECT user_id, epoch(ts) AS t, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), n AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS s FROM g),
x AS (SELECT user_id, min(t) AS start_at, max(t) AS end_at, count(*) AS size FROM n GROUP BY user_id, s) SELECT * FROM x WHERE end_at + 14400 <= (SELECT max(epoch(ts)) FROM events) - 3600""")
def stream_sessions(spark, sf_dir):
    """Sessions of the events as a stream that ends when all is read: those that are closed an hour before its end."""
    root = scratch(spark)
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{root}/in")
    streaming.run_sessions(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("user_id long, start_at double, end_at double, size long").parquet(f"{root}/out")


# --- look-ups, pools, memberships ------------------------------------------------------------------------------------


@query("SELECT id, pos FROM (SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS pos, vec_id AS id FROM embeddings) JOIN documents ON doc_id = id WHERE lang = 'en'")
def hydrated_hits(spark, sf_dir):
    """Ranked hits with their rows; hits whose row is gone (here, of another language) are left out."""
    ranked = positions(v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (-F.col("vec_id")).alias("o")), "o", "id", name="rank")
    rows = v.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("thumb_at"))
    return relational.hydrate(ranked.select("id", "rank"), rows).select("id", F.col("rank").alias("pos"))


@query(f"{v.sql('faces')}, {v.SQL['clusters']} SELECT c.cluster_id, c.rep_face_id, f.photo_id, f.quality FROM clusters c JOIN faces f ON f.face_id = c.rep_face_id")
def cluster_anchors(spark, sf_dir):
    return relational.anchors(v.clusters(spark, sf_dir), v.faces(spark, sf_dir)).select("cluster_id", "rep_face_id", "photo_id", "quality")


@query(f"{v.sql('faces')} SELECT face_id, cluster_id, quality FROM faces WHERE photo_id = 7")
def faces_of_photo(spark, sf_dir):
    return relational.faces_of(v.faces(spark, sf_dir), 7).select("face_id", "cluster_id", "quality")


def _pool(spark, sf_dir):
    """Faces of low quality wait without a cluster."""
    f = v.faces(spark, sf_dir)
    waits = F.col("quality") < 0.3
    return f.withColumns({"assigned": F.when(waits, 0).otherwise(1), "cluster_id": F.when(~waits, F.col("cluster_id"))})


@query(f"{v.sql('faces')} SELECT face_id, photo_id, quality FROM faces WHERE quality < 0.3")
def pending_faces(spark, sf_dir):
    return relational.pending_faces(_pool(spark, sf_dir)).select("face_id", "photo_id", "quality")


@query(f"{v.sql('faces')}, {v.SQL['clusters']} SELECT face_id, CASE WHEN cluster_id < 4 AND quality >= 0.3 THEN cluster_id END AS cluster_id, CASE WHEN cluster_id < 4 AND quality >= 0.3 THEN 1 ELSE 0 END AS assigned FROM faces")
def reset_unpinned(spark, sf_dir):
    """Faces of clusters that aren't pinned go back to the pool."""
    clusters = v.clusters(spark, sf_dir).withColumn("centroid", F.lit(None).cast("array<double>"))
    return people.reset_unpinned(_pool(spark, sf_dir), clusters)[0].select("face_id", "cluster_id", "assigned")


@query(f"{v.sql('faces')}, g AS (SELECT CASE WHEN cluster_id IN (1, 2, 3) THEN 1 ELSE cluster_id END AS cluster_id, face_id, quality FROM faces) SELECT cluster_id, count(*) AS size, arg_max(face_id, [quality, -face_id]) AS rep_face_id FROM g GROUP BY 1")
def merged_clusters(spark, sf_dir):
    """Clusters 2 and 3 go into 1; sizes and representatives are made anew."""
    clusters = v.clusters(spark, sf_dir).withColumn("centroid", F.lit(None).cast("array<double>"))
    return people.merge_clusters(v.faces(spark, sf_dir), clusters, 1, [2, 3])[1].select("cluster_id", "size", "rep_face_id")


def _groups(spark, sf_dir):
    """Customers' orders as groups and items: by priority and by status."""
    o = v.table(spark, sf_dir, "orders")
    items = o.select((F.col("o_custkey") * 2).alias("group_id"), F.col("o_orderkey").alias("photo_id"), F.col("o_totalprice").alias("rank"))
    items = items.unionByName(o.select((F.col("o_custkey") * 2 + 1).alias("group_id"), F.col("o_orderkey").alias("photo_id"), (-F.col("o_totalprice")).alias("rank")))
    groups = v.table(spark, sf_dir, "customer").select(F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 2 + 1)).alias("id"), F.col("c_acctbal").alias("score"))
    return groups.withColumn("kind", F.when(F.col("id") % 2 == 0, "event").otherwise("burst")), items


SQL_GROUPS = """WITH items AS (SELECT o_custkey*2 AS group_id, o_orderkey AS photo_id, o_totalprice AS rank FROM orders UNION ALL SELECT o_custkey*2+1, o_orderkey, -o_totalprice FROM orders),
groups AS (SELECT c_custkey*2 + i AS id, c_acctbal AS score, CASE WHEN i = 0 THEN 'event' ELSE 'burst' END AS kind FROM customer, (VALUES (0), (1)) AS x(i))"""


@query(f"{SQL_GROUPS} SELECT photo_id, rank FROM items WHERE group_id = 14")
def members_by_rank(spark, sf_dir):
    return relational.group_members(_groups(spark, sf_dir)[1], 14).select("photo_id", "rank")


@query(f"{SQL_GROUPS} SELECT photo_id, max(group_id) AS group_id FROM items JOIN groups ON id = group_id WHERE kind = 'burst' AND photo_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY photo_id")
def groups_of_members(spark, sf_dir):
    groups, items = _groups(spark, sf_dir)
    ids = v.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return relational.member_groups(items, groups, "burst", ids)


@query(f"{SQL_GROUPS} SELECT id, kind, score FROM groups WHERE id IN (SELECT group_id FROM items WHERE photo_id = 33)")
def groups_of_photo(spark, sf_dir):
    groups, items = _groups(spark, sf_dir)
    return relational.groups_of(items, groups, 33).select("id", "kind", "score")


@query(f"""{SQL_GROUPS}, fresh AS (SELECT l_orderkey*2 AS id, count(*) AS size FROM lineitem GROUP BY 1) SELECT kind, id, size FROM (SELECT kind, id, 0 AS size FROM groups WHERE kind <> 'event' UNION ALL SELECT 'event', id, size FROM fresh)""")
def replace_groups(spark, sf_dir):
    """All groups of a kind are replaced; those of other kinds stay."""
    groups = _groups(spark, sf_dir)[0].select("id", "kind", F.lit(0).cast("long").alias("size"))
    fresh = v.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("id")).agg(F.count("*").alias("size")).withColumn("kind", F.lit("event"))
    kinds = spark.createDataFrame([("event",)], "kind string")
    return mutation.replace_children(groups, kinds, fresh, "kind").select("kind", "id", "size")


@query("SELECT event_id AS id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def newest_log(spark, sf_dir):
    return relational.newest(v.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type"))


@query("SELECT n_name AS path, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation")
def roots_list(spark, sf_dir):
    return positions(relational.roots(v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"))), "path", "path").select("path", "pos")


# --- changes of tables -----------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)")
def get_or_create(spark, sf_dir):
    names = v.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    return mutation.get_or_create(v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), names)


@query("SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS event_type FROM events")
def upsert_links(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return mutation.upsert(e, e.where("event_id % 3 = 0").withColumn("event_type", F.lit("new")), ["event_id", "user_id"])


@query("SELECT vec_id, label FROM embeddings UNION ALL SELECT DISTINCT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def insert_or_ignore(spark, sf_dir):
    old = v.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    d = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(-1).alias("label"))
    return mutation.insert_missing(old, d.unionByName(d), ["vec_id"])


@query("SELECT event_id, CASE WHEN value > 90 THEN 'high' ELSE event_type END AS event_type, value FROM events")
def partial_update(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return mutation.apply_updates(e, e.select("event_id", F.when(F.col("value") > 90, "high").alias("event_type")), "event_id")


@query("SELECT event_id, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN user_id END AS user_id FROM events")
def set_null_on_delete(spark, sf_dir):
    parents = v.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return mutation.set_null(v.table(spark, sf_dir, "events").select("event_id", "user_id"), parents, "user_id")


@query("SELECT event_id AS id, CASE WHEN running THEN 'error' ELSE event_type END AS state, CASE WHEN running THEN 'interrupted' END AS error_msg, CASE WHEN running THEN 5.0 END AS finished_at FROM (SELECT *, event_type = (SELECT min(event_type) FROM events) AND user_id % 2 = 0 AS running FROM events)")
def interrupted_jobs(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type")).first()[0]
    kind = F.when(F.col("user_id") % 2 == 0, "ingest").otherwise("export")
    jobs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == first, "running").otherwise(F.col("event_type")).alias("state"), kind.alias("kind"), F.lit(None).cast("string").alias("error_msg"), F.lit(None).cast("double").alias("updated_at"), F.lit(None).cast("double").alias("finished_at"))
    done = mutation.fail_running_jobs(jobs, "ingest", 5.0)
    return done.select("id", F.when(F.col("state") == "running", first).otherwise(F.col("state")).alias("state"), "error_msg", "finished_at")


@query("SELECT doc_id AS photo_id, CASE WHEN doc_id % 2 = 0 THEN 'read again: ' || text ELSE text END AS text FROM documents WHERE doc_id % 2 = 1 OR trim(text) <> ''")
def replaced_texts(spark, sf_dir):
    """Text rows of photos that were read again are replaced; blank ones are not stored."""
    rows = v.ocr(spark, sf_dir)
    done = rows.where("photo_id % 2 = 0")
    return mutation.set_ocr(rows, done.select("photo_id"), done.select("photo_id", F.concat(F.lit("read again: "), "text").alias("text")))


# --- dates in queries --------------------------------------------------------------------------------------------------

PHRASES = ["beach 2024", "trip july 2023", "2023 Jul x", "receipts 2022-08", "2020-05-17 party", "2023-02-30", "summer 2019 sea", "last spring", "yesterday", "past 3 days", "this year a", "march on"]


@query("""SELECT * FROM (VALUES ('beach 2024', 'beach', epoch(TIMESTAMP '2024-01-01'), epoch(TIMESTAMP '2025-01-01') - 1), ('trip july 2023', 'trip', epoch(TIMESTAMP '2023-07-01'), epoch(TIMESTAMP '2023-08-01') - 1), ('2023 Jul x', 'x', epoch(TIMESTAMP '2023-07-01'), epoch(TIMESTAMP '2023-08-01') - 1),
('receipts 2022-08', 'receipts', epoch(TIMESTAMP '2022-08-01'), epoch(TIMESTAMP '2022-09-01') - 1), ('2020-05-17 party', 'party', epoch(TIMESTAMP '2020-05-17'), epoch(TIMESTAMP '2020-05-18') - 1), ('2023-02-30', '-30', epoch(TIMESTAMP '2023-02-01'), epoch(TIMESTAMP '2023-03-01') - 1),
('summer 2019 sea', 'sea', epoch(TIMESTAMP '2019-06-01'), epoch(TIMESTAMP '2019-09-01') - 1), ('last spring', '', epoch(TIMESTAMP '2026-03-01'), epoch(TIMESTAMP '2026-06-01') - 1), ('yesterday', '', epoch(TIMESTAMP '2026-07-31'), epoch(TIMESTAMP '2026-08-01') - 1), ('past 3 days', '', epoch(TIMESTAMP '2026-07-29 12:00:00'), epoch(TIMESTAMP '2026-08-01 12:00:00')),
('this year a', 'a', epoch(TIMESTAMP '2026-01-01'), epoch(TIMESTAMP '2026-08-01 12:00:00')), ('march on', 'march on', NULL, NULL)) AS x(query, cleaned, date_from, date_to)""")
def date_phrases(spark, sf_dir):
    found = [(q, parse_dates(q, datetime(2026, 8, 1, 12, tzinfo=UTC))) for q in PHRASES]
    return spark.createDataFrame([(q, p.cleaned_query, p.date_from, p.date_to) for q, p in found], "query string, cleaned string, date_from double, date_to double")
