"""The media library's tables as views over the provided tables, for Spark; ``sql`` has the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "events")
    has_gps = F.col("event_id") % 5 != 0
    rows = e.select(
        F.col("event_id").alias("id"),
        "user_id",
        fn.epoch("ts").alias("sort_at"),
        F.concat(F.lit("/lib/"), (F.col("user_id") % 20).cast("string")).alias("dir"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("cam"), (F.col("user_id") % 4).cast("string"))).alias("camera_model"),
        F.when(has_gps, F.expr("48.0D + (user_id % 40) * 0.05D + ((event_id div 331) % 3) * 0.6D")).alias("gps_lat"),
        F.when(has_gps, F.expr("2.0D + (user_id % 60) * 0.05D")).alias("gps_lon"),
        (F.col("value") / (F.col("value") + 50.0)).alias("quality"),
        F.expr("((event_id * 7919) % 1000) / 1000.0D").alias("aesthetic"),
        F.when(F.col("event_id") % 97 == 0, 1).otherwise(0).alias("missing"),
        F.expr("cast(640 + (event_id % 7) * 160 as int)").alias("width"),
        F.expr("cast(480 + (event_id % 5) * 120 as int)").alias("height"),
    )
    if not vectors:
        return rows
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows.join(v, "id", "left")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), fn.median_hash("embedding").alias("phash"), "embedding")


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), "text")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("face_id"), (F.col("vec_id") % 100).alias("photo_id"), F.expr("(vec_id % 37) / 37.0D").alias("quality"), F.col("label").cast("long").alias("cluster_id"), "embedding", F.lit(1).alias("assigned"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("cluster_id")).agg(F.count("*").alias("size"), F.max_by("vec_id", F.struct(F.expr("(vec_id % 37) / 37.0D"), -F.col("vec_id"))).alias("rep_face_id"))
    return rows.withColumns({"label": F.when(F.col("cluster_id") < 4, F.concat(F.lit("person"), F.col("cluster_id").cast("string"))), "pinned": (F.col("cluster_id") < 4).cast("int")})


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().unionByName(spark.createDataFrame([("unused",)], "name string"))
    return names.select(F.crc32(F.col("name").cast("binary")).alias("id"), "name", F.lit("user").alias("kind"))


def photo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("photo_id"), F.crc32(F.col("event_type").cast("binary")).alias("tag_id"), F.lit("rule").alias("source"), F.lit(1.0).alias("confidence"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("place_id"),
        F.col("n_name").alias("name"),
        F.lit("").alias("country"),
        (40.0 + F.col("n_nationkey")).alias("lat"),
        (F.col("n_nationkey") * 1.0).alias("lon"),
        (1000 * (F.col("n_nationkey") + 1)).cast("long").alias("population"),
        F.array(F.lower("n_name")).alias("keys"),
    )


#: The same views as common table expressions of DuckDB.
SQL = {
    "photos": """photos AS (SELECT event_id AS id, user_id, epoch(ts) AS sort_at, concat('/lib/', user_id % 20) AS dir,
 CASE WHEN event_id % 11 <> 0 THEN concat('cam', user_id % 4) END AS camera_model,
 CASE WHEN event_id % 5 <> 0 THEN 48.0E0 + (user_id % 40)*0.05E0 + ((event_id // 331) % 3)*0.6E0 END AS gps_lat,
 CASE WHEN event_id % 5 <> 0 THEN 2.0E0 + (user_id % 60)*0.05E0 END AS gps_lon,
 value/(value+50.0E0) AS quality, ((event_id*7919) % 1000)/1000.0E0 AS aesthetic, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS missing,
 640 + (event_id % 7)*160 AS width, 480 + (event_id % 5)*120 AS height, v.embedding AS embedding
 FROM events e LEFT JOIN embeddings v ON v.vec_id = e.event_id)""",
    "hashes": """medians AS (SELECT vec_id AS id, embedding, list_sort([x::DOUBLE for x in embedding]) AS s FROM embeddings),
bits AS (SELECT id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x, (s[32]+s[33])/2 AS m FROM medians),
wide AS (SELECT id, sum(CASE WHEN x > m THEN (1::HUGEINT << (64-k)::INT) ELSE 0::HUGEINT END)::HUGEINT AS u FROM bits GROUP BY id),
hashes AS (SELECT id, u, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS phash, embedding FROM wide JOIN medians USING (id))""",
    "ocr": "ocr AS (SELECT doc_id AS photo_id, text FROM documents)",
    "faces": "faces AS (SELECT vec_id AS face_id, vec_id % 100 AS photo_id, (vec_id % 37)/37.0E0 AS quality, label::BIGINT AS cluster_id, embedding FROM embeddings)",
    "clusters": """clusters AS (SELECT cluster_id, count(*) AS size, arg_max(face_id, [quality, -face_id]) AS rep_face_id,
 CASE WHEN cluster_id < 4 THEN concat('person', cluster_id) END AS label, CASE WHEN cluster_id < 4 THEN 1 ELSE 0 END AS pinned
 FROM (SELECT vec_id AS face_id, (vec_id % 37)/37.0E0 AS quality, label::BIGINT AS cluster_id FROM embeddings) GROUP BY cluster_id)""",
    "places": "places AS (SELECT n_nationkey::BIGINT AS place_id, n_name AS name, 40.0E0 + n_nationkey AS lat, n_nationkey*1.0E0 AS lon, 1000*(n_nationkey+1) AS population FROM nation)",
}


def sql(*names: str) -> str:
    """WITH and the views named."""
    return "WITH " + ",\n".join(SQL[n] for n in names)


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2)"
    return f"(CASE WHEN {h} IS NOT NULL THEN 12742.0E0*asin(least(1.0E0, sqrt({h}))) END)"


def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
