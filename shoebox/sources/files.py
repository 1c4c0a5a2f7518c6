"""Files as tables: scans of image folders, decoded images, the gazetteer."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, IMAGE_EXTENSIONS
from ..functions import scalars as fn


def scan_images(spark: SparkSession, roots: list[str], with_content: bool = False) -> DataFrame:
    """(path, dir, filename, ext, size_bytes, mtime) of the images below the roots; names that begin with a dot are left
    out, and so are roots that don't exist. Contents are read only if asked for."""
    found = []
    for root in roots:
        try:
            found.append(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
        except AnalysisException:
            continue
    columns = ["path", "dir", "filename", "ext", "size_bytes", "mtime"] + ["content"] * with_content
    if not found:
        return spark.createDataFrame([], "path string, dir string, filename string, ext string, size_bytes long, mtime double" + ", content binary" * with_content)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = rows.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    rows = rows.withColumns({"dir": fn.folder("path"), "filename": fn.filename("path"), "ext": fn.extension("path"), "size_bytes": F.col("length"), "mtime": fn.epoch("modificationTime")})
    return rows.where(F.col("ext").isin(*IMAGE_EXTENSIONS) & ~F.col("path").rlike(r"/\.")).select(columns)


def _origin() -> Column:
    """The image source gives its files' names as URIs."""
    return F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of decoded images, BGR; files that can't be decoded aren't there."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    return rows.where("height > 0").select(_origin().alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a bounded list of paths that are there, in a form that readers take literally."""
    out = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            out.append(re.sub(r"([\\*?\[\]{}])", r"\\\1", path))
    return out


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of a bounded list of files; those that are gone aren't there."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "path string, content binary")
    rows = spark.read.format("binaryFile").load(found)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")


def read_image_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """read_images of a bounded list of files."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "path string, height int, width int, channels int, data binary")
    rows = spark.read.format("image").load(found).select("image.*").where("height > 0")
    return rows.select(F.regexp_replace(_origin(), "^file:/*", "/").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def read_gazetteer(cities: DataFrame, min_population: int = DEFAULTS.min_population) -> DataFrame:
    """Places with their lower-case names: the main name and those alternate ones that are plain ASCII.

    ``cities``: place_id, name, country, lat, lon, population, alternates (array).
    """
    plain = F.filter(F.coalesce("alternates", F.array().cast("array<string>")), lambda a: a.rlike(r"^[\x00-\x7F]+$"))
    keys = F.array_distinct(F.transform(F.concat(F.array("name"), plain), lambda n: F.lower(F.trim(n))))
    return cities.where(F.col("population") >= min_population).withColumn("keys", F.filter(keys, lambda k: k != "")).drop("alternates")


def place_names(places: DataFrame) -> DataFrame:
    """(key, place_id): one row per name."""
    return places.select(F.explode("keys").alias("key"), "place_id")
