"""Search: filters, places, date phrases, semantic and full-text hits, and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scalars as fn
from ..sources.storage import stored
from .dates import parse_dates
from .relational import clamp_limit
from .text import bm25
from .vector import semantic_search


def geocode(places: DataFrame, name: str) -> DataFrame:
    """The place of a name, or of its part before a comma, with the most inhabitants; at most one row.

    ``places``: place_id, name, country, lat, lon, population, keys (its lower-case names).
    """
    key = name.strip().lower()
    head = key.split(",")[0].strip()
    hits = places.where(F.arrays_overlap("keys", F.array(F.lit(key), F.lit(head)))) if key else places.where("false")
    exact = F.array_contains("keys", key)
    return hits.orderBy(F.desc(exact), F.desc("population"), "place_id").limit(1).select("place_id", "name", "country", "lat", "lon", "population")


#: Cell sizes in degrees of the passes of reverse_geocode, each for what the one before couldn't settle.
GEO_CELLS = (1, 6, 30)
GEO_SHARDS = 64


def _nearest(points: DataFrame, places: DataFrame, on: list[str]) -> DataFrame:
    rows = points.join(places, on).withColumn("km", fn.haversine_km("gps_lat", "gps_lon", "lat", "lon"))
    return rows.groupBy("gps_lat", "gps_lon").agg(F.min(F.struct("km", "place_id", "name")).alias("b"))


def _in_cells(points: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """The nearest place in a point's own cell and the eight around it; ``sure`` where nothing beyond can be nearer."""
    across = 360 // size
    row, column = (F.floor((F.col(name) + half) / size).cast("int") for name, half in (("gps_lat", 90), ("gps_lon", 180)))
    own = points.withColumns({"__row": row, "__column": F.pmod(column, F.lit(across))})
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in sorted({k % across for k in (-1, 0, 1)})))
    row, column = (F.floor((F.col(name) + half) / size).cast("int") for name, half in (("lat", 90), ("lon", 180)))
    around = places.withColumn("__step", F.explode(steps)).withColumns({"__row": row + F.col("__step.i"), "__column": F.pmod(column + F.col("__step.j"), F.lit(across))})
    found = points.join(_nearest(own, around.drop("__step"), ["__row", "__column"]), ["gps_lat", "gps_lon"], "left")
    # At least a whole cell lies between the point and what was left out: along the meridian, or across meridians.
    edge = fn.EARTH_KM * F.least(F.lit(float(size)) * 3.141592653589793 / 180, F.asin(F.cos(F.radians("gps_lat")) * F.sin(F.radians(F.lit(float(size))))))
    return found.withColumn("sure", F.coalesce(F.col("b.km") <= edge - 1e-6, F.lit(False)))


def reverse_geocode(photos: DataFrame, places: DataFrame, cells: tuple[int, ...] = GEO_CELLS) -> DataFrame:
    """(id, place_id, name, km): the nearest place of every photo with coordinates, exactly; of equal ones the smallest id.

    Distinct coordinates are joined with the places by grid cells, with larger cells for those whose nearest place may
    lie outside of the cells around them. What is left by the largest cells (points near the poles, or far from every
    place) is dealt into shards that each meet all places.
    """
    spots = photos.where("gps_lat IS NOT NULL AND gps_lon IS NOT NULL")
    points = spots.select("gps_lat", "gps_lon").distinct()
    places = places.select("place_id", "name", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL")
    done = []
    for size in cells:
        found = stored(_in_cells(points, places, size))
        done.append(found.where("sure").select("gps_lat", "gps_lon", "b"))
        points = found.where("NOT sure").select("gps_lat", "gps_lon")
    if points.limit(1).count():
        shard = F.pmod(F.xxhash64("gps_lat", "gps_lon"), F.lit(GEO_SHARDS)).cast("int")
        everywhere = places.withColumn("__shard", F.explode(F.sequence(F.lit(0), F.lit(GEO_SHARDS - 1))))
        done.append(_nearest(points.withColumn("__shard", shard), everywhere, ["__shard"]))
    best = reduce(DataFrame.unionByName, done)
    return spots.select("id", "gps_lat", "gps_lon").join(best, ["gps_lat", "gps_lon"]).select("id", "b.place_id", "b.name", "b.km")


@dataclass(frozen=True)
class Filters:
    folder: str | None = None
    date_from: float | None = None
    date_to: float | None = None
    place: str | None = None
    near_photo: int | None = None
    radius_km: float | None = None
    has_text: bool = False


def build_candidates(photos: DataFrame, folder: str | None = None, date_from: float | None = None, date_to: float | None = None, center: tuple[float, float] | None = None, radius_km: float | None = None) -> DataFrame | None:
    """(id) of the photos that pass the filters; None if there is no filter."""
    tests = []
    if folder:
        tests.append(F.col("dir") == folder)
    if date_from is not None:
        tests.append(F.col("sort_at") >= date_from)
    if date_to is not None:
        tests.append(F.col("sort_at") <= date_to)
    if center is not None:
        tests.append(fn.within("gps_lat", "gps_lon", center, radius_km or DEFAULTS.radius_km))
    if not tests:
        return None
    rows = photos.where("missing = 0")
    for t in tests:
        rows = rows.where(t)
    return rows.select("id")


def rrf(rankings: Sequence[DataFrame], k: int = DEFAULTS.rrf_k) -> DataFrame:
    """(id, score): the sum over rankings (id, rank from 0) of 1 / (k + rank + 1). Equal scores: the better rank in the
    first ranking, then in the next, then the id."""
    rows = [r.select("id", F.lit(n).alias("list"), F.col("rank").cast("long").alias("rank")) for n, r in enumerate(rankings)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n}") for n in range(len(rankings))]
    fused = every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"), *ranks)
    return fused.orderBy(F.desc("score"), *(F.asc_nulls_last(f"rank_{n}") for n in range(len(rankings))), "id")


def ranked(hits: DataFrame, *order) -> DataFrame:
    """Adds rank from 0 to a short list of hits; the list is bounded by the search limit."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


@dataclass
class SearchResult:
    tier: str
    hits: DataFrame
    cleaned_query: str = ""
    label: str | None = None
    place_error: str | None = None
    place: object = None
    date_range: tuple[float | None, float | None] = field(default=(None, None))


class SearchEngine:
    """Searches over photos (id, dir, sort_at, gps_lat, gps_lon, missing, embedding), ocr (photo_id, text) and places.

    ``embed`` gives the vector of a text.
    """

    def __init__(self, photos: DataFrame, ocr: DataFrame, places: DataFrame | None = None, embed: Callable[[str], Sequence[float]] | None = None):
        self.photos, self.ocr, self.places, self.embed = photos, ocr, places, embed

    def _center(self, filters: Filters) -> tuple[tuple[float, float] | None, object, str | None]:
        if filters.near_photo is not None:
            row = self.photos.where(F.col("id") == filters.near_photo).select("gps_lat", "gps_lon").first()
            if row is None or row[0] is None or row[1] is None:
                return None, None, "that photo has no location"
            return (row[0], row[1]), None, None
        if filters.place:
            row = geocode(self.places, filters.place).first() if self.places is not None else None
            return ((row.lat, row.lon), row, None) if row else (None, None, f"unknown place: {filters.place}")
        return None, None, None

    def search(self, query: str = "", filters: Filters = Filters(), limit: int = 50, now: datetime | None = None) -> SearchResult:
        """Dates in the query are a filter, explicit bounds go first; a place that isn't found is none. ValueError for a
        blank query without any filter.

        With words left: the semantic hits, fused with full-text hits if there are any; without: the newest first.
        """
        limit = clamp_limit(limit)
        parsed = parse_dates(query, now)
        date_from = filters.date_from if filters.date_from is not None else parsed.date_from
        date_to = filters.date_to if filters.date_to is not None else parsed.date_to
        label = parsed.label if filters.date_from is None else None
        center, place, error = self._center(filters)
        candidates = build_candidates(self.photos, filters.folder, date_from, date_to, center, filters.radius_km)
        if filters.has_text:
            with_text = self.ocr.where(F.trim("text") != "").select(F.col("photo_id").alias("id")).distinct()
            candidates = with_text if candidates is None else candidates.join(with_text, "id", "left_semi")
        told = {"cleaned_query": parsed.cleaned_query, "label": label, "place_error": error, "place": place, "date_range": (date_from, date_to)}
        if not parsed.cleaned_query:
            if candidates is None:
                raise ValueError("nothing to search for")
            newest = F.coalesce("sort_at", F.lit(0.0))
            hits = self.photos.join(candidates, "id", "left_semi").orderBy(F.desc(newest), F.desc("id")).limit(limit)
            return SearchResult("filter", ranked(hits.select("id", newest.alias("score"), "sort_at"), F.desc(newest), F.desc("id")).select("id", "score", "rank"), **told)
        tier, semantic = semantic_search(self.photos.select("id", "embedding"), self.embed(parsed.cleaned_query), limit, candidates)
        semantic = ranked(semantic, F.desc("score"), "id")
        text = bm25(self.ocr, parsed.cleaned_query, limit * 5).select(F.col("photo_id").alias("id"), F.col("score").alias("bm25"))
        if candidates is not None:  # after the limit
            text = text.join(candidates, "id", "left_semi")
        if not text.limit(1).count():
            return SearchResult(tier, semantic, **told)
        fused = rrf([semantic, ranked(text, "bm25", "id")]).limit(limit)
        order = (F.desc("score"), F.asc_nulls_last("rank_0"), F.asc_nulls_last("rank_1"), "id")
        return SearchResult("fused", ranked(fused, *order).select("id", "score", "rank"), **told)
