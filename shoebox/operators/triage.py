"""Triage: ranking of photos inside scopes, collapse of near-duplicates, diversity selection, delete candidates.

A scope is any set of photos in an order: (scope_id, photo_id, scope_pos). All scopes run side by side; what depends
on the scope is never stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .vector import centroids

#: The weights of quality, aesthetic score, representativeness and subject, lambda, and whether the
#: worst are wanted.
PRESETS = {
    "story-ready": (0.25, 0.25, 0.30, 0.20, 0.6, False),
    "print-worthy": (0.35, 0.45, 0.10, 0.10, 0.85, False),
    "delete-candidates": (0.5, 0.2, 0.0, 0.0, 1.0, True),
}
STRENGTH, WEAKNESS, NAMED_BONUS, REDUNDANT = 0.66, 0.34, 0.6, 0.5


@dataclass(frozen=True)
class Preset:
    name: str
    quality: float
    aesthetic: float
    repr: float
    subject: float
    lam: float
    invert: bool


def get_preset(name: str | None = None) -> Preset:
    """The preset of a name, story-ready if none is given; KeyError for an unknown one."""
    name = name or "story-ready"
    return Preset(name, *PRESETS[name])


def scope_of_group(items: DataFrame, group_id: int) -> DataFrame:
    """A group's members by rank; LookupError if there are none."""
    rows = items.where(F.col("group_id") == group_id)
    if not rows.limit(1).count():
        raise LookupError(f"group {group_id} not found")
    w = Window.partitionBy("group_id").orderBy("rank", "photo_id")
    return rows.select(F.col("group_id").alias("scope_id"), "photo_id", (F.row_number().over(w) - 1).alias("scope_pos"))


def scope_of_range(photos: DataFrame, date_from: float | None = None, date_to: float | None = None) -> DataFrame:
    """Photos in a date range in timeline order; ValueError without any bound."""
    if date_from is None and date_to is None:
        raise ValueError("triage needs a group or a date range")
    rows = photos.where("missing = 0")
    if date_from is not None:
        rows = rows.where(F.col("sort_at") >= date_from)
    if date_to is not None:
        rows = rows.where(F.col("sort_at") <= date_to)
    w = Window.partitionBy("scope_id").orderBy("sort_at", "id")
    return rows.withColumn("scope_id", F.lit(0).cast("long")).select("scope_id", F.col("id").alias("photo_id"), (F.row_number().over(w) - 1).alias("scope_pos"))


def subject_scores(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """(photo_id, subject): the sum of the faces' quality, more for named people, at most 1."""
    named = F.coalesce(F.trim("label") != "", F.lit(False))
    rows = faces.join(clusters.select("cluster_id", "label"), "cluster_id", "left")
    part = F.coalesce("quality", F.lit(0.0)) * F.when(named, 1 + NAMED_BONUS).otherwise(1.0)
    return rows.groupBy("photo_id").agg(F.least(F.lit(1.0), F.sum(part)).alias("subject"))


def representativeness(rows: DataFrame) -> DataFrame:
    """Adds repr to (scope_id, ..., embedding): the cosine to the scope's centroid; the median where there is no vector,
    0 where the scope has none at all."""
    rows = rows.withColumn("__unit", fn.unit("embedding", 1e-12))
    middle = centroids(rows.withColumnRenamed("__unit", "__v"), ["scope_id"], "__v").select("scope_id", "centroid")
    rows = rows.join(middle, "scope_id", "left").withColumn("__cos", fn.dot("__unit", "centroid"))
    fill = rows.groupBy("scope_id").agg(F.median("__cos").alias("__fill"))
    return rows.join(fill, "scope_id").withColumn("repr", F.coalesce("__cos", "__fill", F.lit(0.0))).drop("__unit", "__cos", "__fill", "centroid")


def scores(scope: DataFrame, photos: DataFrame, subjects: DataFrame) -> DataFrame:
    """Scope rows with the four raw scores and their percentile ranks n_quality, n_aesthetic, n_repr, n_subject."""
    rows = scope.join(photos.select(F.col("id").alias("photo_id"), "quality", "aesthetic", "embedding"), "photo_id")
    rows = representativeness(rows).join(subjects, "photo_id", "left")
    rows = rows.withColumns({"quality": F.coalesce("quality", F.lit(0.0)), "aesthetic": F.coalesce("aesthetic", F.lit(0.0)), "subject": F.coalesce("subject", F.lit(0.0))})
    return rows.withColumns({f"n_{c}": fn.percentile_rank(c, ["scope_id"]) for c in ("quality", "aesthetic", "repr", "subject")})


def collapse_keys(rows: DataFrame, near_dups: DataFrame, bursts: DataFrame) -> DataFrame:
    """Adds kind and key: the near-duplicate group, else the burst, else the photo itself, and key_size in the scope."""
    rows = rows.join(near_dups.select("photo_id", F.col("group_id").alias("__nd")), "photo_id", "left")
    rows = rows.join(bursts.select("photo_id", F.col("group_id").alias("__b")), "photo_id", "left")
    kind = F.when(F.col("__nd").isNotNull(), "near_dup").when(F.col("__b").isNotNull(), "burst").otherwise("single")
    rows = rows.withColumns({"kind": kind, "key": F.coalesce("__nd", "__b", "photo_id")}).drop("__nd", "__b")
    return rows.withColumn("key_size", F.count("*").over(Window.partitionBy("scope_id", "kind", "key")))


def _first_in_key(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("scope_id", "kind", "key").orderBy(*order))


def base_score(preset: Preset) -> Column:
    return preset.quality * F.col("n_quality") + preset.aesthetic * F.col("n_aesthetic") + preset.repr * F.col("n_repr") + preset.subject * F.col("n_subject")


def collapse_best(rows: DataFrame, preset: Preset) -> DataFrame:
    """The best photo of each key by the preset's base score, equal ones by scope order; adds base and base_pos."""
    rows = rows.withColumn("base", base_score(preset))
    best = rows.withColumn("__n", _first_in_key([F.desc("base"), F.asc("scope_pos")])).where("__n = 1").drop("__n")
    # Among equal base scores the order is that in which the keys first come up in the scope.
    w = Window.partitionBy("scope_id", "kind", "key")
    best = best.join(rows.withColumn("__first", F.min("scope_pos").over(w)).select("scope_id", "photo_id", "__first"), ["scope_id", "photo_id"])
    return best.withColumn("base_pos", F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("base"), "__first")) - 1).drop("__first")


def keep_reason() -> Column:
    cases = [(F.col(f"n_{c}") >= STRENGTH, text) for c, text in (("quality", "sharp"), ("aesthetic", "vivid"), ("repr", "representative"), ("subject", "people"))]
    similar = (F.col("kind") != "single") & (F.col("key_size") > 1)
    return fn.reasons([*cases, (similar, F.concat(F.lit("best of "), F.col("key_size").cast("string"), F.lit(" similar")))], "solid overall")


def mmr_order(base: np.ndarray, vectors: list[np.ndarray | None], lam: float, limit: int) -> list[int]:
    """Greedy picks by lam * base - (1 - lam) * largest cosine to what is picked; equal values in the given order.

    A row without a vector is similar to nothing; cosines below zero count as they are.
    """
    n = len(base)
    has = np.array([v is not None for v in vectors], dtype=bool)
    width = next((len(v) for v in vectors if v is not None), 1)
    matrix = np.stack([np.asarray(v, float) if v is not None else np.zeros(width) for v in vectors]) if n else np.zeros((0, 1))
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    nearest = np.full(n, -np.inf)
    left, picked = np.ones(n, dtype=bool), []
    while left.any() and len(picked) < limit:
        sim = np.where(has & np.isfinite(nearest), nearest, 0.0)
        value = np.where(left, lam * base - (1 - lam) * sim, -np.inf)
        k = int(np.argmax(value))
        picked.append(k)
        left[k] = False
        if has[k]:
            nearest = np.maximum(nearest, matrix @ matrix[k])
    return picked


def _pick(rows: pd.DataFrame, lam: float, limit: int) -> pd.DataFrame:
    rows = rows.sort_values("base_pos")
    picked = mmr_order(rows["base"].to_numpy(), rows["embedding"].tolist(), lam, limit)
    return pd.DataFrame({"scope_id": rows["scope_id"].iloc[picked], "photo_id": rows["photo_id"].iloc[picked], "pick": range(len(picked))})


def mmr(best: DataFrame, preset: Preset, limit: int = 50) -> DataFrame:
    """(scope_id, photo_id, pick): diversity selection in each scope, out of collapse_best's rows."""
    need = best.select("scope_id", "photo_id", "base", "base_pos", "embedding")
    lam = preset.lam

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pick(rows, lam, limit)

    return need.groupBy("scope_id").applyInPandas(run, "scope_id long, photo_id long, pick long")


def delete_candidates(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Redundant photos (all but the sharpest of a key) and those of the lower half in quality, worst first.

    Adds score (badness, 6 digits), redundant, reason and pick. The score doesn't depend on the preset's weights.
    """
    keeper = _first_in_key([F.desc("n_quality"), F.asc("scope_pos")]) == 1
    rows = rows.withColumn("redundant", (F.col("kind") != "single") & ~keeper).where(F.col("redundant") | (F.col("n_quality") < 0.5))
    score = 0.5 * (1 - F.col("n_quality")) + 0.2 * (1 - F.col("n_aesthetic")) + F.when(F.col("redundant"), REDUNDANT).otherwise(0.0)
    reason = fn.reasons([(F.col("redundant"), "near-duplicate of a kept shot"), (F.col("n_quality") < WEAKNESS, "soft / low quality"), (F.col("n_aesthetic") < WEAKNESS, "flat")], "weaker than the kept frame")
    rows = rows.withColumns({"score": F.bround(score, 6), "reason": reason})
    rows = rows.withColumn("pick", F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("score"), "scope_pos")) - 1)
    return rows.where(F.col("pick") < limit) if limit is not None else rows


def triage(scope: DataFrame, photos: DataFrame, subjects: DataFrame, near_dups: DataFrame, bursts: DataFrame, preset: Preset | None = None, limit: int = 50) -> DataFrame:
    """The whole of it: (scope_id, pick, photo_id, score, quality, aesthetic, representativeness, subject, reason, redundant,
    scope_size, considered). ``considered`` counts photos after the collapse, for delete candidates after the limit."""
    preset = preset or get_preset()
    rows = collapse_keys(scores(scope, photos, subjects), near_dups, bursts).withColumn("scope_size", F.count("*").over(Window.partitionBy("scope_id")))
    of_scope = Window.partitionBy("scope_id")
    if preset.invert:
        out = delete_candidates(rows, limit).withColumn("considered", F.count("*").over(of_scope))
    else:
        best = collapse_best(rows, preset).withColumn("considered", F.count("*").over(of_scope))
        out = best.join(mmr(best, preset, limit), ["scope_id", "photo_id"]).withColumns({"score": F.bround("base", 6), "reason": keep_reason(), "redundant": F.lit(False)})
    six: Callable[[str], Column] = lambda c: F.bround(c, 6)
    return out.select("scope_id", F.col("pick").cast("long").alias("pick"), "photo_id", "score", six("n_quality").alias("quality"), six("n_aesthetic").alias("aesthetic"), six("n_repr").alias("representativeness"), six("n_subject").alias("subject"), "reason", "redundant", "scope_size", "considered")
