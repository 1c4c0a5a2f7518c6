"""Approximate nearest neighbours by a stored inverted file: vectors by the cell of their nearest centre.

The centres are fitted on a bounded sample; every vector is indexed. A query is compared with the centres, and exactly
with the vectors of the nearest cells, which are stored sorted by cell, so that the scan leaves the others out. Adding
appends to the cells; an index whose size differs from its vectors is built again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import fit_centres, nearest

#: The centres are fitted on so many rows at most; cells number the square root of the rows, within these bounds.
SAMPLE_ROWS, LEAST_CELLS, MOST_CELLS = 20_000, 8, 4_096
ROWS = "id long, embedding array<float>, cell int"


class CellIndex:
    """An index in a folder: ``centres`` (one row), and runs of ``rows``, each sorted by cell."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        try:
            row = spark.read.schema("version long, centres array<array<double>>").parquet(f"{self.root}/centres").orderBy(F.desc("version")).first()
        except AnalysisException:
            row = None
        self.version = row.version if row else 0
        self.centres = np.array(row.centres, float) if row and row.centres else np.zeros((0, 0))

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROWS).parquet(f"{self.root}/rows/{self.version}")
        except AnalysisException:
            return self.spark.createDataFrame([], ROWS)

    def size(self) -> int:
        return self.rows().count()

    def build(self, vectors: DataFrame, sample: int = SAMPLE_ROWS) -> CellIndex:
        """Indexes all rows of (id, embedding) anew; those without a vector are left out."""
        rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        n = rows.count()
        taken = np.array([r.embedding for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], float)
        cells = max(LEAST_CELLS, min(MOST_CELLS, math.isqrt(n)))
        self.centres = fit_centres(taken, cells) if n else np.zeros((0, 0))
        self.version += 1
        if n:
            self._append(rows)
        header = [(self.version, self.centres.tolist())]
        self.spark.createDataFrame(header, "version long, centres array<array<double>>").coalesce(1).write.mode("append").parquet(f"{self.root}/centres")
        return self

    def _append(self, rows: DataFrame) -> None:
        centres = self.centres

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(cell=np.argmax(np.stack(b["embedding"].to_numpy()).astype(float) @ centres.T, axis=1).astype(np.int32))

        placed = rows.mapInPandas(place, ROWS)
        # The id takes part in the ranges, so that a large cell is several files.
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode("append").parquet(f"{self.root}/rows/{self.version}")

    def add(self, vectors: DataFrame) -> CellIndex:
        """Adds the rows whose id is new; the cells stay as they are. An empty index is built."""
        if not len(self.centres):
            return self.build(vectors)
        rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        self._append(rows.join(self.rows().select("id"), "id", "left_anti"))
        return self

    def sync(self, vectors: DataFrame) -> bool:
        """Builds the index again if its size differs from the table's; whether it did."""
        if self.size() == vectors.where(F.col("embedding").isNotNull()).count():
            return False
        self.build(vectors)
        return True

    def search(self, query: Sequence[float], k: int, allowed: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(id, score) of the k best of the nearest cells (a quarter of them, eight at least, unless ``probes`` is given), of
        ``allowed`` (id) only if that is given."""
        if not len(self.centres):
            return nearest(self.rows(), list(query), k)
        many = probes or max(8, len(self.centres) // 4)
        cells = np.argsort(-(self.centres @ np.asarray(query, float)), kind="stable")[:many].tolist()
        rows = self.rows().where(F.col("cell").isin(cells))
        if allowed is not None:
            rows = rows.join(allowed.select("id").distinct(), "id", "left_semi")
        return nearest(rows, list(query), k)
