"""Vector stores: append-only Parquet with a guard on model and dimension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered


class VectorStore:
    """(embed_row, embedding) in appended folders, with a header row of model and dimension."""

    def __init__(self, spark: SparkSession, root: str, model: str, dim: int):
        self.spark, self.root, self.model, self.dim = spark, root.rstrip("/"), model, dim
        try:
            header = spark.read.schema("model string, dim int").parquet(f"{self.root}/header").first()
        except AnalysisException:
            header = None
        if header is None:
            spark.createDataFrame([(model, dim)], "model string, dim int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/header")
        elif (header.model, header.dim) != (model, dim):
            raise ValueError(f"the store holds {header.model} with {header.dim} dimensions, not {model} with {dim}")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema("embed_row long, embedding array<float>").parquet(f"{self.root}/rows")
        except AnalysisException:
            return self.spark.createDataFrame([], "embed_row long, embedding array<float>")

    def rows(self, wanted: DataFrame) -> DataFrame:
        """The vectors of ``wanted`` (embed_row, and a position if the order matters)."""
        return wanted.join(self.read(), "embed_row")

    def append(self, vectors: DataFrame, key: str) -> DataFrame:
        """Stores (key, embedding) and gives (key, embed_row); ValueError for another number of dimensions."""
        if vectors.where((F.size("embedding") != self.dim) | F.col("embedding").isNull()).limit(1).count():
            raise ValueError(f"vectors need {self.dim} dimensions")
        base = self.read().agg(F.coalesce(F.max("embed_row") + 1, F.lit(0)).alias("base")).first().base
        rows = numbered(vectors, key).withColumn("embed_row", F.col("n") + base)
        path = f"{self.root}/rows"
        rows.select("embed_row", F.col("embedding").cast("array<float>").alias("embedding"), key).select("embed_row", "embedding").write.mode("append").parquet(path)
        return rows.select(key, "embed_row")
