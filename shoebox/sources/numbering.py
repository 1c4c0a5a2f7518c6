"""Consecutive numbers for rows, without sending all of them through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def numbered(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Adds numbers from 0, in the order of a hash of ``key`` and then the key: counts per part, then numbers inside."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    rows = rows.withColumn("__k", inside).join(F.broadcast(before.select("__part", "__before")), "__part")
    return rows.withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__part", "__before", "__k")
