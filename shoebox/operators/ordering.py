"""Positions, previous rows and running sums along an order, also without any partition key.

With partition keys these are window functions. Without, one window would put the whole table into one task; here the
rows are cut into ranges of (key, tie) and stored with the number of their range, each range is a window partition, and
what comes from the ranges before is added from a table with one row per range. There are as many ranges as the session
has shuffle partitions, which is set by the size of the data; the tie takes part in the cut, so that many rows with one
key are several ranges too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def with_range(df: DataFrame, key: str, tie: str, ranges: int | None = None) -> DataFrame:
    """The stored rows with __range: the number of their range in the order of (key, tie); null keys come first."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *_order(key, tie)).withColumn("__range", F.spark_partition_id()))


def _order(key: str, tie: str) -> list[Column]:
    return [F.col(key).asc_nulls_first(), F.col(tie).asc()]


def positions(df: DataFrame, key: str, tie: str, by: list[str] | None = None, name: str = "pos", ranges: int | None = None) -> DataFrame:
    """Adds the place (from 0) in the order of (key, tie), inside ``by`` if given."""
    if by:
        w = Window.partitionBy(*by).orderBy(*_order(key, tie))
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    rows = with_range(df, key, tie, ranges)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("__range").orderBy(*_order(key, tie))
    rows = rows.withColumn("__k", F.row_number().over(w) - 1).join(F.broadcast(before.select("__range", "__before")), "__range")
    return rows.withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__range", "__k", "__before")


def with_previous(df: DataFrame, columns: list[str], key: str, tie: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds prev_<column> for each column, and has_prev."""
    row = F.struct(*columns)
    if by:
        w = Window.partitionBy(*by).orderBy(*_order(key, tie))
        rows = df.withColumn("__prev", F.lag(row).over(w))
    else:
        rows = with_range(df, key, tie, ranges)
        last = rows.groupBy("__range").agg(F.max_by(row, F.struct(F.col(key).isNotNull(), key, tie)).alias("__last"))
        last = last.withColumn("__carry", F.lag("__last").over(Window.orderBy("__range"))).select("__range", "__carry")
        w = Window.partitionBy("__range").orderBy(*_order(key, tie))
        rows = rows.withColumn("__prev", F.lag(row).over(w)).join(F.broadcast(last), "__range").withColumn("__prev", F.coalesce("__prev", "__carry")).drop("__range", "__carry")
    for c in columns:
        rows = rows.withColumn(f"prev_{c}", F.col(f"__prev.{c}"))
    return rows.withColumn("has_prev", F.col("__prev").isNotNull()).drop("__prev")


def running_sum(df: DataFrame, value: str, key: str, tie: str, by: list[str] | None = None, name: str = "running", ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row."""
    if by:
        w = Window.partitionBy(*by).orderBy(*_order(key, tie)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    rows = with_range(df, key, tie, ranges)
    sums = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("__range").orderBy(*_order(key, tie)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum(value).over(w)).join(F.broadcast(before.select("__range", "__before")), "__range")
    return rows.withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")
