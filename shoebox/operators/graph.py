"""Graphs over items: connected components, Chinese Whispers, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import remove, scratch, stored
from .ordering import positions

#: Weights count in millionths, as whole numbers: sums don't depend on their order, and equal ones are equal.
WEIGHT_UNIT = 1_000_000
#: Fixed values of the turns: an odd multiplier near 2**32 over the golden ratio, and a step between rounds.
TURN_MULTIPLIER, TURN_STEP, TURN_NODES = 2_654_435_761, 7_919, 1 << 30


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst), component being the smallest node.

    Two star steps per round: every node links its larger neighbours, then its smaller ones, to the least node near
    it, until only stars are left. A step is an aggregate and a join on the node, so that no component is gathered; each round
    is written out, which keeps the plan short and survives lost executors.
    """
    root = scratch(edges.sparkSession)
    now = stored(edges.where("src <> dst").selectExpr("least(src, dst) AS a", "greatest(src, dst) AS b").distinct(), f"{root}/0")
    previous, k = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous, k = state, k + 1
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = stored(small.where("a <> b").distinct(), f"{root}/{k}")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def has_turn(node: Column, turn: int) -> Column:
    """Whether a node may change in a round: for about half of all nodes, other ones in each round."""
    mixed = (F.pmod(node.cast("long"), F.lit(TURN_NODES).cast("long")) + turn * TURN_STEP) * F.lit(TURN_MULTIPLIER).cast("long")
    return F.shiftright(mixed, 16).bitwiseAND(1) == 1


def chinese_whispers(nodes: DataFrame, edges: DataFrame, iterations: int = 20) -> DataFrame:
    """(node, label) for ``nodes`` (node) and ``edges`` (src, dst, weight); parallel links add their weights.

    Every node starts with its own label. In a round each node whose turn it is takes the label with the most weight
    around it; of equal ones it keeps its own, or takes the smallest. As neighbours rarely have the same turns, they
    don't go on swapping labels. It ends when no node would change, or after ``iterations`` rounds. A round is a join and
    two aggregates at any size; results depend on the links alone.
    """
    spark, root = edges.sparkSession, scratch(edges.sparkSession)
    weight = F.round(F.col("weight") * WEIGHT_UNIT).cast("long").alias("weight")
    links = edges.select("src", "dst", weight).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight))
    links = stored(links.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")), f"{root}/links")
    now = links.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for turn in range(iterations):
        near = links.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), F.col("label").alias("near")).agg(F.sum("weight").alias("weight"))
        votes = near.join(now, "node")
        best = votes.groupBy("node").agg(F.max_by("near", F.struct("weight", F.col("near") == F.col("label"), -F.col("near"))).alias("best"), F.first("label").alias("label"))
        best = stored(best, f"{root}/{turn}")
        now = best.select("node", F.when(has_turn(F.col("node"), turn), F.col("best")).otherwise(F.col("label")).alias("label"))
        if turn > 1:
            remove(spark, f"{root}/{turn - 2}")
        if not best.where("best <> label").limit(1).count():
            break
    rest = nodes.select("node").distinct().join(now, "node", "left_anti")
    return now.unionByName(rest.select("node", F.col("node").alias("label")))


def by_size(labels: DataFrame) -> DataFrame:
    """(node, cluster): clusters numbered from 0, the largest first, then the one with the smallest node."""
    sizes = labels.groupBy("label").agg((-F.count("*")).alias("size"), F.min("node").alias("least"))
    numbers = positions(sizes, "size", "least", name="cluster")
    return labels.join(numbers.select("label", "cluster"), "label").select("node", "cluster")
