"""Connected components of an edge table of any size, without collecting it.

Each round gives every node a priority, lets it point to the neighbour (or itself) of the least priority, follows the
pointers twice, and contracts the edges to the nodes pointed to. Priorities are the ids in even rounds, which contract
stars around least ids at once, and pseudo-random in odd rounds, which halve chains of any order. Rounds are written to
the shared folder; only row counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """edges: a, b long (any direction, repeats and loops allowed). Returns node, root long for every node of a real
    edge; nodes have equal roots exactly if they are connected. Which node is the root is not specified."""
    spark = scratch.spark
    left = scratch.write(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    labels = None
    for k in range(most_rounds):
        if left.isEmpty():
            break
        rank = lambda c: F.struct((F.xxhash64(F.lit(k), F.col(c)) if k % 2 else F.lit(0)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min(rank("b")), rank("a"))["v"].alias("to"))
        point = scratch.write(low.select(F.col("a").alias("node"), "to"), f"point{k}")
        jump = point.alias("p").join(point.alias("q"), F.col("p.to") == F.col("q.node")).select(F.col("p.node").alias("node"), F.col("q.to").alias("to"))
        point = scratch.write(jump, f"jump{k}")
        moved = left.join(point.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        left = scratch.write(moved.where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges{k + 1}")
        if labels is None:
            labels = point.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(point.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        labels = scratch.write(labels, f"labels{k}")
    else:
        raise RuntimeError("components: rounds ran out")
    return spark.createDataFrame([], "node long, root long") if labels is None else labels
