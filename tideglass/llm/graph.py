"""Connected components as Spark jobs: large-star and small-star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, durable, fresh_path, owned, with_fact


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of every node to the smallest of its neighbourhood.

    Large-star moves the larger neighbours, small-star the smaller ones and the node itself.
    The minimum is a partial aggregate and the join's large side can be split, so that a node with
    very many links doesn't end in one task.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link to a node that has none itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; component is the smallest node reachable.

    Rows with a null end or with equal ends count for nothing; repeated and reversed rows count once.
    No edges: no rows. Each round is a table in the shared folder, which replaces the last one's, so no link is ever
    on the driver. Rounds go on until all links lead straight to their smallest node; their
    number grows with the square of the logarithm of the nodes at most.
    """
    made: list[str] = []

    def next_round(rows: DataFrame) -> DataFrame:
        made.append(fresh_path(rows.sparkSession))
        rows.write.parquet(made[-1])
        for path in made[:-1]:
            discard(rows.sparkSession, path)
        del made[:-1]
        return rows.sparkSession.read.schema(rows.schema).parquet(made[-1])

    edges = next_round(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(edges):
        edges = next_round(_star(_star(edges, large=True), large=False))
    owned(made[-1])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def least_reachable(near: DataFrame, owners: DataFrame) -> DataFrame:
    """``(node, least)``: for each node of ``near(node, component)`` the smallest ``owner`` of its component, by
    ``owners(node, owner)``, which has one row per node."""
    near = durable(near)
    least = durable(near.join(owners, "node").groupBy("component").agg(F.min("owner").alias("least"), F.count("*").alias("n")))
    return with_fact(near, least, ["component"], "n").select("node", "least")


class Thinner:
    """Links of one task's rows, thinned as they come to those of a spanning forest."""

    def __init__(self, rows: int):
        self.group = np.arange(rows)
        self.links: list[tuple[int, int]] = []

    def add(self, row: int, others: np.ndarray) -> None:
        labels, first = np.unique(self.group[others], return_index=True)
        fresh = labels != self.group[row]
        if fresh.any():
            self.links += [(row, x) for x in others[first[fresh]].tolist()]
            joined = np.r_[labels[fresh], self.group[row]]
            self.group[np.isin(self.group, joined)] = joined.min()
