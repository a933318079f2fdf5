"""Connected components of links, on arrays within a task and on tables across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.session import materialize


def array_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is its component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), which end after a
    logarithmic number of rounds in practice, also on long chains. A step takes the least
    neighbour by an aggregate and hands it on by a join, so a node with many links is
    never gathered in one task. Each round is written, which cuts lineage.

    Self-links, repeated links and either direction are fine. No links: empty.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = _written(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        edges, after = _written(small)
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and a count and checksum that tell when they stay the same."""
    table = materialize(edges, "links")
    return table, tuple(table.agg(
        F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
