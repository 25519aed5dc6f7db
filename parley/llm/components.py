"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of some edges that
    are not themselves the smallest: at most one row a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a = b = np.zeros(0, dtype=np.int64)
    for pdf in frames:
        a, b = forest(np.concatenate([a, pdf["u"].to_numpy()]), np.concatenate([b, pdf["v"].to_numpy()]))
        if len(a) >= 2_000_000:  # hand on what fills the memory and start anew
            yield pd.DataFrame({"u": a, "v": b})
            a = b = np.zeros(0, dtype=np.int64)
    yield pd.DataFrame({"u": a, "v": b})


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u long, v long)``: the smallest
    node of its component.

    Each partition first contracts its edges to a forest. Then alternate
    large-star and small-star rounds, each an aggregate and a join, hang every
    node on its smallest neighbour until nothing changes; a round's edges are
    written to the shared folder. The number of rounds is logarithmic, and the
    edges never outnumber those of the round before.
    """
    e = written(edges.mapInPandas(_contracted, "u long, v long").where("u <> v").distinct(), "cc")
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Every edge now points down; hang a node's lower neighbours on their least.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = written(small.toDF("u", "v").where("u <> v").distinct(), "cc")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
