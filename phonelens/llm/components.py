"""Distributed union-find: connected components of an edge table.

Each task first contracts the edges it holds to a forest (numpy, in bounded
pieces).  What is left, if it fits one such piece (counted first), is
contracted once more and done; otherwise large-star and small-star steps
alternate, each a grouping and a join, until the edges are stars, and no task
sees a whole component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.llm.common import instead, stored, swept

PIECE_EDGES = 1_000_000  # a task contracts so many edges at a time


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for nodes that are not the least."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        u, v = forest(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        count += batch.num_rows
        if count >= PIECE_EDGES:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    out = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _is_forest_of_stars(e: DataFrame) -> bool:
    """No node has two parents, and no parent is a child."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with swept(e.sparkSession):
        return per_node.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count() == 0


def components(edges: DataFrame, piece: int = PIECE_EDGES) -> DataFrame:
    """(node, root) for every node that is not the least of its component.

    ``edges`` has two long columns; NULL ends and loops are ignored, repeated
    edges count once, no edge gives no row.  At most ``piece`` contracted edges
    (up to PIECE_EDGES, 16 MB) are one task's work: a step of stars is some ten
    stages of small tasks, whatever it holds.  A step's edges replace the step's before."""
    a, b = edges.columns
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = stored(e.mapInArrow(_contract, "u long, v long").distinct())
    if e.count() <= min(piece, PIECE_EDGES):
        e = instead(e, e.coalesce(1).mapInArrow(_contract, "u long, v long"))
    else:
        while not _is_forest_of_stars(e):
            e = instead(e, _small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
