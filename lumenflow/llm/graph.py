"""Connected components of a large sparse graph, by contraction in DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task folds into a forest at a time, and up to which what is left of a graph is finished in one task (8 MB).
FOLDED = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (up := low[low]).tobytes() != low.tobytes():
            low = up
        x, y = low[x], low[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[low]


def _folded(size: int, loops: bool):
    """Edges a, b to edges from each node to the smallest that it is connected with among `size` edges of its task; loops: also from that to itself."""

    def fold(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, low = forest(*(np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1)))
        keep = slice(None) if loops else node != low
        return pa.RecordBatch.from_arrays([pa.array(node[keep], pa.int64()), pa.array(low[keep], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for p in batches:
            parts.append(p)
            if not loops and sum(map(len, parts)) >= size:
                yield fold(parts)
                parts = []
        if parts:
            yield fold(parts)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that it is connected with) for every node of edges.

    Tasks first fold the edges that they hold into forests, which have no more edges
    than nodes. While more than FOLDED edges are left, each round every node joins the
    neighbour that comes first in an order drawn anew for the round, itself included;
    merged nodes become one, and edges inside them go. A constant share of the nodes
    goes each round whatever the graph's shape, so the rounds grow with the logarithm
    of its size. What is left then is of bounded size and finished in one task, in
    place of as many rounds again that are hardly more than their jobs. A node with
    very many edges costs no more than its edges: they are folded before each shuffle,
    and joins on it can be split. Null ends and loops are ignored; no edges give no rows.
    """
    size = FOLDED
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = stored(edges.mapInArrow(_folded(size, False), "a long, b long"), "edges")
    levels: list[DataFrame] = []
    while edges.count() > size:
        first = lambda c: F.struct(F.xxhash64(c, F.lit(len(levels))).alias("h"), F.col(c).alias("n"))
        ends = edges.select(F.col("a").alias("node"), first("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), first("a").alias("to")))
        level = stored(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(F.col("to"), first("node"))["n"].alias("parent")), "level")
        levels.append(level)
        up = edges.join(level.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(level.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        edges = stored(up.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).where("a <> b").distinct(), "edges")
    rest = edges.coalesce(1).mapInArrow(_folded(size, True), "a long, b long")
    if not levels:
        return stored(rest.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    top = stored(rest.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    for level in levels[::-1]:
        above = top.select(F.col("node").alias("parent"), F.col("root"))
        top = stored(level.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")), "roots")
    lowest = stored(top.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component")), "lowest")
    return stored(top.join(lowest, "root").select("node", "component"), "components")


def extended(known: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """components() of a graph whose components are known, with more edges: only edges between different components are gone through.

    known(node, component), where a component is named by its smallest node; so is the result.
    """
    of = lambda end, name: known.select(F.col("node").alias(end), F.col("component").alias(name))
    lifted = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    lifted = stored(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "between")
    if not lifted.take(1):
        return known
    up = components(lifted)
    old = known.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = up.join(known.select("node"), "node", "left_anti").select("node", "component")
    return stored(old.unionByName(new), "components")
