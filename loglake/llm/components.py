"""Connected components of an edge table, by repeated contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import materialise, tidy

FOREST_EDGES = 1_000_000
LAST_EDGES = 500_000
EDGES = "u long, v long"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) of as many stars as (u, v) has components; the root is the least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(up := new[new], new):
            new = up
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[far]], nodes[far]


def thinned(edges: DataFrame) -> DataFrame:
    """Edges with the same components, at most one for each node and block of FOREST_EDGES edges of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out():
            u, v = forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += len(b)
            if n >= FOREST_EDGES:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return edges.select("u", "v").mapInArrow(tidy(run), EDGES)


def components(edges: DataFrame, rounds: int = 60, last: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node of edges (u long, v long): the component is one of its nodes.

    Each round every node joins the neighbour (or itself) that comes first in a fresh random order; edges are then
    relabelled, thinned to forests and written. The joins of a node to its neighbour are aggregated before they are
    shuffled, so a hub costs no task more than others. Rounds go with the logarithm of the number of nodes, until at most
    `last` edges are left, which one task finishes: a fixed number of rows of two numbers, whatever the input.
    """
    maps = []
    left = materialise(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")), "edges")
    for i in range(rounds):
        size = left.count()
        if not size:
            break
        if size <= last:
            stars = materialise(thinned(left.coalesce(1)), "stars")
            maps.append(stars.select(F.col("v").alias("node"), F.col("u").alias("up")).union(stars.select("u", "u").distinct()))
            break
        both = left.union(left.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        step = both.groupBy(F.col("u").alias("node")).agg(F.min(rank("v")).alias("best"))
        step = step.select("node", F.least(F.col("best"), rank("node"))["id"].alias("up"))
        step = materialise(step, "step")
        maps.append(step)
        a, b = step.select(F.col("node").alias("u"), F.col("up").alias("a")), step.select(F.col("node").alias("v"), F.col("up").alias("b"))
        moved = left.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        left = materialise(thinned(moved), "edges")
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[-1].select("node", F.col("up").alias("component"))
    for step in reversed(maps[:-1]):  # a label of an earlier round is a node of the next, or is final
        later = out.select(F.col("node").alias("up"), F.col("component").alias("last"))
        out = step.join(later, "up", "left").select("node", F.coalesce("last", "up").alias("component"))
    return out
