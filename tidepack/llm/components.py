"""Connected components of an undirected graph, by alternating star contractions on a table of edges.

Contraction: each task joins up its own edges, PIECE at a time, and keeps an edge from each node to the smallest that it
reaches there. Large star: every node sends its larger neighbours to its smallest one. Small star: every node and its
smaller neighbours go to the smallest. Each star is a minimum by node (pre-aggregated before the shuffle) and a join
that can be split where a node has very many edges. Rounds go on until the table stays as it is. It is written in the
shared folder after each round, so a lost executor costs one round at most.

Repeated edges and edges from a node to itself change nothing. Without edges there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize

#: Edges that a task joins up at once (16 bytes each).
PIECE = 1 << 20


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, and for each the smallest node that it is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> pa.RecordBatch:
            node, label = labels(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
            some = node != label
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(label[some])], names=["u", "v"])

        for b in batches:
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(p[0]) for p in parts) >= PIECE:
                yield joined()
                parts = []
        if parts:
            yield joined()

    return map_arrow(edges.select("u", "v"), run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). One row per node: node, component, the smallest node it is connected with."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(_contracted(edges), "edges")
    measure = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before, state = None, measure(edges)
    while state.n and state != before:
        old, edges = edges, materialize(_contracted(_star(_star(edges, True), False)), "edges")
        discard(old)
        before, state = state, measure(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
