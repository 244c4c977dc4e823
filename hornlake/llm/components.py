"""Connected components of a table of links, without gathering them anywhere.

Each task first replaces its links by a forest that connects the same nodes.  Then large stars and small stars
alternate until nothing changes: every node is linked to the smallest node it can reach.  All steps are joins and
aggregates on narrow rows; each round is written to the shared folder, and the tables that a join reads are written
before it, so that Spark can split a node with very many links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornlake.llm.shared import discard, prepare, settled


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) for all nodes but the smallest, by hooking and pointer jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        low, high = np.minimum(pu, pv), np.maximum(pu, pv)
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > 500_000:
            a, b = forest(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            held = []
    if held:
        a, b = forest(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in `edges`, whose columns a and b are longs, but the smallest ones."""
    prepare(edges.sparkSession)
    now = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_contracted, "a long, b long").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settled(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = settled(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).distinct()
        after = settled(small, "links")
        discard(now, least, large, lower)
        now, was, mark = after, mark, _mark(after)
        if mark == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
