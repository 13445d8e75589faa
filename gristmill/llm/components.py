"""Connected components of an edge table: union-find within partitions, then stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import durable

#: Edges (16 bytes each) that one task may settle; beyond it, rounds over the whole table.
ONE_TASK = 1_000_000
#: Edges that are gathered before they are reduced to a forest.
GATHER = 1_000_000
EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of all nodes of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        live = x != y
        u, v, x, y = u[live], v[live], x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return nodes, nodes[label]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, least node) with the same components; a partition of n nodes gives n - 1 at most for each ``GATHER`` edges."""
    a, b, fresh = [], [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        node, least = forest(np.concatenate(a), np.concatenate(b))
        return node[node != least], least[node != least]

    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
        fresh += x.num_rows
        if fresh >= GATHER:
            one, two = reduced()
            if len(one) >= GATHER:  # a forest of its own: let it go, so that memory stays bounded
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])
                one, two = one[:0], two[:0]
            a, b, fresh = [one], [two], 0
    if a:
        one, two = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large) or smaller (small) neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        linked = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = around.join(least, "a").select("b", "a", "m")
        linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge in ``edges(a, b)``.

    Nulls and loops in edges are dropped. Partitions are reduced to forests first, so that hot nodes and dense groups
    shrink before any shuffle. If what is left is few edges (counted), one task settles it; else alternating large-star
    and small-star rounds do, each checkpointed and counted in the same job, until a round changes nothing.
    """
    e = durable(edges.where("a <> b").select("a", "b").mapInArrow(contracted, EDGES))
    if e.count() <= one_task:
        e = durable(e.repartition(1).mapInArrow(contracted, EDGES))
        return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last = None
    for _ in range(rounds):
        e = durable(_star(_star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = tuple(now)
    raise RuntimeError("components did not settle")
