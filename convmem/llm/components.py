"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.llm.common import checkpoint

#: So many contracted edges, whatever the input's size, are joined by one task instead of further rounds.
FEW = 10_000


def _joined_at_once(edges: DataFrame) -> DataFrame:
    """(node, to) of few edges: nodes and the least of their component, by union-find in one task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in source:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = sorted((root(a), root(b)))
                up[y] = x
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), pa.array(map(root, up), pa.int64())], ["node", "to"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, to bigint")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the least node that can be reached.

    In every round a node joins the neighbour with the least hash, if that is less than its own,
    and edges are drawn between what they joined; each round at least halves an expected constant
    part of the nodes, whatever the graph's diameter. A node's neighbours are only ever reduced
    to a minimum, so a hub is aggregated before it is shuffled. Of no more than ``few`` edges that are
    left, one task makes the last round, which spares the driver many small plans.
    """
    edges = checkpoint(edges.where("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).distinct())
    joined: list[DataFrame] = []
    nodes = None
    turn = 0
    while n := edges.count():
        if n <= few:
            joined.append(checkpoint(_joined_at_once(edges)))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("n"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("least"))
        step = step.select("node", F.when(F.col("least") < order("node"), F.col("least.n")).otherwise(F.col("node")).alias("to"))
        step = checkpoint(step)
        joined.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = checkpoint(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
    if not joined:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # From the last round back to the first: a node's root is the root of what it joined.
    nodes = joined[-1].select("node", F.col("to").alias("root"))
    for step in reversed(joined[:-1]):
        last = nodes.select(F.col("node").alias("to"), F.col("root").alias("final"))
        nodes = step.join(last, "to", "left").select("node", F.coalesce("final", "to").alias("root"))
    nodes = checkpoint(nodes)
    least = checkpoint(nodes.groupBy("root").agg(F.min("node").alias("component")))
    # Roots are hubs: the join is left to adaptive execution, which splits the skewed side.
    return nodes.join(least, "root").select("node", "component")
