"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many contracted edges, whatever the input's size, are joined by one task instead of further rounds.
FEW = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints and intermediate tables."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = f"/tmp/checkpoints/{context.applicationId}"  # one machine, as in tests
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _joined_at_once(edges: DataFrame) -> DataFrame:
    """(node, to) of few edges: nodes and the least of their component, by union-find in one task."""
    kind = dict(edges.dtypes)["a"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in source:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = sorted((root(a), root(b)))
                up[y] = x
            of = batch.schema.field("a").type
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(up, of), pa.array(map(root, up), of)], ["node", "to"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component): the least node that can be reached from each node of ``edges`` (a, b).

    The graph is contracted: in each round every node joins the one of itself and its neighbours
    that a hash of the round puts first, and edges are carried over to what their ends have joined.
    So the edges that are left get fewer by a share in every round, however long a chain is. Of no
    more than ``few`` that are left, one task makes the last round.
    """
    left = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    names, turn = None, 0
    while names is None or not left.isEmpty():
        last = left.count() <= few
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = checkpoint(_joined_at_once(left) if last else both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.min(order("a")))["to"].alias("to")))
        names = joined if names is None else checkpoint(names.join(joined.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", "left").select("node", F.coalesce("then", "to").alias("to")))
        if last:
            break
        for end in ("a", "b"):
            left = left.join(joined.select(F.col("node").alias(end), F.col("to").alias(f"{end}_")), end)
        left = checkpoint(left.select(F.col("a_").alias("a"), F.col("b_").alias("b")).where("a <> b").distinct())
        turn += 1
    least = names.groupBy("to").agg(F.min("node").alias("component"))
    return names.join(least, "to").select("node", "component")
