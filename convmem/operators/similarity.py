"""Similarity joins over token sets and vectors, and what is made of their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convmem.operators import setjoin
from convmem.operators.graph import checkpoint, components


def _words(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


def set_classes(rows: DataFrame, block: str, key: str, tokens: Column, *more: str) -> DataFrame:
    """(block, key, rep, size, further columns): every row, the least key of those with an equal set, which stands for it in the pairs, and the set's size.

    Sets meet by digests, so no set is sent. tokens: words without blanks.
    """
    sets = rows.select(F.col(block).alias("block"), F.col(key).alias("key"), F.size(tokens).alias("size"), F.unhex(F.md5(_words(tokens))).alias("digest"), *more).where("size > 0")
    sets = checkpoint(sets)
    reps = sets.groupBy("block", "digest").agg(F.min("key").alias("rep"))
    return sets.join(reps, ["block", "digest"]).select("block", "key", "rep", "size", *more)


def set_similarity_pairs(rows: DataFrame, block: str, key: str, tokens: Column, least: float, classes: DataFrame | None = None, forest: bool = False) -> DataFrame:
    """(block, a, b, similarity) of pairs a < b of a block with Jaccard similarity of at least ``least``, tile by tile, see ``setjoin.similar_sets``.

    Equal sets are one row, called by their least key, so copies do not multiply. Keys are unique in a block. ``classes``: what ``set_classes`` gives of the same rows, where it is there.
    """
    classes = set_classes(rows, block, key, tokens) if classes is None else classes
    sizes = checkpoint(classes.where(F.col("key") == F.col("rep")).select("block", F.col("key").alias("set_id"), "size"))
    texts = rows.select(F.col(block).alias("block"), F.col(key).alias("set_id"), _words(tokens).alias("words"))
    return setjoin.similar_sets(sizes, texts, least, forest)


def clusters(classes: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """(block, cluster, key, size, oversized): connected rows, without those that stand alone."""
    roots = components(pairs.select("a", "b")).select(F.col("node").alias("rep"), "component")
    rows = classes.join(roots, "rep", "left").select("block", "key", F.coalesce("component", "rep").alias("cluster"))
    sizes = rows.groupBy("block", "cluster").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, ["block", "cluster"]).select("block", "cluster", "key", "size", (F.col("size") > most).alias("oversized"))


def vector_pairs(vectors: DataFrame, scope: str, key: str, vector: str, least: float, bits: int = 0, rows_per_tile: int = 2048) -> DataFrame:
    """(scope, a, b, cosine) of all pairs a < b of a scope with at least that cosine, exactly, by tiles.

    A scope's vectors are dealt to tiles; a task multiplies one pair of tiles, so its memory is
    bounded and a large scope is many tasks.
    """
    sizes = vectors.groupBy(scope).agg(F.count("*").alias("_n"))
    tiled = vectors.join(sizes, scope).withColumn("_k", F.ceil(F.col("_n") / rows_per_tile).cast("int"))
    tiled = tiled.select(F.col(scope).alias("scope"), F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v"), "_k", F.pmod(F.xxhash64(key), F.col("_k")).cast("int").alias("tile"))
    others = F.sequence(F.lit(0), F.col("_k") - 1)
    dealt = tiled.select("scope", "key", "v", "tile", F.explode(others).alias("other"))
    dealt = dealt.select("scope", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "key", "v")

    def multiply(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        keys, tile = table.column("key").to_numpy(), table.column("tile").to_numpy()
        flat = table.column("v").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        m = np.asarray(flat.flatten(), float).reshape(len(keys), -1)
        norm = np.sqrt((m * m).sum(1))
        m = m / np.where(norm > 0, norm, 1)[:, None]
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        p, q = np.nonzero(m[a] @ m[b].T >= least - 1e-12)
        p, q = a[p], b[q]
        keep = (keys[p] < keys[q]) | ((i != j) & (keys[p] != keys[q]))
        p, q = p[keep], q[keep]
        c = np.einsum("ij,ij->i", m[p], m[q])
        lo, hi = np.minimum(keys[p], keys[q]), np.maximum(keys[p], keys[q])
        scope = table.column("scope")[0].as_py()
        return pa.table({"scope": pa.array([scope] * len(p), table.schema.field("scope").type), "a": pa.array(lo, pa.int64()), "b": pa.array(hi, pa.int64()), "cosine": pa.array(c, pa.float64())})

    kind = dict(tiled.dtypes)["scope"]
    return dealt.groupBy("scope", "i", "j").applyInArrow(multiply, f"scope {kind}, a bigint, b bigint, cosine double")


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the mean of a group's vectors, position by position."""
    spread = rows.select(group, F.posexplode(vector).alias("pos", "x"))
    means = spread.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def batch_infer(rows: DataFrame, infer, schema: str, size: int = 64) -> DataFrame:
    """A user's function over batches of rows: it gets a pandas frame and returns one with the columns of ``schema``.

    A batch that fails gives nulls; the others go on.
    """
    names = [f.split()[0] for f in schema.split(",")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].reset_index(drop=True)
                try:
                    got = infer(part)[names].reset_index(drop=True)
                except Exception:  # the user's function: its failure is the batch's
                    got = part.iloc[:, :0].reindex(columns=names)
                yield part.join(got)

    return rows.mapInPandas(run, f"{kept}, {schema}")
