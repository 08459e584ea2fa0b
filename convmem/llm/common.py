"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once: bounds a worker's memory whatever the texts' lengths.
BATCH_BYTES = 8 << 20
#: ASCII white space that separates words; ``bytes.split()`` splits at the same six characters.
SPACES = "\\x20\\x09-\\x0D"


def rebatched(source: Iterable[pa.RecordBatch], size: int = BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of the column, one more row at most; no session setting is touched."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in source:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = min(int(np.searchsorted(ends, before + size - weight)) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            weight += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if weight >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint_dealt(df: DataFrame, partitions: int, *columns: str) -> DataFrame:
    """Checkpoint rows dealt by columns so that Spark still knows how they are dealt, and need not shuffle them again.

    An adaptive plan does not say how its rows are partitioned, so this one is planned without.
    """
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return checkpoint(df.repartition(partitions, *columns))


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


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, read again, and the table's path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trie_pattern(words: Iterable[str], whole: bool = False, between: str = "") -> str:
    """A pattern for any of the words that looks at each character once: alternatives part where the words do.

    Without ``whole`` the words are beginnings, and a shorter one covers those that go on.
    ``between`` is a pattern that stands between two characters of a word.
    """
    words = set(words)
    if words == {""} or ("" in words and not whole):
        return ""
    heads: dict[str, list[str]] = {}
    for w in sorted(words - {""}):
        heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for head, rest in heads.items():
        more = trie_pattern([r for r in rest if r] if between else rest, whole, between) if any(rest) else ""
        joined = f"{between}{more}" if between and more else more
        if between and more and "" in rest:
            joined = f"(?:{joined})?"
        parts.append(re.escape(head) + joined)
    if "" in words:
        return f"(?:{'|'.join(parts)})?"
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def documents(df: DataFrame, *more: str) -> DataFrame:
    """The integer id, the text and the columns named; whatever else a table has is left behind."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns named, and the whole row as the struct ``row``: whatever the input's columns are called, no working column clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
