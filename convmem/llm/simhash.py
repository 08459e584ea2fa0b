"""SimHash near-duplicates by a self-join of binary tries.

Documents become 64-bit fingerprints, and equal ones become one row with its least document.
The distinct fingerprints form a binary trie whose upper levels are dealt out: a task gets one
pair of nodes at a fixed depth whose prefixes differ in no more bits than allowed. There it
walks both subtrees together, level by level, counts differing bits and drops a pair of nodes
when the count exceeds the allowance; leaves that remain are links. A task hands back a
spanning forest of its links, so a group of n fingerprints gives n - 1 rows and not n * n.

Defined cases: null text has no words; no words give fingerprint zero, linked like any other;
texts of fewer words than a shingle are one shingle; rows that repeat an id are linked as any
other equal texts, and a null id is returned with its component and never is one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.llm.common import apart, checkpoint, documents, rebatched, shuffle_partitions, texts_of
from convmem.llm.components import components


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the bits of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashes = np.array([digest(join(s), 42) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, bits): fingerprints as signed 64-bit numbers."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(source):
            bits = np.array([fingerprint(t, width) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(bits, pa.int64())], ["doc_id", "text_hash", "bits"])

    return documents(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash")).mapInArrow(run, "doc_id bigint, text_hash bigint, bits bigint")


# The self-join --------------------------------------------------------------------------------

#: Pairs of trie nodes that are walked at once in a task.
_PAIRS = 1 << 19


class _Forest:
    """Union-find over a task's fingerprints; keeps the links that join two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[s] = r
                self.links.append((x, y))


def close_pairs(left: np.ndarray, right: np.ndarray, budget: int, depth: int, link) -> None:
    """Walk two sorted arrays of fingerprints as tries from a depth on; ``link`` gets index arrays of pairs within the budget.

    A node is a range of an array. With the same array on both sides each pair comes once.
    """
    same = left is right
    stack = [(depth, np.array([[0, len(left), 0, len(right), budget]], np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > _PAIRS:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half]), (depth, nodes[half:])]
            continue
        # Small nodes are leaves: their few pairs are compared as they are.
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        leaf = (size <= 4) | (depth == 64)
        if leaf.any():
            a, b = _products(nodes[leaf], size[leaf], link)
            keep = np.bitwise_count(left[a] ^ right[b]) <= link.budget
            if same:
                keep &= a < b
            link(a[keep], b[keep])
        nodes = nodes[~leaf]
        if not len(nodes):
            continue
        bit = np.uint64(1 << (63 - depth))
        a = _middle(left, nodes[:, 0], nodes[:, 1], depth, bit)
        b = _middle(right, nodes[:, 2], nodes[:, 3], depth, bit)
        l0, l1, r0, r1, left_over = nodes.T
        children = [np.stack(c, 1) for c in ((l0, a, r0, b, left_over), (a, l1, b, r1, left_over), (l0, a, b, r1, left_over - 1), (a, l1, r0, b, left_over - 1))]
        children = np.concatenate(children)
        keep = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] >= 0)
        if same:  # of two mirrored pairs of nodes only one is walked
            keep &= children[:, 0] <= children[:, 2]
        children = children[keep]
        if len(children):
            stack.append((depth + 1, children))


def _middle(values: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int, bit: np.uint64) -> np.ndarray:
    """Where the ones begin at a bit in ranges that agree in all bits above it."""
    above = ~np.uint64(0) << np.uint64(64 - depth) if depth else np.uint64(0)
    return np.clip(np.searchsorted(values, (values[first] & above) | bit), first, last)


def _products(nodes: np.ndarray, size: np.ndarray, link) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(nodes)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    wide = (nodes[:, 3] - nodes[:, 2])[of]
    return nodes[of, 0] + at // wide, nodes[of, 2] + at % wide


class _Links:
    def __init__(self, forest: _Forest, budget: int, shift: int = 0):
        self.forest, self.budget, self.shift = forest, budget, shift

    def __call__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.forest.add(a, b + self.shift)


def depth_for(n: int, partitions: int, per_node: int, least: int) -> int:
    """Levels that are dealt out: nodes of ``per_node`` fingerprints, or less where there would be fewer nodes than partitions, but not under ``least``.

    A fingerprint is sent to 1 + d + d(d - 1)/2 pairs of nodes at depth d and two bits, so nodes are no smaller than need be.
    """
    log = lambda x: (max(1, x) - 1).bit_length()
    return min(24, max(log(n // per_node), min(log(n // least), log(partitions))))


def links(prints: DataFrame, budget: int, per_node: int = 1 << 20, least: int = 4096) -> DataFrame:
    """(a, b): a spanning forest of the pairs of distinct ``bits`` that differ in at most ``budget`` bits."""
    depth = depth_for(prints.count(), shuffle_partitions(prints.sparkSession), per_node, least)
    masks = [0]
    for k in range(budget):
        masks = sorted({m ^ (1 << i) for m in masks for i in range(depth)} | set(masks)) if depth else masks
    prefix = F.shiftrightunsigned(F.col("bits"), 64 - depth) if depth else F.lit(0).cast("bigint")
    dealt = prints.select("bits", prefix.alias("own")).select("bits", "own", F.explode(F.lit(masks).cast("array<bigint>")).alias("mask"))
    # Of the two prefixes of a pair the lesser one names it.
    other = F.col("own").bitwiseXOR(F.col("mask"))
    dealt = dealt.select("bits", "mask", F.least("own", other).alias("pair"), (F.col("own") < other).alias("left"))

    def walk(table: pa.Table) -> pa.Table:
        mask = table.column("mask")[0].as_py()
        bits = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        if mask == 0:
            left = right = np.sort(bits)
            every, shift, spent = left, 0, 0
        else:
            side = table.column("left").to_numpy()
            left, right = np.sort(bits[side]), np.sort(bits[~side])
            every, shift, spent = np.concatenate([left, right]), len(left), mask.bit_count()
        forest = _Forest(len(every))
        if len(left) and len(right):
            close_pairs(left, right, budget - spent, depth, _Links(forest, budget, shift))
        a = every[[x for x, _ in forest.links]].view(np.int64)
        b = every[[y for _, y in forest.links]].view(np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("pair", "mask").applyInArrow(walk, "a bigint, b bigint")


def _components(docs: DataFrame, width: int, budget: int) -> DataFrame:
    """(doc_id, text_hash, bits, component_id) of every document."""
    every = checkpoint(fingerprints(docs, width))
    classes = checkpoint(every.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes, budget))
    merged = classes.join(roots.select(F.col("node").alias("bits"), "component"), "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    least = checkpoint(merged.groupBy("component").agg(F.min("least").alias("component_id")))
    found = checkpoint(checkpoint(merged).join(least, "component").select("bits", "component_id"))
    # A fingerprint that many documents share is a skewed key here: both sides come from a shuffle of their own, so adaptive execution can split it.
    return every.join(found.hint("merge"), "bits")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return _components(docs, width, budget).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """The rows of the input whose id is the least of their component; rows without an id stay where no row of their component has one.

    An id may stand at several texts, so it is a row's id and text that decide. Rows that repeat an id and a text stay or go together.
    """
    found = _components(docs, width, budget)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay"), "text_hash").distinct()
    rows = apart(docs, id=F.col("doc_id").cast("bigint"), own=F.xxhash64(F.col("text").cast("string")))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("stay")) & (F.col("own") == F.col("text_hash")), "left_semi").select("row.*")
