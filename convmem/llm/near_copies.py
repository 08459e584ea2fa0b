"""Near copies by the Jaccard similarity of their sets of word shingles: candidates by SimHash and by MinHash bands, then verified.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or
more; linked documents form components. Documents whose sets are equal become one class first.
Candidates are, first, the pairs that the binary trie self-join of ``simhash`` finds at two
differing bits or fewer. At a similarity of 0.8 fingerprints differ in about ten bits, and a
trie walk with such a budget prunes nothing before it has visited nearly all pairs; so, second,
classes that agree in a band of their MinHash signature are candidates, too: with 20 bands of
four values a pair at 0.8 is missed with a probability of 3 in 100,000, and less above. Links
are verified on the whole sets, never on fingerprints or signatures.

A group of n near copies does not give n * n pairs: every class is first verified against one
hub, the least of what shares a band with it, twice with a new order, after what SimHash has joined; only then every pair of
candidates that are not in one component yet is looked at, so no candidate goes unseen: first at 512 parity bits of both sets,
which bound how far these differ from below, then, where the bound leaves it open, at the sets.

Defined cases: null text has no words; repeated rows have one component; texts without words are one class; texts of fewer words
than a shingle are one shingle; a null id never names a component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.llm import simhash
from convmem.llm.blocks import mixed
from convmem.llm.common import apart, checkpoint, documents, rebatched, texts_of
from convmem.llm.components import components

WIDTH, BANDS, ROWS = 5, 20, 4
#: Numbers of 64 parity bits of a set.
PARITY = 8
_ODD = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(18).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.random.default_rng(19).integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    words = text.lower().split()  # of bytes, as SimHash has them
    if not words:
        return np.empty(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    parts = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter((digest(join(s), 42) for s in parts), np.uint64))


def class_of(found: np.ndarray) -> int:
    """One number for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(found), 4096):
        least = np.minimum(least, (found[i : i + 4096, None] * _ODD).min(axis=0))
    return mixed((least.reshape(BANDS, ROWS) * _PLACE).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def print_of(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 14):
        ones += np.unpackbits(found[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">i8")[0])


def parity_of(found: np.ndarray) -> list[int]:
    """Parity bits of a set, as signed numbers: each member turns over one of them, so two sets differ in as many members as bits, or more."""
    ones = np.bincount((mixed(found) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(ones.astype(np.uint8)).view(">i8").tolist()


def _close_prints(classes: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): classes whose SimHash fingerprints are equal or joined in the forest of the trie self-join."""
    own = classes.where("n > 0").select("class", "bits")
    hubs = checkpoint(own.groupBy("bits").agg(F.min("class").alias("hub")))
    equal = own.join(hubs.hint("merge"), "bits").where("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b"))
    forest = simhash.links(hubs.select("bits"), budget)
    x, y = hubs.select(F.col("bits").alias("a"), F.col("hub").alias("x")), hubs.select(F.col("bits").alias("b"), F.col("hub").alias("y"))
    close = forest.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return checkpoint(equal.unionByName(close))


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class, n, bits, parity, keys) of every document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(source):
            sets = [shingles(t) for t in texts_of(batch)]
            keys = [bands(s).tolist() if len(s) else [] for s in sets]
            numbers = [[f(s) for s in sets] for f in (class_of, len, print_of)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([parity_of(s) for s in sets], keys)]
            columns = [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(x, pa.int64()) for x in numbers], *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "class", "n", "bits", "parity", "keys"])

    return documents(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash")).mapInArrow(run, "doc_id bigint, text_hash bigint, class bigint, n bigint, bits bigint, parity array<bigint>, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the classes wanted (class, least)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(source):
            rows = [(c, s) for c, t in zip(batch.column("class").to_pylist(), texts_of(batch), strict=True) if class_of(s := shingles(t)) == c]  # an id may be repeated
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["class", "shingles"])

    texts = documents(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).select("class", "text")
    return texts.mapInArrow(run, "class bigint, shingles binary").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is 0.8 or more."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(source, column="x"):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return checkpoint(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def links(docs: DataFrame, classes: DataFrame, stars: int = 2) -> DataFrame:
    """(class, component) of the classes (class, least, n, bits, keys) that are linked to another."""
    close = _close_prints(classes)
    keyed = checkpoint(classes.select("class", "n", F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    met = checkpoint(keyed.join(shared, "key"))
    some = met.select("class").unionByName(close.select(F.col("a").alias("class"))).unionByName(close.select(F.col("b").alias("class"))).distinct()
    sets = checkpoint(_sets(docs, classes.join(some, "class", "left_semi").select("class", "least")))

    def star(turn: int) -> DataFrame:
        """Every class and the least by a new order of what shares a band with it."""
        order = F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), F.col("class").alias("hub"))
        hubs = met.groupBy("key").agg(F.min(order).alias("least"))
        near = met.join(hubs, "key").groupBy("class").agg(F.min("least").alias("least")).where("class <> least.hub")
        return near.select(F.least("class", "least.hub").alias("a"), F.greatest("class", "least.hub").alias("b"))

    pairs = close
    for turn in range(stars):
        pairs = pairs.unionByName(star(turn))
    found = _verified(pairs.distinct(), sets)
    roots = checkpoint(components(found).select(F.col("node").alias("class"), "component"))
    # What shares a band and is not in one component yet, pair by pair.
    still = met.join(roots, "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_keys = still.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    signed = classes.select("class", *[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY)])
    still = checkpoint(still.join(open_keys, "key").join(signed, "class"))
    other = still.select("key", F.col("class").alias("b"), F.col("n").alias("m"), F.col("component").alias("of"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(PARITY)])
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(PARITY)))
    fits = (F.col("class") < F.col("b")) & (F.col("component") != F.col("of")) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m"))
    # Sets that are 0.8 alike differ in a ninth of their sizes' sum at most.
    fits = fits & (9 * differ <= F.col("n") + F.col("m"))
    more = _verified(still.join(other.hint("merge"), "key").where(fits).select(F.col("class").alias("a"), "b").distinct(), sets)
    if more.isEmpty():
        return roots
    # Only components are joined from here on: far fewer nodes than classes, so few and small rounds.
    of = lambda side: roots.select(F.col("class").alias(side), F.col("component").alias(f"{side}_of"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    joined = checkpoint(components(between))
    moved = roots.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("class", F.coalesce("top", "component").alias("component"))
    alone = joined.select(F.col("node").alias("class"), "component").join(roots, "class", "left_anti")
    return checkpoint(moved.unionByName(alone))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component_id) of every document; component_id is the least id of the component."""
    every = checkpoint(_classes(docs))
    classes = checkpoint(every.groupBy("class").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("parity").alias("parity"), F.any_value("keys").alias("keys")))
    merged = classes.join(links(docs, classes), "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    merged = checkpoint(merged)
    least = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    found = checkpoint(merged.join(least, "component").select("class", "component_id"))
    # A class that many documents share is a skewed key here, which adaptive execution can split.
    return every.select("doc_id", "text_hash", "class").join(found.hint("merge"), "class").select("doc_id", "text_hash", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of the input whose id is the least of their component; rows without an id stay where no row of their component has one.

    An id may stand at several texts, so it is a row's id and text that decide. Rows that repeat an id and a text stay or go together.
    """
    stay = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay"), "text_hash").distinct()
    rows = apart(docs, id=F.col("doc_id").cast("bigint"), own=F.xxhash64(F.col("text").cast("string")))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("stay")) & (F.col("own") == F.col("text_hash")), "left_semi").select("row.*")
