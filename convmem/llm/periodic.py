"""Periodic runs: stretches of words that repeat with a period, found at every scale, and collapsed to one period.

A run is a maximal stretch of at least 12 words, and at least two periods, in which words one
period apart are the same, by its smallest period. Periods are taken by octaves (1, 2-3, 4-7, ...).

1. Words of a batch of texts are coded as numbers. For every octave a text is screened: in a run's
   stretch of matches lies a block, on a grid of half the octave, that comes back one period
   later; blocks are compared by rolling hashes, which lets too many through but never too few.
   What is found is written: most texts are settled here, with no run.
2. A text with a block at some octave is exploded into overlapping tiles of that octave, each of
   some octaves' lengths, as rows. A tile is solved by itself: at every boundary near such a
   block two Z-functions tell for every period how far matches go to either side.
   A fragment whose words have a smaller period is left to that period's octave.
3. Fragments are shuffled by document and period and stitched: what overlaps by a period is one run.
4. Runs of a document are brought together, and the words after a run's first period dropped.

Tiles overlap by four times the octave's smallest period, so every stretch of two periods lies
whole in one of them. A document's fragments are fewer than its words.

Defined cases: a null text has no words and no run; a null ``doc_id`` is kept, and its text never
altered; repeated rows are told apart by a number given when they are written; an empty table
gives an empty result; other columns are ignored. Texts may be of any length: tiles of the longest
periods are as long as the text, in codes of four bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from convmem.llm.common import documents, rebatched, stored, task_number, texts_of

#: Words of a run at least; and as many periods.
LEAST, TIMES = 12, 2
#: Words of a tile's stride at least, and octaves' lengths of it otherwise.
STRIDE, LENGTHS = 4096, 8
#: Bytes of text coded at once, and pairs of blocks compared at once.
BATCH, PAIRS = 2 << 20, 1 << 19
EMPTY = hashlib.sha256(b"").hexdigest()


def altered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that a document is given: one in ten ends in a repetition that its id decides."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def block(octave: int) -> tuple[int, int]:
    """Grid and block length of an octave's screening.

    Matches of a run with period p go on for max(12 - p, p) words or more, which is at least
    grid + length - 1 for all p of the octave.
    """
    return (2, 8) if octave < 2 else (2, 4) if octave == 2 else (1 << octave - 1, 1 << octave - 1)


def _mixed(hashed: np.ndarray, length: int) -> np.ndarray:
    """Hashes of blocks of twice the length; those that begin too near the end are of no use."""
    shifted = np.zeros_like(hashed)
    shifted[:-length] = hashed[length:]
    return (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + shifted * np.uint64(0x94D049BB133111EB)


def _plain(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _returning(values: np.ndarray, at: np.ndarray, last: np.ndarray, period: int) -> np.ndarray:
    """Which blocks, by hash, come back after ``period`` to twice as many words, at ``last`` or before."""
    found = np.zeros(len(at), bool)
    step = max(1, PAIRS // period)
    for i in range(0, len(at), step):
        other = at[i : i + step, None] + np.arange(period, 2 * period)
        same = values[np.minimum(other, len(values) - 1)] == values[at[i : i + step], None]
        found[i : i + step] = (same & (other <= last[i : i + step, None])).any(axis=1)
    return found


def grid_hits(codes: np.ndarray, octave: int) -> np.ndarray:
    """Grid points of one text whose block comes back within the octave's periods."""
    grid, own = block(octave)
    hashed, length = _plain(codes), 1
    while length < own and length < len(codes):
        hashed, length = _mixed(hashed, length), 2 * length
    at = np.arange(0, max(0, len(codes) - own - (1 << octave) + 1), grid)
    return at[_returning(hashed, at, np.full(len(at), len(codes) - own), 1 << octave)]


def screened(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text a bit set of the octaves at which a block comes back after a period; texts stand one after the other."""
    found = np.zeros(len(sizes), np.int64)
    starts = np.cumsum(sizes) - sizes
    by_length, length, octave = {1: _plain(codes)}, 1, 0
    while len(sizes) and max(LEAST, TIMES << octave) <= sizes.max():
        grid, own = block(octave)
        while length < own:
            by_length[2 * length] = _mixed(by_length[length], length)
            length *= 2
        by_length = {k: v for k, v in by_length.items() if k >= min(own, 4)}
        period = 1 << octave
        which = np.flatnonzero(sizes >= max(LEAST, TIMES << octave))
        counts = (sizes[which] - own - period) // grid + 1
        owner = np.repeat(which, counts)
        at = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * grid + starts[owner]
        found[np.unique(owner[_returning(by_length[own], at, starts[owner] + sizes[owner] - own, period)])] |= 1 << octave
        octave += 1
    return found


def z_function(s: list[int], upto: int) -> list[int]:
    """How far ``s[i:]`` agrees with ``s``, for each i below ``upto``."""
    n = len(s)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def smallest_periods(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Periods around a boundary whose fragment is long enough and has no smaller period; both arrays go by period.

    A sieve: what a period explains of its multiples' fragments is theirs no longer.
    """
    period = np.arange(len(left))
    open_ = left + right >= np.maximum(LEAST - period, period)
    open_[0] = False
    found = []
    for q in np.flatnonzero(open_).tolist():
        if open_[q]:
            found.append(q)
            m = slice(2 * q, None, q)
            open_[m] &= (left[m] > left[q]) | (right[m] + period[m] > right[q] + q)
    return found


def _mismatch(differs: np.ndarray) -> int:
    """How many leading values are false."""
    at = int(differs.argmax()) if len(differs) else 0
    return at if len(differs) and differs[at] else len(differs)


def solved(codes: np.ndarray, octave: int) -> set[tuple[int, int, int]]:
    """Fragments ``(start, end, period)`` of a tile: maximal in it, long enough, with their smallest period.

    A stretch of matches is at least as long as boundaries are apart, so it meets one. At a
    boundary b, words from b are compared with those from b + p, and words before b with those
    before b + p, for every period p, by one Z-function each over a window of some octave's
    lengths; that is enough to tell whether there is a fragment, and whether a smaller period
    makes it up: a divisor's period in a part of two periods holds in all of the fragment.
    What reaches a window's end is followed beyond it.
    """
    smallest = 1 << octave
    apart = max(smallest, 4 if octave == 2 else 8)
    window = max(16, 2 * smallest)
    hits = grid_hits(codes, octave)
    if not len(hits):
        return set()
    n = len(codes)
    boundaries = np.arange(0, n, apart)
    near = np.searchsorted(hits, boundaries + 2 * apart, "right") > np.searchsorted(hits, boundaries - 2 * apart)
    words = codes.tolist()
    found: set[tuple[int, int, int]] = set()
    latest: dict[int, tuple[int, int]] = {}
    for b in boundaries[near].tolist():
        most = min(2 * smallest, n - b)
        if most <= smallest:
            break
        right = z_function(words[b : b + 2 * window], most)
        back = words[max(0, b - window) : b][::-1]
        seen = z_function([*back, -1, *words[max(0, b - window) : b + most][::-1]], len(back) + 1 + most)
        left = [0, *(seen[len(back) + 1 + most - p] for p in range(1, most))]
        for p in smallest_periods(np.array(left), np.array(right)):
            before, after = left[p], right[p]
            own = latest.get(p)
            if p < smallest or (own is not None and own[0] <= b - before and b + p + after <= own[1]):
                continue
            start, end = b - before, b + p + after
            if before == len(back):
                start -= _mismatch((codes[:start] != codes[p : start + p])[::-1])
            if end == min(n, b + 2 * window):
                end += _mismatch(codes[end:] != codes[end - p : n - p])
            latest[p] = (start, end)
            found.add((start, end, p))
    return found


def coded(docs: DataFrame) -> DataFrame:
    """Every document's number of words and octaves to look at; where there are any, its words and their codes, else their digest."""

    def code(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = task_number() << 33
        for batch in rebatched(source, BATCH):
            ids = batch.column("doc_id").to_pylist()
            lists = [altered(i, t.split()) for i, t in zip(ids, texts_of(batch), strict=True)]
            sizes = np.array([len(w) for w in lists], np.int64)
            flat = pa.array([w for ws in lists for w in ws], pa.binary())
            codes = pc.dictionary_encode(flat).indices.to_numpy() if len(flat) else np.zeros(0, np.int32)
            octaves = screened(codes, sizes)
            starts = np.cumsum(sizes) - sizes
            rows = range(number, number + len(ids))
            number += len(ids)
            joined = [b" ".join(w) for w in lists]
            more = octaves != 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array([[k for k in range(int(o).bit_length()) if o >> k & 1] for o in octaves.tolist()], pa.list_(pa.int32())),
                    pa.array([codes[s : s + n].astype("<i4").tobytes() if m else None for s, n, m in zip(starts, sizes, more, strict=True)], pa.binary()),
                    pa.array([j if m else None for j, m in zip(joined, more, strict=True)], pa.binary()),
                    pa.array([None if m else hashlib.sha256(j).hexdigest() for j, m in zip(joined, more, strict=True)], pa.string()),
                ],
                names=["row", "doc_id", "n", "octaves", "codes", "words", "digest"],
            )

    return documents(docs).mapInArrow(code, "row bigint, doc_id bigint, n bigint, octaves array<int>, codes binary, words binary, digest string")


def tiles(found: DataFrame) -> DataFrame:
    """A row for each tile of a document and octave: ``row``, ``octave``, ``start`` and the ``codes`` from there."""
    each = found.where(F.size("octaves") > 0).select("row", "n", "codes", F.explode("octaves").alias("octave"))
    length = F.expr("shiftleft(1L, octave)")
    stride, overlap = F.greatest(F.lit(STRIDE), LENGTHS * length), F.greatest(F.lit(LEAST), 2 * TIMES * length)
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - overlap) / stride) - 1)
    each = each.select("row", "octave", "codes", stride.alias("stride"), overlap.alias("overlap"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("tile"))
    start = F.col("tile") * F.col("stride")
    own = F.substring("codes", (4 * start + 1).cast("int"), (4 * (F.col("stride") + F.col("overlap"))).cast("int"))
    return each.select("row", "octave", start.alias("start"), own.alias("codes"))


def fragments(found: DataFrame) -> DataFrame:
    """``row``, ``period``, ``start`` and ``end`` of what each tile holds."""

    def solve(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[tuple[int, int, int, int]] = []
            for row, octave, start, codes in zip(*(batch.column(c).to_pylist() for c in ("row", "octave", "start", "codes")), strict=True):
                out += [(row, p, start + s, start + e) for s, e, p in solved(np.frombuffer(codes, "<i4"), octave)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "period", "start", "end"])

    return tiles(found).mapInArrow(solve, "row bigint, period bigint, start bigint, end bigint")


def stitched(parts: DataFrame) -> DataFrame:
    """Whole runs: fragments of a document and period that overlap by a period or more become one."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") + F.col("period") <= before, F.lit(False)), 0).otherwise(1)
    marked = parts.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.select("row", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def found_runs(docs: DataFrame) -> DataFrame:
    """Every document with the array ``runs`` of ``start, length, period``, in this order, and the columns of ``coded``."""
    found = stored(coded(docs))[0]
    by_row = stitched(fragments(found)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return found.drop("codes", "octaves").join(by_row, "row", "left").withColumn("runs", F.coalesce("runs", F.array()))


def collapsed(runs: DataFrame) -> DataFrame:
    """``text``, the kept words joined by one space, in place of ``words``; null where no word was dropped and ``digest`` stands for them."""
    fields = [f for f in runs.schema.fields if f.name != "words"]

    def collapse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts: list[bytes | None] = []
            for n, data, own in zip(batch.column("n").to_pylist(), batch.column("words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if data is not None and own:
                    gone = np.zeros(n + 1, np.int64)
                    for r in own:
                        gone[r["start"] + r["period"]] += 1
                        gone[r["start"] + r["length"]] -= 1
                    kept = np.cumsum(gone)[:n] == 0
                    data = b" ".join(w for w, k in zip(data.split(), kept.tolist(), strict=True) if k)
                texts.append(data)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(texts, pa.binary())], names=[*(f.name for f in fields), "text"])

    return runs.mapInArrow(collapse, StructType([*fields, StructField("text", BinaryType())]))


def report(docs: DataFrame) -> DataFrame:
    """For every document its number of runs, the longest one, and digests of all runs and of the text without repetitions."""
    runs = collapsed(found_runs(docs))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    longest = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    best = F.when(F.size("runs") > 0, longest)
    rows = runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(-best.l * 1000) div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.coalesce("digest", F.sha2("text", 256)).alias("collapsed_sha256"),
    )
    return rows
