"""Removal of byte strings that occur earlier, with a logarithmic family of suffix arrays.

A suffix is only worth an index if the string at its start may occur twice. In every run of 100
bytes the 32-byte gram with the least hash is the *anchor*; equal strings have equal anchors, at
the same place. A string that begins 34 or more bytes before its anchor holds the 66 bytes that
end with it, any other the 66 bytes that begin with it. Each block of documents asks about the
fingerprints of these, and the starts whose 66 bytes occur nowhere else are done with. What
remains are *regions*: runs of starts with one anchor, and their bytes. Regions go to buckets
by their anchor, a block's equal ones once.

In a bucket everything is decided by bytes. Blocks come one after another; each batch of them
gets a suffix array, that is its regions in sorted order. It is merge-scanned against the levels
that are there: what matches in full is known, the rest becomes a level, and levels merge when
they are of about equal size. Each known string keeps its earliest occurrence. Regions that an
earlier one equals go whole. Where one anchor has different regions, as at the ends of copied
passages, the 100-byte suffixes that begin in them are indexed likewise, in a second family.

Defined cases: null text is empty; texts under 100 bytes are kept; documents are ordered by id,
null last, rows that repeat an id by their block; an empty table gives an empty result; other
columns are ignored. Cuts may split a UTF-8 character, as strings are bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.llm import blocks as B
from convmem.llm.common import checkpoint, sha256

GRAM = 32
#: Bytes of text in a block; a task holds about a hundred bytes for each.
BLOCK_BYTES = 4 << 20
#: Regions of a batch that gets a suffix array, and strings of one.
BATCH = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = B.mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Family:
    """Levels of distinct byte strings of one length in sorted order, each less than half as long as the one before.

    ``least`` has the earliest order of each string by its number.
    """

    def __init__(self, width: int):
        self.width = width
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.least = np.zeros(0, np.int64)

    def _strings(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{self.width}").ravel()

    def add(self, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The number of each string of a batch (one row of bytes for each), after a merge-scan against all levels."""
        if not len(rows):
            return np.zeros(0, np.int64)
        array = np.argsort(self._strings(rows), kind="stable")
        ranked = rows[array]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
        least = np.minimum.reduceat(order[array], np.flatnonzero(new))
        distinct = ranked[new]
        number = np.full(len(distinct), -1, np.int64)
        strings = self._strings(distinct)
        for have, numbers in self.levels:
            at = np.minimum(np.searchsorted(self._strings(have), strings), len(have) - 1)
            match = (have[at] == distinct).all(axis=1)
            number[match] = numbers[at[match]]
        known = number >= 0
        self.least[number[known]] = np.minimum(self.least[number[known]], least[known])
        number[~known] = len(self.least) + np.arange((~known).sum())
        self.least = np.concatenate([self.least, least[~known]])
        self._level(distinct[~known], number[~known])
        out = np.empty(len(rows), np.int64)
        out[array] = number[np.cumsum(new) - 1]
        return out

    def _level(self, rows: np.ndarray, numbers: np.ndarray) -> None:
        if not len(rows):
            return
        while self.levels and len(self.levels[-1][0]) < 2 * len(rows):
            have, known = self.levels.pop()
            rows, numbers = np.concatenate([have, rows]), np.concatenate([known, numbers])
            merged = np.argsort(self._strings(rows), kind="stable")  # two sorted runs: one merge
            rows, numbers = rows[merged], numbers[merged]
        self.levels.append((rows, numbers))


class Text:
    """A block's bytes, and its segments: runs of starts of whole strings that have one anchor."""

    def __init__(self, block: B.Block, width: int):
        sizes = np.array([len(t) for t in block.texts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.data = data = np.frombuffer(b"".join(block.texts), np.uint8)
        n = len(data)
        # Sum of value * base**-i up to each byte: a string's fingerprint is a difference, shifted.
        top = 1 << max(n, 1).bit_length()  # few lengths, so that the powers are made once
        self.powers = _powers(_BASE, top + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(_INVERSE, top)[:n], out=self.sums[1:])
        self.width = width
        # Where a whole string starts: it must end in its document.
        whole = np.zeros(n + 1, np.int8)
        long = sizes >= width
        np.add.at(whole, self.bounds[:-1][long], 1)
        np.add.at(whole, (self.bounds[1:] - width + 1)[long], -1)
        starts = np.flatnonzero(np.cumsum(whole[:n], dtype=np.int8))
        if not len(starts):
            self.first = self.last = self.anchor = np.zeros(0, np.int64)
            return
        span = width - GRAM + 1
        grams = np.full(n + 1, np.iinfo(np.uint64).max, np.uint64)
        hashes = B.mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.powers[: n - GRAM + 1])
        grams[: n - GRAM + 1] = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - GRAM + 1, dtype=np.uint64)
        # Sliding minimum over ``span`` grams by doubling; the position in the low half makes the leftmost win.
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            grams[:-step] = np.minimum(grams[:-step], grams[step:])
            reach += step
        anchor = (grams[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.anchor = anchor[change]
        self.first = starts[change]
        self.last = starts[np.concatenate([change[1:], [len(starts)]]) - 1]

    def prints(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        raw = (self.sums[at + length] - self.sums[at]) * self.powers[at]
        return B.mixed(raw ^ np.atleast_1d(np.asarray(length, np.uint64)) * _STEP)

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    # What a repeated string must share -------------------------------------------------------

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints of the bytes that end and that begin with an anchor, and the segments that each half is of."""
        self.half = (self.width - GRAM) // 2
        left = np.flatnonzero(self.anchor - self.first >= self.half)
        right = np.flatnonzero(self.anchor - self.last < self.half)
        before = self.prints(self.anchor[left] - self.half, self.half + GRAM)
        after = B.mixed(self.prints(self.anchor[right], self.width - self.half) + _STEP)
        return np.concatenate([before, after]), left, right

    def regions(self, repeated: np.ndarray, left: np.ndarray, right: np.ndarray) -> Regions:
        """Starts of each segment whose feature is repeated."""
        before, after = np.zeros(len(self.first), bool), np.zeros(len(self.first), bool)
        before[left], after[right] = repeated[: len(left)], repeated[len(left) :]
        start = np.where(before, self.first, np.maximum(self.first, self.anchor - self.half + 1))
        last = np.where(after, self.last, np.minimum(self.last, self.anchor - self.half))
        some = (before | after) & (start <= last)
        return Regions(self, start[some], last[some] - start[some] + 1, self.anchor[some] - start[some])


class Regions:
    """Runs of ``count`` starts from ``start`` on, whose strings have the anchor ``anchor`` bytes after the first start."""

    def __init__(self, text: Text, start: np.ndarray, count: np.ndarray, anchor: np.ndarray):
        self.text, self.start, self.count, self.anchor = text, start, count, anchor

    def rows(self, which: np.ndarray) -> np.ndarray:
        return padded(self.text.data, self.start[which], self.count[which], self.anchor[which], self.text.width)

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first of each kind of equal regions, and of the others. Equal fingerprints are verified by bytes."""
        length = self.count + self.text.width - 1
        prints = B.mixed(self.text.prints(self.start, length) + B.mixed(self.anchor.astype(np.uint64) + _STEP))
        _, first, of = np.unique(prints, return_index=True, return_inverse=True)
        later = np.ones(len(prints), bool)
        later[first] = False
        for some in np.array_split(np.flatnonzero(later), len(prints) // BATCH + 1):
            later[some] = (self.rows(some) == self.rows(first[of[some]])).all(axis=1)
        return np.flatnonzero(~later), np.flatnonzero(later)


def padded(data: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """One row of bytes for each region: its text, padded with zeros, its number of starts and its anchor's place."""
    most = 2 * width - GRAM
    length = count + width - 1
    out = np.zeros((len(start), most + 4), np.uint8)
    place = np.arange(most)
    inside = place < length[:, None]
    out[:, :most][inside] = data[(start[:, None] + place)[inside]]
    out[:, most : most + 2] = count.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[:, most + 2 :] = anchor.astype("<u2").view(np.uint8).reshape(-1, 2)
    return out


# Between blocks and buckets --------------------------------------------------------------------


def _sent(text: Text, regions: Regions, which: np.ndarray, owners: np.ndarray) -> bytes:
    length = regions.count[which] + text.width - 1
    data = text.data[_ranges(regions.start[which], regions.start[which] + length - 1)]
    body = regions.count[which].astype("<u2").tobytes() + regions.anchor[which].astype("<u2").tobytes() + owners.astype("<i8").tobytes() + data.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def _received(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts' counts, anchors' places, owners and the bytes of what a block has sent."""
    body = zstandard.ZstdDecompressor().decompress(payload)
    count, anchor = (np.frombuffer(body, "<u2", n, 2 * n * k).astype(np.int64) for k in (0, 1))
    return count, anchor, np.frombuffer(body, "<i8", n, 4 * n), np.frombuffer(body, np.uint8, offset=12 * n)


def decide(sent: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], width: int) -> list[np.ndarray]:
    """For each block in order, for each start of its regions in order: whether its string occurs earlier."""
    every = [np.concatenate([s[k] for s in sent]) for k in (0, 1, 2)]
    count, owner = every[0], every[2]
    rank = np.empty(len(owner), np.int64)
    rank[np.argsort(owner, kind="stable")] = np.arange(len(owner))  # of equal owners the earlier block's first
    sizes = np.array([len(s[0]) for s in sent])
    ends = np.cumsum(sizes)
    family, numbers, begun = Family(2 * width - GRAM + 4), [], 0
    for i, end in enumerate(ends):
        if end - (ends[begun - 1] if begun else 0) >= BATCH or i + 1 == len(ends):
            rows = [padded(d, np.cumsum(n + width - 1) - (n + width - 1), n, a, width) for n, a, _, d in sent[begun : i + 1]]
            numbers.append(family.add(np.concatenate(rows), rank[end - len(np.concatenate([s[0] for s in sent[begun : i + 1]])) : end]))
            begun = i + 1
    number = np.concatenate(numbers)
    first = family.least[number] == rank
    # The distinct regions by number, and those whose anchor has another region, too.
    known = np.concatenate([n for _, n in family.levels])
    rows = np.concatenate([r for r, _ in family.levels])[np.argsort(known)]
    tail = rows[:, -4:].copy().view("<u2").astype(np.int64)
    grams = np.ascontiguousarray(rows[np.arange(len(rows))[:, None], tail[:, 1:] + np.arange(GRAM)]).view(f"S{GRAM}").ravel()
    array = np.argsort(grams, kind="stable")
    grams = grams.view(np.uint8).reshape(-1, GRAM)[array]
    same = (grams[1:] == grams[:-1]).all(axis=1)
    several = np.zeros(len(rows), bool)
    several[array[1:]] |= same
    several[array[:-1]] |= same
    # Their strings, in batches.
    strings, held = Family(width), np.flatnonzero(several)
    order, found = [], []
    for some in np.array_split(held, int(tail[held, 0].sum()) // BATCH + 1):
        n = tail[some, 0]
        of, at = np.repeat(some, n), _ranges(np.zeros(len(n), np.int64), n - 1)
        own = family.least[of] * width + at
        order.append(own)
        found.append(strings.add(rows[of[:, None], at[:, None] + np.arange(width)], own))
    again = strings.least[np.concatenate(found)] < np.concatenate(order)
    where = np.zeros(len(rows), np.int64)
    where[held] = np.cumsum(tail[held, 0]) - tail[held, 0]
    out = np.repeat(~first, count)
    open_ = np.flatnonzero(first & several[number])
    to = np.cumsum(count) - count
    out[_ranges(to[open_], to[open_] + count[open_] - 1)] = again[_ranges(where[number[open_]], where[number[open_]] + count[open_] - 1)]
    return np.split(out.astype(np.uint8), np.cumsum([s[0].sum() for s in sent])[:-1])


FEATURES, REGIONS, OWN = 1, 2, 3


def without_repeats(docs: DataFrame, width: int = 100, with_text: bool = False) -> DataFrame:
    """Counts and digest of what is left of every document; ``with_text`` adds the kept bytes as ``kept``."""
    if not GRAM < width < 1 << 15:
        raise ValueError(f"strings must be longer than {GRAM} bytes, which an anchor has")
    stored = B.blocks(docs, BLOCK_BYTES)
    # Regions hold each byte several times, so that buckets get fewer bytes of text.
    buckets = 2 * B.buckets_for(stored)

    def ask_features(block: B.Block) -> Iterator[pa.RecordBatch]:
        yield B.Entries(Text(block, width).features()[0], buckets).asked(block.number, short=True, level=FEATURES)

    def ask_regions(block: B.Block, known: pa.Table) -> Iterator[pa.RecordBatch]:
        """The block's distinct regions to their buckets; and to itself, where its regions start."""
        text = Text(block, width)
        prints, left, right = text.features()
        entries = B.Entries(prints, buckets)
        repeated = entries.answered(known, FEATURES).astype(bool) | (np.bincount(entries.of, minlength=len(entries.values)) > 1)
        regions = text.regions(repeated[entries.of], left, right)
        one, later = regions.split()
        bucket = B.bucket_of(text.prints(regions.start[one] + regions.anchor[one], GRAM), buckets).astype(np.int64)
        one = one[np.lexsort((regions.start[one], bucket))]
        bucket = np.sort(bucket)
        owners = block.owners[text.docs(regions.start[one])]
        rows = [(REGIONS, k, b - a, _sent(text, regions, one[a:b], owners[a:b])) for k, (a, b) in B.runs(bucket).items()]
        mine = [regions.start[one].astype("<i4"), regions.count[one].astype("<u2"), bucket.astype("<i4"), regions.start[later].astype("<i4"), regions.count[later].astype("<u2")]
        rows.append((OWN, -1, len(one), zstandard.ZstdCompressor(level=1).compress(b"".join(m.tobytes() for m in mine))))
        yield B.asked_rows(block.number, rows)

    first = checkpoint(B.ask(B.each(stored, ask_features, B.ASKED), FEATURES, B.in_two_blocks))
    asked = checkpoint(B.each_answered(stored, first, ask_regions, B.ASKED))

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        sent = [_received(p, n) for p, n in zip(table.column("payload").to_pylist(), table.column("entries").to_pylist(), strict=True)]
        return B.answer_rows(table, REGIONS, decide(sent, width))

    second = asked.where(F.col("level") == REGIONS).groupBy("bucket").applyInArrow(answer, B.ANSWERS)
    own = asked.where(F.col("level") == OWN).select("block", "level", "bucket", "entries", F.col("payload").alias("bits"))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text
    schema = pa.schema(fields)

    def cut(block: B.Block, known: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in block.texts])])
        edge = np.zeros(int(bounds[-1]) + width + 1, np.int32)
        for at in _removed(known):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
        covered = np.cumsum(edge)[: int(bounds[-1])] > 0
        rows = []
        for i, (doc_id, data) in enumerate(zip(block.ids, block.texts, strict=True)):
            out = covered[bounds[i] : bounds[i + 1]]
            removed = int(out.sum())
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()) if removed else 0
            kept = np.frombuffer(data, np.uint8)[~out].tobytes() if removed else data
            rows.append((doc_id, len(data), removed, spans, sha256(kept), *[kept] * with_text))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    return B.each_answered(stored, B.with_level(own, second), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _removed(known: pa.Table) -> Iterator[np.ndarray]:
    """The starts that a block must remove: those of regions that repeat one of its own, and those that buckets name."""
    rows = known.to_pylist()
    for own in (r for r in rows if r["level"] == OWN):
        n, body = own["entries"], zstandard.ZstdDecompressor().decompress(own["bits"])
        start, count, bucket = np.frombuffer(body, "<i4", n).astype(np.int64), np.frombuffer(body, "<u2", n, 4 * n).astype(np.int64), np.frombuffer(body, "<i4", n, 6 * n)
        rest = (len(body) - 10 * n) // 6
        again, more = np.frombuffer(body, "<i4", rest, 10 * n).astype(np.int64), np.frombuffer(body, "<u2", rest, 10 * n + 4 * rest).astype(np.int64)
        yield _ranges(again, again + more - 1)
        places = B.runs(bucket)
        for r in rows:
            if r["level"] == REGIONS:
                a, b = places[r["bucket"]]
                starts = _ranges(start[a:b], start[a:b] + count[a:b] - 1)
                yield starts[B.unpacked_bits(r["bits"], len(starts)).astype(bool)]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers from each first to its last."""
    sizes = last - first + 1
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
