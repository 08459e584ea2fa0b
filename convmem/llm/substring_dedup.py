"""Removal of word windows that an earlier document has, by level-wise doubling.

The fingerprint of a window is made of the fingerprints of two overlapping windows of about
half its length: 1, 2, 4, 7 and 13 words. At the first length that is asked about (7 words) every
window is looked up in the whole corpus by a short fingerprint. Only where both halves are
repeated is a window of 13 words formed and asked about, now with its whole fingerprint and the
smallest document that has it. Levels end at the wanted length, or when nothing is left.

A fingerprint has 64 bits, of which windows are compared within a bucket, and a window must
have passed the level before by other bits; a false match is expected less than once in
10**13 words.

Defined cases: null text has no words; a window of a document with a null id is removed if any
document with an id has it, and shields no other; rows that repeat an id do not shield each
other, for neither id is smaller; texts shorter than a window are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from convmem.llm import blocks as B
from convmem.llm.common import sha256

_TIMES = np.uint64(0x9E3779B97F4A7C15)


def ladder(width: int) -> list[int]:
    """Window lengths, each about twice the one before: 1, 2, 4, 7, 13 for 13."""
    lengths = [width]
    while lengths[0] > 1:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


class Windows:
    """Word windows over the concatenated words of a block's documents."""

    def __init__(self, block: B.Block):
        self.words = [t.split() for t in block.texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.counts)
        total = int(self.counts.sum())
        self.doc = np.repeat(np.arange(len(self.words)), self.counts)
        self.left = np.repeat(self.ends, self.counts) - np.arange(total)
        flat = [w for words in self.words for w in words]
        self.prints = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, total)
        self.length = 1

    def grow(self, length: int) -> None:
        """To windows of ``length`` words, each made of two of the present ones; those over a document's end are garbage."""
        step = length - self.length
        after = np.zeros_like(self.prints)
        after[: len(self.prints) - step] = self.prints[step:]
        self.prints = B.mixed(self.prints * _TIMES + after)
        self.length = length

    def starts(self) -> np.ndarray:
        """Positions at which a whole window starts."""
        return np.flatnonzero(self.left >= self.length)


def without_repeats(docs: DataFrame, width: int = 13, asked_from: int = 7, with_text: bool = False) -> DataFrame:
    """Counts and digest of what is left of every document; ``with_text`` adds the kept words as ``kept``."""
    stored = B.blocks(docs)
    buckets = B.buckets_for(stored)
    lengths = ladder(width)
    levels = [x for x in lengths if asked_from <= x < width]

    def climb(block: B.Block, answers: pa.Table | None, to: int) -> tuple[Windows, np.ndarray, B.Entries]:
        """Windows of length ``to`` at the starts where all shorter levels asked about are repeated."""
        windows, at = Windows(block), None
        for length in lengths:
            if length > 1:
                step = length - windows.length
                windows.grow(length)
                whole = windows.starts()
                if at is None:
                    at = whole
                else:
                    marks = np.zeros(len(windows.prints) + step, bool)
                    marks[at] = True
                    at = whole[marks[whole] & marks[whole + step]]
            else:
                at = windows.starts()
            if length == to or length in levels:
                entries = B.Entries(windows.prints[at], buckets)
                if length == to:
                    return windows, at, entries
                repeated = entries.answered(answers, length).astype(bool)
                inside = windows.doc[at] > windows.doc[at[entries.first]][entries.of] if len(at) else np.zeros(0, bool)
                repeated[entries.of[inside]] = True
                at = at[repeated[entries.of]]
            elif length < (levels[0] if levels else to):
                at = None  # nothing has been asked yet: all windows count
        raise ValueError(f"no window of {to} words")

    answers = None
    for length in levels:

        def asking(block: B.Block, known: pa.Table | None = None, length: int = length) -> Iterator[pa.RecordBatch]:
            _, _, entries = climb(block, known, length)
            yield entries.asked(block.number, short=True)

        asked = B.each(stored, asking, B.ASKED) if answers is None else B.each_answered(stored, answers, asking, B.ASKED)
        found = B.ask(asked, length, B.in_two_blocks)
        answers = B.checkpoint(found if answers is None else B.with_level(answers, found))

    def asking_last(block: B.Block, known: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
        windows, at, entries = climb(block, known, width)
        owners = block.owners[windows.doc[at[entries.first]]] if len(at) else np.zeros(0, np.int64)
        yield entries.asked(block.number, owners)

    asked = B.each(stored, asking_last, B.ASKED) if answers is None else B.each_answered(stored, answers, asking_last, B.ASKED)
    last = B.ask(asked, width, B.smaller_owner, with_owners=True)
    every = last if answers is None else B.with_level(answers, last)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text
    schema = pa.schema(fields)

    def cut(block: B.Block, known: pa.Table) -> Iterator[pa.RecordBatch]:
        windows, at, entries = climb(block, known, width)
        covered = np.zeros(len(windows.doc), bool)
        if len(at):
            owner = block.owners[windows.doc[at]]
            least = owner[entries.first]
            gone = at[entries.answered(known, width).astype(bool)[entries.of] | (owner > least[entries.of])]
            edge = np.zeros(len(windows.doc) + width + 1, np.int32)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + width, -1)
            covered = np.cumsum(edge)[: len(windows.doc)] > 0
        start = 0
        rows: list[tuple] = []
        for doc_id, words in zip(block.ids, windows.words, strict=True):
            out = covered[start : start + len(words)]
            start += len(words)
            removed = int(out.sum())
            kept = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o] if removed else words)
            rows.append((doc_id, len(words), removed, sha256(kept), *[kept.decode()] * with_text))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    return B.each_answered(stored, every, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
