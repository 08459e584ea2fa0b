"""Removal of lines that an earlier line equals or nearly equals, by a deletion-neighbourhood join.

Lines are compared by their words. Two lines are near if one edit of a word (insertion, deletion,
substitution) makes them equal and is no more than a fifth of the words, so of under five words
only equal lines are near. A line goes if any earlier line of the corpus, in the order of
``doc_id`` and then of lines, is near it; it is judged on the input, not on what is left.

Lines that are equal are settled first. Of what remains, a line is looked up further only if one
of its halves occurs in another line, which any near line must share. Such a line emits its
words' fingerprint without any one word, with that word's place, and its whole fingerprint.
Equal ones meet: a whole one and a deletion may be an insertion apart; two deletions at the same
place a substitution. Each block sends the earliest line for a key and role only; the others of
the block have that one before them. What is met is a candidate: its block and number come back,
the words of the candidates are fetched, and the edit distance is verified on the words.

Defined cases: null text is empty, which is one line without words; lines without words
are never removed; of rows that repeat an id those in earlier blocks come first; null ids are
last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.llm import blocks as B
from convmem.llm.common import sha256

EXACT, HALF, NEAR, LINES, FETCHED = 1, 2, 3, 4, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


class Lines:
    """The distinct lines of a block, by their words, in the order of their first occurrence."""

    def __init__(self, block: B.Block, least: int, fuzzy: int):
        self.lines = [t.split(b"\n") for t in block.texts]
        index: dict[bytes, int] = {}
        self.words: list[list[bytes]] = []
        doc: list[int] = []
        self.of: list[list[int]] = []  # for each document the line's number, or -1
        join = b" ".join
        for d, lines in enumerate(self.lines):
            own = []
            for line in lines:
                words = line.split()
                if len(words) < least:
                    own.append(-1)
                    continue
                at = index.setdefault(join(words), len(index))
                if at == len(self.words):
                    self.words.append(words)
                    doc.append(d)
                own.append(at)
            self.of.append(own)
        self.doc = np.array(doc, np.int64)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.fuzzy = np.flatnonzero(self.sizes >= fuzzy)
        self.prints = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))

    def halves(self) -> np.ndarray:
        """Four fingerprints for each line that may have near ones: of its first and last half, for its own size and for one word less."""
        join, digest = b" ".join, xxhash.xxh64_intdigest
        out = np.empty((len(self.fuzzy), 4), np.uint64)
        for k, i in enumerate(self.fuzzy.tolist()):
            w = self.words[i]
            n = len(w)
            a, b = n // 2, (n - 1) // 2
            first, last = join(w[:a]), join(w[n - a :])
            if a == b:
                out[k] = digest(first, 2 * n), digest(last, 2 * n + 1), digest(first, 2 * n - 2), digest(last, 2 * n - 1)
            else:
                out[k] = digest(first, 2 * n), digest(last, 2 * n + 1), digest(join(w[:b]), 2 * n - 2), digest(join(w[n - b :]), 2 * n - 1)
        return out.ravel()

    def variants(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, role and line of each key of the lines ``at``; role 0: the whole line, k: without its k-th word."""
        sizes = self.sizes[at]
        total = int(sizes.sum())
        flat = np.fromiter((xxhash.xxh64_intdigest(w) for i in at.tolist() for w in self.words[i]), np.uint64, total)
        start = np.cumsum(sizes) - sizes
        place = np.arange(total) - np.repeat(start, sizes)
        power = np.full(int(sizes.max()) + 1 if len(sizes) else 1, _BASE, np.uint64)
        power[0] = 1
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(flat * np.cumprod(power, dtype=np.uint64)[place], out=sums[1:])
        whole = sums[start + sizes] - sums[start]
        before = sums[:-1] - np.repeat(sums[start], sizes)
        after = np.repeat(sums[start + sizes], sizes) - sums[1:]
        less = before + after * _INVERSE
        n = sizes.astype(np.uint64)
        keys = np.concatenate([B.mixed(whole + n * _STEP), B.mixed(less + np.repeat(n - np.uint64(1), sizes) * _STEP)])
        roles = np.concatenate([np.zeros(len(at), np.int64), place + 1])
        lines = np.concatenate([at, np.repeat(at, sizes)])
        # In the order of the lines, so that the first of equal entries is the earliest.
        order = np.argsort(lines, kind="stable")
        return keys[order], roles[order], lines[order]


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, deleted or substituted, or none, makes two lines equal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


def candidates(keys: np.ndarray, roles: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (entry, earlier entry): for each entry the earliest one with its key in a role that may make the lines near.

    A whole line looks for a line that comes to it without a word; a line without its k-th word
    for a whole one and for another without its k-th.
    """
    at = np.arange(len(keys))
    late = np.iinfo(np.int64).max

    def earliest(of: np.ndarray, some: np.ndarray) -> np.ndarray:
        """For each entry the position of the entry of its group with the least rank among some; -1 if there is none."""
        order = np.lexsort((np.where(some, ranks, late), of))
        start = np.concatenate([[True], of[order][1:] != of[order][:-1]])
        first = order[start]
        out = np.empty(len(of), np.int64)
        out[order] = np.where(some[first], first, -1)[np.cumsum(start) - 1]
        return out

    if not len(keys):
        return at, at
    whole = roles == 0
    _, key = np.unique(keys, return_inverse=True)
    _, both = np.unique(key * (roles.max() + 1) + roles, return_inverse=True)
    found = [np.where(whole, earliest(key, ~whole), earliest(key, whole)), np.where(whole, -1, earliest(both, ~whole))]
    entry, other = np.concatenate([at, at]), np.concatenate(found)
    keep = other >= 0
    keep[keep] = ranks[other[keep]] < ranks[entry[keep]]
    return entry[keep], other[keep]


def meet(table: pa.Table) -> pa.Table:
    """A bucket's candidates, sent to the blocks of the later lines: line, other block, other line."""
    table = table.sort_by("block")
    blocks = table.column("block").to_pylist()
    parts: list[tuple[np.ndarray, ...]] = []
    for n, payload in zip(table.column("entries").to_pylist(), table.column("payload").to_pylist(), strict=True):
        roles, at = B.unpacked_values(payload, 0, n)
        owners, at = B.unpacked_owners(payload, at, n)
        keys, at = B.unpacked_values(payload, at, n)
        parts.append((keys, roles.astype(np.int64), owners, B.unpacked_owners(payload, at, n)[0]))
    keys, roles, _, lines = (np.concatenate(p) for p in zip(*parts, strict=True))
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    entry, other = candidates(keys, roles, np.concatenate(B.ranked([p[2] for p in parts])))
    order = np.argsort(of[entry], kind="stable")
    entry, other = entry[order], other[order]
    rows = [(blocks[k], NEAR, table.column("bucket")[0].as_py(), b - a, _pairs(lines[entry[a:b]], np.array(blocks)[of[other[a:b]]], lines[other[a:b]])) for k, (a, b) in B.runs(of[entry]).items()]
    return B.answers(rows)


def _pairs(lines: np.ndarray, blocks: np.ndarray, others: np.ndarray) -> bytes:
    return np.unique(np.stack([lines, blocks, others], 1).astype("<i8"), axis=0).tobytes()


def _unpaired(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, "<i8").reshape(-1, 3)


def _wanted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, other_block, other_line) from a bucket's answers."""
    for batch in source:
        for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            pairs = np.unique(_unpaired(bits)[:, 1:], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(pairs), pa.int64()), pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["block", "other_block", "other_line"])


def cleaned(docs: DataFrame, least: int = 1, fuzzy: int = 5) -> DataFrame:
    """The input's rows and columns with the lines that stay as ``text``; null texts stay null."""
    return _applied(docs, least, fuzzy, whole_rows=True)


def without_repeats(docs: DataFrame, least: int = 1, fuzzy: int = 5) -> DataFrame:
    """Counts and digest of the lines that stay of every document."""
    return _applied(docs, least, fuzzy, whole_rows=False)


def _applied(docs: DataFrame, least: int, fuzzy: int, whole_rows: bool) -> DataFrame:
    stored = B.blocks(docs, more=whole_rows)
    buckets = B.buckets_for(stored)

    def ask_exact(block: B.Block) -> Iterator[pa.RecordBatch]:
        lines = Lines(block, least, fuzzy)
        exact = B.Entries(lines.prints, buckets)
        yield exact.asked(block.number, block.owners[lines.doc[exact.first]], level=EXACT)
        yield B.Entries(lines.halves(), buckets).asked(block.number, short=True, level=HALF)

    def settled(block: B.Block, known: pa.Table) -> tuple[Lines, np.ndarray, np.ndarray]:
        """The lines, which of them an equal one elsewhere precedes, and those that must be looked up further."""
        lines = Lines(block, least, fuzzy)
        exact = B.Entries(lines.prints, buckets)
        gone = exact.answered(known, EXACT).astype(bool)[exact.of]
        halves = B.Entries(lines.halves(), buckets)
        shared = halves.answered(known, HALF).astype(bool) | (np.bincount(halves.of, minlength=len(halves.values)) > 1)
        some = shared[halves.of].reshape(-1, 4).any(axis=1)
        return lines, gone, lines.fuzzy[some & ~gone[lines.fuzzy]]

    def near_entries(lines: Lines, at: np.ndarray) -> tuple[B.Entries, np.ndarray]:
        keys, roles, of = lines.variants(at)
        return B.Entries(roles.astype(np.uint64), buckets, keys, small=True), of

    def ask_near(block: B.Block, known: pa.Table) -> Iterator[pa.RecordBatch]:
        """Keys to their buckets, and the words of the lines that may be asked for."""
        lines, _, at = settled(block, known)
        entries, of = near_entries(lines, at)
        first = of[entries.first]
        yield entries.asked(block.number, block.owners[lines.doc[first]], level=NEAR, numbers=first)
        yield B.asked_rows(block.number, [(LINES, i, 0, b" ".join(lines.words[i])) for i in at.tolist()])

    asked = B.checkpoint(B.each(stored, ask_exact, B.ASKED))
    exact = B.ask(asked, EXACT, B.earlier, with_owners=True)
    first = B.checkpoint(B.with_level(exact, B.ask(asked, HALF, B.in_two_blocks)))
    asked = B.checkpoint(B.each_answered(stored, first, ask_near, B.ASKED))
    met = B.checkpoint(asked.where(F.col("level") == NEAR).groupBy("bucket").applyInArrow(meet, B.ANSWERS))
    wanted = met.select("block", "bits").mapInArrow(_wanted, "block long, other_block long, other_line long").distinct()
    words = asked.where(F.col("level") == LINES).select(F.col("block").alias("other_block"), F.col("bucket").cast("bigint").alias("other_line"), "payload")
    fetched = wanted.join(words, ["other_block", "other_line"])
    fetched = fetched.select("block", F.lit(FETCHED).alias("level"), F.col("other_line").cast("int").alias("bucket"), F.lit(0).alias("entries"), F.concat(F.unhex(F.lpad(F.hex("other_block"), 16, "0")), "payload").alias("bits"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    names = docs.columns

    def cut(block: B.Block, known: pa.Table) -> Iterator[pa.RecordBatch]:
        lines, gone, at = settled(block, known)
        entries, of = near_entries(lines, at)
        there: dict[tuple[int, int], list[bytes]] = {}
        pairs = []
        for row in known.filter(pa.compute.greater_equal(known["level"], NEAR)).to_pylist():
            if row["level"] == FETCHED:
                there[int.from_bytes(row["bits"][:8], "big"), row["bucket"]] = row["bits"][8:].split(b" ")
            elif row["level"] == NEAR:
                pairs.append(_unpaired(row["bits"]))
        words = lines.words
        for line, other_block, other in np.concatenate(pairs).tolist() if pairs else ():
            # What one candidate is not, no other need be: a key is shared by chance once in ages.
            if not gone[line] and within_one_edit(words[line], there[other_block, other]):
                gone[line] = True
        # In this block, of a key and role the first line stands for all; other lines are near it, or the other role's first.
        first_line = of[entries.first]
        entry, other = candidates(entries.heads, entries.values.astype(np.int64), first_line)
        for line, before in {*zip(first_line[entry].tolist(), first_line[other].tolist(), strict=True), *zip(of.tolist(), first_line[entries.of].tolist(), strict=True)}:
            if before < line and not gone[line] and within_one_edit(words[line], words[before]):
                gone[line] = True
        seen = gone.tolist()
        rows, kept_texts = [], []
        for doc_id, text, parts, own in zip(block.ids, block.texts, lines.lines, lines.of, strict=True):
            keep = []
            for part, at_line in zip(parts, own, strict=True):
                if at_line < 0 or not seen[at_line]:
                    keep.append(part)
                    if at_line >= 0:
                        seen[at_line] = True  # whatever equals it comes later
            removed = len(parts) - len(keep)
            kept = b"\n".join(keep) if removed else text
            kept_texts.append(kept)
            if not whole_rows:
                rows.append((doc_id, len(parts), removed, sha256(kept)))
        if whole_rows:
            was_null = block.table.column("text").is_null()
            text = pa.compute.if_else(was_null, pa.scalar(None, pa.string()), pa.chunked_array([pa.array([t.decode() for t in kept_texts], pa.string())]))
            yield from pa.table([text if c == "text" else block.table.column(c) for c in names], names=names).combine_chunks().to_batches()
        else:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    as_was = ", ".join(f"`{f.name}` {'bigint' if f.name == 'doc_id' else 'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    counts = "doc_id long, n_lines long, n_removed long, kept_sha256 string"
    return B.each_answered(stored, B.with_level(first, met, fetched), cut, as_was if whole_rows else counts)
