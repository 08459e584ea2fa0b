"""Best-fit packing of tokenised documents into sequences of a fixed length.

Every task packs what it reads, in one pass and in bounded space: a fixed number of
sequences is open at a time, and a bitset has bit ``f`` set while some open sequence has
``f`` tokens free. The smallest sufficient ``f`` is the lowest set bit at or above a piece's
length. When too many are open, the fullest (the lowest set bit) closes. Nothing is shuffled.

Defined cases: a null text is empty; a document always has its end id, so an empty one takes
one token; a null ``doc_id`` is kept as null; repeated rows are packed as often as they occur;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convmem.llm.common import documents, rebatched, task_number


class Bins:
    """Bounded-space best fit: at most ``most`` open sequences of ``capacity`` tokens."""

    def __init__(self, capacity: int, most: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.bits = 0
        self.open = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The sequence for a piece, and the piece's offset in it."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


class Encoder:
    """Ids of whole texts by a byte-level BPE of the ``tokenizers`` library.

    The vocabulary and merges of the library's file are given to a faster implementation of the
    same algorithm, which all tests find equal. Texts that it refuses, such as ones with very
    long runs of white space, are encoded by the library itself; all are, if the file's merges
    are not in the order of its ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.fast = _fast(json.load(f))

    def encode(self, text: str) -> np.ndarray:
        """The ids; strings of special tokens become these, as the library has it."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # too long a run for its pattern matcher
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


#: Fixed value: the pattern by which public byte-level BPE tokenisers part a text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _fast(file: dict):
    """The file's tokeniser for the ``tiktoken`` library, or None if it is of another kind."""
    import tiktoken

    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = not file["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    exact = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"])
    ids = model["vocab"]
    merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if not (plain and exact and model["type"] == "BPE" and not model.get("ignore_merges") and merged == sorted(merged)):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printed))}
    ranks = {bytes(byte[c] for c in token): i for token, i in ids.items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each file and worker, whatever the number of its tasks."""
    return Encoder(path)


def packed(docs: DataFrame, path: str, capacity: int = 2048, open_bins: int = 4096, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence of ``capacity`` tokens.

    A document is its ids and then ``end_id``. One of more than ``capacity`` tokens is cut into
    full pieces, the remainder first. ``with_ids`` adds the ids themselves (``ids``, binary).
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)
    end = np.array([end_id], "<u4").tobytes()

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        bins = Bins(capacity, open_bins, task_number() << 33)
        for batch in rebatched(source):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "").astype("<u4").tobytes() + end
                total = len(ids) // 4
                start, number = 0, 0
                while start < total:
                    length = (total % capacity or capacity) if start == 0 else capacity
                    own = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, number, start, length, zlib.crc32(own), *bins.place(length), *[own] * with_ids))
                    start, number = start + length, number + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return documents(docs).mapInArrow(pack, ", ".join(f"{n} {kinds[t]}" for n, t in fields))
