"""Questions that blocks of documents ask of the whole corpus.

Substring and line de-duplication need to know, for each of many fingerprints in a document,
whether it also occurs somewhere else. Moving every occurrence to the place where its equals
meet would move more bytes than the texts have, and would gather all occurrences of a common
passage in one task. So documents are first put into *blocks* of some megabytes, written once
to the cluster's shared folder. A block then asks about each of its *distinct* fingerprints
once: sorted, shortened to a few bytes, dealt by value to *buckets*. A bucket thus gets at most
one entry per block for any fingerprint, however common it is. It answers each entry with one
or two bits, in the order in which the block, which can always compute its entries again, had
sent them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from convmem.llm.common import BATCH_BYTES, checkpoint, checkpoint_dealt, documents, rebatched, shuffle_partitions, task_number

#: Owner of an entry whose document has no id: later than all others.
NO_ID = np.iinfo(np.int64).max
ASKED = "level int, bucket int, block long, entries int, payload binary"
ANSWERS = "block long, level int, bucket int, entries int, bits binary"
_ANSWER = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("entries", pa.int32()), ("bits", pa.binary())])
_ASK = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("entries", pa.int32()), ("payload", pa.binary())])
_BLOB = pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("blob", pa.binary())])


def blocks(docs: DataFrame, size: int = BATCH_BYTES, more: bool = False) -> DataFrame:
    """Documents in blocks of one Arrow batch each, ordered by id within a block, compressed, written once and dealt by block.

    With ``more`` a block also holds the other columns of ``docs``.
    """

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = task_number() << 32
        for batch in rebatched(source, size):
            table = pa.Table.from_batches([batch]).sort_by("doc_id")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.combine_chunks())
            held = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_BLOB)
            number += 1

    others = [c for c in docs.columns if c not in ("doc_id", "text")] if more else []
    packed = documents(docs, *others).mapInArrow(pack, "block long, bytes long, blob binary")
    return checkpoint_dealt(packed, shuffle_partitions(docs.sparkSession), "block")


class Block:
    """The documents of one block: ids, owners (the ids with null as the largest) and texts as bytes."""

    def __init__(self, number: int, blob: bytes):
        self.table = table = pa.ipc.open_stream(blob).read_all()
        self.number = number
        self.ids: list[int | None] = table.column("doc_id").to_pylist()
        self.owners = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.texts: list[bytes] = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _blobs(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
        yield Block(number, blob)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit values (the finaliser of a public hash)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def bucket_of(prints: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit fingerprint, by its upper half."""
    return ((prints >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def runs(buckets: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each bucket's entries lie in an array that is in bucket order."""
    if not len(buckets):
        return {}
    start = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return {int(k): (int(a), int(b)) for k, a, b in zip(buckets[start], start, np.append(start[1:], len(buckets)), strict=True)}


# What a block asks -----------------------------------------------------------------------------


def asked_rows(block: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (level, bucket, entries, payload) of a block."""
    levels, buckets, entries, payloads = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(buckets, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(entries, pa.int32()), pa.array(payloads, pa.binary())], schema=_ASK)


class Entries:
    """Distinct fingerprints of one block in the order of (bucket, fingerprint)."""

    def __init__(self, prints: np.ndarray, buckets: int, heads: np.ndarray | None = None, small: bool = False):
        """prints: 64-bit fingerprints, one for each occurrence, in the order of the occurrences.

        heads: if given, entries are distinct pairs of head and fingerprint, dealt by head. With
        ``small`` the heads are sent whole, and the fingerprints are small numbers.
        """
        self.buckets, self.small = buckets, small
        if heads is None:
            self.values, self.first, self.of = np.unique(prints, return_index=True, return_inverse=True)
            self.heads = None
            dealt = self.values
        else:
            order = np.lexsort((prints, heads))
            values, tops = prints[order], heads[order]
            start = np.ones(len(order), bool)
            start[1:] = (values[1:] != values[:-1]) | (tops[1:] != tops[:-1])
            self.values, self.heads, self.first = values[start], tops[start], order[start]
            self.of = np.empty(len(order), np.int64)
            self.of[order] = np.cumsum(start) - 1
            dealt = self.heads
        # The bucket is a monotone function of what is dealt by, so entries in its order are in bucket order.
        self.runs = runs(bucket_of(dealt, buckets))

    def asked(self, block: int, owners: np.ndarray | None = None, short: bool = False, level: int = 0, numbers: np.ndarray | None = None) -> pa.RecordBatch:
        """A row for each bucket: the fingerprints, the owners of the entries, their heads and other numbers of theirs, packed."""
        more = (self.buckets - 1).bit_length()
        rows: list[tuple] = []
        for bucket, (a, b) in self.runs.items():
            values = self.values[a:b]
            payload = packed_owners(values.astype(np.int64)) if self.small else _packed_values(values, SHORT_BITS + more if short else 64)
            if owners is not None:
                payload += packed_owners(owners[a:b])
            if self.heads is not None:
                payload += _packed_values(self.heads[a:b], 64)
            if numbers is not None:
                payload += packed_owners(numbers[a:b])
            rows.append((level, bucket, b - a, payload))
        return asked_rows(block, rows)

    def answered(self, answers: pa.Table, level: int) -> np.ndarray:
        """The answer to each entry; entries of buckets that sent nothing are 0."""
        out = np.zeros(len(self.values), np.uint8)
        for of, bucket, n, bits in zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "entries", "bits")), strict=True):
            if of == level:
                a = self.runs[bucket][0]
                out[a : a + n] = unpacked_bits(bits, n)
        return out


def _packed_values(values: np.ndarray, bits: int) -> bytes:
    """Sorted values: all 64 bits, or fewer upper ones as differences in as few bytes as they take."""
    if bits >= 64:
        return b"\x08" + values.astype("<u8").tobytes()
    steps = np.diff((values >> np.uint64(64 - bits)).astype(np.int64), prepend=0)
    base, steps[0] = int(steps[0]), 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([16 + width]) + base.to_bytes(8, "little") + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


#: Bits of a short fingerprint besides those that choose the bucket. With a few million fingerprints in
#: a bucket, some in a hundred meet a different one by chance; they are told apart at the next level.
SHORT_BITS = 26


def unpacked_values(payload: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The values that start at a byte of the payload, and the byte after them."""
    width = payload[at]
    if width > 32:
        return unpacked_owners(payload, at, n)
    if width == 8:
        return np.frombuffer(payload, "<u8", n, at + 1).astype(np.uint64), at + 1 + 8 * n
    width -= 16
    base = int.from_bytes(payload[at + 1 : at + 9], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(payload, np.uint8, n * width, at + 9).reshape(n, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base), at + 9 + n * width


def packed_owners(owners: np.ndarray) -> bytes:
    least = int(owners.min())
    over = (owners - least).astype(np.uint64)
    kind = np.min_scalar_type(int(over.max()))
    return bytes([32 + kind.itemsize]) + least.to_bytes(8, "little", signed=True) + over.astype(kind).tobytes()


def unpacked_owners(payload: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = payload[at] - 32
    least = int.from_bytes(payload[at + 1 : at + 9], "little", signed=True)
    return np.frombuffer(payload, f"<u{size}", n, at + 9).astype(np.int64) + least, at + 9 + n * size


def _packed_bits(answers: np.ndarray) -> bytes:
    """One bit for each answer if none is over 1, else two."""
    if not answers.any():
        return b""
    return b"\x01" + np.packbits(answers).tobytes() if answers.max() <= 1 else b"\x02" + np.packbits(np.stack([answers & 1, answers >> 1], 1)).tobytes()


def unpacked_bits(bits: bytes, n: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.uint8)
    if bits[0] == 1:
        return np.unpackbits(np.frombuffer(bits, np.uint8, offset=1))[:n]
    both = np.unpackbits(np.frombuffer(bits, np.uint8, offset=1))[: 2 * n].reshape(n, 2)
    return both[:, 0] | (both[:, 1] << 1)


# What a bucket answers -------------------------------------------------------------------------

#: From the values, owners and heads that each block sent, in the order of the blocks, to its answers.
Decide = Callable[[list[np.ndarray], list[np.ndarray], list[np.ndarray]], list[np.ndarray]]


def in_two_blocks(values: list[np.ndarray], owners: list[np.ndarray], heads: list[np.ndarray]) -> list[np.ndarray]:
    """1 for a fingerprint that another block has, too."""
    _, of, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    return _split((count[of] > 1).astype(np.uint8), values)


def smaller_owner(values: list[np.ndarray], owners: list[np.ndarray], heads: list[np.ndarray]) -> list[np.ndarray]:
    """1 for a fingerprint that another block has for a smaller owner."""
    every, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((owner, every))
    every, sorted_owner = every[order], owner[order]
    start = np.concatenate([[True], every[1:] != every[:-1]])
    least = sorted_owner[start][np.cumsum(start) - 1]
    out = np.zeros(len(every), np.uint8)
    out[order] = least < sorted_owner
    return _split(out, values)


def ranked(owners: list[np.ndarray]) -> list[np.ndarray]:
    """Owners as ranks by (owner, block): of equal owners the earlier block's is less."""
    every = np.unique(np.concatenate(owners))
    return [np.searchsorted(every, o) * len(owners) + i for i, o in enumerate(owners)]


def earlier(values: list[np.ndarray], owners: list[np.ndarray], heads: list[np.ndarray]) -> list[np.ndarray]:
    """1 for a fingerprint that an earlier document has in another block."""
    return smaller_owner(values, ranked(owners), heads)


def _split(answers: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(answers, np.cumsum([len(v) for v in like])[:-1])


def answer_rows(table: pa.Table, level: int, decided: list[np.ndarray]) -> pa.Table:
    """What a bucket sends back to the blocks whose rows it got; nothing where all answers are 0."""
    bits = [_packed_bits(a) for a in decided]
    out = [table.column("block"), pa.array([level] * table.num_rows, pa.int32()), table.column("bucket"), table.column("entries"), pa.array(bits, pa.binary())]
    return pa.Table.from_arrays(out, schema=_ANSWER).filter(pa.array([bool(b) for b in bits]))


def answers(rows: list[tuple]) -> pa.Table:
    """Rows (block, level, bucket, entries, bits)."""
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ANSWER)], schema=_ANSWER)


def ask(asked: DataFrame, level: int, decide: Decide, with_owners: bool = False, with_heads: bool = False) -> DataFrame:
    """Answers to what the blocks asked, in rows that a block finds by its number."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        values, owners, heads = [], [], []
        sizes = table.column("entries").to_pylist()
        for n, payload in zip(sizes, table.column("payload").to_pylist(), strict=True):
            found, at = unpacked_values(payload, 0, n)
            values.append(found)
            if with_owners:
                found, at = unpacked_owners(payload, at, n)
                owners.append(found)
            if with_heads:
                heads.append(unpacked_values(payload, at, n)[0])
        return answer_rows(table, level, decide(values, owners, heads))

    return asked.where(F.col("level").isin(0, level)).groupBy("bucket").applyInArrow(bucket, ANSWERS)


def each(stored: DataFrame, run: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over every block."""

    def every(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for block in _blobs(batch):
                yield from run(block)

    return stored.mapInArrow(every, schema)


def each_answered(stored: DataFrame, answers: DataFrame, run: Callable[[Block, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over every block and the answers to it."""

    def every(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.Table.from_batches([b]) for block in _blobs(left) for b in run(block, right)]
        return pa.concat_tables(out) if out else empty

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(every, schema)


#: Bytes of text whose fingerprints a bucket gets, about: bounds what one call holds.
BUCKET_BYTES = 32 << 20


def buckets_for(stored: DataFrame) -> int:
    """Buckets in proportion to the bytes of text, as counted; no fewer than shuffle partitions.

    A block sends a row to no more buckets than it has entries, however many there are.
    """
    held = stored.agg(F.sum("bytes")).first()[0] or 0
    return max(shuffle_partitions(stored.sparkSession), -(-held // BUCKET_BYTES))


def with_level(answers: DataFrame, *more: DataFrame) -> DataFrame:
    for other in more:
        answers = answers.unionByName(other)
    return answers.select(*(F.col(c) for c in ("block", "level", "bucket", "entries", "bits")))
