"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and these are put in an order from which the middle can be learnt.

Cuts lie between units: a run of ASCII letters, or any other single code point. A batch of texts
is worked on as a whole, by Arrow's compute functions: units are split into list arrays, the lists
are flattened with their parents' places, ordinals within the parents tell each unit's role, and
the units of a role are filtered, put back into lists and joined. Nothing is shuffled.

Which cuts and which form a document gets is drawn from the SHA-256 of a seed and its id, so that
reruns and retried tasks agree.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays as it is
(form ``plain``); a null ``doc_id`` draws as the empty string and is returned as null; repeated
rows give equal rows; an empty table gives an empty result; other columns are ignored. A text of
any length is one row of a batch; batches are bounded by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convmem.llm.common import documents, rebatched

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A unit in the bytes of a UTF-8 text: letters, or the bytes of one other code point.
UNIT = rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*"
#: A byte that no UTF-8 text holds.
BETWEEN = b"\xff"
#: Bytes of text in a batch: its units take some ten times as much for a while.
BATCH = 2 << 20


def drawn(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers that depend on the seed and the id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text, as lists; the texts' bytes come back when a list is joined."""
    ended = pc.replace_substring_regex(texts, UNIT, rb"\0" + BETWEEN)
    return pc.split_pattern(ended, BETWEEN)  # with an empty string after the last


def pieces(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """How many units each text has, and its pieces before, between and after two places drawn from 0 to that number."""
    lists = units(texts)
    sizes = pc.list_value_length(lists).to_numpy()
    n = sizes.astype(np.int64) - 1
    cuts = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    starts = np.cumsum(sizes.astype(np.int64)) - sizes
    ordinals = np.arange(len(values)) - starts[parents]
    roles = (ordinals >= cuts[0][parents]).astype(np.int8) + (ordinals >= cuts[1][parents])
    joined = []
    for role in range(3):
        mask = roles == role
        counts = np.bincount(parents[mask], minlength=len(texts))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        own = pa.ListArray.from_arrays(pa.array(offsets), values.filter(pa.array(mask)))
        joined.append(pc.binary_join(own, pa.scalar(b"", pa.binary())))
    return n, joined


def chars(data: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_length(data.cast(pa.string())), pa.int64())


def pasted(*parts: pa.Array | bytes) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in parts], pa.scalar(b"", pa.binary()))


def transformed(docs: DataFrame, rate: int = 90, spm_rate: int = 20, seed: str = "1") -> DataFrame:
    """``doc_id``, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output``.

    Of a hundred texts ``rate`` change, and of these ``spm_rate`` have the suffix first (form
    ``spm``), the others the prefix (``psm``).
    """
    numbers = [h.alias(f"h{k}") for k, h in enumerate(drawn(F.col("doc_id"), seed), 1)]

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(source, BATCH):
            texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
            n, (prefix, middle, suffix) = pieces(texts, h1, h2)
            marked = np.zeros(len(texts), bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (h3 % 100 >= rate)
            spm = h4 % 100 < spm_rate
            moved = pc.if_else(pa.array(spm), pasted(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), pasted(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
            output = pc.if_else(pa.array(plain), texts, moved)
            form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
            counts = [pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), chars(p)) for p in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), form, *counts, output.cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents(docs, *numbers).mapInArrow(cut, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _parted(texts: pa.Array, mark: bytes) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first mark; every text has one."""
    both = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(both, 0), pc.list_element(both, 1)


def restored(moved: DataFrame) -> DataFrame:
    """``text`` rebuilt from ``output`` and ``form`` alone; all other columns stay, but for one that is called ``text``.

    The pieces hold no sentinel, and none can arise where a piece and a sentinel meet, for only
    a sentinel's first character opens and only its last one closes.
    """
    moved = moved.drop("text")
    schema = StructType([*moved.schema.fields, StructField("text", StringType())])

    def rebuild(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(source, column="output"):
            form = batch.column("form")
            output = batch.column("output").cast(pa.binary())
            text = output
            for name, head, then in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
                own = pc.equal(form, name)
                some = output.filter(own)
                if len(some):
                    first, rest = _parted(_parted(some, head)[1], then)
                    second, middle = _parted(rest, MIDDLE)
                    prefix, suffix = (first, second) if name == "psm" else (second, first)
                    text = pc.replace_with_mask(text, own, pasted(prefix, middle, suffix))
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], names=[*batch.schema.names, "text"])

    return moved.mapInArrow(rebuild, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The operator and its inverse over every text, with the digests of what both return."""
    back = restored(transformed(docs))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
