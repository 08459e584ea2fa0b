"""Encoding and decoding with a SentencePiece vocabulary by a streaming Viterbi search.

The search goes over a text once. For every boundary between characters it keeps the best way to
reach it: the last piece, which points back to the boundary before. Only boundaries within the
longest piece's reach can still be extended, so only their paths survive; whenever all of them
run through one boundary, the ids up to it are final and are committed, and what lies before is
forgotten. Memory is bounded by the longest piece and the distance to the last such boundary.

What "best" means depends on the model. For a unigram model it is the greatest sum of scores. A
BPE model has an order of merges instead: there the way to reach a boundary is unique, its last
piece being the one that the piece before it would not have been merged with. With this rule the
search gives the ids of the library's own encoder.

Defined cases: null text is empty; empty text has no ids and decodes to empty text; characters
without a piece become their UTF-8 bytes' pieces; repeated rows are encoded one by one; a null id
is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.llm.common import documents, rebatched

SPACE = "▁"
#: Words whose ids a worker remembers, at most, and pairs of pieces.
REMEMBERED = 600_000
#: Characters between two looks for a boundary that all paths share; words of no more are remembered.
_LOOK = 64


class Vocabulary:
    """Pieces, scores and the kind of a SentencePiece model with byte pieces and a leading space."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.unigram = unigram
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.worst = min(self.score.values(), default=0.0) - 10.0  # the library's penalty for a character without a piece
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.rank = {p: -self.score[i] for p, i in self.ids.items()}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.pieces = {i: p for p, i in self.ids.items()}
        # Pieces that a search may use: of a BPE model those that their own text is merged to.
        self.usable = self.ids if unigram else {p: i for p, i in self.ids.items() if self.is_own(p)}
        # The lengths that usable pieces with a given ending of three characters have, longest first.
        ends: dict[str, set[int]] = {}
        for piece in self.usable:
            if len(piece) >= 3:
                ends.setdefault(piece[-3:], {1, 2}).add(len(piece))
        self.sizes = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        # No piece goes on with a space after another character, so words can be encoded apart.
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        odd = "\n" not in "".join(self.ids)
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart and odd else "(?s).+").findall
        self.joined: dict[int, bool] = {}
        # For decoding.
        self.text = [b""] * size
        for p, i in self.ids.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])

    # The rule of a BPE model -------------------------------------------------------------------

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece's own text is merged from at last; none for one that its text does not come to."""
        known = self.parts.get(piece, 0)
        if known == 0:
            parts, last = list(piece), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    rank = self.rank.get(parts[i] + parts[i + 1])
                    if rank is not None and (best is None or rank < best):
                        best, at = rank, i
                if at < 0:
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.parts[piece] = last if len(parts) == 1 else None
        return known

    def is_own(self, piece: str) -> bool:
        """Whether a piece's own text is merged to that piece."""
        return len(piece) == 1 or self._last_merge(piece) is not None

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge would have joined two pieces, given by id, across the boundary between them.

        The merges that made them are undone from the last one back: before each, what then stood
        on either side of the boundary must not have had an earlier merge; of equal ones the left
        goes first.
        """
        if len(self.joined) > REMEMBERED:
            self.joined.clear()
        known = self.joined[left << 32 | right] = self._apart(self.pieces[left], self.pieces[right])
        return known

    def _apart(self, left: str, right: str) -> bool:
        rank, bound, closed = self.rank, float("inf"), False
        while True:
            across = rank.get(left + right)
            if across is not None and (across < bound or (closed and across == bound)):
                return False
            a = rank[left] if len(left) > 1 else -1.0
            b = rank[right] if len(right) > 1 else -1.0
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, closed, left = a, False, self._last_merge(left)[1]
            else:
                bound, closed, right = b, True, self._last_merge(right)[0]


#: Instead of a piece's id: a character without a piece, and the beginning of the text.
_BYTES, _START = -1, -2


class Search:
    """The best way to reach each boundary of a text, from ``base`` on: where its last piece starts, the piece, the score.

    What is known of a boundary depends on the text before it only, so texts that begin alike
    share it.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.base = 0
        self.start, self.piece, self.score = [0], [_START], [0.0]

    def extend(self, text: str, last: int) -> None:
        """All boundaries up to ``last``."""
        (self._unigram if self.v.unigram else self._bpe)(text, last)

    def _bpe(self, text: str, last: int) -> None:
        v, start, piece, base = self.v, self.start, self.piece, self.base
        usable, sizes, joined, apart = v.usable, v.sizes, v.joined, v.stays_apart
        for i in range(base + len(start), last + 1):
            for size in sizes.get(text[i - 3 : i], (2, 1)) if i >= 3 else (2, 1):
                j = i - size
                if j < base:
                    continue
                found = usable.get(text[j:i])
                if found is None:
                    continue
                left = piece[j - base]
                if left >= 0:
                    ok = joined.get(left << 32 | found)
                    if not (apart(left, found) if ok is None else ok):
                        continue
                start.append(j)
                piece.append(found)
                break
            else:  # a character without a piece
                start.append(i - 1)
                piece.append(_BYTES)

    def _unigram(self, text: str, last: int) -> None:
        v, base = self.v, self.base
        for i in range(base + len(self.start), last + 1):
            best = None
            for size in v.sizes.get(text[i - 3 : i], (2, 1)) if i >= 3 else (2, 1):
                j = i - size
                found = v.usable.get(text[j:i]) if j >= base else None
                if found is not None:
                    total = self.score[j - base] + v.score[found]
                    if best is None or total > best[2]:
                        best = (j, found, total)
            worst = self.score[i - 1 - base] + v.worst
            if text[i - 1] not in v.ids and (best is None or worst > best[2]):
                best = (i - 1, _BYTES, worst)
            for held, new in zip((self.start, self.piece, self.score), best, strict=True):
                held.append(new)

    def cut(self, length: int) -> None:
        """Forget the boundaries after a text's first ``length`` characters."""
        del self.start[length + 1 :], self.piece[length + 1 :], self.score[length + 1 :]

    def shared(self, last: int, whole: bool) -> int:
        """The last boundary that all paths run through which can still be extended; at the end of the text there is one path."""
        live = {last} if whole else set(range(max(self.base, last - self.v.longest + 1), last + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.start[top - self.base])
        return live.pop()

    def ids(self, text: str, to: int) -> list[int]:
        """The ids on the way from ``base`` to a boundary."""
        start, piece, base = self.start, self.piece, self.base
        out: list[int] = []  # from the last one back
        while to > base:
            at, found = start[to - base], piece[to - base]
            if found >= 0:
                out.append(found)
            else:
                out += [self.v.bytes[b] for b in reversed(text[at:to].encode())]
            to = at
        out.reverse()
        return out

    def commit(self, to: int) -> None:
        """What lies before a boundary is final: of it only the boundary's last piece and score are kept."""
        for held in (self.start, self.piece, self.score):
            del held[: to - self.base]
        self.base = to


def viterbi(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """The ids of a text in runs, each committed as soon as it is final."""
    search, n = Search(v), len(text)
    for last in range(min(_LOOK, n), n + _LOOK, _LOOK):
        last = min(last, n)
        search.extend(text, last)
        to = search.shared(last, last == n)
        if to > search.base:
            yield search.ids(text, to)
            search.commit(to)
        if last == n:
            return


class _Known(dict):
    """Ids of words; those of a word that is not remembered are searched when asked for."""

    def __missing__(self, word: str) -> bytes:
        return self.search(word)


class Coder:
    """Ids of whole texts, and texts of ids."""

    def __init__(self, path: str, unigram: bool = False):
        self.v = Vocabulary(path, unigram)
        self.known = _Known()
        self.known.search = self._long
        self.text = pa.array(self.v.text, pa.binary())

    def learn(self, words: Iterable[str]) -> None:
        """Remember the ids of short words. In order, so that a word goes on from what the one before shares with it."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        search, before = Search(self.v), ""
        for word in sorted(words):
            same = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                same += 1
            search.cut(same)
            search.extend(word, len(word))
            self.known[word] = array("I", search.ids(word, len(word))).tobytes()
            before = word

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.v.split((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()  # before the batch's words are looked up, so that none of them goes
        self.learn([w for w in set().union(*split) if w not in known and len(w) <= _LOOK])
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _long(self, word: str) -> bytes:
        return array("I", [i for run in viterbi(word, self.v) for i in run]).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def bytes_of(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids, without the leading space: what ``decode`` makes texts of, for many at once."""
        ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int64)
        found = self.text.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        at = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1][ends].tolist()
        data = found.buffers()[2].to_pybytes() if len(found) else b""
        return [data[x + (data[x : x + 1] == b" " and x < y) : y] for x, y in zip(at, at[1:], strict=False)] if len(found) else [b""] * len(ids)

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the leading space that encoding put there."""
        data = b"".join(map(self.v.text.__getitem__, array("I", ids)))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder_of(path: str, unigram: bool = False) -> Coder:
    """One for each model and worker, whatever the number of its tasks."""
    return Coder(path, unigram)


def encoded(docs: DataFrame, path: str, unigram: bool = False) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit ids of every text."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, unigram)
        for batch in rebatched(source):
            ids = coder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id bigint, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in rebatched(source, column="ids"):
            texts = [coder.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def _measured(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
    n, crc, back, same = [], [], [], []
    texts = [t or "" for t in batch.column("text").to_pylist()]
    every = coder.encode_all(texts)
    for text, ids, data in zip(texts, every, coder.bytes_of(every), strict=True):
        equal = data == text.encode()
        if not equal:  # what is no UTF-8 is replaced
            again = data.decode("utf-8", "replace")
            equal, data = again == text, again.encode()
        n.append(len(ids) // 4)
        crc.append(zlib.crc32(ids))
        back.append(zlib.crc32(data))
        same.append(equal)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "same"])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, same): encodes and decodes every text in one pass."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in rebatched(source):
            yield _measured(coder, batch)

    return documents(docs).mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_crc32 bigint, same boolean")
