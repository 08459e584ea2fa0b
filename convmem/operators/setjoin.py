"""Joins of token sets by Jaccard similarity, between a probing and a target role, inside blocks.

Equal sets of a block are one row with a number, so copies do not multiply. Tokens are coded as
integers in the order of their frequency in the block, rare ones first. Two sets of similarity s
share a token among the first few of each (prefix filter); their sizes are near (length filter);
what follows the first shared token is long enough (positional filter); and a signature of 256
parity bits, each of which differs only if the sets differ, bounds the difference (the part a
suffix filter plays, as one expression). Only what passes all of that is compared, as sorted integers.

Where a block does not stay small, candidates are not written: ``similar_in_tiles`` (long sets) and
``similar_by_word_pairs`` (short ones) compare two tiles of a block in a task, which returns what it finds.
A tile is packed once, into its words and a byte or two for each token, and is sent packed to the tasks that need it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convmem.operators.graph import checkpoint

#: Words of 64 parity bits of a signature.
SIGNATURE = 4

#: Bytes of a row that holds a piece of a packed tile, and pairs of a batch that a task returns.
PIECE, FOUND = 4 << 20, 1 << 17


def numbered_sets(rows: DataFrame) -> DataFrame:
    """(block, set_id, t, probe, target): the distinct sets of each block. rows: (block, t: sorted array of distinct tokens, probe, target)."""
    sets = rows.where(F.size("t") > 0).groupBy("block", "t").agg(F.max("probe").alias("probe"), F.max("target").alias("target"))
    return checkpoint(sets.withColumn("set_id", F.monotonically_increasing_id()))


def _coded(sets: DataFrame) -> DataFrame:
    """(block, set_id, probe, target, size, c): sets as integers, in the order of their tokens' frequency."""
    words = sets.select("block", "set_id", F.explode("t").alias("w"))
    counts = words.groupBy("block", "w").agg(F.count("*").alias("n"))
    codes = checkpoint(counts.repartitionByRange("n", "block", "w").sortWithinPartitions("n", "block", "w").select("block", "w", F.monotonically_increasing_id().alias("c")))
    coded = words.join(codes, ["block", "w"]).groupBy("set_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return sets.select("block", "set_id", "probe", "target", F.size("t").alias("size")).join(coded, "set_id")


def _signature(codes: Column) -> list[Column]:
    """Each token turns over one bit."""
    spread = F.transform(codes, lambda x: F.xxhash64(x))
    bit = lambda k: F.aggregate(
        F.filter(spread, lambda h: F.shiftrightunsigned(h, 62) == k), F.lit(0).cast("bigint"), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (h.bitwiseAND(63)).cast("int")))
    )
    return [bit(k) for k in range(SIGNATURE)]


def candidates(coded: DataFrame, least: float | Column) -> DataFrame:
    """(x, y): pairs x < y, of a probing and a target set, that pass all filters. ``least`` may be a column made of ``block``."""
    prefix = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
    signed = coded.withColumns({f"g{k}": g for k, g in enumerate(_signature(F.col("c")))})
    index = signed.select("block", "set_id", "probe", "target", "size", *[f"g{k}" for k in range(SIGNATURE)], F.posexplode(F.slice("c", F.lit(1), prefix)).alias("at", "w"))
    other = index.select("block", "w", *[F.col(c).alias(f"{c}_") for c in ("set_id", "probe", "target", "size", "at", *[f"g{k}" for k in range(SIGNATURE)])])
    least = least if isinstance(least, Column) else F.lit(least)
    both = index.join(other, ["block", "w"]).where("set_id < set_id_ and ((probe and target_) or (target and probe_))")
    total = F.col("size") + F.col("size_")
    needed = F.ceil(total * least / (1 + least) - 1e-9)
    after = F.least(F.col("size") - F.col("at"), F.col("size_") - F.col("at_"))
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"g{k}").bitwiseXOR(F.col(f"g{k}_"))) for k in range(SIGNATURE)))
    passed = both.where((F.least("size", "size_") >= F.greatest("size", "size_") * least - 1e-9) & (after >= needed) & (total - differ >= 2 * needed))
    return passed.select(F.col("set_id").alias("x"), F.col("set_id_").alias("y")).distinct()


def similar(sets: DataFrame, least: float | Column) -> DataFrame:
    """(a, b, similarity): every probing set with each target set of its block at ``least`` or more; a set that is both, with itself too. ``least`` may be a column made of ``block``."""
    coded = checkpoint(_coded(sets))
    near = candidates(coded, least)
    for side in ("x", "y"):
        near = near.join(coded.select(*["block"] * (side == "x"), F.col("set_id").alias(side), F.col("c").alias(f"c{side}"), F.col("probe").alias(f"p{side}"), F.col("target").alias(f"t{side}")), side)
    shared = F.size(F.array_intersect("cx", "cy"))
    found = near.withColumn("similarity", shared / (F.size("cx") + F.size("cy") - shared)).where(F.col("similarity") >= (least - 1e-12 if isinstance(least, Column) else least))
    ways = F.filter(F.array(F.when(F.expr("px and ty"), F.struct(F.col("x").alias("a"), F.col("y").alias("b"))), F.when(F.expr("py and tx"), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))), lambda p: p.isNotNull())
    found = found.select(F.explode(ways).alias("p"), "similarity").select("p.a", "p.b", "similarity")
    return found.unionByName(sets.where("probe and target").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("similarity")))


def _overlaps(x: tuple, y: tuple, least: float, same: bool) -> tuple[np.ndarray, ...]:
    """(rows of x, rows of y, shared tokens) of two runs of sets that are ``least`` alike. A run: (starts and end, tokens); tokens are small integers, sorted in each set.

    Tokens are counted in buckets, and the product of two sets' counts is never less than what they share; what passes that bound is counted exactly.
    """
    (p, a), (q, b) = x, y
    n, m = np.diff(p), np.diff(q)
    width = 1 << int(np.ceil(np.log2(max(1024, 4 * min(n.max(), m.max(), 4096)))))
    counts = lambda at, t: np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)) * width + t % width, minlength=(len(at) - 1) * width).astype(np.float32).reshape(-1, width)
    total = n[:, None] + m
    needed = np.ceil(total * least / (1 + least) - 1e-9)
    fit = np.minimum(n[:, None], m) >= np.maximum(n[:, None], m) * least - 1e-9
    i, j = np.nonzero(fit & (counts(p, a) @ counts(q, b).T >= needed - 0.5))
    if same:
        i, j = i[i < j], j[i < j]
    space = int(max(a.max(), b.max())) + 1
    there = np.repeat(np.arange(len(m)), m) * space + b
    shared = np.zeros(len(i), np.int64)
    step = max(1, 2_000_000 // int(n.max()))
    for at in range(0, len(i), step):
        r, c = i[at : at + step], j[at : at + step]
        size = n[r]
        ends = np.cumsum(size)
        own = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(p[r], size)
        wanted = np.repeat(c, size) * space + a[own]
        place = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        shared[at : at + step] = np.add.reduceat((there[place] == wanted).astype(np.int64), ends - size)
    hit = shared / (n[i] + m[j] - shared) >= least
    return i[hit], j[hit], shared[hit]


def _lists(words: pa.ChunkedArray) -> pa.ListArray:
    lists = pc.split_pattern(words, " ").combine_chunks()
    return lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists


def _codes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(sizes, tokens, words): sets as the places of their words in ``words``, sorted in each set, frequent words first."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-np.bincount(token, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return size, _in_order(size, rank[token]), coded.dictionary.take(pa.array(order))


def _in_order(size: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Tokens sorted in each set."""
    both = np.repeat(np.arange(len(size)) << 32, size) | token
    both.sort()
    return both & 0xFFFFFFFF


def _pack(keys: pa.Array, size: np.ndarray, token: np.ndarray, words: pa.Array) -> bytes:
    """Tokens go as their steps, byte by byte of equal weight, as most of these are nought."""
    step = np.diff(token, prepend=0)
    at = np.cumsum(size) - size
    step[at] = token[at]
    planes = np.ascontiguousarray(step.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    blob = pickle.dumps((keys, size.astype(np.int32), words, planes))
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    keys, size, words, planes = pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    size = size.astype(np.int64)
    run = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
    at = np.cumsum(size) - size
    return keys, size, run - np.repeat(np.concatenate([[0], run[at[1:] - 1]]), size), words


def _packed(table: pa.Table) -> pa.Table:
    """A tile's rows (set_id, words) as pieces: (its other columns, piece, packed)."""
    keys = table.column("set_id").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    blob = _pack(keys, *_codes(_lists(table.column("words"))))
    pieces = [blob[at : at + PIECE] for at in range(0, len(blob), PIECE)]
    own = [c for c in table.column_names if c not in ("set_id", "words")]
    first = pa.array(np.zeros(len(pieces), np.int64))
    return pa.table({**{c: table.column(c).take(first) for c in own}, "piece": pa.array(range(len(pieces)), pa.int32()), "packed": pa.array(pieces, pa.binary())})


def _two_tiles(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sizes, tokens, first) of the sets of one packed tile or of two, in the words of both; ``first`` is true for the first tile's."""
    keys, sizes, tokens, words, heads = [], [], [], [], []
    for head in (True, False):
        part = table.filter(pc.equal(table.column("first"), head)).sort_by("piece")
        if part.num_rows:
            k, n, t, w = _unpack(b"".join(part.column("packed").to_pylist()))
            keys.append(k), sizes.append(n), tokens.append(t), words.append(w), heads.append(np.full(len(n), head))
    if len(words) == 2:
        coded = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tokens[1] = _in_order(sizes[1], coded[len(words[0]) :][tokens[1]])
    return pa.concat_arrays(keys), np.concatenate(sizes), np.concatenate(tokens), np.concatenate(heads)


def _runs(which: np.ndarray, size: np.ndarray, token: np.ndarray, start: np.ndarray, run: int) -> list[tuple]:
    """(sets, starts and end, tokens): sets of like size in runs, each with its own tokens."""
    which = which[np.argsort(size[which], kind="stable")]
    out = []
    for at in range(0, len(which), run):
        part = which[at : at + run]
        ends = np.concatenate([[0], np.cumsum(size[part])])
        out.append((part, ends, token[np.arange(ends[-1]) + np.repeat(start[part] - ends[:-1], size[part])]))
    return out


def _alike(size: np.ndarray, token: np.ndarray, head: np.ndarray, least: float, run: int) -> Iterator[tuple]:
    """(x, y, shared tokens) of the sets of one tile, or of the two, that are ``least`` alike, run by run."""
    start = np.cumsum(size) - size
    left = _runs(np.flatnonzero(head), size, token, start, run)
    one = bool(head.all())
    right = left if one else _runs(np.flatnonzero(~head), size, token, start, run)
    for g, x in enumerate(left):
        for y in right[g * one :]:
            small, large = sorted(((size[x[0][0]], size[x[0][-1]]), (size[y[0][0]], size[y[0][-1]])))
            if small[1] >= large[0] * least - 1e-9:
                i, j, shared = _overlaps(x[1:], y[1:], least, x is y)
                yield x[0][i], y[0][j], shared


def _forest(n: int, pairs: Iterator[tuple]) -> Iterator[tuple]:
    """Of pairs among ``n`` sets those that join two trees."""
    up = np.arange(n)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    for u, v, shared in pairs:
        while (up[up] != up).any():
            up = up[up]
        kept = []
        for k in np.flatnonzero(up[u] != up[v]).tolist():
            x, y = root(u[k]), root(v[k])
            if x != y:
                up[y] = x
                kept.append(k)
        yield u[kept], v[kept], shared[kept]


def _rows(block: pa.Scalar, keys: pa.Array, size: np.ndarray, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """(block, a, b, similarity), a < b, in batches."""
    for u, v, shared in found:
        for at in range(0, len(u), FOUND):
            x, y, n = u[at : at + FOUND], v[at : at + FOUND], shared[at : at + FOUND]
            a, b = keys.take(pa.array(x)), keys.take(pa.array(y))
            less = pc.less(a, b)
            yield pa.RecordBatch.from_arrays([pa.repeat(block, len(x)), pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(n / (size[x] + size[y] - n))], ["block", "a", "b", "similarity"])


def similar_sets(sizes: DataFrame, texts: DataFrame, least: float, forest: bool = False, rows_per_tile: int = 65_536, tokens_per_tile: int = 8_000_000, run: int = 1024) -> DataFrame:
    """(block, a, b, similarity): every two sets of a block at ``least`` or more, a < b; with ``forest`` only so many of them as connect what is connected.

    A small block is one task. Sets of others go to tiles by their size and a hash; a task compares two tiles whose sizes are near
    enough and returns only what it finds, so no candidate is written. sizes: (block, set_id, size), checkpointed, equal sets once;
    texts: (block, set_id, words: the words, none with a blank, joined by one) of these sets, of which others are left out.
    """
    sizes = sizes.withColumn("k", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / least)) * (1 - 1e-6)).cast("int"))
    steps = checkpoint(sizes.groupBy("block", "k").agg(F.count("*").alias("sets"), F.sum("size").alias("tokens")))
    small = steps.groupBy("block").agg(((F.sum("sets") <= rows_per_tile / 8) & (F.sum("tokens") <= tokens_per_tile / 8)).alias("small"))
    n = F.ceil(F.greatest(F.col("sets") / rows_per_tile, F.col("tokens") / tokens_per_tile)).cast("int")
    plan = checkpoint(steps.join(small, "block").select("block", "k", F.when(F.col("small"), 0).otherwise(n).alias("n")))
    rows = sizes.join(plan, ["block", "k"]).select("block", "set_id", "k", F.when(F.col("n") > 0, F.pmod(F.xxhash64("set_id"), F.col("n"))).cast("int").alias("i"))
    # The rows without texts are the hashed side, so texts are not sorted.
    dealt = texts.join(rows.hint("shuffle_hash"), ["block", "set_id"])
    block, key = dealt.schema["block"].dataType, dealt.schema["set_id"].dataType
    result = T.StructType().add("block", block).add("a", key).add("b", key).add("similarity", "double")

    def found(keys: pa.Array, size: np.ndarray, token: np.ndarray, head: np.ndarray, block: pa.Scalar) -> Iterator[pa.RecordBatch]:
        pairs = _alike(size, token, head, least, run)
        return _rows(block, keys, size, _forest(len(size), pairs) if forest else pairs)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        size, token, _ = _codes(_lists(table.column("words")))
        return found(pa.concat_arrays(table.column("set_id").chunks), size, token, np.ones(len(size), bool), table.column("block")[0])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        return found(*_two_tiles(table), table.column("block")[0])

    out = dealt.where("i is null").select("block", "set_id", "words").groupBy("block").applyInArrow(alone, result)
    tiles = plan.where("n > 0").select("block", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    many = tiles.count()
    if not many:
        return out
    # Sizes a factor 1 / least apart are less than one step apart, so the same step and the next are enough.
    pairs = checkpoint(tiles.join(tiles.select("block", F.col("k").alias("l"), F.col("i").alias("j")), "block").where("l between k and k + 1 and (l > k or j >= i)"))
    # Tasks are long and their input is small, so their number is given, lest they be put together by bytes.
    tasks = lambda n: min(max(n, 1), 10_000)
    packed = dealt.where("i is not null").select("block", "k", "i", "set_id", "words").repartition(tasks(many), "block", "k", "i").groupBy("block", "k", "i").applyInArrow(_packed, T.StructType().add("block", block).add("k", "integer").add("i", "integer").add("piece", "integer").add("packed", "binary"))
    packed = checkpoint(packed)
    first = packed.join(pairs, ["block", "k", "i"]).select("block", "k", "i", "l", "j", "piece", "packed", F.lit(True).alias("first"))
    second = packed.withColumnsRenamed({"k": "l", "i": "j"}).join(pairs.where("l > k or j > i"), ["block", "l", "j"]).select("block", "k", "i", "l", "j", "piece", "packed", F.lit(False).alias("first"))
    both = first.unionByName(second).repartition(tasks(pairs.count()), "block", "k", "i", "l", "j").groupBy("block", "k", "i", "l", "j").applyInArrow(compare, result)
    return both if plan.where("n = 0").isEmpty() else out.unionByName(both)


def similar_in_tiles(sets: DataFrame, least: float, rows_per_tile: int = 65_536, tokens_per_tile: int = 8_000_000, run: int = 1024) -> DataFrame:
    """(a, b, similarity): every two sets of a block at ``least`` or more, a < b, for long sets of words that many have, where a prefix leaves more pairs than there are.

    sets: (block, set_id, t: words without blanks), equal sets once; see ``similar_sets``.
    """
    sizes = checkpoint(sets.select("block", "set_id", F.size("t").alias("size")))
    return similar_sets(sizes, sets.select("block", "set_id", F.array_join("t", " ").alias("words")), least, False, rows_per_tile, tokens_per_tile, run).select("a", "b", "similarity")


def _prefix_keys(p: np.ndarray, size: np.ndarray, token: np.ndarray, which: np.ndarray, length: np.ndarray, width: int, space: int, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, set, tokens after it): every choice of ``width`` tokens (1 or 2) among the first ``length`` ones of the sets ``which``, without tokens that only one set has."""
    keys, sets, after = [], [], []
    for n in np.unique(length):
        rows = which[length == n]
        at = np.triu_indices(n, 1) if width == 2 else (np.arange(n), np.arange(n))
        step = max(1, 4_000_000 // max(1, len(at[0])))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            t = token[p[part][:, None] + np.arange(n)]
            i, j = np.nonzero(often[t[:, at[0]]] & often[t[:, at[1]]])
            first, second = at[0][j], at[1][j]
            keys.append(t[i, first] * space + t[i, second] if width == 2 else t[i, first])
            sets.append(part[i].astype(np.int32))
            after.append((size[part[i]] - 1 - second).astype(np.int32))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(after)


def _cuts(costs: np.ndarray, most: int) -> list[slice]:
    """Runs of rows whose costs come to no more than ``most``, but for single rows."""
    ends = np.cumsum(costs)
    out, at = [], 0
    while at < len(costs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out.append(slice(at, to))
        at = to
    return out


def _tile_pairs(p: np.ndarray, token: np.ndarray, tile: np.ndarray, one: bool, least: float, most: int = 48, keys_at_once: int = 4_000_000) -> tuple[np.ndarray, ...]:
    """(x, y, shared tokens) of the sets of one tile (``one``), or of a tile (``tile`` is true) with the other, that are ``least`` alike. Set x has tokens p[x] to p[x + 1], rare ones first; sets are in the order of their sizes.

    Two sets that must share two tokens have the first two that they share among the first few of each, fewer in the smaller one; these
    two are the key they meet by. A single token is, where sharing one is enough, or the larger set has more than ``most`` tokens.
    """
    size = np.diff(p)
    sets = np.arange(len(size))
    space = int(token.max()) + 1
    often = np.bincount(token, minlength=space) > 1
    need = lambda n, m: np.ceil((n + m) * least / (1 + least) - 1e-9).astype(np.int64)
    widest = np.floor(size / least + 1e-9).astype(np.int64)  # of those that a set can be the smaller one of
    enough = np.floor((1 + 1e-9) * (1 + least) / least).astype(np.int64) - size  # up to here one shared token is
    owner = np.repeat(sets, size)
    bits = np.random.default_rng(7).integers(0, 128, space)
    signs = []
    for word in range(2):
        mine = np.where(bits[token] // 64 == word, np.uint64(1) << (bits[token] % 64).astype(np.uint64), np.uint64(0))
        signs.append(np.bitwise_xor.reduceat(mine, p[:-1]))
    there = np.sort(owner * space + token)
    out = [np.empty((3, 0), np.int64)]

    def meet(x: np.ndarray, y: np.ndarray, width: int, low: np.ndarray, high: np.ndarray) -> None:
        """Sets x with sets y of ``low`` to ``high`` tokens (given for each x)."""
        ok = (low <= high) & (size[x] >= width)
        x, low, high = x[ok], low[ok], high[ok]
        y = y[(size[y] >= low.min()) & (size[y] <= high.max())] if len(x) else y[:0]
        if not len(y):
            return
        top = int(high.max()) + 1
        bounds = np.zeros((2, len(size)), np.int64)
        bounds[0, x], bounds[1, x] = low, high
        short = lambda of, least_shared: np.minimum(size[of], size[of] - np.maximum(width, least_shared) + width)
        prefix_x, prefix_y = short(x, need(size[x], low)), short(y, np.ceil(size[y] * least - 1e-9).astype(np.int64))
        for ly in _cuts(prefix_y**width, keys_at_once):
            lk, ls, la = _prefix_keys(p, size, token, y[ly], prefix_y[ly], width, space, often)
            lk = lk * top + size[ls]
            o = np.argsort(lk, kind="stable")
            lk, ls, la = lk[o], ls[o], la[o]
            for lx in _cuts(prefix_x**width, keys_at_once):
                sk, ss, sa = _prefix_keys(p, size, token, x[lx], prefix_x[lx], width, space, often)
                o = np.argsort(sk)
                sk, ss, sa = sk[o], ss[o], sa[o]
                start = np.searchsorted(lk, sk * top + bounds[0, ss])
                many = np.searchsorted(lk, sk * top + bounds[1, ss], "right") - start
                some = many > 0
                start, many, ss, sa = start[some], many[some], ss[some], sa[some]
                ends = np.cumsum(many)
                for at in range(0, int(ends[-1]) if len(ends) else 0, keys_at_once):
                    to = min(at + keys_at_once, int(ends[-1]))
                    lo, hi = np.searchsorted(ends, [at, to - 1], "right")
                    part = slice(lo, hi + 1)
                    skip = at - (ends[lo] - many[lo])
                    n = many[part].copy()
                    n[0] -= skip
                    n[-1] -= ends[hi] - to
                    first = start[part].copy()
                    first[0] += skip
                    stop = np.cumsum(n)
                    e = np.arange(to - at) + np.repeat(first - stop + n, n)
                    found(np.repeat(ss[part], n), np.repeat(sa[part], n), e, ls, la, width)

    def found(u: np.ndarray, left: np.ndarray, e: np.ndarray, ls: np.ndarray, la: np.ndarray, width: int) -> None:
        v = ls[e]
        total = size[u] + size[v]
        needed = need(size[u], size[v])
        ok = (u < v) & (np.minimum(left, la[e]) + width >= needed)
        u, v, total, needed = u[ok], v[ok], total[ok], needed[ok]
        for g in signs:
            ok = total - np.bitwise_count(g[u] ^ g[v]) >= 2 * needed
            u, v, total, needed = u[ok], v[ok], total[ok], needed[ok]
        ok = total - np.bitwise_count(signs[0][u] ^ signs[0][v]).astype(np.int64) - np.bitwise_count(signs[1][u] ^ signs[1][v]) >= 2 * needed
        both = np.unique(u[ok].astype(np.int64) * len(size) + v[ok])
        step = max(1, keys_at_once // int(size.max()))
        for k in range(0, len(both), step):
            i, j = np.divmod(both[k : k + step], len(size))
            n = size[i]
            stop = np.cumsum(n)
            wanted = np.repeat(j, n) * space + token[np.arange(stop[-1]) + np.repeat(p[i] - stop + n, n)]
            shared = np.add.reduceat((there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted).astype(np.int64), stop - n)
            hit = shared / (n + size[j] - shared) >= least
            out.append(np.stack([i[hit], j[hit], shared[hit]]))

    for x, y in ((sets, sets),) if one else ((sets[tile], sets[~tile]), (sets[~tile], sets[tile])):
        meet(x, y, 1, size[x], np.minimum(enough[x], widest[x]))
        meet(x, y, 1, np.maximum(np.maximum(size[x], enough[x] + 1), most + 1), widest[x])
        meet(x, y, 2, np.maximum(size[x], enough[x] + 1), np.minimum(widest[x], most))
    x, y, shared = np.concatenate(out, 1)
    once = np.unique(x * len(size) + y, return_index=True)[1]
    return x[once], y[once], shared[once]


def similar_by_word_pairs(sets: DataFrame, least: float, tokens_per_tile: int = 4_000_000) -> DataFrame:
    """(block, a, b, similarity): every two sets of a block at ``least`` or more, a < b, for short sets in blocks of any size.

    Sets go to tiles by a hash, each packed once; a task compares two tiles of a block and returns only what it finds, so no candidate is written.
    sets: (block, set_id: bigint, words: the distinct words in order, none with a blank, joined by one); equal sets are one, by the least id.
    Words are sent once, straight to their tile, so ``sets`` is read twice: first for the number of tiles, which copies raise.
    """
    rows = sets.withColumn("size", F.size(F.split("words", " ")))
    tiles = checkpoint(rows.groupBy("block").agg(F.ceil(F.sum("size") / tokens_per_tile).cast("int").alias("n")))
    counts = tiles.agg(F.sum("n"), F.sum(F.expr("n * (n + 1) / 2"))).first()
    # Tasks are long and their input is small, so their number is given, lest they be put together by bytes.
    tasks = [int(min(max(n or 1, 1), 10_000)) for n in counts]
    rows = rows.join(tiles, "block").select("block", "n", F.pmod(F.xxhash64("words"), F.col("n")).cast("int").alias("tile"), "set_id", "words")
    kind = dict(sets.dtypes)["block"]
    once = rows.repartition(tasks[0], "block", "tile").groupBy("block", "n", "tile", "words").agg(F.min("set_id").alias("set_id"))
    packed = checkpoint(once.groupBy("block", "tile").applyInArrow(_packed, f"block {kind}, n int, tile int, piece int, packed binary"))
    dealt = packed.select("block", "tile", "piece", "packed", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("block", "piece", "packed", (F.col("tile") <= F.col("other")).alias("first"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        keys, size, token, first = _two_tiles(table)
        by_size = np.argsort(size, kind="stable")
        start, size, first, keys = (np.cumsum(size) - size)[by_size], size[by_size], first[by_size], keys.take(pa.array(by_size))
        p = np.concatenate([[0], np.cumsum(size)])
        token = token[np.arange(p[-1]) + np.repeat(start - p[:-1], size)]
        # Rare words first.
        rank = np.empty(int(token.max()) + 1, np.int64)
        rank[np.argsort(np.bincount(token), kind="stable")] = np.arange(len(rank))
        found = _tile_pairs(p, _in_order(size, rank[token]), first, bool(first.all()), least)
        return _rows(table.column("block")[0], keys, size, iter([found]))

    return dealt.repartition(tasks[1], "block", "i", "j").groupBy("block", "i", "j").applyInArrow(compare, f"block {kind}, a bigint, b bigint, similarity double")
