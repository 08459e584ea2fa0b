"""Near-duplicate embeddings: navigable small-world graphs per shard, exact cosine, components.

Equal vectors are one row first, with the number of their copies. The distinct ones of a length
are dealt to shards by hash. A task builds a hierarchical navigable small-world graph of one
shard, once; the graphs are written to the shared folder. Then every shard is queried by every
vector: a task gets one graph and one bounded block of queries. A search is a beam over the
graph: it is widened until its worst member lies below the threshold, so that a vector with
thousands of partners finds them all, and an audit of a block's queries against the whole shard
widens the beam further until the recall is right. Every reported pair's cosine is computed in
double precision from the vectors as given, scaled by powers of two, which changes no digit.

A task hands back, for every vector, how many rows it is linked to, and a spanning forest of
the links, not the links. Graphs and blocks hold a bounded number of bytes, whatever the table:
a graph goes as its links and the vectors as given, in pieces, and what is derived from them is made
where it is used; wide beams take fewer queries at once, and pairs found are gone through in slices.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows
without an id, link with nothing, not even their copies; vectors of different lengths do not
link with each other; repeated ids count as one more copy; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.llm.common import checkpoint
from convmem.llm.components import components


#: Members of beams that are held at once.
BEAM_CELLS = 1 << 20
#: Pairs that are computed in double precision at once.
PAIRS_AT_ONCE = 1 << 16
#: Bytes of a row that holds a piece of a graph.
PIECE = 4 << 20


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; searches run for many queries at once.

    Level 0 holds every vector, each further level a random sixteenth of the one below. A vector
    has ``width`` links to near vectors of its level and takes as many links back.
    """

    def __init__(self, unit: np.ndarray, width: int = 12, beam: int = 24, seed: int = 1):
        self.unit = unit.astype(np.float32)
        n = len(unit)
        self.width = width
        order = np.random.default_rng(seed).permutation(n)
        self.members: list[np.ndarray] = []
        size = n
        while True:
            self.members.append(order[:size])
            if size <= 64:
                break
            size //= 16
        # links[level][place]: places of near members of the level, -1 where there are fewer.
        self.links = [np.full((len(m), 2 * width), -1, np.int32) for m in self.members]
        for level in range(len(self.members) - 1, -1, -1):
            self._build(level, beam)

    def _build(self, level: int, beam: int) -> None:
        """Insert the members of a level in batches that double; the members of the level above come first and are its entry."""
        own = self.unit[self.members[level]]
        links = self.links[level]
        n, done = len(own), min(len(own), 64)
        self._connect(own, links, np.arange(done), own[:done] @ own[:done].T, np.arange(done))
        while done < n:
            more = np.arange(done, min(n, 2 * done, done + 512))
            entry = self._enter(own[more], level) if level + 1 < len(self.members) else np.zeros(len(more), np.int64)
            found, near = self._beam(own[more], own, links, entry, beam)
            inside = own[more] @ own[more].T
            self._connect(own, links, more, np.concatenate([near, inside], 1), np.concatenate([found, np.broadcast_to(more, (len(more), len(more)))], 1))
            done += len(more)

    def _connect(self, own: np.ndarray, links: np.ndarray, new: np.ndarray, near: np.ndarray, to: np.ndarray) -> None:
        """Link each new place to the nearest of its candidates, half of them spread out, and back."""
        to = np.broadcast_to(to, near.shape)
        near = np.where((to == new[:, None]) | (to < 0), -2.0, near)
        keep = min(self.width, near.shape[1])
        best = np.argsort(-near, axis=1, kind="stable")[:, : 4 * keep]
        to, near = np.take_along_axis(to, best, 1), np.take_along_axis(near, best, 1)
        for place, candidates, scores in zip(new.tolist(), to, near, strict=True):
            ok = scores > -2.0
            candidates, scores = candidates[ok], scores[ok]
            if not len(candidates):
                continue
            # A candidate nearer to one already chosen than to the new place leads nowhere new.
            between = own[candidates] @ own[candidates].T
            chosen: list[int] = []
            rest: list[int] = []
            for i in range(len(candidates)):
                (chosen if all(between[i, j] < scores[i] for j in chosen) else rest).append(i)
                if len(chosen) == keep:
                    break
            chosen = (chosen + rest)[:keep]
            links[place, : len(chosen)] = candidates[chosen]
            for other in candidates[chosen].tolist():
                self._link_back(own, links[other], other, place)

    def _link_back(self, own: np.ndarray, row: np.ndarray, place: int, new: int) -> None:
        if (row == new).any():
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        # Full: of the links the most redundant goes, the one that another link is nearest to.
        every = np.append(row, new)
        vectors = own[every]
        between = vectors @ vectors.T
        np.fill_diagonal(between, -2.0)
        worst = int(np.argmax(between.max(axis=1) - vectors @ own[place]))
        row[:] = np.delete(every, worst)

    def _enter(self, queries: np.ndarray, level: int) -> np.ndarray:
        """For each query a place of ``level`` to start from, found greedily from the top level down."""
        place = np.zeros(len(queries), np.int64)
        for above in range(len(self.members) - 1, level, -1):
            own = self.unit[self.members[above]]
            found, _ = self._beam(queries, own, self.links[above], place, 4)
            place = found[:, 0]  # a member of a level has the same place in all levels below
        return place

    @staticmethod
    def _beam(queries: np.ndarray, own: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the beam of each query, nearest first; -1 and -2 where a beam is not full."""
        q, n = len(queries), len(own)
        seen = np.zeros((q, n), np.int32)
        at = np.full((q, beam), -1, np.int64)
        near = np.full((q, beam), -2.0, np.float32)
        open_ = np.zeros((q, beam), bool)
        rows = np.arange(q)
        at[:, 0], open_[:, 0] = entry, True
        near[:, 0] = np.einsum("ij,ij->i", queries, own[entry])
        seen[rows, entry] = -1
        active = rows
        steps = min(4, beam)
        while len(active):
            # The nearest members not yet walked from, some at a time.
            score = np.where(open_[active], near[active], -3.0)
            step = np.argpartition(-score, steps - 1, axis=1)[:, :steps] if steps < beam else np.broadcast_to(np.arange(beam), score.shape)
            has = np.take_along_axis(open_[active], step, 1)
            live = has.any(axis=1)
            active, step, has = active[live], step[live], has[live]
            if not len(active):
                break
            open_[active[:, None], step] = False
            froms = np.where(has, at[active[:, None], step], -1)
            nexts = np.where((froms >= 0)[:, :, None], links[froms], -1).reshape(len(active), -1)
            r, c = np.nonzero((nexts >= 0) & (seen[active[:, None], np.maximum(nexts, 0)] == 0))
            # Two links may lead to one place in the same step: the last writer's is the one that counts.
            to = nexts[r, c]
            number = np.arange(1, len(r) + 1, dtype=np.int32)
            seen[active[r], to] = number
            once = seen[active[r], to] == number
            r, c, to = r[once], c[once], to[once]
            score = np.full(nexts.shape, -2.0, np.float32)
            score[r, c] = np.einsum("ij,ij->i", queries[active[r]], own[to])
            all_near = np.concatenate([near[active], score], 1)
            all_at = np.concatenate([at[active], nexts], 1)
            all_open = np.concatenate([open_[active], score > -2.0], 1)
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            near[active] = np.take_along_axis(all_near, top, 1)
            at[active] = np.where(near[active] > -2.0, np.take_along_axis(all_at, top, 1), -1)
            open_[active] = np.take_along_axis(all_open, top, 1) & (near[active] > -2.0)
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)

    def search(self, queries: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs that are within the threshold by the beam; beams that are full of such are widened."""
        queries = queries.astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.arange(len(queries))
        entry = self._enter(queries, 0)
        n = len(self.unit)
        own = self.unit[self.members[0]]
        while len(todo):
            beam = min(beam, n)
            left, few = [], max(1, BEAM_CELLS // beam)
            for start in range(0, len(todo), few):
                some = todo[start : start + few]
                at, near = self._beam(queries[some], own, self.links[0], entry[some], beam)
                wide = (near[:, -1] >= least) & (beam < n)
                q, b = np.nonzero((near >= least) & ~wide[:, None])
                found.append((some[q], self.members[0][at[q, b]]))
                left.append(some[wide])
            todo, beam = np.concatenate(left), 4 * beam
        return np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64), np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the pairs that join two trees."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        r, s = root(x), root(y)
        if r != s:
            up[s] = r
            out.append(i)
    return out


_FOUND = "id bigint, other bigint, links bigint"
_KEY = ["dim", "shard", "asked"]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as rows, as given."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Doubles, each row scaled by a power of two so that its greatest component lies between a half and one."""
    rows = rows.astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in single precision, lengths of the scaled rows), some rows at a time."""
    unit, norm = np.empty(rows.shape, np.float32), np.empty(len(rows))
    for at in range(0, len(rows), 4096):
        part = _scaled(rows[at : at + 4096])
        norm[at : at + 4096] = np.sqrt(np.einsum("ij,ij->i", part, part))
        unit[at : at + 4096] = part / norm[at : at + 4096, None]
    return unit, norm


def build(shard: pa.Table) -> pa.Table:
    """A shard's graph with its vectors, ids and copies, as pieces of some bytes."""
    raw = _matrix(shard.column("vector"))
    graph = Graph(_units(raw)[0])
    graph.unit = None  # made anew from the vectors
    blob = pickle.dumps((shard.column("id").to_numpy(), shard.column("copies").to_numpy(), raw, graph))
    pieces = [blob[at : at + PIECE] for at in range(0, len(blob), PIECE)]
    of = pa.array(np.zeros(len(pieces), np.int64))
    return pa.table({**{c: shard.column(c).take(of) for c in ("dim", "shard", "blocks")}, "piece": pa.array(range(len(pieces)), pa.int32()), "graph": pa.array(pieces, pa.binary())})


def _links_of(pieces: pa.Table, queries: pa.Table, threshold: float, recall: float, at_once: int) -> pa.Table:
    """What one block of queries finds in one shard: (id, null, links) and (id, other, null), a forest."""
    ids, copies, raw, graph = pickle.loads(b"".join(pieces.sort_by("piece").column("graph").to_pylist()))
    graph.unit, norm = _units(raw)
    qids, given = queries.column("id").to_numpy(), _matrix(queries.column("vector"))
    # Single precision may miss by a little: what is near the threshold is computed in double.
    floor = threshold - 1e-5
    beam, exact, counts, edges = 12, False, [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for number, start in enumerate(range(0, len(qids), at_once)):
        mine, qraw = qids[start : start + at_once], given[start : start + at_once]
        unit, qnorm = _units(qraw)
        audited = exact or number % 16 > 0
        while True:
            q, v = np.nonzero(unit @ graph.unit.T >= floor) if exact else graph.search(unit, beam, floor)
            if audited or len(q) >= recall * int((unit @ graph.unit.T >= floor).sum()):
                break
            # The audit failed: wider beams from here on; after the widest, a graph that cannot be walked is compared whole.
            exact, beam = beam >= len(ids), 2 * beam
            audited = exact
        links = np.zeros(len(mine), np.int64)
        for at in range(0, len(q), PAIRS_AT_ONCE):
            x, y = q[at : at + PAIRS_AT_ONCE], v[at : at + PAIRS_AT_ONCE]
            cosine = np.einsum("ij,ij->i", _scaled(qraw[x]), _scaled(raw[y])) / (qnorm[x] * norm[y])
            keep = (cosine >= threshold) & (mine[x] != ids[y])
            x, y = x[keep], y[keep]
            links += np.bincount(x, weights=copies[y], minlength=len(mine)).astype(np.int64)
            # Of a block's links only a forest is kept.
            a, b = np.concatenate([mine[x], edges[0]]), np.concatenate([ids[y], edges[1]])
            every, where = np.unique(np.concatenate([a, b]), return_inverse=True)
            some = _forest(len(every), where[: len(a)], where[len(a) :])
            edges = (a[some], b[some])
        counts.append(links)
    links = np.concatenate(counts)
    some = np.flatnonzero(links)
    a, b = edges
    return pa.table(
        {
            "id": pa.array(np.concatenate([qids[some], a]), pa.int64()),
            "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]),
            "links": pa.concat_arrays([pa.array(links[some], pa.int64()), pa.nulls(len(a), pa.int64())]),
        }
    )


def linked(vectors: DataFrame, threshold: float, shard_bytes: int, block_bytes: int, recall: float, queries_at_once: int = 256) -> DataFrame:
    """From distinct vectors (id, vector, copies): (id, null, links) per shard and block, and (id, other, null), a forest of the links."""
    sized = vectors.withColumn("dim", F.size("vector"))
    bytes_of = F.col("n") * F.col("dim") * 8
    dealt = sized.groupBy("dim").agg(F.count("*").alias("n"))
    dealt = dealt.select("dim", F.greatest(F.lit(4), F.ceil(bytes_of / shard_bytes)).cast("int").alias("shards"), F.greatest(F.lit(4), F.ceil(bytes_of / block_bytes)).cast("int").alias("blocks"))
    rows = checkpoint(sized.join(dealt, "dim"))
    own = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    columns = ["dim", "shard", "blocks", "id", "vector", "copies"]
    graphs = checkpoint(own.select(*columns).groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, blocks int, piece int, graph binary"))
    graphs = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("asked"), "piece", "graph")
    queries = rows.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("asked"), "id", "vector")

    def run(graph: pa.Table, block: pa.Table) -> pa.Table:
        if graph.num_rows and block.num_rows:
            return _links_of(graph, block, threshold, recall, queries_at_once)
        return pa.table({c: pa.array([], pa.int64()) for c in ("id", "other", "links")})

    return graphs.groupBy(*_KEY).cogroup(queries.groupBy(*_KEY)).applyInArrow(run, _FOUND)


def near_duplicates(table: DataFrame, threshold: float = 0.9, shard_bytes: int = 32 << 20, block_bytes: int = 8 << 20, recall: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    # Single-precision components are sent as such.
    kind = "array<float>" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    # Adding zero makes the two zeros one, so that equal vectors have equal bytes.
    rows = rows.select("vec_id", F.when(good, F.transform("v", lambda x: x + F.lit(0).cast(kind[6:-1]))).alias("v"))
    rows = checkpoint(rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    classes = checkpoint(rows.where("v is not null").groupBy("h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    found = checkpoint(linked(classes.select("id", F.col("v").alias("vector"), "copies"), threshold, shard_bytes, block_bytes, recall))
    links = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    done = classes.join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "component"), "id", "left")
    done = checkpoint(done.select("h", F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    # A vector with many copies is a skewed key: a sort-merge join, which adaptive execution splits.
    joined = rows.join(done.hint("merge"), (rows.h == done.h) & (rows.v == done.w), "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
