"""Recall of the graphs, odd vectors, and several shards and blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from convmem.llm import embedding_dedup as E


def clustered(n: int, dim: int, spread: float, seed: int) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    return rnd.normal(size=(n // 10, dim))[rnd.integers(0, n // 10, n)] + rnd.normal(size=(n, dim)) * spread


def brute(m: np.ndarray, least: float = 0.9) -> tuple[np.ndarray, list[int]]:
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    link = (unit @ unit.T >= least) & ~np.eye(len(m), dtype=bool)
    comp = np.arange(len(m))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], len(m)).min(axis=1))
        if (new == comp).all():
            return link, comp.tolist()
        comp = new


def test_graph_recall():
    """A shard of 3000 vectors is walked, not compared whole."""
    m = clustered(3000, 32, 0.2, 1)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    graph = E.Graph(unit)
    q, v = graph.search(unit[:600], 12, 0.9)
    want = set(zip(*np.nonzero(unit[:600].astype(np.float32) @ graph.unit.T >= 0.9), strict=True))
    got = set(zip(q.tolist(), v.tolist(), strict=True))
    assert got <= want and len(want) > 2000 and len(got) >= 0.98 * len(want)
    at, _ = E.Graph._beam(unit[:8].astype(np.float32), graph.unit[graph.members[0]], graph.links[0], graph._enter(unit[:8].astype(np.float32), 0), 12)
    assert at.shape == (8, 12)


def test_beams_widen_to_all_partners():
    m = np.vstack([np.ones(16) + np.random.default_rng(2).normal(size=(500, 16)) * 0.02, clustered(500, 16, 0.1, 3)])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    q, _ = E.Graph(unit).search(unit[:5], 12, 0.9)
    assert np.bincount(q).min() >= 500


def test_query_over_shards_and_blocks(spark):
    m = clustered(2400, 16, 0.15, 4)
    link, comp = brute(m)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in E.near_duplicates(df, shard_bytes=60 * 16 * 8 * 10, block_bytes=40 * 16 * 8 * 10).collect()}
    found, want = sum(r.n_links for r in got.values()), int(link.sum())
    assert want > 1000 and 0.98 * want <= found <= want
    assert sum(got[i].component_id == c for i, c in enumerate(comp)) >= 0.98 * len(comp)


def test_tiny_huge_and_other_lengths(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [5.0, 1.0]), (3, [1e200, 2e200, 3e200]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [-0.0, 1.0]), (8, [0.0, 3.0]), (9, [0.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    link, comp = brute(np.array([[1, 1], [5, 1], [1, 2], [1, 2], [0, 1], [0, 3]]))
    flat = [1, 2, 5, 6, 7, 8]
    want = {i: (int(link[k].sum()), flat[comp[k]]) for k, i in enumerate(flat)}
    assert got == want | {3: (1, 3), 4: (1, 3), 9: (0, 9), None: (0, None)}
    assert E.near_duplicates(df.where("vec_id > 100")).count() == 0


def test_a_graph_goes_in_pieces_and_pairs_in_slices(monkeypatch):
    """A graph takes little more than its vectors as given, in rows of bounded size, and slices of beams and pairs change nothing."""
    rng = np.random.default_rng(3)
    centre = np.repeat(rng.normal(size=(40, 64)), 50, axis=0)
    vectors = (centre + 0.05 * rng.normal(size=centre.shape)).astype(np.float32)
    n = len(vectors)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 64, pa.int32()), pa.array(vectors.ravel()))
    zero = pa.array(np.zeros(n, np.int32))
    shard = pa.table({"dim": zero, "shard": zero, "blocks": zero, "id": pa.array(range(n), pa.int64()), "vector": lists, "copies": pa.array(np.ones(n, np.int64))})
    asked = shard.select(["id", "vector"])
    found = []
    for piece, cells, pairs in ((4 << 20, 1 << 20, 1 << 16), (10_000, 200, 77)):
        for name, value in {"PIECE": piece, "BEAM_CELLS": cells, "PAIRS_AT_ONCE": pairs}.items():
            monkeypatch.setattr(E, name, value)
        graph = E.build(shard)
        sizes = [len(x) for x in graph.column("graph").to_pylist()]
        assert max(sizes) <= piece and sum(sizes) < 1.6 * vectors.nbytes
        got = E._links_of(graph.take(rng.permutation(len(sizes))), asked, 0.9, 0.98, 256).to_pylist()
        found.append({r["id"]: r["links"] for r in got if r["links"] is not None})
        edges = [(r["id"], r["other"]) for r in got if r["other"] is not None]
        assert len(edges) == n - 40 and all(a // 50 == b // 50 for a, b in edges)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert found[0] == found[1] == dict(enumerate(want.tolist()))
