"""The pipeline's near copies against brute force over all pairs of documents."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from convmem.llm import near_copies
from tests.llm.corpus import frame, texts


def _kept(rows):
    """Ids that stay, by comparing every two sets of shingles."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return {d for i, (d, _) in enumerate(rows) if least.get(top(i)) == d}


@pytest.mark.parametrize("stars", [2, 0])  # without stars all links of bands are left to the pair-by-pair rest
def test_stage_keeps_one_of_edited_copies(spark, monkeypatch, stars):
    monkeypatch.setattr(near_copies.links, "__defaults__", (stars,))
    rnd = random.Random(5)
    rows, at, edited = texts(), 1000, set()
    for size in (30, 60, 100, 100, 400):  # copies with one to many changed words, on both sides of the bound
        base = [f"u{rnd.randint(0, 5000)}" for _ in range(size)]
        rows.append((at, " ".join(base)))
        for k in range(1, 12):
            words = base.copy()
            for p in rnd.sample(range(size), min(k, size // 12)):
                words[p] = f"v{rnd.randint(0, 5000)}"
            rows.append((at + k, " ".join(words)))
        edited.add(at + 1)
        at += 100
    # A chain: each is near the next, its ends are not near.
    chain = [f"c{i}" for i in range(160)]
    rows += [(2000 + i, " ".join(chain[i * 8 : i * 8 + 100])) for i in range(7)]
    want = _kept(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert not got & edited - {1001} and len([d for d in want if d is not None and 2000 <= d < 2010]) == 1
    assert got == want
