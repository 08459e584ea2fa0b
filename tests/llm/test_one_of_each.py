"""Rows that stay, where ids are missing or stand at several texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from convmem.llm import near_copies, simhash
from tests.llm.corpus import frame

ROWS = [(None, None), (None, "a lonely text without any number at all"), (3, None), (4, ""), (1, "the same words in both of these rows"), (5, "the same words in both of these rows"), (5, "something else that nobody has said before"), (7, "twice the same row with its own number"), (7, "twice the same row with its own number")]
WANT = Counter([(None, "a lonely text without any number at all"), (3, None), (1, "the same words in both of these rows"), (5, "something else that nobody has said before"), *[(7, "twice the same row with its own number")] * 2])


@pytest.mark.parametrize("operator", [near_copies.one_of_each, simhash.one_of_each])
def test_rows_not_ids_decide(spark, operator):
    assert Counter((r.doc_id, r.text) for r in operator(frame(spark, ROWS)).collect()) == WANT
    assert operator(frame(spark, [])).count() == 0


def test_parity_never_says_more_than_the_difference():
    rnd = np.random.default_rng(4)
    for size in (0, 1, 50, 700, 5000):
        a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], rnd.integers(0, 1 << 63, size // 8).astype(np.uint64)]))
        apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(near_copies.parity_of(a), near_copies.parity_of(b), strict=True))
        assert apart <= len(np.setxor1d(a, b))


def test_recall_of_planted_pairs(spark):
    """Of all pairs of a planted table that are 0.8 to 0.9 alike, none is missed."""
    rnd = random.Random(8)
    rows, sets = [], []
    for g in range(60):
        base = [f"g{g}w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([60, 120, 300]))]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            words = base.copy()
            for p in rnd.sample(range(len(base)), max(1, len(base) * k // 110)):
                words[p] = f"x{rnd.randint(0, 9999)}"
            rows.append((10 * g + k, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    close = [1 for i, j in linked if 10 * len(sets[i] & sets[j]) < 9 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, rows)).collect()}
    assert len(close) > 60 and all(got[rows[i][0]] == got[rows[j][0]] for i, j in linked)
