"""The edit distance of lines, and what it is verified on."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from convmem.llm import line_dedup
from tests.llm.corpus import frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_within_one_edit():
    for a in itertools.product(b"ab", repeat=4):
        for n in range(3, 7):
            for b in itertools.product(b"ab", repeat=n):
                assert line_dedup.within_one_edit(list(a), list(b)) == (distance(a, b) <= 1)


@pytest.mark.parametrize("same", [False, True])
def test_equal_keys_are_no_proof(spark, monkeypatch, same):
    """With keys that nearly all lines share, only lines within an edit go."""
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "a b c x y z"), (4, "q b c d e f"), (5, "a b c d e f h"), (6, "a b d e f"), (7, "m n o d e f")]
    whole = line_dedup.Lines.variants

    def few(self, at):
        keys, roles, of = whole(self, at)
        return (np.zeros_like(keys) if same else keys), roles, of

    monkeypatch.setattr(line_dedup.Lines, "variants", few)
    got = {r.doc_id: r.n_removed for r in line_dedup.without_repeats(frame(spark, rows)).collect()}
    gone = {i for i, n in got.items() if n}
    near = {2, 4, 5, 6}
    assert gone <= near if same else gone == near
