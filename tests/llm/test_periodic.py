"""Periodic runs against a search of all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from convmem.llm import periodic
from tests.llm.corpus import frame, texts


def brute(w: list) -> set[tuple[int, int, int]]:
    """Start, end and smallest period of every run."""
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return {(s, e, p) for (s, e), p in out.items()}


def words_of(doc_id, text) -> list[bytes]:
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text) -> tuple:
    w = words_of(doc_id, text)
    runs = sorted((s, e - s, p) for s, e, p in brute(w))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows():
    rnd = random.Random(4)
    out = texts()
    for i in range(300, 499):
        n = rnd.choice([1, 12, 13, 30, 90, 200, 300])
        w = [rnd.choice("abcdefgh"[: rnd.choice([1, 2, 3, 8])]) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randrange(n)
            p, end = rnd.randint(1, max(1, (n - a) // 3)), rnd.randint(a, n)
            w[a:end] = [w[a + k % p] for k in range(end - a)]
        out.append((i, " ".join(w)))
    out += [(500, "ha " * 3000), (501, " ".join(str(k % 700) for k in range(5000))), (502, " ".join(str(k) for k in range(6000)))]
    return out


@pytest.mark.parametrize("stride", [16, 4096])
def test_report(spark, monkeypatch, stride):
    monkeypatch.setattr(periodic, "STRIDE", stride)
    data = rows()
    got = Counter(map(tuple, periodic.report(frame(spark, data)).collect()))
    assert got == Counter(expected(i, t) for i, t in data)
    assert sum(r[1] > 0 for r in got) > 50


def test_columns_and_types(spark):
    df = periodic.report(frame(spark, []))
    assert df.count() == 0
    assert [f"{n} {t}" for n, t in df.dtypes] == ["doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint", "runs_sha256 string", "collapsed_sha256 string"]


def test_fragments_of_tiles_make_whole_runs(spark):
    """Tiles overlap, and what each of them holds is a part of a run."""
    w = [k % 37 for k in range(900)] + list(range(100, 400)) + [k % 150 for k in range(1300)]
    text = " ".join(map(str, w))
    found = periodic.found_runs(frame(spark, [(1, text)])).first()
    assert {(r["start"], r["start"] + r["length"], r["period"]) for r in found["runs"]} == brute(words_of(1, text))


def test_screening_never_misses():
    rnd = random.Random(9)
    for _ in range(400):
        n = rnd.choice([12, 13, 25, 60, 150])
        w = [rnd.randint(0, rnd.choice([1, 2, 30])) for _ in range(n)]
        octaves = int(periodic.screened(np.array(w, np.int32), np.array([n]))[0])
        assert all(octaves >> (p.bit_length() - 1) & 1 for _, _, p in brute(w))


def test_neighbouring_texts_are_apart():
    """No block is found again in the next text of a batch."""
    a = np.arange(40, dtype=np.int32)
    assert not periodic.screened(np.concatenate([a, a, a]), np.array([40, 40, 40])).any()
