"""Source mixing against one queue after the other."""

from __future__ import annotations

import hashlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from convmem.llm import mixing
from tests.llm.corpus import texts


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, queue int, size string, upto int, target int").repartition(5)


def rows():
    out = []
    for k, (i, t) in enumerate(texts()):
        out.append((i, t, "abcd"[k % 4] if k % 9 else None, 1, "s", 2, 3))
    out += [(1000 + k, "few words", "tiny", 1, "s", 2, 3) for k in range(3)]
    out += [(2000 + k, f"hot source {k} " + "w " * (k % 50), "hot", 1, "s", 2, 3) for k in range(400)]
    out += [(3000, "   ", "empty", 1, "s", 2, 3), (3001, None, "é", 1, "s", 2, 3), (3002, "x y", "é", 1, "s", 2, 3)]
    return out


def filled(sizes: dict, most: int, weights) -> dict:
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, capped = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left, total = budget - sum(capped.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: Fraction(most * sizes[s]) for s in above}


def expected(data, most=3, weights=(1, 2, 3)) -> Counter:
    docs = [(i, s, len((t or "").encode().split()), hashlib.md5(f"1:{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s, *_ in data]
    sizes = Counter()
    for _, s, n, _ in docs:
        sizes[s] += n
    target = filled(sizes, most, weights)
    items = []
    for s in sizes:
        if target[s]:
            at = 0
            for turn in range(most):
                for k, d in sorted(((k, d) for k, d in enumerate(docs) if d[1] == s and d[2]), key=lambda x: (x[1][3], x[1][0] or 0)):
                    at += d[2]
                    items.append((float(at) / float(target[s]), d[3], turn, k))
    spent, taken = 0, Counter()
    for _, _, _, k in sorted(items):
        spent += docs[k][2]
        if spent > sum(sizes.values()):
            break
        taken[k] += docs[k][2]
    return Counter((i, s, n, sizes[s], round(float(target[s]), 6), taken[k]) for k, (i, s, n, _) in enumerate(docs))


@pytest.mark.parametrize("per_bucket,buckets", [(16_384, 256), (3, 1), (50, 7)])
def test_allotted(spark, monkeypatch, per_bucket, buckets):
    monkeypatch.setattr(mixing, "ROWS", per_bucket)
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    data = rows()
    got = mixing.allotted(table(spark, data)).collect()
    assert Counter((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == expected(data)
    by = Counter()
    for r in got:
        by[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    budget, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert budget - longest < sum(by.values()) <= budget
    assert any(r.target == 3 * r.source_size for r in got if r["size"])


def test_each_source_comes_near_its_target(spark):
    data = [(k, "w " * (1 + k % 30), f"s{k % 7}" if k % 3 else "hot", 1, "s", 2, 3) for k in range(6000)]
    got = mixing.allotted(table(spark, data)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 60 for r in got)


def test_targets_of_many_sources(spark):
    import random

    rnd = random.Random(2)
    for _ in range(3):
        sizes = {f"s{k:02d}" if k else None: rnd.choice([0, 1, 5, 50, 900, 20_000]) for k in range(rnd.randint(1, 25))}
        if not sum(sizes.values()):
            continue
        sized = spark.createDataFrame([(("=" + s) if s is not None else "", s, n) for s, n in sizes.items()], "queue string, source string, size bigint")
        want = filled(sizes, 3, (1, 2, 3))
        assert {r.queue: round(r.target, 6) for r in mixing.targets(sized, (1, 2, 3), 3).collect()} == {("=" + s) if s is not None else "": round(float(v), 6) for s, v in want.items()}


def test_mix_itself(spark):
    data = rows()
    docs = table(spark, data)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(len((r.text or "").split()) for r in got) == sum(k[5] * n for k, n in expected(data).items())
    count = Counter((r.doc_id, r.text) for r in got)
    for r in mixing.allotted(docs).where("doc_id >= 1000").collect():
        assert sum(n for (i, _), n in count.items() if i == r.doc_id) == (r.taken // r["size"] if r["size"] else 0)


def test_nothing_to_mix(spark):
    assert mixing.allotted(table(spark, [])).count() == 0 and mixing.mixed(table(spark, [])).count() == 0
    blank = table(spark, [(1, None, None, 1, "s", 2, 3), (2, " ", "a", 1, "s", 2, 3)])
    assert {(r.doc_id, r.target, r.taken) for r in mixing.allotted(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
