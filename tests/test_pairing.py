"""One-to-one pairing against the greedy loop, and the nearest in time against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from convmem.operators import pairing


def test_best_first_is_the_greedy_walk(spark):
    """A thousand random tables at once, with many ties."""
    rnd = random.Random(5)
    edges, want = [], set()
    for block in range(1000):
        own = [((block, f"s{a}"), (block, f"r{b}"), rnd.choice([0.25, 0.5, 0.5, 1.0]), a, b) for a in range(rnd.randint(0, 6)) for b in range(rnd.randint(0, 6)) if rnd.random() < 0.8]
        edges += own
        used = set()
        for a, b, *_ in sorted(own, key=lambda e: (-e[2], e[3], e[4])):
            if a not in used and ("r", b) not in used:
                used |= {a, ("r", b)}
                want.add((a, b))
    df = spark.createDataFrame(edges, "a struct<k: int, n: string>, b struct<k: int, n: string>, score double, pa int, pb int").repartition(5)
    from pyspark.sql import functions as F

    assert {(tuple(r.a), tuple(r.b)) for r in pairing.best_first(df, F.desc("score"), "pa", "pb").collect()} == want


def tables(spark):
    rnd = random.Random(2)
    words = "tower castle ferry lantern garden bridges bridge harbour silverware silver wedding storm about which".split()
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    scenes = [(o, f"s{o}-{k}", k, say(rnd.randint(0, 12)).title() if rnd.random() < 0.9 else None, rnd.randint(0, 50)) for o in range(30) for k in range(rnd.randint(0, 5))]
    texts = [(o, f"r{o}-{k}", k, rnd.choice([say(rnd.randint(0, 5)), "", None, "a of 12"]), rnd.choice([None, *range(0, 50)])) for o in range(30) for k in range(rnd.randint(0, 5))]
    schema = "origin int, {} string, pos int, text string, at int"
    return scenes, texts, spark.createDataFrame(scenes, schema.format("scene")).repartition(3), spark.createDataFrame(texts, schema.format("summary")).repartition(3)


def score(summary, scene):
    w = set(re.findall("[a-z]{4,}", (summary or "").lower())) - set(pairing.COMMON)
    return sum(x in (scene or "").lower() for x in w) / len(w) if w else 0.0


@pytest.mark.parametrize("fallback", [False, True])
def test_paired(spark, fallback):
    scenes, texts, a, b = tables(spark)
    want = set()
    for o in range(30):
        own, said = [s for s in scenes if s[0] == o], [t for t in texts if t[0] == o]
        used = set()
        for x, s, r in sorted(((score(r[3], s[3]), s, r) for s in own for r in said), key=lambda e: (-e[0], e[1][2], e[2][2])):
            if x >= 0.3 and s[1] not in used and r[1] not in used:
                used |= {s[1], r[1]}
                want.add((s[1], r[1]))
        timed = [r for r in said if r[4] is not None]
        if fallback and timed:
            want |= {(s[1], min(timed, key=lambda r: (abs(r[4] - s[4]), r[2]))[1]) for s in own if s[1] not in used}
    got = [(r.scene, r.summary) for r in pairing.paired(a, b, 0.3, fallback).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_nothing_to_pair(spark):
    _, _, a, b = tables(spark)
    assert pairing.paired(a.limit(0), b, fallback=True).count() == 0 and pairing.paired(a, b.limit(0), fallback=True).count() == 0
