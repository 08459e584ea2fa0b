"""Components, leaders, clusters and arcs against loops over rows."""

from __future__ import annotations

import datetime as dt
import random
from itertools import combinations

import numpy as np

from convmem.operators import arcs as A
from convmem.operators import curation as K
from convmem.operators.graph import components


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_odd_edges(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(400)] + [(1000, 1000 + k) for k in range(300)] + [(2000 + rnd.randint(0, 90), 2000 + rnd.randint(0, 90)) for _ in range(70)] + [(5, 4), (5, 4), (9000, 9000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_consensus_by_meaning_is_the_loop(spark):
    rnd = np.random.default_rng(4)
    rows, want = [], {}
    for scope in "pq":
        centres = rnd.normal(size=(9, 6))
        for i in range(80):
            v = centres[rnd.integers(0, 9)] + rnd.normal(size=6) * 0.45
            vector = None if i % 29 == 7 else [float(x) for x in (v if i % 13 else centres[0])]
            rows.append((scope, i + (1000 if scope == "q" else 0), int(i * 3 // 80), i, f"fact {'x' * int(rnd.integers(1, 5))}", "user_topics", ["Ann", "Bo", None][rnd.integers(0, 3)], vector))
    for scope in "pq":
        leads = []
        groups = {}
        for r in (r for r in rows if r[0] == scope):
            best, sim = None, 0.85
            for c in leads:
                if r[7] and c[7]:
                    s = float(np.dot(r[7], c[7]) / np.linalg.norm(r[7]) / np.linalg.norm(c[7]))
                    if s >= sim - 1e-12:
                        best, sim = c, max(s, sim)
            if best is None:
                leads.append(r)
            groups.setdefault((best or r)[1], []).append(r)
        for leader, g in groups.items():
            if len({r[2] for r in g}) >= 2:
                count = {}
                for r in g:
                    count[r[6] or "?"] = count.get(r[6] or "?", 0) + 1
                top = max(count, key=lambda s: count[s])
                want[(scope, leader)] = (max((r[4] for r in g if (r[6] or "?") == top), key=len), top, len({r[2] for r in g}))
    df = spark.createDataFrame(rows, "scope_id string, id long, pass int, pos int, fact string, lane string, subject string, vector array<double>").repartition(4)
    got = {(r.scope_id, r.leader): (r.fact, r.subject, r.seen) for r in K.consensus_by_meaning(df, 3).collect()}
    assert got == want and len(want) > 4


BEAT = "scope_id string, beat_id string, n long, seq long, salience double, thread_id string, entities array<string>, vector array<double>, created date"
SAID = "scope_id string, beat_id string, keep boolean, role string, label string, lead string, body string"


def beat(n, scope="p", thread=None, entities=(), vector=None, salience=0.7):
    return (scope, f"b{n}", n, n, salience, thread, list(entities), vector, dt.date(2024, 1, 1))


def test_clusters(spark):
    rnd = random.Random(3)
    rows = [beat(n, rnd.choice("pq"), rnd.choice([None, "", f"t{rnd.randint(0, 30)}"]), rnd.sample("abcdefghijklmnop", rnd.randint(0, 3)), None if rnd.random() < 0.3 else [rnd.gauss(0, 1) for _ in range(5)]) for n in range(120)]

    def close(x, y):
        u, v = np.array(x), np.array(y)
        return u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9

    edges = [(x[2], y[2]) for x, y in combinations(rows, 2) if x[0] == y[0] and ((x[5] and x[5] == y[5]) or len(set(x[6]) & set(y[6])) >= 2 or (x[7] and y[7] and close(x[7], y[7])))]
    root = roots([r[2] for r in rows], edges)
    size = {}
    for c in root.values():
        size[c] = size.get(c, 0) + 1
    want = {(root[r[2]], r[1]) for r in rows if size[root[r[2]]] >= 3}
    assert {(r.cluster, r.beat_id) for r in A.beat_clusters(spark.createDataFrame(rows, BEAT), 0.9).collect()} == want and want


def run(spark, rows, arcs, members, day, drop=()):
    said = [(r[0], r[1], r[1] not in drop, "pivot", f"line {r[1]}", "lead", "body") for r in rows]
    return A.promoted(spark.createDataFrame(rows, BEAT), arcs, members, spark.createDataFrame(said, SAID), day)


def test_arcs_go_on_and_a_second_run_changes_nothing(spark):
    none = spark.createDataFrame([], A.ARC), spark.createDataFrame([], A.MEMBER)
    first = [beat(n, thread="t1", entities=["Ann", "Bo"], vector=[1.0, 0.0]) for n in range(1, 5)] + [beat(9, thread="t1", salience=0.2), beat(10, "q", "t7"), beat(11, "q", "t7")]
    arcs, members, recaps = run(spark, first, *none, "2024-01-02", drop=("b4",))
    (arc,) = arcs.collect()
    assert (arc.label, arc.version, arc.covered_through, arc.threads, arc.entities, arc.centroid) == ("line b1", 1, 3, ["t1"], ["Ann", "Bo"], [1.0, 0.0])
    assert {m.beat_id for m in members.collect()} == {"b1", "b2", "b3"}
    (recap,) = recaps.collect()
    assert recap.id == f"recap-{arc.arc_id}" and recap.summary == "[arc recap] line b1 — lead" and recap.footnotes == ["b1", "b2", "b3"]

    more = first + [beat(n, thread="t1", vector=[0.0, 1.0]) for n in (20, 21, 22)]
    arcs2, members2, _ = run(spark, more, arcs, members, "2024-01-20", drop=("b4", "b22"))
    (arc2,) = arcs2.collect()
    assert (arc2.arc_id, arc2.version, arc2.covered_through, arc2.label) == (arc.arc_id, 2, 21, "line b20")
    assert {m.beat_id for m in members2.collect()} == {"b1", "b2", "b3", "b20", "b21"}

    arcs3, members3, recaps3 = run(spark, more, arcs2, members2, "2024-01-21", drop=("b4", "b22"))
    assert arcs3.collect() == arcs2.collect() and sorted(members3.collect()) == sorted(members2.collect()) and recaps3.count() == 0
    arcs4, _, _ = run(spark, more, arcs3, members3, "2024-05-01", drop=("b4", "b22"))
    assert [a.status for a in arcs4.collect()] == ["dormant"]


def test_no_arc_of_fewer_than_three_kept(spark):
    none = spark.createDataFrame([], A.ARC), spark.createDataFrame([], A.MEMBER)
    arcs, members, recaps = run(spark, [beat(n, thread="t") for n in range(4)], *none, "2024-01-02", drop=("b0", "b1"))
    assert arcs.count() == members.count() == recaps.count() == 0


def test_consensus_looks_up_only_what_it_returns(spark):
    """Facts with lengths in place of their texts agree on the same, equal lengths and missing texts too."""
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    rows = [(f"s{k % 3}", k, k // 3 % 3, k, rnd.choice([None, "a", "bb", "cc", "ddd " * (k % 4)]), rnd.choice(["x", "y"]), rnd.choice([None, "Ann", "Bo"]), [rnd.choice([0.0, 1.0]) for _ in range(3)]) for k in range(120)]
    df = spark.createDataFrame(rows, "scope_id string, id long, pass int, pos long, fact string, lane string, subject string, vector array<double>")
    want = K.consensus_by_meaning(df, 3).collect()
    found = K.consensus_by_meaning(df.withColumn("chars", F.length("fact")).drop("fact"), 3, texts=df.select("id", "fact"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want)) and want
