"""Literal cases of what is made of several steps."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from convmem.operators import composites as M
from convmem.operators import routing as G


def test_clock_line(spark):
    rows = spark.createDataFrame([(1, "late_night", "monday", "evening", "here", 0), (2, "unknown", None, None, "away", 0), (3, None, "unknown", "evening", None, None), (4, "morning", "unknown", None, "here", 2)], "k int, t string, d string, p string, w string, r int")
    got = [r.line for r in rows.select("k", M.clock_line(*[F.col(c) for c in "tdpwr"]).alias("line")).orderBy("k").collect()]
    assert got[0] == "Session context: late night, Monday (morning after evening)"
    assert got[1] == "Session context: the user has stepped away and will return when ready"
    assert got[2] == ""
    assert got[3].startswith("Session context: morning · the user steps away")


def test_labels_match(spark):
    rows = spark.createDataFrame([("Zieliöska", "Zielińska"), ("mari  Zielińska", "zielińska, Mari Anna"), ("", ""), (None, "a"), ("ann", "joanna"), ("bo", "Bo")], "a string, b string")
    got = [r.m for r in rows.select(M.labels_match(F.col("a"), F.col("b"), 0.9).alias("m")).collect()]
    assert got == [True, True, False, False, False, True]


def test_first_thread_is_the_earliest_active_one(spark):
    threads = spark.createDataFrame([(1, 10, "old feud", 0, "closed"), (1, 11, "the old feud", 2, "active"), (1, 12, "old feud", 1, "active"), (2, 13, "old feud", 0, "active")], "chat_id int, thread_id int, label string, pos int, status string")
    asked = spark.createDataFrame([(1, "Old Feud"), (1, "new job"), (3, "old feud")], "chat_id int, label string")
    assert {(r.chat_id, r.label): r.thread_id for r in M.first_thread(asked, threads).collect()} == {(1, "Old Feud"): 12, (1, "new job"): None, (3, "old feud"): None}


def test_routed_beats(spark):
    beats = spark.createDataFrame([(1, None, "Zed"), (2, " User ", "Zed"), (3, "Ann", "Zed"), (4, "Mara", "Zed"), (5, "Cy", "Zed"), (6, "Cy", "Narrator"), (7, "Me", "Zed"), (8, "Cy", None)], "beat_id int, subject string, speaker string")
    resolved = spark.createDataFrame([("Ann", "k2"), ("Me", "k1"), ("Cy", None)], "name string, identity_key string")
    got = {r.beat_id: (r.route, r.identity_key, r.speaker) for r in M.routed_beats(beats, resolved, "k1", "Mara", ["Narrator"]).collect()}
    assert got == {1: ("bucket", "k1", "Zed"), 2: ("bucket", "k1", "Zed"), 3: ("routed", "k2", "Ann"), 4: ("bucket", "k1", "Zed"), 5: ("pending", None, "Cy"), 6: ("bucket", "k1", "Narrator"), 7: ("bucket", "k1", "Zed"), 8: ("pending", None, "Cy")}
    assert {r.beat_id for r in M.routed_beats(beats, resolved, "k1", "Mara", ["Narrator"], live=True).where("route = 'pending'").collect()} == {5, 6, 8}


def test_matched_arcs(spark):
    arcs = spark.createDataFrame([("s", "a1", 1, "dormant", ["t1"], ["x", "y"], [1.0, 0.0]), ("s", "a2", 2, "active", [], ["x", "y"], [])], "scope_id string, arc_id string, pos int, status string, threads array<string>, entities array<string>, centroid array<double>")
    clusters = spark.createDataFrame([("s", 1, ["t1"], [], []), ("s", 2, [], ["x"], []), ("s", 3, [], ["z"], [0.9, 0.1]), ("s", 4, [], [], [0.0, 1.0]), ("r", 5, ["t1"], [], [])], "scope_id string, cluster int, threads array<string>, entities array<string>, centroid array<double>")
    assert {r.cluster: r.arc_id for r in M.matched_arcs(clusters, arcs).collect()} == {1: "a1", 2: "a2", 3: "a1", 4: None, 5: None}


def test_matched_arcs_by_brute_force(spark):
    """All relations at once, over several tiles, with odd vectors, nulls and repeated elements."""
    rnd = random.Random(8)
    pick = lambda names, k: rnd.choice([None, [], [rnd.choice(names) for _ in range(rnd.randint(1, k))]])
    vec = lambda: rnd.choice([None, [], [0.0, 0.0, 0.0], [rnd.choice([-1.0, 0.0, 1.0, 2.0, None]) for _ in range(rnd.randint(1, 4))]])
    signs = lambda: (rnd.choice(["s", "r", None]), pick([f"t{i}" for i in range(90)], 2), pick(["x", "y", "z", "u", "v", "w", "q", None], 5), vec())
    arcs = [(*signs(), f"a{k:02d}", k, rnd.choice(["active", "dormant", "dormant", None])) for k in range(40)]
    clusters = [(*signs(), k) for k in range(120)]
    sign = "scope_id string, threads array<string>, entities array<string>, centroid array<double>"

    def hit(c, a):
        if c[0] is None or c[0] != a[0]:
            return False
        x, y = ([v or 0.0 for v in row[3] or []] for row in (c, a))
        size = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        close = size > 0 and sum(p * q for p, q in zip(x, y, strict=False)) / size >= 0.7
        e, f = set(c[2] or []), set(a[2] or [])
        alike = a[6] == "active" and c[2] is not None and a[2] is not None and e | f and len(e & f) / len(e | f) >= 0.5
        return bool(set(c[1] or []) & set(a[1] or []) or close or alike)

    want = {c[4]: next((a[4] for a in arcs if hit(c, a)), None) for c in clusters}
    got = M.matched_arcs(spark.createDataFrame(clusters, f"{sign}, cluster int"), spark.createDataFrame(arcs, f"{sign}, arc_id string, pos int, status string"), rows_per_tile=7)
    assert {r.cluster: r.arc_id for r in got.collect()} == want and len({*want.values()}) > 6


def test_applied_merges_and_audit(spark, tmp_path):
    ledger = spark.createDataFrame([("a", "calm", None, "hot"), ("b", "calm", None, "hot"), ("c", "the trauma", None, "hot"), ("d", "calm", None, "hot")], "id string, summary string, superseded_by string, temp string")
    merges = spark.createDataFrame([(1, "a", ["b", "gone"], "high", "same"), (2, "c", ["d"], "low", "same"), (3, "x", ["y"], "high", "same")], "cluster int, canonical_id string, redundant_ids array<string>, confidence string, rationale string")
    after, held, audit = M.applied_merges(ledger, merges, {"trauma": ["trauma"]}, "2024-01-01")
    assert {r.id: (r.superseded_by, r.temp) for r in after.collect()} == {"a": (None, "hot"), "b": ("a", "cold"), "c": (None, "hot"), "d": (None, "hot")}
    assert [(r.cluster, r.reasons) for r in held.collect()] == [(2, ["confidence", "trauma"])]
    folder = str(tmp_path / "sweep")
    M.append_audit(audit, folder)
    M.append_audit(held.select("cluster", "source", "at"), folder)
    kept = spark.read.json(folder)
    assert kept.count() == 4 and {tuple(r.superseded_ids) for r in kept.where("mode = 'apply'").collect()} == {("b",), ()}
    assert M.applied_merges(ledger, merges, {}, "2024-01-01", gated=False)[0].where("superseded_by is not null").count() == 2


def test_migration_is_idempotent(spark):
    pending = spark.createDataFrame([("cy", "Cy", "b1"), ("cy", "CY", "b2"), ("di", "Di", "b3")], "speaker_norm string, speaker string, beat_id string")
    mapping = spark.createDataFrame([("cy", "k1"), ("eve", "k3")], "speaker_norm string, identity_key string")
    beats = spark.createDataFrame([("k1", "b1")], "identity_key string, beat_id string")
    aliases = spark.createDataFrame([("k2", " CY ")], "identity_key string, label string")
    own, left, names = M.migrated(pending, mapping, beats, aliases)
    assert sorted(map(tuple, own.collect())) == [("k1", "b1"), ("k1", "b2")] and [r.beat_id for r in left.collect()] == ["b3"]
    assert [tuple(r) for r in names.collect()] == [("k2", " CY ")]
    again = M.migrated(left, mapping, own, names)
    assert again[0].count() == 2 and again[1].count() == 1 and again[2].count() == 1


def test_duplicates_by_brute_force(spark):
    chance = random.Random(4)
    said = ["red house by the lake", "red house by a lake", "[hope] red house", "old feud at sea", "old feud", "a storm", "", "the red lake", "storm at sea by the house"]
    rows = [(f"s{chance.randrange(2)}", chance.choice(["x", "y"]), i, f"e{i}", chance.choice(said), chance.choice([None, "open", "done"]), chance.randrange(3), chance.choice([None, 1])) for i in range(60)]
    ledger = spark.createDataFrame(rows, "scope_id string, lane string, entry_pos long, id string, summary string, status string, retrieval_count long, recitation_count long")
    bag = lambda t: set(re.sub(r"[^\w\s]", " ", t.lower()).split())
    order = sorted((r for r in rows if r[5] != "done" and bag(r[4])), key=lambda r: (-(2 if r[4].startswith("[") else 1), -(r[6] + 3 * (r[7] or 0)), r[2]))
    kept, lost = [], set()
    for r in order:
        if any(k[:2] == r[:2] and len(bag(k[4]) & bag(r[4])) >= 0.35 * len(bag(k[4]) | bag(r[4])) for k in kept):
            lost.add(r[3])
        else:
            kept.append(r)
    assert lost and {r.id for r in M.duplicates(ledger).collect()} == lost
    assert M.duplicates(ledger.limit(0)).count() == 0


def test_equally_good_suggestions(spark):
    """Of equally good suggestions the first held beat's stands, null or not, however rows are dealt."""
    rows = [("ann", 30, "t30", 5), ("ann", 10, "t10", 7), ("ann", 20, "t20", 7), ("bo", 11, None, 7), ("bo", 21, "t21", 7), ("bo", 1, "t1", 6)]
    held = spark.createDataFrame([(n, n, *r) for n, *r in rows], "speaker_norm string, speaker string, seq long, suggestion string, score long")
    for order in (F.col("seq"), F.desc("seq")):
        got = G.pending_speakers(held.coalesce(1).sortWithinPartitions(order)).collect()
        assert {(r.speaker_norm, r.held, r.suggestion) for r in got} == {("ann", 3, "t10"), ("bo", 3, None)}
