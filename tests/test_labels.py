"""Label suggestions against all pairs, and labels of any length in scenes."""

from __future__ import annotations

import random

from convmem.operators import identity as I


def test_no_suggestion_is_lost(spark):
    rnd = random.Random(6)
    letters = "abcdeimnorst"
    names = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 11))) for _ in range(150)]
    names += ["katherine", "martha", "professor mari", "Mari", "anna of the north", "x", "dwayne", "dixon", "jellyfish"]
    asked = ["catherine", "marhta", "mari", "mari the professor", "north", "dicksonx", "smellyfish", "duane", "", " ", None]
    for n in rnd.sample(names[:150], 90):
        i = rnd.randrange(len(n))
        asked += [n[:i] + n[i + 1 :], n[:i] + rnd.choice(letters) + n[i:], n[1:2] + n[:1] + n[2:]]
    norm = lambda t: " ".join((t or "").lower().split())
    want = {}
    for a in set(asked):
        n = norm(a)
        best = None
        for k, b in enumerate(names):
            m = norm(b)
            if n:
                v, w = set(n.split(" ")), set(m.split(" "))
                s = max(I.similarity(n, m), 0.9 if v <= w or w <= v else 0.0)
                key = (-s, f"k{k:03d}")
                if s >= 0.85 and (best is None or key < best):
                    best = key
        if best:
            want[a] = (best[1], round(-best[0], 9))
    labels = spark.createDataFrame([(a,) for a in asked], "label string").repartition(3)
    aliases = spark.createDataFrame([(f"k{k:03d}", b) for k, b in enumerate(names)], "identity_key string, label string").repartition(3)
    got = {r.label: (r.identity_key, round(r.score, 9)) for r in I.fuzzy_suggestions(labels, aliases).collect()}
    assert got == want
    assert got["catherine"][0] == "k150" and len(want) > 100


def test_labels_of_many_words_in_scenes(spark):
    scenes = spark.createDataFrame([("a", "Here comes Anna of the far cold North, again."), ("b", "Anna of the far north"), ("c", None), ("d", "")], "scene_id string, text string")
    names = spark.createDataFrame([("k1", "Anna of the far cold north"), ("k2", "anna"), ("k3", "an"), ("k4", "the far"), ("k5", ""), ("k6", None)], "identity_key string, label string")
    assert {tuple(r) for r in I.in_scene(scenes, names).collect()} == {("a", "k1"), ("a", "k2"), ("b", "k2"), ("a", "k4"), ("b", "k4")}


def test_a_word_that_all_labels_have_pairs_nothing(spark):
    """Twenty thousand labels with one word in common: no pair of them is made (before, 4 * 10^8 were counted)."""
    n = 20_000
    names = spark.range(n).selectExpr("concat('customer#', lpad(id, 9, '0')) AS name")
    aliases = spark.range(n).where("id % 4 > 0").selectExpr("concat('k', id) AS identity_key", "concat('Mr ', lpad(id, 9, '0'), ' Customer') AS label")
    sets = lambda rows, c: rows.selectExpr(f"array_sort(split(regexp_replace(lower({c}), '(^mr )|#', ' '), ' +')) AS s").selectExpr("filter(s, x -> x <> '') AS s")
    pairs = I.contained_sets(sets(names, "name").withColumnRenamed("s", "v"), sets(aliases, "label").withColumnRenamed("s", "w"))
    assert pairs.count() == n * 3 // 4
    people = spark.createDataFrame([], "identity_key string, name string")
    got = {r.name: r.identity_key for r in I.resolved(names, aliases, people).collect()}
    assert len(got) == n and all(k == (f"k{int(name[9:])}" if int(name[9:]) % 4 else None) for name, k in got.items())


def test_routes_need_no_suggestions(spark, monkeypatch):
    """Where only routes are asked for, no suggestion is looked for, and routes are the same."""
    orphans = spark.createDataFrame([("Ann",), ("Bo",), ("Anna",), ("Me",)], "speaker string")
    aliases = spark.createDataFrame([("k1", "ann"), ("k2", "Bo"), ("k3", "bo"), ("k4", "me")], "identity_key string, label string")
    want = {tuple(r) for r in I.routed(orphans, aliases, "k4").drop("suggestion").collect()}
    monkeypatch.setattr(I, "fuzzy_suggestions", None)
    got = I.routed(orphans, aliases, "k4", suggest=False)
    assert got.columns == ["speaker", "route", "identity_key"] and {tuple(r) for r in got.collect()} == want == {("Ann", "routed", "k1"), ("Bo", "held", None), ("Anna", "held", None), ("Me", "dropped", None)}
