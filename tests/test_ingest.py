"""Ingest against a row-by-row loop, and the set join against all pairs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from convmem.functions.text import FUNCTION_WORDS
from convmem.operators import ingest, setjoin
from convmem.plans import ingest as plans

SCHEMA = "scope_id string, lane string, kind string, id string, pos bigint, summary string, content string, source_chat_id string, turn_start bigint"
LANES = ("user_topics", "character_topics", "open_threads")


def bag(text):
    return set(re.sub(r"[^\w\s]", " ", (text or "").lower(), flags=re.ASCII).split())


def alike(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def loop(known, new):
    """One row after the other, over lists."""
    entries = [dict(r) for r in known]
    out = {}
    for r in new:
        if not (r["summary"] or "").strip():
            out[(r["scope_id"], r["id"])] = ("blank", None)
            continue
        content = (r["content"] or "").strip()
        bags = [bag(r["summary"])] + ([bag(content)] if len(content) > 20 else [])
        own = [e for e in entries if e["scope_id"] == r["scope_id"] and e["lane"] == r["lane"]]
        hit = lambda e, least, bags=bags: any(alike(bag(e["summary"]), b) >= least for b in bags)
        action, against = "created", None
        if r["lane"] == "character_topics" and r["kind"] == "incident":
            for e in own:
                near = None not in (e["turn_start"], r["turn_start"], e["source_chat_id"], r["source_chat_id"]) and e["source_chat_id"] == r["source_chat_id"] and abs(e["turn_start"] - r["turn_start"]) <= 5
                if near and re.match(r"\[\w+\]", e["summary"].strip(), re.ASCII) and hit(e, 0.6):
                    action, against = "skipped", e
                    break
        else:
            against = next((e for e in own if hit(e, 0.35)), None)
            if against is not None:
                action = "skipped"
                if r["lane"] == "user_topics":
                    a, b = bag(against["summary"]), bags[0]
                    carrying = [w for w in a ^ b if len(w) >= 3 and w not in FUNCTION_WORDS]
                    if alike(a, b) >= 0.5 and 1 <= len(carrying) <= 4:
                        action = "corrected"
                        entries.remove(against)
        if action != "skipped":
            entries.append(dict(r))
        out[(r["scope_id"], r["id"])] = (action, against and against["id"])
    return out


def rows(seed, n=160):
    rnd = random.Random(seed)
    names = "scope_id lane kind id pos summary content source_chat_id turn_start".split()
    out, said = [], []
    for i in range(n):
        lane = rnd.choice(LANES)
        words = [rnd.choice("anna bob city dog eats fish goes home into jam the was".split()) for _ in range(rnd.randint(1, 7))]
        text = " ".join(words)
        if said and rnd.random() < 0.5:
            text = rnd.choice(said) + rnd.choice(["", "", " Mei", " lin", " the"])
        said.append(text)
        kind = rnd.choice(["incident", "trait", None]) if lane == "character_topics" else None
        if kind == "incident" and rnd.random() < 0.9:
            text = "[fear] " + text
        text = rnd.choice([text, text, text, text.upper(), text + "!"]) if rnd.random() < 0.97 else rnd.choice(["", " ", None])
        content = rnd.choice(["", None, "short", rnd.choice(said) + " and something more", rnd.choice(said) * 2])
        out.append(dict(zip(names, (rnd.choice("pq"), lane, kind, f"r{i:03d}", i // 2, text, content, rnd.choice(["c1", "c1", "c2", None]), rnd.choice([None, *range(12)])), strict=True)))
    return out


@pytest.mark.parametrize("seed,copies", [(1, 0), (2, 0), (3, 40)])
def test_decisions(spark, seed, copies):
    data = rows(seed)
    data += [data[20] | {"id": f"x{k:03d}", "pos": 200 + k // 7} for k in range(copies)]
    data += [data[21] | {"id": f"y{k:03d}", "pos": 190 + k // 3, "lane": "user_topics", "summary": "anna goes home Mei" if k % 9 else "anna goes home Lin", "kind": None} for k in range(copies)]
    known = [r for r in data[:40] if (r["summary"] or "").strip()]
    new = sorted(data[40:], key=lambda r: (r["pos"], r["id"]))
    want = loop(sorted(known, key=lambda r: (r["pos"], r["id"])), new)
    frames = [spark.createDataFrame([tuple(r.values()) for r in part], SCHEMA).repartition(3) for part in (known, new)]
    got = {(r.scope_id, r.id): (r.action, r.against) for r in ingest.decisions(*frames).collect()}
    assert got == want
    kinds = {(r["lane"], want[(r["scope_id"], r["id"])][0]) for r in new}
    assert kinds >= {(lane, a) for lane in LANES for a in ("created", "skipped")} | {("user_topics", "corrected")}


def test_components_are_replayed_together(spark, tmp_path):
    """Some hundred components are a few groups of rows, not a group each, and decisions are those of the loop."""
    data = [r | {"id": f"{k:02d}{r['id']}", "scope_id": f"{r['scope_id']}{k}"} for k in range(12) for r in rows(k, 60)]
    known, new = [r for r in data if r["id"][2:] < "r015" and (r["summary"] or "").strip()], [r for r in data if r["id"][2:] >= "r015"]
    want = loop(*(sorted(part, key=lambda r: (r["pos"], r["id"])) for part in (known, new)))
    counted = spark.sparkContext.accumulator(0)
    plain = ingest._replay

    def counting(r, e):
        counted.add(1)
        return plain(r, e)

    for size in (20_000, 40):
        ingest._replay, counted.value = counting, 0
        try:
            got = {(r.scope_id, r.id): (r.action, r.against) for r in ingest.decisions(*(spark.createDataFrame([tuple(r.values()) for r in part], SCHEMA) for part in (known, new)), rows_per_part=size).collect()}
        finally:
            ingest._replay = plain
        assert got == want
        assert counted.value <= (spark.sparkContext.defaultParallelism + 1 if size > 40 else 40)


def test_outputs(spark):
    known = spark.createDataFrame([("p", "user_topics", None, "a", 1, "his sister is Mei", "", None, None), ("p", "open_threads", None, "b", 2, "find the lost key", "", None, None)], SCHEMA)
    new = spark.createDataFrame([("p", "user_topics", None, "c", 1, "his sister is Lin", "", None, None), ("p", "user_topics", None, "d", 2, "sister is Lin", "", None, None), ("p", "open_threads", None, "e", 3, "find the key", "", None, None)], SCHEMA)
    decided = ingest.decisions(known, new)
    assert {(r.id, r.action, r.against) for r in decided.collect()} == {("c", "corrected", "a"), ("d", "skipped", "c"), ("e", "skipped", "b")}
    assert [tuple(r) for r in ingest.supersessions(known, new, decided).collect()] == [("p", "a", "his sister is Mei", "c", "his sister is Lin")]
    assert [r.id for r in ingest.tasks(new, decided).collect()] == ["d"]
    assert {(r.id, r.superseded_by) for r in ingest.applied(known, new, decided).collect()} == {("a", "c"), ("b", None), ("c", None)}
    plain = ingest.decisions(known, new, ingest.REMEMBER)
    assert {r.action for r in plain.collect()} == {"skipped"}


def test_nothing_arrives(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ingest.decisions(none, none).count() == 0


@pytest.mark.parametrize("least", [0.35, 0.8])
def test_set_join(spark, least):
    rnd = random.Random(3)
    data = [(f"b{i % 3}", sorted({f"w{int(rnd.paretovariate(0.7)) % 40}" for _ in range(rnd.randint(0, 14))}), rnd.random() < 0.6, rnd.random() < 0.7) for i in range(300)]
    sets = setjoin.numbered_sets(spark.createDataFrame(data, "block string, t array<string>, probe boolean, target boolean"))
    known = sets.collect()
    want = set()
    for a in known:
        for b in known:
            if a.block == b.block and a.probe and b.target and alike(set(a.t), set(b.t)) >= least:
                want.add((a.set_id, b.set_id, round(alike(set(a.t), set(b.t)), 9)))
    assert {(r.a, r.b, round(r.similarity, 9)) for r in setjoin.similar(sets, least).collect()} == want
    pairs = setjoin.candidates(setjoin._coded(sets), 0.8).count()
    assert pairs < 0.05 * len(known) ** 2 / 6


def test_sentences_give_few_candidates(spark):
    """Of all pairs of sentences of a scope, under five in a hundred are compared."""
    from convmem.plans import ingest as plans

    rows = plans._sentences(spark, "/root/testdata/sf0.001").select(F.col("scope").alias("block"), F.array_sort(ingest.X.bag(F.col("summary"))).alias("t"), F.lit(True).alias("probe"), F.lit(True).alias("target"))
    sets = setjoin.numbered_sets(rows)
    every = sum(r["count"] * (r["count"] - 1) // 2 for r in sets.groupBy("block").count().collect())
    assert setjoin.candidates(setjoin._coded(sets), 0.35).count() < 0.05 * every


@pytest.mark.parametrize("least,tile,run", [(0.35, 9, 4), (0.5, 1000, 7), (0.8, 20, 100)])
def test_set_join_in_tiles(spark, least, tile, run):
    """Words that most sets have, over several tiles and runs: all pairs are found, each once, and no candidate leaves a task."""
    rnd = random.Random(4)
    data = {(f"b{i % 3}", tuple(sorted({f"w{int(rnd.paretovariate(0.6)) % 60}" for _ in range(rnd.choice([1, 2, 5, 14, 30]))}))) for i in range(300)}
    data |= {("b0", tuple(f"v{k:04d}" for k in range(n))) for n in (7, 20, 400, 1142, 1143, 1144, 1500)}
    sets = setjoin.checkpoint(spark.createDataFrame([(b, list(t)) for b, t in sorted(data)], "block string, t array<string>").repartition(3).withColumn("set_id", F.monotonically_increasing_id()))
    known = sets.collect()
    want = sorted((a.set_id, b.set_id, round(alike(set(a.t), set(b.t)), 9)) for a in known for b in known if a.block == b.block and a.set_id < b.set_id and alike(set(a.t), set(b.t)) >= least)
    got = setjoin.similar_in_tiles(sets, least, rows_per_tile=tile, run=run)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in got.collect()) == want and len(want) > 2


def written(spark):
    """Rows that shuffles have written so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    nothing = gateway.jvm.java.util.ArrayList
    stages = store.stageList(nothing(), False, False, gateway.new_array(gateway.jvm.double, 0), nothing())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_of_sentences_write_no_candidates(spark, tmp_path):
    """Sentences of one scope that nearly all have a word in common, but hardly any two: shuffles carry sentences, not pairs."""
    rnd = random.Random(11)
    word = lambda: f"w{min(rnd.randrange(1, 400), rnd.randrange(1, 400), rnd.randrange(1, 400))}"
    said = [{word() for _ in range(rnd.randint(1, 14))} for _ in range(3000)]
    spark.createDataFrame([(k, "a", "en", " ".join(sorted(s)) + ".") for k, s in enumerate(said)], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = written(spark)
    got = plans.sentence_pairs(spark, str(tmp_path)).collect()
    assert written(spark) - before < 5 * len(said)
    once = {}
    for k, s in enumerate(said):
        once.setdefault(frozenset(s), k * 100_000)
    own = list(once.items())
    want = {(a, b, round(len(s & t) / len(s | t), 6)) for i, (s, a) in enumerate(own) for t, b in own[i + 1 :] if len(s & t) / len(s | t) >= 0.35}
    assert len(got) == len(want) and {(r.a, r.b, r.similarity) for r in got} == want and len(want) > 30


@pytest.mark.parametrize(("least", "tile"), [(0.35, 10**6), (0.35, 300), (0.6, 300), (0.9, 10**6)])
def test_set_join_by_word_pairs(spark, least, tile):
    """Short and long sets, in two blocks, by one tile and by many."""
    rnd = random.Random(int(least * 100) + tile)
    sets = {(rnd.choice("xy"), " ".join(sorted({f"w{min(rnd.randrange(90), rnd.randrange(90))}" for _ in range(rnd.choice([1, 2, 3, 5, 9, 30, 130]))}))) for _ in range(300)}
    sets |= {(b, f"{w} wz") for b, w in rnd.sample(sorted(sets), 100)}
    rows = [(b, k, w) for k, (b, w) in enumerate(sorted(sets))]
    split = {k: set(w.split()) for _, k, w in rows}
    like = lambda a, b: len(split[a] & split[b]) / len(split[a] | split[b])
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and like(x[1], y[1]) >= least}
    got = [(r.a, r.b) for r in setjoin.similar_by_word_pairs(spark.createDataFrame(rows, "block string, set_id long, words string"), least, tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_long_sets_are_compared_in_tiles(spark, monkeypatch):
    """Whole texts find the same ones alike as by a prefix, in both families and roles, and their candidates are not written."""
    rnd = random.Random(8)
    texts = [[f"w{k}" for k in sorted(rnd.sample(range(160), rnd.randint(40, 110)))] for _ in range(60)]
    texts += [sorted({*t[rnd.randint(0, 30) :], f"w{rnd.randint(160, 170)}"}) for t in texts]
    data = [(f'["{rnd.choice("ab")}","s","l"]', t, rnd.random() < 0.7, rnd.random() < 0.8) for t in texts]
    sets = setjoin.numbered_sets(spark.createDataFrame(data, "block string, t array<string>, probe boolean, target boolean"))
    rules = ingest.Rules()
    rows = lambda df: sorted((r.a, r.b, round(r.similarity, 9)) for r in df.collect())
    want = rows(setjoin.similar(sets, F.when(F.startswith("block", F.lit('["a"')), rules.least).otherwise(rules.least_incident)))
    monkeypatch.delattr(setjoin, "candidates")
    assert rows(ingest._alike(sets, rules)) == want and len(want) > 60
    assert {(r.a, r.b) for r in ingest._edges(sets, rules).collect()} == {p[:2] for p in want}
