"""Set joins send sets packed, tile by tile: what shuffles write grows with the sets, not with words, tiles or pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convmem.operators import composites, setjoin
from convmem.operators import similarity as S
from convmem.plans import catalog
from tests.test_ingest import alike, written


def texts(n: int, groups: int, words: int = 60, seed: int = 1) -> list[str]:
    """Texts that have most words in common, in groups of near copies."""
    rnd = random.Random(seed)
    heads = [[f"w{min(rnd.randrange(400), rnd.randrange(400))}" for _ in range(words)] for _ in range(groups)]
    return [" ".join([*heads[k % groups], f"own{k}"]) for k in range(n)]


def test_a_packed_tile_is_its_sets():
    rnd = random.Random(2)
    said = [" ".join(sorted({f"w{min(rnd.randrange(5000), rnd.randrange(5000))}" for _ in range(rnd.randint(1, 300))})) for _ in range(500)]
    coded = setjoin._codes(setjoin._lists(pa.chunked_array([pa.array(said)])))
    blob = setjoin._pack(pa.array(range(500)), *coded)
    keys, size, token, words = setjoin._unpack(blob)
    assert keys.to_pylist() == list(range(500)) and (size == coded[0]).all() and (token == coded[1]).all()
    assert [sorted(words.take(pa.array(t)).to_pylist()) for t in np.split(token, np.cumsum(size)[:-1])] == [s.split() for s in said]
    assert len(blob) < 3 * len(token)


@pytest.mark.parametrize("tile", [40, 10**6])
def test_words_are_no_rows(spark, tile):
    """Neither are candidates, nor copies of a set for each tile it is compared with."""
    said = texts(400, 40)
    sets = spark.createDataFrame([(k, sorted(set(s.split()))) for k, s in enumerate(said)], "set_id long, t array<string>")
    sets = setjoin.checkpoint(sets.select(F.struct(F.lit("b").alias("of")).alias("block"), "set_id", "t"))
    before = written(spark)
    got = setjoin.similar_in_tiles(sets, 0.35, rows_per_tile=tile).collect()
    assert written(spark) - before < 6 * len(said)
    split = [set(s.split()) for s in said]
    want = {(a, b, round(alike(split[a], split[b]), 9)) for a in range(400) for b in range(a + 1, 400) if alike(split[a], split[b]) >= 0.35}
    assert len(got) == len(want) and {(r.a, r.b, round(r.similarity, 9)) for r in got} == want and len(want) > 1700


def test_sentences_go_to_their_tiles_once(spark):
    said = sorted({" ".join(sorted({*s.split()[:8], f"x{k % 7}"})) for k, s in enumerate(texts(600, 300))})
    sets = setjoin.checkpoint(spark.createDataFrame([("b", k, s) for k, s in enumerate(said)], "block string, set_id long, words string"))
    before = written(spark)
    got = [(r.a, r.b) for r in setjoin.similar_by_word_pairs(sets, 0.5, 200).collect()]
    assert written(spark) - before < 4 * len(said)
    split = [set(s.split()) for s in said]
    want = {(a, b) for a in range(len(said)) for b in range(a + 1, len(said)) if alike(split[a], split[b]) >= 0.5}
    assert len(got) == len(want) and set(got) == want and len(want) > 100


def test_clusters_are_made_of_few_pairs(spark, tmp_path):
    """Groups of near copies return what connects them, not all their pairs."""
    said = [*texts(400, 2), "", "one two"]
    spark.createDataFrame([(k, "en" if k % 5 else None, s) for k, s in enumerate(said)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = written(spark)
    got = {r.doc_id: (r.cluster, r.size, r.oversized) for r in catalog.queries()["d4_fact_clusters"](spark, str(tmp_path)).collect()}
    assert written(spark) - before < 20 * len(said)
    own = [[k for k in range(g, 400, 2) if k % 5] for g in range(2)]
    assert got == {k: (g[0], len(g), True) for g in own for k in g}


def test_ingest_does_not_ask_for_use(spark, tmp_path):
    """Texts meet no events, and small scopes are compared by a task each."""
    said = texts(300, 60)
    spark.createDataFrame([(k, "en", s) for k, s in enumerate(said)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = written(spark)
    got = {r.id for r in catalog.queries()["d1_dedup_ingest"](spark, str(tmp_path)).collect()}
    assert written(spark) - before < 40 * len(said)
    split, kept = [set(s.split()) for s in said], []
    for k in range(300):
        if not any(j // 200 == k // 200 and j % 3 == k % 3 and alike(split[j], split[k]) >= 0.35 for j in kept):
            kept.append(k)
    assert got == set(kept) and 10 < len(kept) < 150


def test_duplicates_send_no_words(spark):
    said = texts(300, 60)
    rows = [(f"s{k % 2}", "l", f"e{k:03d}", k, s, "open", k % 7, 0) for k, s in enumerate(said)]
    ledger = spark.createDataFrame(rows, "scope_id string, lane string, id string, entry_pos long, summary string, status string, retrieval_count long, recitation_count long")
    ledger = ledger.withColumn("lane", F.lit("l"))  # never null, as a lane by rule
    before = written(spark)
    got = {r.id for r in composites.duplicates(ledger).collect()}
    assert written(spark) - before < 25 * len(said)
    split, kept = [set(s.split()) for s in said], []
    for k in sorted(range(300), key=lambda k: (-(k % 7), k)):
        if not any(j % 2 == k % 2 and alike(split[j], split[k]) >= 0.35 for j in kept):
            kept.append(k)
    assert got == {f"e{k:03d}" for k in set(range(300)) - set(kept)}


def test_further_copies_and_classes(spark):
    rows = spark.createDataFrame([("b", 3, "x y", "p"), ("b", 1, "y x", "q"), ("b", 2, "x", "r"), ("c", 4, "x y", "s"), ("b", 5, "", "t"), (None, 6, "x", "u")], "block string, key long, text string, more string")
    got = {tuple(r) for r in S.set_classes(rows, "block", "key", F.filter(F.split("text", " "), lambda w: w != ""), "more").collect()}
    assert got == {("b", 3, 1, 2, "p"), ("b", 1, 1, 2, "q"), ("b", 2, 2, 1, "r"), ("c", 4, 4, 2, "s")}
