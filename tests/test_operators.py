"""Literal cases and invariants of the memory operators."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import commands as C
from convmem.operators import curation as K
from convmem.operators import graph, recall
from convmem.operators import identity as I
from convmem.operators import ledger as L
from convmem.operators import routing as G
from convmem.operators import similarity as S
from convmem.operators import turns as T
from convmem.plans import catalog
from convmem.streaming import conversations as ST

DATA = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Ann: hello\nthere\n*waves*\nmore\nBo (low): no\n\n"), (1, 1, "user", "  ")], "conv_id long, turn long, role string, text string")
    got = [(r.speaker, r.text) for r in T.parse_turns(T.messages(rows), "Mara").orderBy("turn_index").collect()]
    assert got == [("Ann", "hello there"), ("Narrator", "*waves*"), ("Ann", "more"), ("Bo", "no")]


def test_chunk_cap(spark):
    rows = spark.createDataFrame([(1, i, "A" if i < 8 else "B", f"t{i}") for i in range(9)], "conv_id long, turn_index long, speaker string, text string")
    assert [(r.turn_start, r.turn_end) for r in T.chunks(rows).orderBy("chunk_id").collect()] == [(0, 5), (6, 7), (8, 8)]


def test_scores(spark):
    rows = spark.createDataFrame([(1, "I'm afraid"), (2, "nothing here"), (3, "so furious, so betrayed")], "id long, text string")
    cfg = T.Scoring({"fear": 0.8, "anger": 0.9, "dysregulation": 0.9})
    got = {r.id: r for r in T.score(rows, {"fear": ["afraid"], "anger": ["furious", "betrayed"]}, cfg).collect()}
    assert round(got[1].fear, 3) == 0.528 and got[1].primary_emotion == "fear"
    assert got[2].salience == 0 and got[2].primary_emotion is None
    assert got[3].anger == 1.0


def test_text(spark):
    assert value(spark, X.label(F.lit("  Ann   Lee "))) == "ann lee"
    assert value(spark, X.jaccard(X.bag(F.lit("")), X.bag(F.lit("")))) == 0
    assert value(spark, X.correction(X.bag(F.lit("sister is called Mei now")), X.bag(F.lit("sister is called Lin now"))))
    assert value(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert value(spark, C.stripped(F.lit("a [remember: b]\n\n\n\nc"))) == "a \n\nc"


def test_gate(spark):
    domains = {"trauma": ["trauma"]}
    act = lambda t, c: value(spark, C.gated(F.lit(t), F.lit(c), domains)).action
    assert (act("old trauma", "high"), act("fine", "medium"), act("fine", "high")) == ("hold", "hold", "auto")


def test_windows(spark):
    got = value(spark, C.windows(F.lit("aa\n\nbb\n\ncccccccccc\n\nd"), 6))
    assert got == ["aa\n\nbb", "cccccccccc", "d"]


def entry(i, **more):
    base = {"scope_id": "s", "entry_pos": i, "id": f"e{i}", "summary": f"summary {i}", "lane": "user_topics", "status": None, "tier": "short", "cycle_count": 0, "retrieval_count": 0, "recitation_count": 0, "last_retrieved": None, "last_accessed": dt.date(2024, 3, 13), "thread_id": None, "superseded_by": None, "deleted": False, "temp": "hot", "tokens": 10}
    return base | more


FIELDS = "scope_id string, entry_pos long, id string, summary string, lane string, status string, tier string, cycle_count long, retrieval_count long, recitation_count long, last_retrieved date, last_accessed date, thread_id string, superseded_by string, deleted boolean, temp string, tokens long"


def ledger(spark, *entries):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in entries], FIELDS)


def test_archive(spark):
    old = dt.date(2023, 12, 1)
    rows = ledger(
        spark,
        entry(0, last_accessed=old),
        entry(1, last_accessed=old, tier="core"),
        entry(2),
        entry(3, last_accessed=old, thread_id="open"),
        entry(4, last_accessed=old, thread_id="shut"),
        entry(5, last_accessed=old, thread_id="shut"),
        entry(6, last_accessed=old, thread_id="mixed"),
        entry(7, thread_id="mixed"),
    )
    threads = spark.createDataFrame([("open", "active"), ("shut", "closed"), ("mixed", "closed")], "thread_id string, thread_status string")
    got = {r.id for r in L.archive_cold(rows, threads, "2024-03-15").where("temp = 'cold'").collect()}
    assert got == {"e0", "e4", "e5"}


def test_rollback(spark):
    rows = ledger(spark, entry(0, superseded_by="e1", temp="cold"), entry(1))
    ask = lambda flip: spark.createDataFrame([("e0", flip), ("e1", flip)], "id string, flip boolean")
    undo = {r.id: r for r in L.restore(rows, ask(False)).collect()}
    assert undo["e0"].superseded_by is None and undo["e0"].temp == "hot" and undo["e1"].superseded_by is None
    flip = {r.id: r for r in L.restore(rows, ask(True)).collect()}
    assert flip["e0"].superseded_by is None and flip["e1"].superseded_by == "e0"


def test_budget_skips_and_goes_on(spark):
    rows = ledger(spark, entry(0, tokens=60), entry(1, tokens=50), entry(2, tokens=40), entry(3, tokens=0), entry(4, tokens=200))
    ranked = rows.withColumns({"rank": F.col("entry_pos") + 1, "relevance": F.lit(0.0)})
    assert {r.id for r in recall.within_budget(ranked, 100).collect()} == {"e0", "e2", "e3"}


def test_votes(spark):
    items = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(3)], "task long, idx long")
    votes = spark.createDataFrame([(1, 0, [0, 1]), (1, 1, [0]), (1, 2, None), (2, 0, None)], "task long, pass long, keep array<long>")
    assert {(r.task, r.idx) for r in K.kept_by_vote(items, votes).collect()} == {(1, 0), (2, 0), (2, 1), (2, 2)}


def test_first_come(spark):
    items = spark.range(6).select("id")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4), (4, 5)], "a long, b long")
    assert {r.id for r in K.independent_first(items, edges).collect()} == {0, 2, 5}


@pytest.mark.parametrize("partitions", [1, 50])
def test_components(spark, partitions):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 100), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(partitions)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == 100


def test_vector_tiles_agree(spark):
    import random

    rnd = random.Random(1)
    rows = spark.createDataFrame([(1, i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(60)], "scope long, key long, v array<double>")
    one = {(r.a, r.b) for r in S.vector_pairs(rows, "scope", "key", "v", 0.8).collect()}
    many = {(r.a, r.b) for r in S.vector_pairs(rows, "scope", "key", "v", 0.8, rows_per_tile=7).collect()}
    assert one == many and one


def test_names(spark):
    aliases = spark.createDataFrame([("k1", "Ann"), ("k2", "Bo"), ("k3", "Bo"), ("k4", "Mara Lee")], "identity_key string, label string")
    names = spark.createDataFrame([("ann",), ("BO",), ("Mara",), ("Zed",)], "name string")
    people = spark.createDataFrame([("k5", "Zoe")], "identity_key string, name string")
    assert {r.name: r.identity_key for r in I.resolved(names, aliases, people).collect()} == {"ann": "k1", "BO": None, "Mara": "k4", "Zed": None}


def test_names_by_their_words(spark):
    aliases = spark.createDataFrame([("k1", "Dr. Mari Zielińska"), ("k2", "Mari Lund"), ("k3", "Ann-Kathrin Meier")], "identity_key string, label string")
    names = spark.createDataFrame([("zielińska mari",), ("Mari",), ("Meier",), ("Herr Meier",), ("Kath",), ("Dr",)], "name string")
    people = spark.createDataFrame([], "identity_key string, name string")
    got = {r.name: r.identity_key for r in I.resolved(names, aliases, people).collect()}
    assert got == {"zielińska mari": "k1", "Mari": None, "Meier": "k3", "Herr Meier": None, "Kath": None, "Dr": None}


def test_slugs_are_unique(spark):
    rows = spark.createDataFrame([(1, "Bob"), (2, "bob"), (3, "Bob 2"), (4, "bob!"), (5, "bob 2"), (6, "")], "n long, name string")
    got = {r.n: r.slug for r in I.unique_slugs(rows, "name", "n").collect()}
    assert got == {1: "bob", 2: "bob_3", 3: "bob_2", 4: "bob_4", 5: "bob_2_2", 6: "character"}


def test_scene_participants_and_orphans(spark):
    scenes = spark.createDataFrame([(1, ["a", None, "x", "b", "a"])], "scene_id long, characters array<string>")
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "identity_key string, name string")
    assert {(r.identity_key, r.first) for r in K.scene_participants(scenes, known).collect()} == {("a", True), ("b", False)}
    beats = spark.createDataFrame([("k", "b1", "Ann"), ("l", "b2", "Bo")], "identity_key string, beat_id string, speaker string")
    held = spark.createDataFrame([("ann", "b1"), ("zed", "b9")], "speaker_norm string, beat_id string")
    gone = spark.createDataFrame([("k",)], "identity_key string")
    assert {tuple(r) for r in K.orphaned(beats, held, gone).collect()} == {("ann", "b1"), ("zed", "b9")}


def test_batches_that_fail_give_nulls(spark):
    def infer(frame):
        if (frame["id"] == 3).any():
            raise ValueError("no")
        return frame.assign(twice=frame["id"] * 2)

    got = {r.id: r.twice for r in S.batch_infer(spark.range(6).coalesce(1), infer, "twice long", size=2).collect()}
    assert got == {0: 0, 1: 2, 2: None, 3: None, 4: 8, 5: 10}


def test_bundles(spark):
    rows = ledger(spark, entry(0), entry(1)).withColumn("content", F.lit("c"))
    people = spark.createDataFrame([("s", "Ann")], "identity_key string, name string")
    bundles = G.bundles(rows, people)
    assert {r.id for r in G.imported(bundles).collect()} == {"e0", "e1"}
    assert G.imported(bundles.withColumn("bundle", F.replace("bundle", F.lit('"version":1'), F.lit('"version":2')))).count() == 0


def stream(spark, tmp_path, rows, schema, operator):
    """Runs a streaming operator over two files and returns what it has written."""
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = operator(source).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.sql("select * from out").collect()


TURN = "conv_id long, turn long, role string, text string, ts timestamp"


def test_bookmarks_fade(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, "user", '[bookmark: topic="old house", weight=1]' if i == 0 else "x", t) for i in range(4)]
    got = {r.turn: r.weight for r in stream(spark, tmp_path, rows, TURN, ST.bookmark_state)}
    assert [round(got[i], 6) for i in range(4)] == [1, 0.9, 0.81, 0.729]


def test_snapshots(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, "user", f"m{i}", t + dt.timedelta(minutes=10 * i)) for i in range(8)]
    assert sorted(r.turn for r in stream(spark, tmp_path, rows, TURN, ST.snapshots)) == [3, 6]


def test_clock(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, "user", s, t) for i, s in enumerate(["it is friday evening", "hm", "in the morning", "later"])]
    got = {r.turn: (r.day, r.part) for r in stream(spark, tmp_path, rows, TURN, ST.soft_clock)}
    assert got[0] == ("friday", "evening") and got[3] == ("saturday", "morning")


def test_ingest_twice_is_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 1)], "conv_id long, turn long")
    write = ST.ingest(lambda df: df, str(tmp_path / "t"), ["conv_id", "turn"])
    write(rows, 0)
    write(rows, 0)
    write(rows.unionByName(spark.createDataFrame([(1, 2)], "conv_id long, turn long")), 1)
    assert sorted((r.conv_id, r.turn) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 0), (1, 1), (1, 2)]


def test_queries_and_sql_have_the_same_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", ["flagship_top_chunks", "l2_archive_cold", "k2_budgeted_fill", "d1_dedup_ingest", "j7_summary_pairs"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "events", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = con.sql(catalog.oracle_sql()[name]).df()[names].astype(str).values.tolist()
    assert sorted(map(list, got.select(names).toPandas().astype(str).values)) == sorted(want)


def test_no_phrase_is_looked_for_in_a_filter(spark):
    """The salience gate filters on counts that are there, and each phrase is looked for once."""
    from convmem.plans import bindings as B

    plan = T.gate(B.scores(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "salience" in line or "Filter" in line and "_h_" in line]
    assert filters and not any("RLIKE" in line for line in filters)
    phrases = sum(len(w) for w in B.LEXICON.values()) + len(B.DIRECT + B.DEFLECTION + B.ATTACHMENT)
    assert plan.count("RLIKE (^|[^A-Za-z0-9_])") <= phrases


def test_sentence_candidates_on_odd_spaces(spark, tmp_path):
    """White space that only one engine counts as such: vertical tabs do not split, space separators of all kinds are trimmed, and the mark that SQL splits at splits here."""
    said = "Ann goes home"
    texts = [f"{said}.\x0b{said}. ", f"　{said} \n{said}\u0085", f"{said}! {said}", f"{said}\x01{said} now", f"My \x0c{said}. \x0c {said}\r{said}"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(catalog.oracle_sql()["p9_sentence_candidates"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["p9_sentence_candidates"](spark, str(tmp_path)).collect()) == want and len(want) > 6


def test_relevance_sends_each_entry_once_and_talk_in_pieces(spark):
    """Talk of many words is cut into pieces, shares stay whole, and no word of an entry is a row of its own."""
    talk = spark.createDataFrame([("s", " ".join(f"word{i}" for i in range(k, 60, 3))) for k in range(3)] + [("t", "other")], "scope_id string, talk string")
    ledger = spark.createDataFrame([("s", "a", "word1 word2 word3 missing"), ("s", "b", "nothing here"), ("t", "a", "word1 other"), ("u", "a", "word1"), ("s", "c", "")], "scope_id string, id string, summary string")
    for size in (4096, 7):
        rows = recall.relevance(ledger, talk, size)
        assert {(r.scope_id, r.id): r.relevance for r in rows.collect()} == {("s", "a"): 0.75, ("s", "b"): 0.0, ("t", "a"): 0.5, ("u", "a"): 0.0, ("s", "c"): 0.0}
    # Between the scan and the first exchange only the talk, checkpointed before, is spread into words.
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
