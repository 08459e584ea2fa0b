"""Imports that are run again, and what they do to beats and ledgers."""

from __future__ import annotations

from convmem.operators import importing as M
from convmem.operators.graph import checkpoint

SCORED = "scope_id string, source_chat_id string, conv_id long, chunk_id long, speaker string, text string, turn_start long, turn_end long, salience double, primary_emotion string"
NONE = "scope_id string, lane string, kind string, id string, pos bigint, summary string, content string, source_chat_id string, turn_start bigint"


def chunk(k, text, salience=0.6, speaker="Ann", scope="p", chat="c1"):
    return (scope, chat, 1, k, speaker, text, k, k, salience, "fear")


def test_import_again_changes_nothing(spark):
    rows = [chunk(0, "the old house burns tonight"), chunk(1, "the old house burns tonight again"), chunk(9, "small talk", 0.1), chunk(10, "the garden gate was open"), chunk(11, "unanswered yet"), chunk(11, "unanswered yet")]
    scored = spark.createDataFrame(rows, SCORED)
    own = scored.withColumn("beat_id", M._id(scored))
    answers = own.where("text <> 'unanswered yet'").selectExpr("beat_id", "text as motivation", "'none' as outcome")
    beats, ledger, decided = M.transcripts(scored, answers, spark.createDataFrame([], M.BEAT), spark.createDataFrame([], NONE))
    beats, ledger = checkpoint(beats), checkpoint(ledger)
    assert [(b.text, round(b.salience, 3), b.seq) for b in beats.orderBy("seq").collect()] == [("the old house burns tonight", 0.6, 1), ("the old house burns tonight again", 0.6, 2), ("the garden gate was open", 0.78, 3)]
    assert sorted(r.action for r in decided.collect()) == ["created", "created", "skipped"]  # the second says the first's moment again
    assert [r.summary for r in ledger.orderBy("pos").collect()] == ["[fear] the old house burns tonight", "[fear] the garden gate was open"]

    again, after, more = M.transcripts(scored, answers, beats, ledger)
    assert sorted(again.collect()) == sorted(beats.collect()) and sorted(after.collect()) == sorted(ledger.collect()) and more.count() == 0
    late, _, more = M.transcripts(scored, own.selectExpr("beat_id", "text as motivation", "'none' as outcome"), beats, ledger)
    assert [(b.text, b.seq) for b in late.subtract(beats).collect()] == [("unanswered yet", 4)] and more.count() == 1

    held = checkpoint(ledger.where("pos = 1"))
    once, _ = M.backfilled(beats, held)
    once = checkpoint(once)
    assert {r.id for r in once.collect()} == {r.id for r in ledger.collect()}
    assert sorted(M.backfilled(beats, once)[0].collect()) == sorted(once.collect())


def test_beats_move_to_whom_they_are_about(spark):
    beats = spark.createDataFrame([("p", f"b{i}", "Ann", f"text number {i}", i, i, "hope", f"motive {'abcdefg'[i] * 3} {i}", "none", 0.5, "c1" if i < 6 else "c2", i) for i in range(7)], M.BEAT)
    ledger = M.backfilled(beats, spark.createDataFrame([], NONE))[0]
    subjects = spark.createDataFrame([("p", f"b{i}", s) for i, s in enumerate(["user", "Bo", "Cleo", "", "Anna", "Ann", "Bo"])], "scope_id string, beat_id string, subject string")
    known = spark.createDataFrame([("Bo", "q"), ("Ann", "p")], "name string, identity_key string")
    chats = spark.createDataFrame([("c1",)], "source_chat_id string")
    after, rows, pooled = M.reattributed(beats, checkpoint(ledger), subjects, known, "Anna", chats)
    got = {(b.scope_id, b.text) for b in after.collect()}
    assert got == {("q" if i == 1 else "p", f"text number {i}") for i in range(7) if i != 2}
    assert {(r.scope_id, r.kind is None) for r in rows.collect() if "motive bbb" in r.summary} == {("q", True)}
    assert [(r.speaker_norm, r.beat_id) for r in pooled.collect()] == [("cleo", "b2")]
    assert rows.count() == 6


def test_a_scene_has_one_recap(spark):
    scenes = spark.createDataFrame([("p", "c1", "Scene: the fire", "  What happened to the old  house ", "2024-01-01"), ("p", "c2", None, "too short", "2024-01-01"), ("q", "c3", None, "nobody remembers this scene", "2024-02-02T03")], "scope_id string, scene_id string, name string, summary string, concluded string")
    beats = spark.createDataFrame([("p", f"b{i}", "t1" if i > 9 else None, "c1" if i < 10 else "c9", i / 20, i) for i in range(12)], "scope_id string, beat_id string, thread_id string, source_chat_id string, salience double, seq long")
    threads = spark.createDataFrame([("t1", "c1", "active"), ("t2", "c1", "closed"), ("t3", "c8", "active")], "thread_id string, chat_id string, status string")
    recaps, closed = M.scene_recaps(scenes, beats, threads, spark.createDataFrame([], "scope_id string, scene_id string"))
    rows = {r.scene_id: r for r in recaps.collect()}
    assert set(rows) == {"c1", "c3"} and rows["c1"].label == "the fire" and rows["c3"].label == "Scene concluded 2024-02-02"
    assert rows["c1"].members == 12 and rows["c1"].covered_through == 11 and rows["c1"].footnotes == ["b11", "b10", "b9", "b8", "b7", "b6", "b5", "b4"]
    assert rows["c3"].footnotes == [] and [r.thread_id for r in closed.collect()] == ["t1"]
    assert M.scene_recaps(scenes, beats, threads, recaps.select("scope_id", "scene_id"))[0].count() == 0
