"""Imports that can be run again: every row has an id made of what it is, so a second run adds nothing.

A transcript's scored chunks become beats, and each beat a companion row in its ledger, by the
decisions of ``ingest``. Backfill gives stored beats the companions they lack, scene recaps are made
once for a scene, and re-attribution moves beats, and what goes with them, to whom they are about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import ingest
from convmem.operators import routing as G
from convmem.operators import turns as T
from convmem.operators.graph import checkpoint

BEAT = "scope_id string, beat_id string, speaker string, text string, turn_start bigint, turn_end bigint, emotion string, motivation string, outcome string, salience double, source_chat_id string, seq bigint"


def _id(rows: DataFrame) -> Column:
    return X.beat_id(F.col("turn_start"), F.col("turn_end"), F.col("speaker"), F.col("text"))


def _companions(beats: DataFrame, kind: str | None) -> DataFrame:
    """Ledger rows that go with beats, in the order of their numbers; called by their beats."""
    said = G.companion_rows(beats.withColumn("emotions", F.lit(None).cast("array<struct<emotion:string,weight:double>>")).withColumn("beat_id", F.struct("scope_id", "beat_id")))
    rows = beats.join(said.select("beat_id.*", "summary", "content"), ["scope_id", "beat_id"])
    return rows.select(
        "scope_id", F.lit("character_topics").alias("lane"), F.lit(kind).cast("string").alias("kind"), F.concat(F.lit("ctopic-"), "beat_id").alias("id"), F.col("seq").alias("pos"), "summary", "content", "source_chat_id", F.col("turn_start").cast("bigint").alias("turn_start"),
    )


def _taken_in(ledger: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, decisions): new rows are placed after those that are there."""
    last = ledger.groupBy("scope_id").agg(F.max("pos").alias("_last"))
    place = F.row_number().over(W.partitionBy("scope_id").orderBy("pos", "id"))
    placed = checkpoint(incoming.join(last, "scope_id", "left").withColumn("pos", (F.coalesce("_last", F.lit(0)) + place).cast("bigint")).drop("_last"))
    decided = checkpoint(ingest.decisions(ledger, placed))
    return ledger.select(*ingest.COLUMNS).unionByName(ingest.created(placed, decided).select(*ingest.COLUMNS)), decided


def transcripts(scored: DataFrame, analyses: DataFrame, beats: DataFrame, ledger: DataFrame, threshold: float = 0.4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(beats, ledger, decisions) after the import of scored chunks.

    scored: as of ``turns.score``, with scope_id and source_chat_id; analyses: (beat_id, motivation, outcome), and a chunk without one is left for a later
    run. What the threshold passes over, and what is stored, is not looked at again.
    """
    own = T.late_boost(scored.withColumn("_plain", F.col("salience"))).where(F.col("_plain") >= threshold).withColumn("beat_id", _id(scored))  # the boost does not open the gate
    fresh = own.join(analyses.where("motivation is not null").dropDuplicates(["beat_id"]), "beat_id").join(beats.select("scope_id", "beat_id"), ["scope_id", "beat_id"], "left_anti")
    first = F.row_number().over(W.partitionBy("scope_id", "beat_id").orderBy("source_chat_id", "chunk_id"))
    fresh = fresh.withColumn("_rn", first).where("_rn = 1")
    last = beats.groupBy("scope_id").agg(F.max("seq").alias("_last"))
    seq = F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy("scope_id").orderBy("source_chat_id", "chunk_id"))
    new = fresh.join(last, "scope_id", "left").select("scope_id", "beat_id", "speaker", "text", "turn_start", "turn_end", F.col("primary_emotion").alias("emotion"), "motivation", "outcome", "salience", "source_chat_id", seq.cast("bigint").alias("seq"))
    new = checkpoint(new)
    after, decided = _taken_in(ledger, _companions(new, "incident"))
    return beats.unionByName(new), after, decided


def backfilled(beats: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, decisions): stored beats that have no companion of their own get one, unless it says what is there already. A second run changes nothing."""
    rows = _companions(beats, "incident")
    return _taken_in(ledger, rows.join(ledger.select("scope_id", "id"), ["scope_id", "id"], "left_anti"))


def scene_recaps(scenes: DataFrame, beats: DataFrame, threads: DataFrame, known: DataFrame, least: int = 20, notes: int = 8) -> tuple[DataFrame, DataFrame]:
    """(recaps, closed): a recap of each concluded scene of a character, once, and the scene's threads that it closes.

    scenes: (scope_id, scene_id, name, summary, concluded); beats: (scope_id, beat_id, thread_id, source_chat_id, salience, seq);
    threads: (thread_id, chat_id, status); known: (scope_id, scene_id) with recaps. Members are the beats of the scene, or of a thread that is active in it.
    """
    body = F.trim(F.regexp_replace("summary", r"\s+", " "))
    new = checkpoint(scenes.withColumn("summary", body).where(F.length("summary") >= least).join(known.select("scope_id", "scene_id"), ["scope_id", "scene_id"], "left_anti"))
    active = threads.where("status = 'active'").select("thread_id", F.col("chat_id").alias("scene_id"))
    own = new.select("scope_id", "scene_id")
    members = beats.withColumn("scene_id", F.col("source_chat_id")).join(own, ["scope_id", "scene_id"]).select("scope_id", "scene_id", "beat_id", "salience", "seq")
    members = members.unionByName(beats.join(active, "thread_id").join(own, ["scope_id", "scene_id"]).select("scope_id", "scene_id", "beat_id", "salience", "seq")).distinct()
    ranked = members.withColumn("_r", F.row_number().over(W.partitionBy("scope_id", "scene_id").orderBy(F.desc("salience"), "beat_id")))
    found = ranked.groupBy("scope_id", "scene_id").agg(
        F.count("*").alias("members"), F.max("seq").alias("through"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= notes, F.struct("_r", "beat_id")))), lambda x: x["beat_id"]).alias("footnotes"),
    )
    named = F.trim(F.regexp_replace(F.coalesce("name", F.concat(F.lit("Scene concluded "), F.substring(F.col("concluded").cast("string"), 1, 10))), "(?i)^Scene:\\s*", ""))
    arc = F.concat(F.lit("arc-"), F.substring(F.sha1(F.concat_ws("/", "scope_id", "scene_id")), 1, 10))
    rows = new.join(found, ["scope_id", "scene_id"], "left").withColumns({"arc_id": arc, "label": named})
    recaps = rows.select(
        "scope_id", "scene_id", "arc_id", F.concat(F.lit("recap-"), "arc_id").alias("id"), "label", F.col("summary").alias("content"), F.coalesce("members", F.lit(0)).cast("bigint").alias("members"), F.coalesce("through", F.lit(0)).cast("bigint").alias("covered_through"), F.coalesce("footnotes", F.array().cast("array<string>")).alias("footnotes"),
    )
    return recaps, threads.join(own.select(F.col("scene_id").alias("chat_id")).distinct(), "chat_id").where("status = 'active'").select("thread_id")


def reattributed(beats: DataFrame, ledger: DataFrame, subjects: DataFrame, resolved: DataFrame, session: str, chats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(beats, ledger, pooled): beats of the chats given go to whom they are about.

    subjects: (scope_id, beat_id, subject), a beat without a row stays; resolved: (name, identity_key); chats: (source_chat_id). Of the user, the
    session's character, nobody, or its own scope's character: it stays. Of somebody known: it moves, under a new id, and its companion is taken in there
    like any row. Of somebody unknown: it is pooled. What moved or was pooled leaves its old ledger.
    """
    from convmem.operators.composites import labels_match

    asked = beats.join(chats.select("source_chat_id").distinct(), "source_chat_id", "left_semi").join(subjects.select("scope_id", "beat_id", F.trim("subject").alias("subject")), ["scope_id", "beat_id"])
    known = resolved.where("identity_key is not null").select(F.col("name").alias("subject"), "identity_key")
    rows = asked.join(known, "subject", "left")
    own = (F.coalesce("subject", F.lit("")) == "") | (X.label(F.col("subject")) == "user") | labels_match(F.col("subject"), F.lit(session), 0.9) | F.coalesce(F.col("identity_key") == F.col("scope_id"), F.lit(False))
    rows = checkpoint(rows.where(~own))
    gone = rows.select("scope_id", "beat_id")
    moved = rows.where("identity_key is not null").withColumns({"scope_id": F.col("identity_key"), "speaker": F.col("subject")}).drop("identity_key", "subject")
    moved = moved.withColumn("beat_id", _id(moved)).join(beats.select("scope_id", "beat_id"), ["scope_id", "beat_id"], "left_anti").dropDuplicates(["scope_id", "beat_id"])
    last = beats.groupBy("scope_id").agg(F.max("seq").alias("_last"))
    place = F.row_number().over(W.partitionBy("scope_id").orderBy("source_chat_id", "seq", "beat_id"))
    moved = checkpoint(moved.join(last, "scope_id", "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + place).cast("bigint")).select(*beats.columns))
    left = ledger.join(gone.select("scope_id", F.concat(F.lit("ctopic-"), "beat_id").alias("id")), ["scope_id", "id"], "left_anti")
    after, _ = _taken_in(left, _companions(moved, None))
    pooled = rows.where("identity_key is null").select(X.label(F.col("subject")).alias("speaker_norm"), F.col("subject").alias("speaker"), "beat_id", "source_chat_id")
    return beats.join(gone, ["scope_id", "beat_id"], "left_anti").unionByName(moved), after, pooled
