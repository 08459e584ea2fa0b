"""Queries that import the conversations as beats and ledger rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import importing as M
from convmem.operators.graph import checkpoint
from convmem.plans import bindings as B

Q: dict = {}
SQL: dict[str, str] = {}

_NONE = "scope_id string, lane string, kind string, id string, pos bigint, summary string, content string, source_chat_id string, turn_start bigint"


def _scored(s, d):
    """Ten conversations are one character's."""
    return B.scores(s, d).withColumns({"scope_id": F.concat(F.lit("k"), F.floor(F.col("conv_id") / 10).cast("string")), "source_chat_id": F.concat(F.lit("c"), F.col("conv_id").cast("string"))})


def _analyses(rows):
    """What a model would say, by rule: the beginning of the text; every ninth chunk has no answer."""
    own = rows.withColumn("beat_id", X.beat_id(F.col("turn_start"), F.col("turn_end"), F.col("speaker"), F.col("text")))
    return own.where(F.col("chunk_id") % 9 != 8).select("beat_id", F.substring("text", 1, 80).alias("motivation"), F.lit("none").alias("outcome"))


def imported(s, d):
    rows = checkpoint(_scored(s, d))
    return M.transcripts(rows, _analyses(rows), s.createDataFrame([], M.BEAT), s.createDataFrame([], _NONE))


Q["d15_imported_beats"] = lambda s, d: imported(s, d)[0].select("scope_id", "beat_id", "speaker", "source_chat_id", F.round("salience", 6).alias("salience"), "seq")
_BEATS = f"""{B.SCORES}, g0 AS (SELECT 'k' || (conv_id // 10) AS scope_id, 'c' || conv_id AS source_chat_id, *, max(turn_end) OVER (PARTITION BY conv_id) AS last FROM scores), g AS (SELECT * FROM g0 WHERE salience >= 0.4),
b0 AS (SELECT *, 'beat-' || substr(sha1(turn_start::VARCHAR || ':' || turn_end::VARCHAR || ':' || speaker || chr(10) || text), 1, 12) AS beat_id,
  CASE WHEN turn_start >= (last + 1) * 0.8::DOUBLE THEN least(1.0, salience * 1.3::DOUBLE) ELSE salience END AS boosted FROM g WHERE chunk_id % 9 <> 8 QUALIFY row_number() OVER (PARTITION BY scope_id, beat_id ORDER BY source_chat_id, chunk_id) = 1),
beats AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY source_chat_id, chunk_id) AS seq FROM b0)"""
SQL["d15_imported_beats"] = f"WITH {_BEATS} SELECT scope_id, beat_id, speaker, source_chat_id, round(boosted, 6) AS salience, seq FROM beats"
Q["d15_ledger_rows"] = lambda s, d: imported(s, d)[1].select("scope_id", "id", "lane", "kind", "source_chat_id")


def twice(s, d):
    """The same import again, over what the first one left: every table as it was."""
    rows = checkpoint(_scored(s, d))
    said = _analyses(rows)
    beats, ledger, _ = M.transcripts(rows, said, s.createDataFrame([], M.BEAT), s.createDataFrame([], _NONE))
    again, after, _ = M.transcripts(rows, said, checkpoint(beats), checkpoint(ledger))
    return again.select("scope_id", "beat_id", "speaker", "source_chat_id", F.round("salience", 6).alias("salience"), "seq")


Q["d15_import_twice"] = twice
SQL["d15_import_twice"] = SQL["d15_imported_beats"]


def backfill(s, d):
    beats, ledger, _ = imported(s, d)
    held = checkpoint(ledger).where("pos % 2 = 0")
    return M.backfilled(checkpoint(beats), held)[0].select("scope_id", "id", "lane", "source_chat_id")


Q["io13_backfilled_ledger"] = backfill


def _scenes(s, d):
    chats = B.ledger(s, d).select("scope_id", F.col("source_chat_id").alias("scene_id")).distinct()
    n = F.substring("scene_id", 2, 9).cast("int")
    return chats.select("scope_id", "scene_id", F.when(n % 3 > 0, F.concat(F.lit("Scene: the "), "scene_id")).alias("name"), F.concat(F.lit("What happened  in "), "scene_id", F.when(n % 4 == 0, ".").otherwise(" was long remembered.")).alias("summary"), F.lit("2024-02-03").alias("concluded"))


def _recaps(s, d):
    beats = B.ledger(s, d).select("scope_id", F.col("id").alias("beat_id"), "thread_id", "source_chat_id", ((F.col("entry_pos") % 97) / 97.0).alias("salience"), F.col("entry_pos").alias("seq"))
    threads = beats.where("thread_id is not null").groupBy("thread_id").agg(F.min("source_chat_id").alias("chat_id")).withColumn("status", F.when(F.length("thread_id") % 2 == 0, "closed").otherwise("active"))
    scenes = _scenes(s, d)
    return M.scene_recaps(scenes, beats, threads, scenes.where(F.substring("scene_id", -1, 1) == "7"))


Q["d12_scene_recaps"] = lambda s, d: _recaps(s, d)[0].select("scope_id", "scene_id", "arc_id", "label", "content", "members", "covered_through", F.array_join("footnotes", ",").alias("footnotes"))
SQL["d12_scene_recaps"] = f"""WITH {B.LEDGER}, b AS (SELECT scope_id, id AS beat_id, thread_id, source_chat_id, (entry_pos % 97) / 97.0::DOUBLE AS salience, entry_pos AS seq FROM ledger),
t AS (SELECT thread_id, min(source_chat_id) AS chat_id FROM b WHERE thread_id IS NOT NULL AND length(thread_id) % 2 = 1 GROUP BY 1),
s AS (SELECT DISTINCT scope_id, source_chat_id AS scene_id, CAST(substr(source_chat_id, 2) AS INT) AS n FROM ledger), w AS (SELECT *, 'What happened in ' || scene_id || CASE WHEN n % 4 = 0 THEN '.' ELSE ' was long remembered.' END AS content FROM s WHERE right(scene_id, 1) <> '7'),
m AS (SELECT w.scope_id, w.scene_id, beat_id, salience, seq FROM w JOIN b ON b.scope_id = w.scope_id AND b.source_chat_id = w.scene_id UNION SELECT w.scope_id, w.scene_id, beat_id, salience, seq FROM w JOIN t ON t.chat_id = w.scene_id JOIN b ON b.scope_id = w.scope_id AND b.thread_id = t.thread_id),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, scene_id ORDER BY salience DESC, beat_id) AS k FROM m),
f AS (SELECT scope_id, scene_id, count(*) AS members, max(seq) AS through, string_agg(beat_id, ',' ORDER BY k) FILTER (WHERE k <= 8) AS notes FROM r GROUP BY 1, 2)
SELECT w.scope_id, w.scene_id, 'arc-' || substr(sha1(w.scope_id || '/' || w.scene_id), 1, 10) AS arc_id, CASE WHEN n % 3 > 0 THEN 'the ' || w.scene_id ELSE 'Scene concluded 2024-02-03' END AS label, content,
coalesce(members, 0) AS members, coalesce(through, 0) AS covered_through, coalesce(notes, '') AS footnotes FROM w LEFT JOIN f USING (scope_id, scene_id) WHERE length(content) >= 20"""


def reattributed(s, d):
    beats, ledger, _ = imported(s, d)
    beats = checkpoint(beats)
    subjects = beats.select("scope_id", "beat_id", F.element_at(F.array(F.lit("user"), F.lit("Ann"), F.lit("Stranger"), F.lit(None).cast("string"), F.lit("Mara")), (F.col("seq") % 5 + 1).cast("int")).alias("subject"))
    known = B.table(s, d, "region").where("r_regionkey = 0").select(F.lit("Ann").alias("name"), F.lit("k3").alias("identity_key"))
    chats = beats.select("source_chat_id").where(F.substring("source_chat_id", -1, 1).isin("1", "2", "3", "4")).distinct()
    return M.reattributed(beats, checkpoint(ledger), subjects, known, "Mara", chats)


Q["d16_reattributed_beats"] = lambda s, d: reattributed(s, d)[0].select("scope_id", "beat_id", "speaker", "source_chat_id")
SQL["d16_reattributed_beats"] = f"""WITH {_BEATS}, a AS (SELECT *, right(source_chat_id, 1) IN ('1', '2', '3', '4') AND (seq % 5 = 2 OR (seq % 5 = 1 AND scope_id <> 'k3')) AS goes FROM beats),
n AS (SELECT DISTINCT 'k3' AS scope_id, 'beat-' || substr(sha1(turn_start::VARCHAR || ':' || turn_end::VARCHAR || ':Ann' || chr(10) || text), 1, 12) AS beat_id, 'Ann' AS speaker, source_chat_id FROM a WHERE goes AND seq % 5 = 1)
SELECT scope_id, beat_id, speaker, source_chat_id FROM a WHERE NOT goes UNION ALL SELECT * FROM n WHERE beat_id NOT IN (SELECT beat_id FROM beats WHERE scope_id = 'k3')"""
Q["d16_pooled_beats"] = lambda s, d: reattributed(s, d)[2].select("speaker_norm", "beat_id")
SQL["d16_pooled_beats"] = f"WITH {_BEATS} SELECT 'stranger' AS speaker_norm, beat_id FROM beats WHERE right(source_chat_id, 1) IN ('1', '2', '3', '4') AND seq % 5 = 2"
