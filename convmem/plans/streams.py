"""Streaming operators over the conversations, read as a stream to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convmem.functions import signals
from convmem.functions import text as X
from convmem.operators import turns as T
from convmem.operators.graph import shared_folder
from convmem.plans import bindings as B
from convmem.streaming import conversations as ST

Q: dict = {}
SQL: dict[str, str] = {}

#: A turn comes seven minutes after the one before, but for each fifth, which waits for the next day; every third marks a place, with a weight by its number.
_TEXT = "concat(CASE turn % 3 WHEN 0 THEN concat('[bookmark: topic=\"place ', CAST(turn AS STRING), '\", weight=0.', CAST(1 + (conv_id + turn) % 9 AS STRING), '] ') ELSE '' END, CASE (conv_id + turn) % 7 WHEN 0 THEN 'Good evening, it is late. ' WHEN 1 THEN 'I just woke up. ' WHEN 3 THEN 'Happy friday. ' WHEN 5 THEN 'brb ' ELSE '' END, text)"
_WHEN = "conv_id % 50 * 86400 + turn * 420 + CAST(floor(turn / 5) AS BIGINT) * 86400"


def turns(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    rows = spark.readStream.schema(B.table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a pattern, so that a single file will do
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.expr(_WHEN))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.expr(_TEXT).alias("text"), at.alias("ts")).withColumns(more)


def played(stream: DataFrame) -> DataFrame:
    """What a stream writes until its input ends, as a table in the shared folder."""
    at = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def _of(operator: Callable[[DataFrame], DataFrame], **more: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """Columns are made when the query is, for there may be no session yet."""
    return lambda spark, sf_dir: played(operator(turns(spark, sf_dir, **{n: c() for n, c in more.items()})))


_TURNS = f"""t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, {_TEXT.replace("AS STRING", "AS VARCHAR")} AS text, CAST({_WHEN} AS BIGINT) AS sec,
  row_number() OVER (PARTITION BY conv_id ORDER BY {_WHEN}, turn) AS rn FROM conversations)"""

Q["st1_new_turns"] = lambda s, d: played(ST.new_turns(turns(s, d).unionByName(turns(s, d)))).select("conv_id", "turn", "role")
SQL["st1_new_turns"] = "SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations"

Q["st2_bookmarks"] = lambda s, d: _of(ST.bookmark_state)(s, d).select("conv_id", "turn", "topic", F.round("weight", 6).alias("weight"))
SQL["st2_bookmarks"] = f"""WITH {_TURNS}, m AS (SELECT conv_id, rn, regexp_extract(text, 'topic="([^"]*)"', 1) AS topic, CAST(regexp_extract(text, 'weight=([0-9.]+)', 1) AS DOUBLE) AS w FROM t WHERE contains(text, '[bookmark:'))
SELECT t.conv_id, t.turn, topic, round(w * pow(0.9::DOUBLE, t.rn - m.rn), 6) AS weight FROM t JOIN m ON m.conv_id = t.conv_id AND m.rn <= t.rn WHERE m.rn = t.rn OR w * pow(0.9::DOUBLE, t.rn - m.rn) >= 0.1 - 1e-9"""


def _phrases(table: dict[str, list[str]]) -> str:
    hit = lambda ps: " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in ps)
    return "CASE " + " ".join(f"WHEN {hit(ps)} THEN '{k}'" for k, ps in table.items()) + " END"


Q["st3_soft_clock"] = _of(lambda t: ST.soft_clock(t, signals.TIMES, signals.DAYS))
SQL["st3_soft_clock"] = f"""WITH RECURSIVE {_TURNS}, g AS (SELECT *, {_phrases(signals.TIMES)} AS told, {_phrases(signals.DAYS)} AS named, {_phrases({"x": signals.AWAY}).replace("'x'", "true")} AS gone, role = 'user' AND text <> '' AS said FROM t),
c AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS day, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS VARCHAR) AS after, CAST(NULL AS VARCHAR) AS presence, CAST(0 AS BIGINT) AS returns FROM t GROUP BY 1
  UNION ALL SELECT g.conv_id, g.rn, g.turn, coalesce(named, CASE WHEN told = 'morning' AND part IN ('evening', 'night', 'late_night') AND day IS NOT NULL THEN ['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'][list_position(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], day) % 7 + 1] ELSE day END),
  coalesce(told, part), CASE WHEN told = 'morning' AND part IN ('evening', 'night', 'late_night') THEN part END,
  CASE WHEN said AND gone THEN 'away' WHEN said AND presence = 'away' THEN 'present' ELSE presence END, CASE WHEN said AND coalesce(gone, false) = false AND presence = 'away' THEN returns + 1 ELSE returns END
  FROM c JOIN g ON g.conv_id = c.conv_id AND g.rn = c.rn + 1) SELECT conv_id, turn, day, part, after, presence, returns FROM c WHERE rn > 0"""

_LABEL = lambda: F.concat(F.element_at(F.split(F.regexp_replace("text", r"^\[[^\]]*\] *", ""), " "), 1), F.lit(" affair"))
Q["st4_threads"] = _of(ST.threads, label=lambda: F.when(F.col("turn") % 4 != 1, _LABEL()), participant=lambda: F.col("role"))

Q["st5_snapshots"] = lambda s, d: _of(ST.snapshots)(s, d).select("conv_id", "turn", F.md5("messages").alias("messages"))
SQL["st5_snapshots"] = f"""WITH RECURSIVE {_TURNS}, c AS (SELECT conv_id, rn, turn, sec AS fired, false AS fires FROM t WHERE rn = 1
  UNION ALL SELECT t.conv_id, t.rn, t.turn, CASE WHEN t.sec - fired >= 1800 THEN t.sec ELSE fired END, t.sec - fired >= 1800 FROM c JOIN t ON t.conv_id = c.conv_id AND t.rn = c.rn + 1)
SELECT c.conv_id, c.turn, (SELECT md5(string_agg(role || ': ' || text, chr(10) ORDER BY x.rn)) FROM t x WHERE x.conv_id = c.conv_id AND x.rn BETWEEN c.rn - 39 AND c.rn) AS messages FROM c WHERE fires"""

_SURFACED = lambda: F.array(
    F.struct(F.concat(F.lit("e"), F.col("turn").cast("string")).alias("id"), F.concat(F.substring("text", 1, 60), F.lit(" the and with")).alias("summary"))
)
Q["st6_recited"] = _of(ST.recited, surfaced=_SURFACED)
_BAG = B.sql_bag("{}")
_STOPS = "[" + ", ".join(f"'{w}'" for w in ST.STOP_WORDS) + "]"
SQL["st6_recited"] = f"""WITH {_TURNS}, w AS (SELECT conv_id, rn, turn, list_filter({_BAG.format("text")}, lambda w: length(w) > 2 AND NOT list_contains({_STOPS}, w)) AS said, list_filter({_BAG.format("substring(text, 1, 60) || ' the and with'")}, lambda w: length(w) > 2 AND NOT list_contains({_STOPS}, w)) AS ws FROM t)
SELECT a.conv_id, a.turn, 'e' || b.turn AS id FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.rn = a.rn - 1 WHERE len(b.ws) > 0 AND len(list_intersect(b.ws, a.said)) / len(b.ws)::DOUBLE >= 0.3"""


def live_beats(rows: DataFrame) -> DataFrame:
    """What a micro-batch of messages brings: turns, chunks, scores, the gate, and beats by their ids."""
    chunks = T.chunks(T.parse_turns(B.as_messages(rows)))
    scored = T.gate(T.score(chunks, B.LEXICON, B.SCORING, B.DIRECT, B.DEFLECTION, B.ATTACHMENT))
    beat = X.beat_id(F.col("turn_start"), F.col("turn_end"), F.col("speaker"), F.col("text"))
    return scored.select("conv_id", beat.alias("beat_id"), "speaker", "primary_emotion", F.round("salience", 6).alias("salience"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a stream into a table of beats, committed batch by batch."""
    at = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(B.table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque[t]")
    write = ST.committed(live_beats, f"{at}/beats", ["conv_id", "beat_id"])
    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/beats").select("conv_id", "beat_id", "speaker", "primary_emotion", "salience")


Q["st7_live_beats"] = live
SQL["st7_live_beats"] = f"""WITH {B.SCORES} SELECT DISTINCT conv_id, 'beat-' || substr(sha1(turn_start::VARCHAR || ':' || turn_end::VARCHAR || ':' || speaker || chr(10) || text), 1, 12) AS beat_id, speaker,
CASE salience WHEN fear THEN 'fear' WHEN hope THEN 'hope' WHEN anger THEN 'anger' WHEN joy THEN 'joy' ELSE 'dysregulation' END AS primary_emotion, round(salience, 6) AS salience FROM scores WHERE salience >= 0.4"""
