"""Queries over conversations: turns, chunks, scores, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import turns as T
from convmem.plans import bindings as B

Q: dict = {}
SQL: dict[str, str] = {}
_LANES = ("fear", "hope", "anger", "joy", "dysregulation")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


Q["io1_messages"] = B.messages
SQL["io1_messages"] = f"WITH {B.MESSAGES} SELECT * FROM msg"

Q["p1_parse_turns"] = B.turns
SQL["p1_parse_turns"] = f"WITH {B.TURNS} SELECT * FROM turns"

Q["w1_chunks"] = B.chunks
SQL["w1_chunks"] = f"WITH {B.CHUNKS} SELECT * FROM chunks"

Q["a1_scores"] = lambda s, d: _rounded(B.scores(s, d).drop("text"), *_LANES, "salience")
_PRIMARY = "CASE WHEN salience > 0 THEN CASE salience WHEN fear THEN 'fear' WHEN hope THEN 'hope' WHEN anger THEN 'anger' WHEN joy THEN 'joy' ELSE 'dysregulation' END END"
_SCORED = f"conv_id, chunk_id, speaker, turn_start, turn_end, hits, {', '.join(f'round({k}, 6) AS {k}' for k in _LANES)}, round(salience, 6) AS salience, {_PRIMARY} AS primary_emotion"
SQL["a1_scores"] = f"WITH {B.SCORES} SELECT {_SCORED} FROM scores"

Q["v6_salience_gate"] = lambda s, d: _rounded(T.gate(B.scores(s, d)).select("conv_id", "chunk_id", "speaker", "salience"), "salience")
SQL["v6_salience_gate"] = f"WITH {B.SCORES} SELECT conv_id, chunk_id, speaker, round(salience, 6) AS salience FROM scores WHERE salience >= 0.4"

Q["flagship_top_chunks"] = lambda s, d: _rounded(T.top_chunks(T.gate(B.scores(s, d))).select("conv_id", "rank", "chunk_id", "speaker", "primary_emotion", "salience"), "salience")
SQL["flagship_top_chunks"] = f"""WITH {B.SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY salience DESC, chunk_id) AS rank FROM scores WHERE salience >= 0.4)
SELECT conv_id, rank, chunk_id, speaker, {_PRIMARY} AS primary_emotion, round(salience, 6) AS salience FROM ranked WHERE rank <= 3"""

Q["p33_late_boost"] = lambda s, d: _rounded(T.late_boost(B.scores(s, d)).select("conv_id", "chunk_id", "salience"), "salience")
SQL["p33_late_boost"] = f"""WITH {B.SCORES} SELECT conv_id, chunk_id,
round(CASE WHEN turn_start >= (max(turn_end) OVER (PARTITION BY conv_id) + 1) * 0.8::DOUBLE THEN least(1.0, salience * 1.3::DOUBLE) ELSE salience END, 6) AS salience FROM scores"""

Q["j16_neighbours"] = lambda s, d: T.neighbours(B.chunks(s, d), 400).select("conv_id", "chunk_id", "before", "after")
SQL["j16_neighbours"] = f"""WITH {B.CHUNKS} SELECT conv_id, chunk_id, substr(lag(text) OVER w, 1, 400) AS before, substr(lead(text) OVER w, 1, 400) AS after
FROM chunks WINDOW w AS (PARTITION BY conv_id ORDER BY chunk_id)"""

Q["p19_beat_ids"] = lambda s, d: B.chunks(s, d).select("conv_id", "chunk_id", X.beat_id(F.col("turn_start"), F.col("turn_end"), F.col("speaker"), F.col("text")).alias("beat_id"))
SQL["p19_beat_ids"] = f"""WITH {B.CHUNKS} SELECT conv_id, chunk_id, 'beat-' || substr(sha1(turn_start::VARCHAR || ':' || turn_end::VARCHAR || ':' || speaker || chr(10) || text), 1, 12) AS beat_id FROM chunks"""

Q["w8_last_messages"] = lambda s, d: T.last_messages(B.messages(s, d), 3).select("conv_id", "turn", "role")
SQL["w8_last_messages"] = f"""WITH {B.MESSAGES} SELECT conv_id, turn, role FROM msg QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3"""

Q["w11_fact_windows"] = lambda s, d: T.fact_windows(B.chunks(s, d), 2)
SQL["w11_fact_windows"] = f"""WITH {B.CHUNKS} SELECT conv_id, CAST(chunk_id // 2 AS BIGINT) AS window_id,
string_agg(CASE WHEN speaker = 'user' THEN 'User: ' ELSE 'Scene: ' END || text, chr(10) ORDER BY chunk_id) AS text FROM chunks GROUP BY 1, 2"""

Q["v9_relabel_narrator"] = lambda s, d: B.chunks(s, d).select("conv_id", "chunk_id", F.when(F.col("speaker") == "Narrator", F.lit("Mara")).otherwise(F.col("speaker")).alias("speaker"))
SQL["v9_relabel_narrator"] = f"WITH {B.CHUNKS} SELECT conv_id, chunk_id, CASE WHEN speaker = 'Narrator' THEN 'Mara' ELSE speaker END AS speaker FROM chunks"

Q["v7_speaker_filter"] = lambda s, d: B.chunks(s, d).where(F.contains(F.lower("speaker"), F.lit("ann")) | F.contains(F.lit("ann"), F.lower("speaker"))).select("conv_id", "chunk_id", "speaker")
SQL["v7_speaker_filter"] = f"WITH {B.CHUNKS} SELECT conv_id, chunk_id, speaker FROM chunks WHERE contains(lower(speaker), 'ann') OR contains('ann', lower(speaker))"

Q["v10_long_messages"] = lambda s, d: B.messages(s, d).select("conv_id", "turn", F.when((F.col("role") == "user") & (F.length("text") > 1500), F.lit("windowed")).otherwise(F.lit("single")).alias("path"))
SQL["v10_long_messages"] = f"WITH {B.MESSAGES} SELECT conv_id, turn, CASE WHEN role = 'user' AND length(text) > 1500 THEN 'windowed' ELSE 'single' END AS path FROM msg"

Q["v11_estimate"] = lambda s, d: B.scores(s, d).groupBy("conv_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("salience") >= 0.4).alias("passing")).withColumn("tokens", F.col("passing") * 700)
SQL["v11_estimate"] = f"WITH {B.SCORES} SELECT conv_id, count(*) AS chunks, count(*) FILTER (WHERE salience >= 0.4) AS passing, count(*) FILTER (WHERE salience >= 0.4) * 700 AS tokens FROM scores GROUP BY 1"

Q["a2_import_counts"] = lambda s, d: B.scores(s, d).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.count("*").alias("chunks"), F.count_if(F.col("salience") >= 0.4).alias("passed"), F.count_if(F.col("salience") < 0.4).alias("filtered"))
SQL["a2_import_counts"] = f"WITH {B.SCORES} SELECT conv_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, count(*) AS chunks, count(*) FILTER (WHERE salience >= 0.4) AS passed, count(*) FILTER (WHERE salience < 0.4) AS filtered FROM scores GROUP BY 1"

Q["v8_resume"] = lambda s, d: (lambda c: c.join(c.where("chunk_id % 2 = 0").select("beat_id"), "beat_id", "left_anti").select("conv_id", "chunk_id", "beat_id"))(B.chunks(s, d).withColumn("beat_id", X.beat_id(F.col("turn_start"), F.col("turn_end"), F.col("speaker"), F.col("text"))))
SQL["v8_resume"] = f"""WITH {B.CHUNKS}, b AS (SELECT conv_id, chunk_id, 'beat-' || substr(sha1(turn_start::VARCHAR || ':' || turn_end::VARCHAR || ':' || speaker || chr(10) || text), 1, 12) AS beat_id FROM chunks)
SELECT conv_id, chunk_id, beat_id FROM b WHERE beat_id NOT IN (SELECT beat_id FROM b WHERE chunk_id % 2 = 0)"""
