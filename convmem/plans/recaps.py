"""Queries that pair scenes with their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.operators import pairing as P
from convmem.plans import bindings as B

Q: dict = {}
SQL: dict[str, str] = {}

# A conversation is a scene; five of them have one origin. Its summary is what its second speaker
# first says, or, by rule of the key, the neighbour's; some have none.
_BY = "CAST(floor(conv_id / 5) AS BIGINT)"


def scenes(spark, sf_dir):
    rows = B.table(spark, sf_dir, "conversations").select(F.expr(_BY).alias("origin"), F.col("conv_id").cast("bigint").alias("scene"), "turn", "text")
    joined = rows.groupBy("origin", "scene").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return joined.withColumns({"pos": F.col("scene"), "at": F.col("scene") * 1000})


def summaries(spark, sf_dir):
    rows = B.table(spark, sf_dir, "conversations").where("turn = 1 and conv_id % 7 <> 3").select(F.expr(_BY).alias("origin"), F.col("conv_id").cast("bigint").alias("summary"), "text")
    return rows.where("length(text) >= 20").withColumns({"pos": -F.col("summary"), "at": F.col("summary") * 1000 + F.when(F.col("summary") % 2 == 0, 700).otherwise(-300)})


_TABLES = f"""sc AS (SELECT {_BY} AS origin, CAST(conv_id AS BIGINT) AS scene, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2),
su AS (SELECT {_BY} AS origin, CAST(conv_id AS BIGINT) AS summary, text, CAST(conv_id AS BIGINT) * 1000 + CASE WHEN conv_id % 2 = 0 THEN 700 ELSE -300 END AS sec FROM conversations WHERE turn = 1 AND conv_id % 7 <> 3 AND length(text) >= 20),
ws AS (SELECT origin, summary, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in P.COMMON)}], w)) AS w FROM su),
e AS MATERIALIZED (SELECT sc.origin, scene, summary, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w)::DOUBLE AS score FROM sc JOIN ws USING (origin) WHERE len(w) > 0)"""

Q["j14_word_scores"] = lambda s, d: P.word_scores(scenes(s, d), summaries(s, d)).withColumn("score", F.round("score", 6))
SQL["j14_word_scores"] = f"WITH {_TABLES} SELECT origin, scene, summary, round(score, 6) AS score FROM e WHERE score > 0"

_GREEDY = f"""WITH RECURSIVE {_TABLES}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, scene, -summary) AS rn FROM e WHERE score >= 0.25),
g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS a, CAST([] AS BIGINT[]) AS b, CAST(NULL AS BIGINT) AS origin, CAST(NULL AS BIGINT) AS scene, CAST(NULL AS BIGINT) AS summary, CAST(NULL AS DOUBLE) AS score, false AS took
  UNION ALL SELECT o.rn, CASE WHEN free THEN list_append(a, o.scene) ELSE a END, CASE WHEN free THEN list_append(b, o.summary) ELSE b END, o.origin, o.scene, o.summary, o.score, free
  FROM (SELECT g.a, g.b, o.*, NOT list_contains(g.a, o.scene) AND NOT list_contains(g.b, o.summary) AS free FROM g JOIN o ON o.rn = g.rn + 1) o),
taken AS (SELECT origin, scene, summary, score FROM g WHERE took)"""
Q["j14_paired_recaps"] = lambda s, d: P.paired(scenes(s, d), summaries(s, d)).withColumn("score", F.round("score", 6))
SQL["j14_paired_recaps"] = f"{_GREEDY} SELECT origin, scene, summary, round(score, 6) AS score FROM taken"
Q["j14_recaps_or_nearest"] = lambda s, d: P.paired(scenes(s, d), summaries(s, d), fallback=True).select("scene", "summary")
SQL["j14_recaps_or_nearest"] = f"""{_GREEDY} SELECT scene, summary FROM taken UNION ALL
SELECT sc.scene, arg_min(su.summary, abs(su.sec - sc.scene * 1000) * 1000000000 - su.summary) AS summary FROM sc JOIN su USING (origin) WHERE sc.scene NOT IN (SELECT scene FROM taken) GROUP BY 1"""
