"""Queries over facts by meaning, beat clusters and arcs: vectors are those of ``embeddings``, texts those of the documents of the same number."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.operators import arcs as A
from convmem.operators import curation as K
from convmem.operators import ingest as I
from convmem.operators import routing as G
from convmem.plans import bindings as B

Q: dict = {}
SQL: dict[str, str] = {}

_COS = "list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"
#: Vectors of the table are hardly ever close, so these bounds are lower than the operators' own.
_MEANS, _NEAR = 0.3, 0.35


def facts(spark, sf_dir):
    """Facts without their texts, which ``texts`` has."""
    i = F.col("vec_id").cast("bigint")
    sizes = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").alias("chars"))
    rows = B.table(spark, sf_dir, "embeddings").join(sizes, "vec_id")
    return rows.select(F.col("label").cast("string").alias("scope_id"), i.alias("id"), (i % 3).alias("pass"), i.alias("pos"), "chars", F.when(i % 2 == 0, "user_topics").otherwise("character_topics").alias("lane"), F.when(i % 5 > 1, F.lit("Ann")).when(i % 5 == 1, F.lit("Bo")).alias("subject"), F.col("embedding").alias("vector"))


def texts(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("fact"))


_AGREED = f"""f AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS scope_id, CAST(vec_id AS BIGINT) AS id, vec_id % 3 AS pass, text AS fact, CASE WHEN vec_id % 2 = 0 THEN 'user_topics' ELSE 'character_topics' END AS lane,
  CASE WHEN vec_id % 5 > 1 THEN 'Ann' WHEN vec_id % 5 = 1 THEN 'Bo' ELSE '?' END AS subject, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN documents ON doc_id = vec_id),
p AS MATERIALIZED (SELECT y.id, list({{'c': {_COS}, 'a': x.id}}) AS near FROM f x JOIN f y ON x.scope_id = y.scope_id AND x.id < y.id WHERE {_COS} >= {_MEANS} GROUP BY 1),
o AS MATERIALIZED (SELECT p.*, row_number() OVER (ORDER BY id) AS rn FROM p),
s AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS followers, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader UNION ALL
  SELECT rn, CASE WHEN best IS NULL THEN followers ELSE list_append(followers, id) END, id, best.a FROM (SELECT o.rn, s.followers, o.id, list_reverse_sort(list_filter(o.near, lambda z: NOT list_contains(s.followers, z.a)))[1] AS best FROM s JOIN o ON o.rn = s.rn + 1)),
m AS (SELECT f.*, coalesce(s.leader, f.id) AS leader FROM f LEFT JOIN s ON s.id = f.id),
c AS (SELECT scope_id, leader, subject, count(*) AS c, min({{'p': pass, 'i': id}}) AS first, arg_min({{'f': fact, 'l': lane}}, {{'l': -length(fact), 'p': pass, 'i': id}}) AS rep FROM m GROUP BY 1, 2, 3),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY scope_id, leader ORDER BY c DESC, first) = 1), k AS (SELECT scope_id, leader, count(DISTINCT pass) AS seen FROM m GROUP BY 1, 2),
agreed AS (SELECT scope_id, leader, rep.l AS lane, rep.f AS fact, subject, seen FROM b JOIN k USING (scope_id, leader) WHERE seen >= 2)"""

Q["a3_consensus_by_meaning"] = lambda s, d: K.consensus_by_meaning(facts(s, d), 3, _MEANS, texts(s, d))
SQL["a3_consensus_by_meaning"] = f"WITH RECURSIVE {_AGREED} SELECT * FROM agreed"


def ingested(spark, sf_dir):
    agreed = A.checkpoint(K.consensus_by_meaning(facts(spark, sf_dir), 3, _MEANS, texts(spark, sf_dir))).withColumn("keep", F.col("leader") % 11 != 0)
    known = spark.createDataFrame([], "name string, identity_key string").unionByName(B.table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("Ann").alias("name"), F.lit("k9").alias("identity_key")))
    none = spark.createDataFrame([], "scope_id string, lane string, kind string, id string, pos bigint, summary string, content string, source_chat_id string, turn_start bigint")
    return I.decisions(none, G.facts_for_ledgers(agreed.where("keep"), known, ["user", "self", "?"]))


Q["d14_ingested_facts"] = ingested


def beats(spark, sf_dir):
    i = F.col("vec_id").cast("bigint")
    name = lambda k, c: F.concat(F.lit(c), (i % k).cast("string"))
    return B.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("scope_id"), F.concat(F.lit("b"), i.cast("string")).alias("beat_id"), i.alias("n"), i.alias("seq"), (F.lit(0.5) + i % 6 / 10.0).alias("salience"), F.when(i % 4 == 0, name(97, "t")).alias("thread_id"),
        F.array(name(13, "x"), name(17, "y")).alias("entities"), F.col("embedding").alias("vector"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")).alias("created"),
    )


Q["d5_beat_clusters"] = lambda s, d: A.beat_clusters(beats(s, d), _NEAR)
SQL["d5_beat_clusters"] = f"""WITH RECURSIVE b AS (SELECT CAST(label AS VARCHAR) AS scope_id, CAST(vec_id AS BIGINT) AS n, CASE WHEN vec_id % 4 = 0 THEN vec_id % 97 END AS t, vec_id % 221 AS e, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS MATERIALIZED (SELECT x.n AS a, y.n AS b FROM b x JOIN b y ON x.scope_id = y.scope_id AND x.n <> y.n WHERE x.t = y.t OR x.e = y.e OR {_COS} >= {_NEAR}),
r AS (SELECT a AS n, a AS m FROM p UNION SELECT r.n, p.b FROM r JOIN p ON p.a = r.m), c AS (SELECT n, min(m) AS cluster FROM r GROUP BY 1)
SELECT scope_id, cluster, 'b' || n AS beat_id FROM c JOIN b USING (n) QUALIFY count(*) OVER (PARTITION BY cluster) >= 3"""


def renderings(spark, sf_dir):
    rows = beats(spark, sf_dir)
    return rows.select("scope_id", "beat_id", (F.col("n") % 9 != 0).alias("keep"), F.when(F.col("n") % 3 == 0, "pivot").otherwise("minor").alias("role"), F.concat(F.lit("line of "), "beat_id").alias("label"), F.lit("It goes on").alias("lead"), F.concat(F.lit("What "), "beat_id", F.lit(" began.")).alias("body"))


def passes(spark, sf_dir):
    """Three passes: over the first half of the beats, over all of them, and once more with nothing new."""
    arcs, members = spark.createDataFrame([], A.ARC), spark.createDataFrame([], A.MEMBER)
    every, said = A.checkpoint(beats(spark, sf_dir)), renderings(spark, sf_dir)
    half = every.agg(F.max("n")).first()[0] or 0
    for rows, day in ((every.where(F.col("n") * 2 <= half), "2024-03-01"), (every, "2024-03-20"), (every, "2024-03-21")):
        arcs, members, recaps = A.promoted(rows, arcs, members, said, day, least=_NEAR)
    return arcs, members, recaps


Q["d11_promoted_arcs"] = lambda s, d: passes(s, d)[0].select("scope_id", "arc_id", "pos", "status", "label", F.size("threads").alias("threads"), F.size("entities").alias("entities"), "covered_through", "version", "promoted_at")
Q["d11_memberships"] = lambda s, d: passes(s, d)[1]
