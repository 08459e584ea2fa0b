"""Queries over what is made of several steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import composites as M
from convmem.operators import curation as K
from convmem.operators import identity as I
from convmem.operators.graph import checkpoint
from convmem.plans import bindings as B
from convmem.plans import people as P

Q: dict = {}
SQL: dict[str, str] = {}
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def _similar(a: str, b: str) -> str:
    same = f"CASE WHEN {a}[1] <> {b}[1] THEN 0 WHEN {a}[2] <> {b}[2] THEN 1 WHEN {a}[3] <> {b}[3] THEN 2 WHEN {a}[4] <> {b}[4] THEN 3 ELSE 4 END"
    return f"(CASE WHEN {a} = {b} THEN 1 ELSE jaro_similarity({a}, {b}) + {same} * 0.1::DOUBLE * (1 - jaro_similarity({a}, {b})) END)"


def _match(a: str, b: str, least: float) -> str:
    words = lambda x: f"list_distinct(list_filter(string_split_regex({x}, '[^\\pL\\pN]+'), lambda w: length(w) >= 3))"
    fewer = f"least(len({words(a)}), len({words(b)}))"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR ({fewer} > 0 AND len(list_intersect({words(a)}, {words(b)})) = {fewer}) OR {_similar(a, b)} >= {least}::DOUBLE))"


def _pick(values: list[str], n) -> F.Column:
    return F.element_at(X.words(values), (F.col("o_orderkey") % n + 1).cast("int"))


Q["p34_clock_lines"] = lambda s, d: B.table(s, d, "orders").select(
    "o_orderkey",
    M.clock_line(
        _pick(["morning", "late_night", "unknown", "evening"], 4),
        _pick(["monday", "unknown", "sunday"], 3),
        F.when(F.col("o_orderkey") % 5 == 0, "late_night"),
        F.when(F.col("o_orderkey") % 7 == 0, "away").otherwise("here"),
        F.col("o_orderkey") % 2,
    ).alias("line"),
)
SQL["p34_clock_lines"] = """WITH o AS (SELECT o_orderkey AS k, (['morning', 'late night', NULL, 'evening'])[o_orderkey % 4 + 1] AS t, (['Monday', NULL, 'Sunday'])[o_orderkey % 3 + 1] AS d FROM orders),
p AS (SELECT k, concat_ws(', ', t, d) AS w, CASE WHEN k % 7 = 0 THEN 'the user has stepped away and will return when ready' WHEN k % 2 > 0 THEN 'the user steps away and comes back on their own schedule — they manage their own time' END AS n FROM o),
l AS (SELECT k, concat_ws(' · ', CASE WHEN w <> '' THEN w || CASE WHEN k % 5 = 0 THEN ' (morning after late night)' ELSE '' END END, n) AS l FROM p) SELECT k AS o_orderkey, CASE WHEN l = '' THEN '' ELSE 'Session context: ' || l END AS line FROM l"""

Q["j4_session_names"] = lambda s, d: B.table(s, d, "part").select(
    "p_partkey",
    M.labels_match(F.when(F.col("p_partkey") % 5 == 0, F.upper(F.element_at(F.split("p_name", " "), 1))).when(F.col("p_partkey") % 3 == 0, F.translate("p_name", "i", "ö")).otherwise(F.col("p_name")), F.lit("Small Ring"), 0.9).alias("own"),
)
SQL["j4_session_names"] = f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN string_split(p_name, ' ')[1] WHEN p_partkey % 3 = 0 THEN replace(p_name, 'i', 'ö') ELSE p_name END AS a, 'small ring' AS b FROM part)
SELECT p_partkey, {_match("a", "b", 0.9)} AS own FROM p"""


def _lines(s, d):
    names = B.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return B.table(s, d, "lineitem").join(names, "l_partkey").select(F.col("l_orderkey").alias("chat_id"), F.col("l_linenumber").alias("thread_id"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("label"), F.when(F.col("l_linestatus") == "O", "active").otherwise("closed").alias("status"))


Q["j20_first_threads"] = lambda s, d: M.first_thread(_lines(s, d).where("pos = 1").select("chat_id", F.expr("substring(label, 1, length(label) - 1)").alias("label")), _lines(s, d).where("pos > 1"))
SQL["j20_first_threads"] = f"""WITH l AS (SELECT l_orderkey AS chat_id, l_linenumber AS pos, p_name AS b, l_linestatus FROM lineitem JOIN part ON p_partkey = l_partkey),
q AS (SELECT DISTINCT chat_id, b[1:-2] AS a FROM l WHERE pos = 1), h AS (SELECT q.chat_id, a, min(pos) AS t FROM q JOIN l ON l.chat_id = q.chat_id WHERE pos > 1 AND l_linestatus = 'O' AND {_match("a", "b", 0.85)} GROUP BY 1, 2)
SELECT q.chat_id, q.a AS label, t AS thread_id FROM q LEFT JOIN h ON h.chat_id = q.chat_id AND h.a = q.a"""


def _said(s, d):
    newest = F.row_number().over(P.K.W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return B.table(s, d, "conversations").withColumn("rn", newest).where("rn <= 2").select(F.col("conv_id").alias("chat_id"), F.col("text").alias("talk"))


Q["j21_label_relevance"] = lambda s, d: M.label_relevance(B.table(s, d, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("thread_id"), F.col("text").alias("label")), _said(s, d)).withColumn("relevance", F.round("relevance", 6))
SQL["j21_label_relevance"] = f"""WITH t AS (SELECT conv_id, turn, list_filter({B.sql_bag("text")}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)) AS tw FROM conversations),
n AS (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2), r AS (SELECT conv_id, list_distinct(flatten(list({B.sql_bag("text")}))) AS talk FROM n GROUP BY 1)
SELECT conv_id AS chat_id, turn AS thread_id, round(len(list_intersect(tw, talk)) / len(tw)::DOUBLE, 6) AS relevance FROM t JOIN r USING (conv_id) WHERE len(list_intersect(tw, talk)) > 0"""

Q["j24_routed_beats"] = lambda s, d: M.routed_beats(
    P._names(s, d).select(F.col("name").alias("beat_id"), F.col("name").alias("subject"), F.when(F.substring("name", -1, 1).isin("1", "3", "5"), "Narrator").otherwise("Zed").alias("speaker")),
    I.resolved(P._names(s, d), P._aliases(s, d), P._identities(s, d)), "k5", "NATION_1", ["user", "Narrator"],
)
SQL["j24_routed_beats"] = f"""WITH j3 AS ({P.SQL["j3_resolved_names"]}), s AS (SELECT name, identity_key AS k, lower(name) AS a, 'nation_1' AS b, CASE WHEN right(name, 1) IN ('1', '3', '5') THEN 'Narrator' ELSE 'Zed' END AS speaker FROM j3),
r AS (SELECT *, CASE WHEN {_match("a", "b", 0.9)} OR k = 'k5' THEN 'bucket' WHEN k IS NOT NULL THEN 'routed' WHEN speaker = 'Zed' THEN 'pending' ELSE 'bucket' END AS route FROM s)
SELECT name AS beat_id, route, CASE route WHEN 'routed' THEN k WHEN 'bucket' THEN 'k5' END AS identity_key, CASE route WHEN 'bucket' THEN speaker ELSE name END AS speaker FROM r"""


def _signed(s, d):
    i = F.col("vec_id")
    return B.table(s, d, "embeddings").select(F.col("label").alias("scope_id"), i, F.array(i % 97 + F.when(i % 10 == 0, 1).otherwise(0)).alias("threads"), F.array(i % 5, i % 7 + 10).alias("entities"), F.col("embedding").alias("centroid"), F.when(i % 20 == 0, "active").otherwise("dormant").alias("status"))


Q["j10_matched_arcs"] = lambda s, d: M.matched_arcs(_signed(s, d).where("vec_id % 10 <> 0").withColumnRenamed("vec_id", "cluster").drop("status"), _signed(s, d).where("vec_id % 10 = 0").withColumns({"arc_id": F.concat(F.lit("a"), F.col("vec_id").cast("string")), "pos": F.col("vec_id")}))
SQL["j10_matched_arcs"] = """WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT * FROM v WHERE vec_id % 10 <> 0), a AS (SELECT * FROM v WHERE vec_id % 10 = 0),
h AS (SELECT c.vec_id, min(a.vec_id) AS m FROM c JOIN a USING (label) WHERE c.vec_id % 97 = a.vec_id % 97 + 1 OR list_dot_product(c.v, a.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(a.v, a.v))) >= 0.7
  OR (a.vec_id % 20 = 0 AND c.vec_id % 5 = a.vec_id % 5 AND c.vec_id % 7 = a.vec_id % 7) GROUP BY 1)
SELECT c.label AS scope_id, c.vec_id AS cluster, 'a' || m AS arc_id FROM c LEFT JOIN h USING (vec_id)"""

#: Words that hold a merge; the table's texts are invented, so these are, too.
_DOMAINS = {"family": ["ouaux", "tionre"], "health": ["thintion", "lement"]}


def _merges(s, d):
    rows = K.proposals(P._clusters(s, d), P._verdicts(s, d)).where("verdict = 'merge'")
    return rows.select("cluster", "canonical_id", "redundant_ids", F.when(F.col("cluster") % 4 == 0, "medium").otherwise("high").alias("confidence"), F.concat(F.lit("same "), F.col("cluster").cast("string")).alias("rationale"))


def _applied(s, d, merges=None):
    return M.applied_merges(B.ledger(s, d), merges or _merges(s, d), _DOMAINS, "2024-03-01")


_IN = lambda words: f"bool_or(regexp_matches(lower(text), '(^|[^a-z0-9_])(?:{'|'.join(words)})([^a-z0-9_]|$)'))"
_MERGED = f"""{P._CL}, ok AS (SELECT *, CASE WHEN cluster % 4 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM cl WHERE cluster % 3 <> 0 AND cluster % 5 <> 0 AND n > 1),
seen AS (SELECT cluster, {_IN(_DOMAINS["family"])} AS family, {_IN(_DOMAINS["health"])} AS health FROM ok JOIN documents ON doc_id BETWEEN m AND least(m + 2, m + n - 1) GROUP BY 1),
gate AS (SELECT ok.*, concat_ws(', ', CASE WHEN confidence <> 'high' THEN 'confidence' END, CASE WHEN family THEN 'family' END, CASE WHEN health THEN 'health' END) AS reasons,
  list_transform(list_filter([1, 2], lambda k: k < n), lambda k: 'e' || (m + k)) AS red FROM ok JOIN seen USING (cluster))"""

Q["d7_merge_audit"] = lambda s, d: _applied(s, d)[2].withColumns({"redundant_ids": F.array_join("redundant_ids", ","), "superseded_ids": F.array_join("superseded_ids", ",")}).drop("at")
SQL["d7_merge_audit"] = f"""WITH {_MERGED} SELECT 'apply' AS mode, cluster, 'merge' AS verdict, 'e' || m AS canonical_id, array_to_string(list_sort(red), ',') AS redundant_ids, confidence,
CASE WHEN reasons = '' THEN 'same ' || cluster ELSE 'HELD for review (' || reasons || ')' END AS rationale, CASE WHEN reasons = '' THEN array_to_string(list_sort(red), ',') ELSE '' END AS superseded_ids FROM gate"""
Q["d7_held_merges"] = lambda s, d: _applied(s, d)[1].withColumn("reasons", F.array_join("reasons", ", ")).drop("at")
SQL["d7_held_merges"] = f"""WITH {_MERGED} SELECT cluster, 'sweep' AS source, 'merge: keep e' || m || ' ⟵ retire [' || array_to_string(list_sort(red), ', ') || ']' AS summary, confidence, reasons FROM gate WHERE reasons <> ''"""
Q["d7_merged_ledger"] = lambda s, d: _applied(s, d)[0].select("id", "superseded_by", "temp")
_SUPERSEDED = "SELECT id, coalesce(canon, superseded_by) AS superseded_by, CASE WHEN canon IS NOT NULL THEN 'cold' ELSE temp END AS temp FROM ledger LEFT JOIN done USING (id)"
SQL["d7_merged_ledger"] = f"WITH {B.LEDGER}, {_MERGED}, done AS (SELECT unnest(red) AS id, 'e' || m AS canon FROM gate WHERE reasons = '') {_SUPERSEDED}"
Q["io12_replayed_merges"] = lambda s, d: _applied(s, d, checkpoint(_merges(s, d)).where("cluster % 7 <> 1"))[0].select("id", "superseded_by", "temp")
SQL["io12_replayed_merges"] = f"WITH {B.LEDGER}, {_MERGED}, done AS (SELECT unnest(red) AS id, 'e' || m AS canon FROM gate WHERE reasons = '' AND cluster % 7 <> 1) {_SUPERSEDED}"
Q["io6_sweep_tallies"] = lambda s, d: K.tallies(_applied(s, d)[2])
SQL["io6_sweep_tallies"] = f"""WITH {_MERGED} SELECT 'mode' AS dimension, 'apply' AS value, count(*) AS n FROM gate UNION ALL SELECT 'verdict', 'merge', count(*) FROM gate UNION ALL SELECT 'confidence', confidence, count(*) FROM gate GROUP BY 2"""


def _moved(s, d):
    pending = B.ledger(s, d).select(F.col("source_chat_id").alias("speaker_norm"), F.upper("source_chat_id").alias("speaker"), F.col("id").alias("beat_id"))
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    mapping = B.table(s, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("speaker_norm"), key("c_custkey").alias("identity_key"))
    beats = B.ledger(s, d).where("entry_pos % 4 = 0").select(F.concat(F.lit("k"), (F.col("entry_pos") % 100).cast("string")).alias("identity_key"), F.col("id").alias("beat_id"))
    aliases = B.table(s, d, "nation").select(key("n_nationkey").alias("identity_key"), F.concat(F.lit(" C"), (F.col("n_nationkey") + 5).cast("string")).alias("label"))
    return M.migrated(pending, mapping, beats, aliases)


Q["l13_migrated_beats"] = lambda s, d: _moved(s, d)[0]
SQL["l13_migrated_beats"] = "SELECT 'k' || doc_id % 100 AS identity_key, 'e' || doc_id AS beat_id FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 100 % 3 = 0 AND doc_id % 100 IN (SELECT c_custkey FROM customer))"
Q["l13_left_pending"] = lambda s, d: _moved(s, d)[1].select("speaker_norm", "beat_id")
SQL["l13_left_pending"] = "SELECT 'c' || doc_id % 100 AS speaker_norm, 'e' || doc_id AS beat_id FROM documents WHERE NOT (doc_id % 100 % 3 = 0 AND doc_id % 100 IN (SELECT c_custkey FROM customer))"
Q["l13_learnt_aliases"] = lambda s, d: _moved(s, d)[2]
SQL["l13_learnt_aliases"] = """SELECT 'k' || n_nationkey AS identity_key, ' C' || (n_nationkey + 5) AS label FROM nation UNION ALL
SELECT 'k' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey IN (SELECT doc_id % 100 FROM documents) AND c_custkey NOT IN (SELECT n_nationkey + 5 FROM nation)"""


def _sized(frame):
    return frame.assign(n=frame["text"].str.len())


def _cached(s, d):
    rows = B.table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "turn", "text")
    return M.completed_cache(rows.select("id", "text"), rows.where("turn % 2 = 0").select("id", F.lit(-1).cast("bigint").alias("n")), "id", _sized, "n long")


Q["u4_completed_cache"] = _cached
SQL["u4_completed_cache"] = "SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 2 = 0 THEN -1 ELSE CAST(length(text) AS BIGINT) END AS n FROM conversations"

# Order decides here, which SQL has no words for: tested against brute force.
Q["d3_duplicates"] = lambda s, d: M.duplicates(B.ledger(s, d))
