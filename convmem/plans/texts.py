"""Queries over texts: tokens, overlaps, cuts, commands, parsing; and similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import commands as C
from convmem.operators import similarity as S
from convmem.plans import bindings as B

Q: dict = {}
SQL: dict[str, str] = {}
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_FUNC = "[" + ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS) + "]"


def _docs(s, d):
    return B.table(s, d, "documents").select("doc_id", "lang", "text", F.col("text").alias("summary"))


def _joined(c):
    return F.array_join(F.array_sort(c), " ")


_DOC = "WITH doc AS (SELECT doc_id, lang, text, text AS summary FROM documents)"
_J = "array_to_string(list_sort({}), ' ')"
_SWEEP = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) >= 3))"

for name, fn, sql in (
    ("p15_word_bag", X.bag, B.sql_bag("summary")),
    ("p16_sweep_tokens", X.sweep_tokens, _SWEEP.format("summary")),
    ("p17_topic_words", X.topic_words, f"list_filter({B.sql_bag('summary')}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"),
    ("p18_content_words", X.content_words, f"list_filter(list_distinct(regexp_extract_all(lower(summary), '[a-z]{{4,}}')), lambda w: NOT list_contains({_STOP}, w))"),
):
    Q[name] = lambda s, d, fn=fn: _docs(s, d).select("doc_id", _joined(fn(F.col("summary"))).alias("words"))
    SQL[name] = f"{_DOC} SELECT doc_id, {_J.format(sql)} AS words FROM doc"

Q["p10_tokens"] = lambda s, d: _docs(s, d).select("doc_id", X.tokens(F.col("text")).cast("bigint").alias("tokens"))
SQL["p10_tokens"] = f"{_DOC} SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM doc"

Q["p11_summaries"] = lambda s, d: _docs(s, d).select("doc_id", X.cut_at_word(F.col("text")).alias("at_word"), X.cut_with_mark(F.col("text")).alias("marked"))
SQL["p11_summaries"] = rf"""{_DOC}, h AS (SELECT *, regexp_extract(substr(text, 1, 120), '(?s)^(.*) [^ ]*$', 1) AS sp FROM doc)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN sp <> '' THEN sp ELSE substr(text, 1, 120) END AS at_word, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 119) || '…' END AS marked FROM h"""

Q["p12_content_cap"] = lambda s, d: _docs(s, d).select("doc_id", X.cut_at_sentence(F.col("text")).alias("content"))
SQL["p12_content_cap"] = rf"""{_DOC}, h AS (SELECT *, regexp_extract(substr(text, 1, 600), '(?s)^(.*[.!?])[^.!?]*$', 1) AS sp FROM doc)
SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN length(sp) > 300 THEN sp ELSE substr(text, 1, 600) || '…' END AS content FROM h"""

Q["p13_labels"] = lambda s, d: B.table(s, d, "part").select("p_partkey", X.label(F.concat(F.lit("  "), F.col("p_name"), F.lit("  X "))).alias("label"))
SQL["p13_labels"] = r"SELECT p_partkey, regexp_replace(trim(lower('  ' || p_name || '  X ')), '\s+', ' ', 'g') AS label FROM part"

Q["p21_job_keys"] = lambda s, d: _docs(s, d).select("doc_id", X.job_key(F.col("text"), F.lit("story"), F.col("lang")).alias("key"))
SQL["p21_job_keys"] = f"{_DOC} SELECT doc_id, substr(sha1(concat_ws(chr(10), text, 'story', lang)), 1, 16) AS key FROM doc"

Q["p25_row_kinds"] = lambda s, d: _docs(s, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[tense] "), "summary")).otherwise(F.col("summary")).alias("x")).select("doc_id", X.looks_incident(F.col("x")).alias("incident"), X.is_compound(F.col("x")).alias("compound"))
SQL["p25_row_kinds"] = rf"""{_DOC}, x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[tense] ' || summary ELSE summary END AS x FROM doc)
SELECT doc_id, regexp_matches(trim(x), '^\[\w+\]') AS incident, regexp_matches(lower(x), '(^|[^a-z0-9_])(and|with|plus)([^a-z0-9_]|$)|[&,/+]') AS compound FROM x"""

Q["p31_without_lead"] = lambda s, d: _docs(s, d).select("doc_id", X.without_lead(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("*she waits*  "), "summary")).otherwise(F.col("summary"))).alias("text"))
SQL["p31_without_lead"] = rf"{_DOC} SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '*she waits*  ' || summary ELSE summary END, '(?s)^\s*\*[^*]*\*\s*', '') AS text FROM doc"

Q["p32_edge_salience"] = lambda s, d: _docs(s, d).select("doc_id", F.round(C.edge_salience(F.col("doc_id") % 10 / 10, F.col("doc_id") % 7 / 7, F.col("doc_id") % 100), 6).alias("salience"))
SQL["p32_edge_salience"] = """WITH e AS (SELECT doc_id, (doc_id % 10) / 10.0::DOUBLE AS s, (doc_id % 7) / 7.0::DOUBLE AS p, doc_id % 100 AS n FROM documents), f AS (SELECT *, pow(0.5, n / 30.0::DOUBLE) * (0.5 + p / 2) * s AS x FROM e)
SELECT doc_id, round(least(1.0, CASE WHEN s > 0.8 THEN greatest(x, 0.7::DOUBLE * s) ELSE x END), 6) AS salience FROM f"""

Q["p5_pre_attributed"] = lambda s, d: C.pre_attributed(_docs(s, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Ann: "), F.replace("text", F.lit("\n"), F.lit("\nAnn: ")))).otherwise(F.col("text"))), "doc_id", "text", ["chapter", "note"])
SQL["p5_pre_attributed"] = rf"""{_DOC}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Ann: ' || replace(text, chr(10), chr(10) || 'Ann: ') ELSE text END AS text FROM doc),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t), n AS (SELECT doc_id, regexp_extract(line, '^\s*\**([A-Za-z][A-Za-z0-9 _''-]{{0,40}}):', 1) AS nm FROM l WHERE trim(line) <> ''),
g AS (SELECT doc_id, CASE WHEN length(nm) >= 2 AND lower(nm) NOT IN ('chapter', 'note') THEN nm END AS nm, count(*) AS n FROM n GROUP BY ALL)
SELECT doc_id, coalesce(sum(n) FILTER (WHERE nm IS NOT NULL AND n >= 2), 0) >= 3 AND coalesce(sum(n) FILTER (WHERE nm IS NOT NULL AND n >= 2), 0) / sum(n) >= 0.4 AS attributed FROM g GROUP BY doc_id"""

Q["p9_sentence_candidates"] = lambda s, d: _docs(s, d).select("doc_id", F.posexplode(C.sentence_candidates(F.col("text"))).alias("pos", "sentence")).select("doc_id", "sentence")
SQL["p9_sentence_candidates"] = rf"""{_DOC}, p AS (SELECT doc_id, trim(unnest(string_split_regex(regexp_replace(text, '([.!])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'))) AS sentence FROM doc)
SELECT doc_id, sentence FROM p WHERE length(sentence) > 10 AND length(sentence) <= 120 AND NOT ends_with(sentence, '?') AND regexp_matches(sentence, '(^|[^A-Za-z0-9_])(I|my|me|We|our)([^A-Za-z0-9_]|$)|^[A-Z][a-z]+ [a-z]+')"""

Q["p8_windows"] = lambda s, d: _docs(s, d).select("doc_id", F.posexplode(C.windows(F.col("text"), 1200, "\n")).alias("window", "text"))

_DOMAINS = {"loss": ["der", "les"], "harm": ["this", "from"]}
Q["p23_gate"] = lambda s, d: B.table(s, d, "labels").join(_docs(s, d), "doc_id").select("doc_id", C.gated(F.col("summary"), F.when(F.col("quality") == 1, "high").otherwise("medium"), _DOMAINS).alias("g")).select("doc_id", "g.action", "g.reasons")
SQL["p23_gate"] = f"""{_DOC}, f AS (SELECT doc_id, regexp_matches(lower(summary), '(^|[^a-z0-9_])(?:der|les)([^a-z0-9_]|$)') AS a, regexp_matches(lower(summary), '(^|[^a-z0-9_])(?:this|from)([^a-z0-9_]|$)') AS b, quality FROM labels JOIN doc USING (doc_id))
SELECT doc_id, CASE WHEN a OR b OR quality <> 1 THEN 'hold' ELSE 'auto' END AS action, concat_ws(',', CASE WHEN a THEN 'loss' END, CASE WHEN b THEN 'harm' END, CASE WHEN quality <> 1 THEN 'confidence' END) AS reasons FROM f"""

_raw = lambda: F.when(
    F.col("doc_id") % 3 == 0, F.concat(F.lit('{"motivation": "m'), F.col("doc_id"), F.lit('", "salience": 1.5}'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('Sure:\n```json\n{"motivation": "n'), F.col("doc_id"), F.lit('", "subject": "Ann"}\n```'))).otherwise(F.lit("no json"))
Q["p22_model_responses"] = lambda s, d: _docs(s, d).select("doc_id", C.analysis(_raw()).alias("a")).select("doc_id", "a.motivation", "a.salience", "a.subject")
SQL["p22_model_responses"] = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'm' || doc_id WHEN 1 THEN 'n' || doc_id END AS motivation, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 END::DOUBLE AS salience, CASE WHEN doc_id % 3 = 1 THEN 'Ann' END AS subject FROM documents"

# Commands are put into every fourth message by rule.
_cmd_text = lambda: F.concat(
    "text", F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" [remember: likes tea "), F.col("conv_id").cast("string"), F.lit(" | lane=open_threads, scope=space] [bookmark: topic=\"old house\", weight="), (F.col("turn") / 4).cast("string"), F.lit("]\n\n\n\nend"))).otherwise(F.lit("")))
_CMDSQL = "cmd AS (SELECT conv_id, turn, text || CASE WHEN turn % 4 = 0 THEN ' [remember: likes tea ' || conv_id || ' | lane=open_threads, scope=space] [bookmark: topic=\"old house\", weight=' || CAST(turn / 4.0::DOUBLE AS VARCHAR) || ']' || chr(10) || chr(10) || chr(10) || chr(10) || 'end' ELSE '' END AS text FROM conversations)"
_cmd = lambda s, d: B.table(s, d, "conversations").select("conv_id", "turn", _cmd_text().alias("text"))
Q["p2_remembers"] = lambda s, d: C.remembers(_cmd(s, d))
SQL["p2_remembers"] = rf"WITH {_CMDSQL} SELECT conv_id, turn, trim(regexp_extract(text, '\[remember:\s*([^|\]]*)', 1)) AS content, 'open_threads' AS lane, 'chat' AS scope FROM cmd WHERE contains(text, '[remember:')"
Q["p3_bookmarks"] = lambda s, d: C.bookmarks(_cmd(s, d))
SQL["p3_bookmarks"] = rf"WITH {_CMDSQL} SELECT conv_id, turn, 'old house' AS topic, least(1.0, CAST(regexp_extract(text, 'weight=([^\]]*)\]', 1) AS DOUBLE)) AS weight, 'unspecified' AS why FROM cmd WHERE contains(text, '[bookmark:')"
Q["p4_stripped"] = lambda s, d: _cmd(s, d).select("conv_id", "turn", C.stripped(F.col("text")).alias("text"))
SQL["p4_stripped"] = rf"WITH {_CMDSQL} SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\[(remember|bookmark):[^\]]*\]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM cmd"

# Similarity -----------------------------------------------------------------------------------

_PAIRS = """tok AS MATERIALIZED (SELECT doc_id, lang, {tok} AS t FROM doc), one AS MATERIALIZED (SELECT lang, list_sort(t) AS t, min(doc_id) AS k FROM tok WHERE len(t) > 0 GROUP BY 1, 2),
cand AS (SELECT x.lang, x.k AS a, y.k AS b, len(list_intersect(x.t, y.t)) AS i, len(x.t) + len(y.t) AS n FROM one x JOIN one y ON x.lang = y.lang AND x.k < y.k)"""
Q["j7_summary_pairs"] = lambda s, d: S.set_similarity_pairs(_docs(s, d), "lang", "doc_id", X.bag(F.col("summary")), 0.35).select(F.col("block").alias("lang"), "a", "b", F.round("similarity", 6).alias("similarity"))
SQL["j7_summary_pairs"] = f"{_DOC}, {_PAIRS.format(tok=B.sql_bag('summary'))} SELECT lang, a, b, round(i / (n - i)::DOUBLE, 6) AS similarity FROM cand WHERE i / (n - i)::DOUBLE >= 0.35"
Q["j8_fact_pairs"] = lambda s, d: S.set_similarity_pairs(_docs(s, d), "lang", "doc_id", X.sweep_tokens(F.col("summary")), 0.5).select(F.col("block").alias("lang"), "a", "b", F.round("similarity", 6).alias("similarity"))
SQL["j8_fact_pairs"] = f"{_DOC}, {_PAIRS.format(tok=_SWEEP.format('summary'))} SELECT lang, a, b, round(i / (n - i)::DOUBLE, 6) AS similarity FROM cand WHERE i / (n - i)::DOUBLE >= 0.5"


def _clusters(s, d):
    docs, tok = _docs(s, d), X.sweep_tokens(F.col("summary"))
    classes = S.checkpoint(S.set_classes(docs, "lang", "doc_id", tok))
    return S.clusters(classes, S.set_similarity_pairs(docs, "lang", "doc_id", tok, 0.5, classes, forest=True))


Q["d4_fact_clusters"] = lambda s, d: _clusters(s, d).select("cluster", F.col("key").alias("doc_id"), "size", "oversized")
SQL["d4_fact_clusters"] = f"""WITH RECURSIVE doc AS (SELECT doc_id, lang, text, text AS summary FROM documents), tok AS MATERIALIZED (SELECT doc_id, lang, {_SWEEP.format("summary")} AS t FROM doc),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.t, y.t)) AS i, len(x.t) + len(y.t) AS n FROM tok x JOIN tok y ON x.lang = y.lang AND x.doc_id < y.doc_id AND len(x.t) > 0 AND len(y.t) > 0),
q AS MATERIALIZED (SELECT a, b FROM p WHERE i / (n - i)::DOUBLE >= 0.5), e AS MATERIALIZED (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
reach AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m),
c AS (SELECT n AS doc_id, min(m) AS cluster FROM reach GROUP BY 1) SELECT cluster, doc_id, count(*) OVER (PARTITION BY cluster) AS size, count(*) OVER (PARTITION BY cluster) > 12 AS oversized FROM c"""

_COS = "list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"
Q["j9_vector_pairs"] = lambda s, d: S.vector_pairs(B.table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.3).select("a", "b", F.round("cosine", 6).alias("cosine"))
SQL["j9_vector_pairs"] = f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, round({_COS}, 6) AS cosine FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE {_COS} >= 0.3"
Q["a10_centroids"] = lambda s, d: S.mean_vectors(B.table(s, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "m")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("m", 6).alias("m"))
SQL["a10_centroids"] = "WITH v AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS BIGINT) AS pos, round(avg(x), 6) AS m FROM v GROUP BY 1, 2"
Q["p30_cosine_to_first"] = lambda s, d: (lambda e: e.join(F.broadcast(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))), "label").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine")))(B.table(s, d, "embeddings"))
SQL["p30_cosine_to_first"] = f"WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS v FROM v GROUP BY 1) SELECT x.vec_id, round({_COS}, 6) AS cosine FROM v x JOIN f y USING (label)"

_PAIR = lambda s, d: (lambda a: a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("summary").alias("next")), "doc_id"))(_docs(s, d))
_NEXT = _DOC + ", n AS (SELECT a.doc_id, {} AS x, {} AS y FROM doc a JOIN doc b ON b.doc_id = a.doc_id + 1)"


def _corrections(s, d):
    """Bags are made once per text, before texts meet, and each correction reads them as columns."""
    rows = _docs(s, d).select("doc_id", X.bag(F.col("summary")).alias("bag"), X.bag(F.concat(F.col("summary"), F.lit(" indeed here"))).alias("more"))
    both = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bag").alias("next")), "doc_id")
    return both.select("doc_id", X.correction(F.col("bag"), F.col("more")).alias("same"), X.correction(F.col("bag"), F.col("next")).alias("next"))


Q["x3_corrections"] = _corrections
SQL["x3_corrections"] = f"""{_NEXT.format(B.sql_bag("a.summary"), B.sql_bag("a.summary || ' indeed here'"))}, m AS (SELECT a.doc_id, {B.sql_bag("a.summary")} AS x, {B.sql_bag("b.summary")} AS y FROM doc a JOIN doc b ON b.doc_id = a.doc_id + 1),
z AS (SELECT doc_id, x, y, list_filter(list_concat(list_filter(x, lambda w: NOT list_contains(y, w)), list_filter(y, lambda w: NOT list_contains(x, w))), lambda w: length(w) >= 3 AND NOT list_contains({_FUNC}, w)) AS s FROM n),
u AS (SELECT doc_id, x, y, list_filter(list_concat(list_filter(x, lambda w: NOT list_contains(y, w)), list_filter(y, lambda w: NOT list_contains(x, w))), lambda w: length(w) >= 3 AND NOT list_contains({_FUNC}, w)) AS s FROM m)
SELECT z.doc_id, len(list_intersect(z.x, z.y)) / (len(z.x) + len(z.y) - len(list_intersect(z.x, z.y)))::DOUBLE >= 0.5 AND len(z.s) BETWEEN 1 AND 4 AS same,
len(list_intersect(u.x, u.y)) / (len(u.x) + len(u.y) - len(list_intersect(u.x, u.y)))::DOUBLE >= 0.5 AND len(u.s) BETWEEN 1 AND 4 AS next FROM z JOIN u USING (doc_id)"""
Q["x5_overlaps"] = lambda s, d: _PAIR(s, d).select("doc_id", F.size(F.array_intersect(X.bag(F.col("summary")), X.bag(F.col("next")))).cast("bigint").alias("shared"))
SQL["x5_overlaps"] = f"{_NEXT.format(B.sql_bag('a.summary'), B.sql_bag('b.summary'))} SELECT doc_id, CAST(len(list_intersect(x, y)) AS BIGINT) AS shared FROM n"
