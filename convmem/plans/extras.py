"""Queries over routing, pairing, pools, bundles and what else goes with ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import identity as I
from convmem.operators import ledger as L
from convmem.operators import recall as R
from convmem.operators import routing as G
from convmem.operators import similarity as S
from convmem.operators import turns as T
from convmem.plans import bindings as B
from convmem.plans import people as P

Q: dict = {}
SQL: dict[str, str] = {}
_W = f"WITH {B.LEDGER}"

Q["p6_speaker_labels"] = lambda s, d: B.messages(s, d).select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", "Ann:", "**Ann:**"), r"(?m)^\*{1,2}([A-Za-z][A-Za-z0-9 _'-]*):\*{1,2}", "$1:").alias("text"))
SQL["p6_speaker_labels"] = f"WITH {B.MESSAGES} SELECT conv_id, turn, text FROM msg"

Q["p7_paragraphs"] = lambda s, d: B.table(s, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")).alias("pos", "p")).select("doc_id", F.concat(F.lit("Narrator: "), F.trim("p")).alias("line"))
SQL["p7_paragraphs"] = "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) SELECT doc_id, 'Narrator: ' || trim(p) AS line FROM p WHERE trim(p) <> ''"


def _beats(s, d):
    e = F.array(F.struct(F.lit("hope").alias("emotion"), F.lit(0.5).alias("weight")))
    return B.ledger(s, d).select(F.col("id").alias("beat_id"), "scope_id", F.when(F.col("entry_pos") % 2 == 0, e).otherwise(F.array().cast("array<struct<emotion:string,weight:double>>")).alias("emotions"), F.lit("fear").alias("emotion"), "summary", F.col("summary").alias("motivation"), F.lit("none").alias("outcome"), F.col("content").alias("text"))


Q["p20_companion_rows"] = lambda s, d: G.companion_rows(_beats(s, d))
SQL["p20_companion_rows"] = f"""{_W}, b AS (SELECT id, CASE WHEN entry_pos % 2 = 0 THEN 'hope' ELSE 'fear' END AS e, summary AS m, content FROM ledger)
SELECT id AS beat_id, substr('[' || e || '] ' || m, 1, 140) AS summary, substr('Emotion: ' || e || chr(10) || 'Why: ' || m || chr(10) || 'Outcome: none' || chr(10) || content, 1, 700) AS content FROM b"""

Q["p24_transient"] = lambda s, d: B.ledger(s, d).select("id", F.lower("summary").rlike("(^|[^a-z])(this|now|today|soon)([^a-z]|$)").alias("transient"))
SQL["p24_transient"] = f"{_W} SELECT id, regexp_matches(lower(summary), '(^|[^a-z])(this|now|today|soon)([^a-z]|$)') AS transient FROM ledger"

Q["p27_cast_lists"] = lambda s, d: B.table(s, d, "part").select("p_partkey", G.is_cast_list(F.col("p_name"), X.words(["red", "blue", "green", "steel", "small", "large"])).alias("cast"))
SQL["p27_cast_lists"] = "WITH p AS (SELECT p_partkey, list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ('and', 'with', 'the', 'of', 'vs')) AS w FROM part) SELECT p_partkey, len(w) > 0 AND len(list_filter(w, lambda x: x NOT IN ('red', 'blue', 'green', 'steel', 'small', 'large'))) = 0 AS cast FROM p"

Q["p28_clock_signals"] = lambda s, d: B.messages(s, d).select("conv_id", "turn", G.clock_signals(F.col("text"), {"morning": ["thea", "eau"], "evening": ["ing", "ich"], "night": ["e"]}).alias("signal"))
SQL["p28_clock_signals"] = f"WITH {B.MESSAGES} SELECT conv_id, turn, CASE WHEN contains(lower(text), 'thea') OR contains(lower(text), 'eau') THEN 'morning' WHEN contains(lower(text), 'ing') OR contains(lower(text), 'ich') THEN 'evening' WHEN contains(lower(text), 'e') THEN 'night' END AS signal FROM msg"

Q["io4_late_bodies"] = lambda s, d: (lambda a: R.ranked(a.withColumn("relevance", F.lit(0.0))).where("rank <= 5").select("scope_id", "id", "rank").join(B.table(s, d, "documents").select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content")), "id"))(R.live(B.ledger(s, d)))
SQL["io4_late_bodies"] = f"{_W}, r AS (SELECT scope_id, id, content, row_number() OVER (PARTITION BY scope_id ORDER BY coalesce(last_retrieved, last_accessed) DESC NULLS LAST, retrieval_count + 3 * recitation_count DESC, list_position(['open_threads', 'user_topics', 'character_topics'], lane), entry_pos) AS rank FROM ledger WHERE coalesce(status, 'open') <> 'done' AND superseded_by IS NULL) SELECT id, scope_id, rank, content FROM r WHERE rank <= 5"


def _scopes(s, d):
    return B.ledger(s, d).select(F.col("scope_id").alias("identity_key"), F.upper("scope_id").alias("name")).distinct()


Q["io7_io8_bundles"] = lambda s, d: G.imported(G.bundles(B.ledger(s, d), _scopes(s, d)))
SQL["io7_io8_bundles"] = f"{_W} SELECT scope_id, entry_pos, id, summary, lane, status, content FROM ledger"

Q["io9_rebuilt_index"] = lambda s, d: (lambda a: G.rebuilt(a.where("scope_id not like 'de-%' or entry_pos % 3 > 0").where("scope_id not like 'fr-%' or entry_pos % 2 = 0"), a.where("scope_id not like 'en-%'")))(B.ledger(s, d))
SQL["io9_rebuilt_index"] = f"{_W} SELECT scope_id, id, CAST(CASE WHEN (scope_id LIKE 'de-%' AND entry_pos % 3 = 0) OR (scope_id LIKE 'fr-%' AND entry_pos % 2 = 1) THEN 0 ELSE retrieval_count END AS BIGINT) AS retrieval_count FROM ledger"

Q["j15_recap_audit"] = lambda s, d: (lambda a: G.recap_audit(a.select(F.col("id").alias("recap_id"), F.concat(F.lit("*scene* "), "summary").alias("content")), a.where("entry_pos % 3 > 0").select(F.col("id").alias("recap_id"), F.when(F.col("entry_pos") % 5 == 0, F.lit("other")).otherwise(F.col("summary")).alias("expected"))))(B.ledger(s, d))
SQL["j15_recap_audit"] = f"{_W} SELECT id AS recap_id, CASE WHEN entry_pos % 3 = 0 THEN 'unresolved' WHEN entry_pos % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM ledger"

Q["j17_orphan_speakers"] = lambda s, d: G.orphan_speakers(B.chunks(s, d), B.table(s, d, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "Anna").otherwise("user").alias("name"))).select("conv_id", "chunk_id", "speaker")
SQL["j17_orphan_speakers"] = f"WITH {B.CHUNKS} SELECT conv_id, chunk_id, speaker FROM chunks WHERE NOT (contains('anna', lower(speaker)) OR contains(lower(speaker), 'anna') OR contains('user', lower(speaker)) OR contains(lower(speaker), 'user'))"

Q["j18_companions"] = lambda s, d: G.companions(_beats(s, d), B.ledger(s, d))
SQL["j18_companions"] = rf"""{_W}, k AS (SELECT *, substr(lower(regexp_replace(summary, '\s+', ' ', 'g')), 1, 100) AS k FROM ledger), c AS (SELECT scope_id, k, min(id) AS id FROM k WHERE lane = 'character_topics' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT k.id AS beat_id, c.id FROM k JOIN c ON c.scope_id = k.scope_id AND c.k = k.k"""

Q["j20_thread_labels"] = lambda s, d: (lambda p: p.select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("a"), F.element_at(F.split("p_type", " "), 1).alias("b")).withColumn("score", F.round(I.jaro_winkler(F.lower("a"), F.lower("b")), 6)).select("p_partkey", "score"))(B.table(s, d, "part"))
SQL["j20_thread_labels"] = """WITH p AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS a, lower(string_split(p_type, ' ')[1]) AS b FROM part),
c AS (SELECT *, jaro_similarity(a, b) AS j, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 WHEN a[4] <> b[4] THEN 3 ELSE 4 END AS n FROM p) SELECT p_partkey, round(CASE WHEN a = b THEN 1 ELSE j + n * 0.1::DOUBLE * (1 - j) END, 6) AS score FROM c"""

Q["j23_fact_targets"] = lambda s, d: G.fact_targets(P._facts(s, d).select("pos", "fact", F.when(F.col("pos") % 3 == 0, F.lit("User")).otherwise(F.col("subject")).alias("subject")), s.createDataFrame([], "name string, identity_key string").unionByName(B.table(s, d, "region").where("r_regionkey = 0").select(F.lit("Ann").alias("name"), F.lit("k9").alias("identity_key"))), ["user", "self"]).select("pos", "scope", "target", "fact")
SQL["j23_fact_targets"] = f"""WITH {P._FACTS}, f AS (SELECT pos, fact, CASE WHEN pos % 3 = 0 THEN 'User' ELSE subject END AS s FROM fact)
SELECT pos, CASE WHEN s = 'Bo' THEN 'chat' ELSE 'character' END AS scope, CASE WHEN s IS NULL OR s = 'User' THEN 'self' WHEN s = 'Ann' THEN 'k9' END AS target, CASE WHEN s = 'Bo' THEN '[about: Bo] ' || fact ELSE fact END AS fact FROM f"""

_CH = lambda s, d: B.table(s, d, "orders").select(F.col("o_orderkey").alias("chat_id"), F.col("o_custkey").alias("primary_id"), F.array(F.col("o_custkey") + 1, F.col("o_custkey") + 2).alias("participants"))
Q["j27_chats_of"] = lambda s, d: G.chats_of(_CH(s, d), F.lit(7), F.lit(1)).select("chat_id")
SQL["j27_chats_of"] = "SELECT o_orderkey AS chat_id FROM orders WHERE o_custkey IN (7, 6, 5) AND o_orderkey <> 1"

_PEND = lambda s, d: B.ledger(s, d).select(F.lower("lane").alias("speaker_norm"), F.when(F.col("entry_pos") % 2 == 0, F.upper("lane")).otherwise(F.col("lane")).alias("speaker"), F.col("id").alias("beat_id"), F.col("entry_pos").alias("seq"), F.col("thread_id").alias("suggestion"), (F.col("entry_pos") * 7 % 1009).alias("score"))
Q["a7_pending_speakers"] = lambda s, d: G.pending_speakers(_PEND(s, d))
SQL["a7_pending_speakers"] = f"{_W} SELECT lane AS speaker_norm, count(*) AS held, arg_max(CASE WHEN entry_pos % 2 = 0 THEN upper(lane) ELSE lane END, entry_pos) AS label, arg_max_null(thread_id, entry_pos * 7 % 1009) AS suggestion FROM ledger GROUP BY 1"
Q["l15_add_pending"] = lambda s, d: (lambda a: G.add_pending(a.where("seq % 2 = 0"), a.where("seq % 3 = 0").unionByName(a.where("seq % 9 = 0"))).select("speaker_norm", "beat_id"))(_PEND(s, d))
SQL["l15_add_pending"] = f"{_W} SELECT lane AS speaker_norm, id AS beat_id FROM ledger WHERE entry_pos % 2 = 0 OR entry_pos % 3 = 0"
Q["l12_kept_ignored"] = lambda s, d: G.expired(B.ledger(s, d).select("id", F.col("last_accessed").alias("ignored_at")), "2024-02-20").select("id")
SQL["l12_kept_ignored"] = f"{_W} SELECT id FROM ledger WHERE date_diff('day', last_accessed, DATE '2024-02-20') <= 30"
Q["l16_renamed_scopes"] = lambda s, d: G.renamed(B.ledger(s, d), _scopes(s, d).where("identity_key like 'de-%'").select(F.col("identity_key").alias("old"), F.concat(F.lit("ger"), F.substring("identity_key", 3, 99)).alias("new"))).select("scope_id", "id")
SQL["l16_renamed_scopes"] = f"{_W} SELECT CASE WHEN scope_id LIKE 'de-%' THEN 'ger' || substr(scope_id, 3) ELSE scope_id END AS scope_id, id FROM ledger"
Q["l17_added_aliases"] = lambda s, d: (lambda a: G.added_aliases(a, a.select(F.lit("k5").alias("identity_key"), "label", "canonical_name").unionByName(a.where("identity_key = 'k2'").select("identity_key", F.lit("New One").alias("label"), "canonical_name"))).select("identity_key", "label"))(P._aliases(s, d))
SQL["l17_added_aliases"] = f"WITH {P._AL} SELECT identity_key, label FROM alias UNION ALL SELECT 'k2', 'New One' FROM alias WHERE identity_key = 'k2'"
Q["a13_presence"] = lambda s, d: G.presence(_beats(s, d), B.table(s, d, "region").select(F.col("r_regionkey").alias("identity_key"), F.element_at(X.words(["the", "and", "que", "der", "los"]), (F.col("r_regionkey") + 1).cast("int")).alias("name")))
SQL["a13_presence"] = f"{_W}, w AS (SELECT id, {B.sql_bag('content')} AS w FROM ledger) SELECT id AS beat_id, r_regionkey AS identity_key FROM w JOIN region ON list_contains(w, (['the', 'and', 'que', 'der', 'los'])[r_regionkey + 1])"
Q["k7_bookmarks_by_weight"] = lambda s, d: B.ledger(s, d).select("id", (F.col("entry_pos") % 10 / 10.0).alias("weight")).orderBy(F.desc("weight"), "id")
SQL["k7_bookmarks_by_weight"] = f"{_W} SELECT id, (entry_pos % 10) / 10.0::DOUBLE AS weight FROM ledger"
Q["k8_surfaced_bookmarks"] = lambda s, d: G.surfaced_bookmarks(B.ledger(s, d).select("id", "turn_start", (F.col("entry_pos") % 10 / 10.0).alias("weight")), F.col("turn_start")).select("id")
Q["x2_hot_and_cold"] = lambda s, d: (lambda a: a.where("temp = 'hot'").unionByName(a.where("temp = 'cold'")).select("id", "temp"))(B.ledger(s, d))
SQL["x2_hot_and_cold"] = f"{_W} SELECT id, temp FROM ledger"
Q["v12_entries_of_thread"] = lambda s, d: B.ledger(s, d).where("thread_id = 't8'").select("id", "thread_id")
SQL["v12_entries_of_thread"] = f"{_W} SELECT id, thread_id FROM ledger WHERE thread_id = 't8'"

_V = lambda s, d: B.table(s, d, "embeddings").select(F.col("label").cast("bigint").alias("scope_id"), F.col("vec_id").alias("recap_id"), F.col("embedding").alias("vector"))
Q["k3_recap_activation"] = lambda s, d: (lambda v: G.recap_activation(v, v.groupBy("scope_id").agg(F.min_by("vector", "recap_id").alias("vector")), 0.2))(_V(s, d))
_COS = "list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"
SQL["k3_recap_activation"] = f"""WITH v AS (SELECT CAST(label AS BIGINT) AS scope_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT scope_id, arg_min(v, vec_id) AS v FROM v GROUP BY 1),
c AS (SELECT x.scope_id, vec_id AS recap_id, round({_COS}, 9) AS c FROM v x JOIN q y USING (scope_id)) SELECT scope_id, recap_id, row_number() OVER (PARTITION BY scope_id ORDER BY c DESC, recap_id) AS rank FROM c WHERE c >= 0.2 QUALIFY rank <= 3"""

Q["u1_batch_infer"] = lambda s, d: S.batch_infer(B.table(s, d, "conversations").select("conv_id", "turn", "text"), _lengths, "n long").select("conv_id", "turn", F.col("n").cast("bigint").alias("n"))
SQL["u1_batch_infer"] = "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n FROM conversations"


def _lengths(frame):
    return frame.assign(n=frame["text"].str.len())


Q["w2_semantic_chunks"] = lambda s, d: T.chunks(B.turns(s, d), breaks=F.col("turn_index") % 4 == 3).select("conv_id", "chunk_id", "turn_start", "turn_end")
SQL["w2_semantic_chunks"] = f"""WITH {B.TURNS}, r0 AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn_index) OR turn_index = 0 OR turn_index % 4 = 3 THEN 1 ELSE 0 END AS ch FROM turns),
r1 AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn_index) AS run FROM r0), r2 AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, run ORDER BY turn_index) - 1) // 6 AS part FROM r1),
c AS (SELECT conv_id, min(turn_index) AS turn_start, max(turn_index) AS turn_end FROM r2 GROUP BY conv_id, run, part) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn_start) - 1 AS BIGINT) AS chunk_id, turn_start, turn_end FROM c"""


def _turn_vectors(s, d):
    """Two turns in a row have one vector of the table, where there is one."""
    v = B.table(s, d, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    t = B.turns(s, d).withColumn("_v", F.col("conv_id") * 5 + F.floor(F.col("turn_index") / 2))
    return t.join(v, "_v", "left").drop("_v")


Q["w2_chunks_by_meaning"] = lambda s, d: T.chunks(_turn_vectors(s, d), breaks=T.apart_in_meaning(0.1)).select("conv_id", "chunk_id", "turn_start", "turn_end")
SQL["w2_chunks_by_meaning"] = f"""WITH {B.TURNS}, x AS (SELECT turns.*, CAST(embedding AS DOUBLE[]) AS v FROM turns LEFT JOIN embeddings ON vec_id = conv_id * 5 + turn_index // 2),
y AS (SELECT *, lag(v) OVER w AS u, lag(speaker) OVER w AS before FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn_index)),
r0 AS (SELECT *, CASE WHEN turn_index = 0 OR speaker IS DISTINCT FROM before OR coalesce(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 0) < 0.1 THEN 1 ELSE 0 END AS ch FROM y),
r1 AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn_index) AS run FROM r0), r2 AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, run ORDER BY turn_index) - 1) // 6 AS part FROM r1),
c AS (SELECT conv_id, min(turn_index) AS turn_start, max(turn_index) AS turn_end FROM r2 GROUP BY conv_id, run, part) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn_start) - 1 AS BIGINT) AS chunk_id, turn_start, turn_end FROM c"""
Q["w10_newest_vectors"] = lambda s, d: (lambda v: v.withColumn("rn", F.row_number().over(L.W.partitionBy("scope_id").orderBy(F.desc("recap_id")))).where("rn <= 6").select("scope_id", "recap_id"))(_V(s, d))
SQL["w10_newest_vectors"] = "SELECT CAST(label AS BIGINT) AS scope_id, vec_id AS recap_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 6"
