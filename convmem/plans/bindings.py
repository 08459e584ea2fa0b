"""How the given tables stand for messages, ledgers and identities: the same rules as DataFrames and as SQL.

The tables lack some patterns that operators look for, so they are put in by rule of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convmem.operators import turns as T

LEXICON = {"fear": ["the", "que"], "hope": ["with", "der"], "anger": ["of", "les"], "joy": ["and", "los"]}
DIRECT, DEFLECTION, ATTACHMENT = ["this"], ["from"], ["that"]
SCORING = T.Scoring({"fear": 0.8, "hope": 0.7, "anger": 0.9, "joy": 0.6, "dysregulation": 0.9})
AS_OF = "2024-03-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Messages -------------------------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(table(spark, sf_dir, "conversations"))


def as_messages(rows: DataFrame) -> DataFrame:
    """Every third message begins with a name, every fifth goes on with narration and another line."""
    text = F.concat(F.when(F.col("turn") % 3 == 0, F.lit("Ann: ")).otherwise(F.lit("")), F.col("text"), F.when(F.col("turn") % 5 == 0, F.lit("\n*waves slowly*\nand goes on")).otherwise(F.lit("")))
    return T.messages(rows.withColumn("text", text))


MESSAGES = """msg AS (SELECT conv_id, turn, role, trim(CASE WHEN turn % 3 = 0 THEN 'Ann: ' ELSE '' END || text ||
  CASE WHEN turn % 5 = 0 THEN chr(10) || '*waves slowly*' || chr(10) || 'and goes on' ELSE '' END) AS text
  FROM conversations WHERE trim(text) <> '')"""

TURNS = MESSAGES + r""",
line0 AS (SELECT conv_id, turn, role, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT *, string_split_regex(text, '\n+') AS l FROM msg)),
line1 AS (SELECT conv_id, turn, role, pos, trim(line) AS line, regexp_extract(trim(line), '^([A-Za-z][A-Za-z0-9 _''-]{0,40})(\s*\([^)]*\))?\s*:\s*', 1) AS nm FROM line0 WHERE trim(line) <> ''),
line2 AS (SELECT *, (nm = '' AND regexp_matches(line, '^\*[^*]+\*$')) AS narr,
  CASE WHEN nm <> '' THEN trim(regexp_replace(line, '^([A-Za-z][A-Za-z0-9 _''-]{0,40})(\s*\([^)]*\))?\s*:\s*', '')) ELSE line END AS said FROM line1),
line3 AS (SELECT *, CASE WHEN nm <> '' OR narr OR coalesce(lag(narr) OVER w, false) OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens,
  coalesce(last_value(CASE WHEN nm <> '' THEN trim(nm) END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING), CASE WHEN role = 'user' THEN 'user' ELSE 'Character' END) AS sp
  FROM line2 WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
line4 AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM line3),
turn1 AS (SELECT conv_id, turn, island, trim(string_agg(said, ' ' ORDER BY pos)) AS text, bool_or(narr) AS narr, max(sp) AS sp FROM line4 GROUP BY ALL),
turns AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, island) - 1 AS BIGINT) AS turn_index, CASE WHEN narr THEN 'Narrator' ELSE sp END AS speaker, text FROM turn1 WHERE text <> '')"""

CHUNKS = TURNS + """,
run0 AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn_index) OR turn_index = 0 THEN 1 ELSE 0 END AS ch FROM turns),
run1 AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn_index) AS run FROM run0),
run2 AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, run ORDER BY turn_index) - 1) // 6 AS part FROM run1),
chunk0 AS (SELECT conv_id, run, part, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY turn_index) AS text, min(turn_index) AS turn_start, max(turn_index) AS turn_end FROM run2 GROUP BY conv_id, run, part),
chunks AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn_start) - 1 AS BIGINT) AS chunk_id, speaker, text, turn_start, turn_end FROM chunk0)"""


def _sql_hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(lower(text), '(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)') AS INT)" for w in words) + ")"


_LANES = {k: w for k, w in SCORING.lanes.items() if k != "dysregulation"}
SCORES = (
    CHUNKS
    + ",\nhit AS (SELECT *, "
    + ", ".join(f"{_sql_hits(LEXICON[k])} AS h_{k}" for k in _LANES)
    + f", {_sql_hits(DIRECT)} AS d, {_sql_hits(DEFLECTION)} AS f, {_sql_hits(ATTACHMENT)} AS a FROM chunks),\n"
    + "tot AS (SELECT *, "
    + " + ".join(f"h_{k}" for k in _LANES)
    + " + d + f + a AS hits, least(1.0, least(1.0, d * 0.55 * 0.9::DOUBLE) + f * 0.15::DOUBLE) AS own, CASE WHEN len(string_split_regex(trim(text), '\\s+')) <= 10 THEN 1.2::DOUBLE ELSE 1.0 END AS sh FROM hit),\n"
    + "base AS (SELECT *, CASE WHEN hits >= 3 THEN 1.5::DOUBLE WHEN hits >= 2 THEN 1.3::DOUBLE ELSE 1.0 END AS comp, CASE WHEN f > 0 AND a > 0 THEN least(1.0, own * 1.5::DOUBLE) ELSE own END AS dys FROM tot),\n"
    + "sc AS (SELECT conv_id, chunk_id, speaker, text, turn_start, turn_end, CAST(hits AS BIGINT) AS hits, "
    + ", ".join(f"least(1.0, least(1.0, least(1.0, h_{k} * 0.55::DOUBLE * {w}::DOUBLE) * comp) * sh) AS {k}" for k, w in _LANES.items())
    + ", least(1.0, least(1.0, dys * comp) * sh) AS dysregulation FROM base),\n"
    + "scores AS (SELECT *, greatest(fear, hope, anger, joy, dysregulation) AS salience FROM sc)"
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.parse_turns(messages(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(turns(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.score(chunks(spark, sf_dir), LEXICON, SCORING, DIRECT, DEFLECTION, ATTACHMENT)


# The ledger -----------------------------------------------------------------------------------

LEDGER_COLUMNS = {
    "scope_id": "concat(lang, '-', CAST(CAST(floor(doc_id / 200) AS BIGINT) AS STRING))",
    "entry_pos": "doc_id",
    "id": "concat('e', CAST(doc_id AS STRING))",
    "summary": "text",
    "content": "text",
    "lane": "CASE doc_id % 3 WHEN 0 THEN 'open_threads' WHEN 1 THEN 'user_topics' ELSE 'character_topics' END",
    "status": "CASE doc_id % 7 WHEN 0 THEN 'done' WHEN 1 THEN NULL ELSE 'open' END",
    "tier": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'short' WHEN 2 THEN 'long' WHEN 3 THEN 'core' ELSE 'secondary_core' END",
    "cycle_count": "doc_id % 4",
    "last_accessed": "date_add(DATE '2023-11-01', CAST(doc_id % 120 AS INT))",
    "source_chat_id": "concat('c', CAST(doc_id % 100 AS STRING))",
    "thread_id": "CASE WHEN doc_id % 4 = 0 THEN concat('t', CAST(doc_id % 40 AS STRING)) END",
    "turn_start": "doc_id % 200",
    "superseded_by": "CASE WHEN doc_id % 17 = 0 THEN concat('e', CAST(doc_id + 1 AS STRING)) END",
    "deleted": "doc_id % 23 = 5",
    "temp": "CASE WHEN doc_id % 6 = 0 THEN 'cold' ELSE 'hot' END",
}


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ledger entries, without their use."""
    return table(spark, sf_dir, "documents").select(*[F.expr(e).alias(k) for k, e in LEDGER_COLUMNS.items()])


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ledger entries; what events say about a user is credited to the entries of that number."""
    credit = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").cast("bigint").alias("entry_pos"))
        .agg(
            F.count_if(F.col("event_type") == "view").alias("views"),
            F.count_if(F.col("event_type") == "purchase").alias("buys"),
            F.max(F.to_date("ts")).alias("last"),
        )
    )
    joined = entries(spark, sf_dir).join(credit, "entry_pos", "left")
    return joined.select(
        *LEDGER_COLUMNS,
        F.ceil(F.length("summary") / 4).cast("bigint").alias("tokens"),
        F.coalesce("views", F.lit(0)).cast("bigint").alias("retrieval_count"),
        F.coalesce("buys", F.lit(0)).cast("bigint").alias("recitation_count"),
        F.col("last").alias("last_retrieved"),
    )


def _duck(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR").replace("date_add(DATE '2023-11-01', CAST(doc_id % 120 AS INT))", "CAST(DATE '2023-11-01' + CAST(doc_id % 120 AS INT) AS DATE)")


LEDGER = (
    "credit AS (SELECT CAST(user_id AS BIGINT) AS entry_pos, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS buys, CAST(max(ts) AS DATE) AS last FROM events GROUP BY 1),\n"
    "entry AS (SELECT "
    + ", ".join(f"{_duck(e)} AS {k}" for k, e in LEDGER_COLUMNS.items())
    + " FROM documents),\n"
    "ledger AS (SELECT e.*, CAST(ceil(length(summary) / 4.0) AS BIGINT) AS tokens, CAST(coalesce(views, 0) AS BIGINT) AS retrieval_count, CAST(coalesce(buys, 0) AS BIGINT) AS recitation_count, last AS last_retrieved\n"
    "  FROM entry e LEFT JOIN credit c USING (entry_pos))"
)

# Word sets ------------------------------------------------------------------------------------


def sql_bag(text: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower({text}), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: w <> ''))"
