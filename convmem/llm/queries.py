"""One query for each operator of the subpackage, over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convmem.llm import embedding_dedup, fill_middle, line_dedup, mixing, packing, periodic, pieces, pii, quality, simhash, substring_dedup, suffix_dedup, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allotted(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_rules": op5_quality_rules,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_pii": op8_pii,
        "op9_line_dedup": op9_line_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_source_mixing": op13_source_mixing,
    }


_WORDS = r"""w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force or the library that they must agree with."""
    stop = "|".join(quality.stop_words())
    rules = " AND ".join(f"{r.measure} {op} {bound}" for r in quality.RULES for op, bound in ((">=", r.least), ("<=", r.most)) if bound is not None)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0 END"
    without = lambda c: f"length(t) - length(translate(t, '{c}', ''))"
    return {
        "op2_substring_dedup": f"""WITH {_WORDS}, p AS (SELECT doc_id, unnest(ws) AS wd, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13), h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM h), c AS (SELECT DISTINCT doc_id, i + k AS i FROM m, (SELECT unnest(range(13)) AS k) WHERE m < doc_id),
k AS (SELECT p.doc_id, count(*) AS n, count(c.i) AS r, string_agg(wd, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
        "op5_quality_rules": rf"""WITH {_WORDS}, g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest(range(3)) AS k) WHERE c > 1 GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST({without("#*$%&|<>")} AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^\pL]+', '', 'g')) AS letters,
  length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS upper, {without("|")} AS bars, {without("!")} AS bangs,
  len(regexp_extract_all(regexp_replace(lower(t), '([\x20\x09-\x0D])', '\1\1', 'g'), '(?:^|[\x20\x09-\x0D])(?:{stop})(?:[\x20\x09-\x0D,.;:!?]|$)')) AS stops,
  len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)$')) AS ellipses FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
m AS (SELECT *, {share("word_chars", "n_words")} AS mean_word_chars, {share("n_symbols", "n_words")} AS symbols_per_word, {share("bars", "n_words")} AS bars_per_word, {share("bangs", "n_words")} AS bangs_per_word,
  {share("letters", "word_chars")} AS letter_share, {share("upper", "letters")} AS upper_share, {share("stops", "n_words")} AS stop_word_share, {share("n_dup_lines", "n_lines")} AS dup_line_share,
  {share("n_repeat_words", "n_words")} AS repeat_word_share, {share("ellipses", "n_lines")} AS ellipsis_line_share, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM m""",
        "op12_fill_in_middle": r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, t, us, len(us) AS n, [CAST('0x' || substr(d, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
        "op13_source_mixing": rf"""WITH d AS (SELECT doc_id, source, CAST(len(string_split_regex(trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\x20\x09-\x0D]+')) AS BIGINT) AS words,
  CASE WHEN regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') THEN words ELSE 0 END AS size, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap, cap / CAST(w AS DOUBLE) AS full_at FROM d GROUP BY 1),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS BIGINT) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS level, row_number() OVER (ORDER BY full_at, source NULLS LAST) AS k FROM s
  WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, k) FROM l WHERE level <= full_at) * w) AS target FROM l),
q AS (SELECT d.doc_id, d.source, size, place, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, CAST(turn * source_size + upto AS BIGINT) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, place, turn ROWS UNBOUNDED PRECEDING) AS spent FROM o),
k AS (SELECT doc_id, place, count(*) FILTER (WHERE spent <= (SELECT sum(size) FROM d)) AS n FROM r GROUP BY ALL)
SELECT q.doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM q LEFT JOIN k ON q.place = k.place AND q.doc_id IS NOT DISTINCT FROM k.doc_id""",
    }
