"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Every measure is an expression over the text and, for word windows, over an array of hashes
made and consumed within the row: nothing is shuffled and no Python runs.

Defined cases: null text is empty and has no words, so it fails the base rule; measures that
divide by a count of zero are 0; repeated rows are judged one by one; a null id is returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convmem.llm.common import SPACES, documents, trie_pattern

#: Frequent function words of the languages that are expected.
STOP_WORDS = {
    "en": "the of and to in is that it for as with was on be by this are or an from at not have",
    "fr": "le la les de des du un une et en que qui est pour dans par au sur avec il elle ne pas",
    "de": "der die das und ist von zu den mit auf ein eine nicht im dem des sich es an als auch sie",
    "es": "el la los las de del que y en un una es por con para se al su no lo como",
}


@dataclass(frozen=True)
class Rule:
    """A measure's bounds, both of them allowed values; None: no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Texts outside any of these bounds are rejected.
RULES = (
    Rule("n_words", 50, 1_000_000),
    Rule("mean_word_chars", 2, 14),
    Rule("symbols_per_word", None, 0.1),
    Rule("bars_per_word", None, 0.2),
    Rule("bangs_per_word", None, 0.2),
    Rule("letter_share", 0.6, None),
    Rule("upper_share", None, 0.4),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.5),
    Rule("repeat_word_share", None, 0.3),
    Rule("ellipsis_line_share", None, 0.3),
)

WORD = f"[^{SPACES}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once for the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that the text has at least twice.

    Windows are hashed to 64 bits and sorted with their places; equal neighbours are repeats.
    """

    def count(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        # Most texts have no window twice: a set of hashes tells, and only the others are sorted.
        return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), spread)))

    def spread(s: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.when(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.array(F.get(s, k - 1)["i"], F.get(s, k)["i"])))
        starts = F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull())))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[i + k for k in range(width)])))))

    return F.when(F.size(words) > width, count(words)).otherwise(0).cast("bigint")


def lines(text: Column) -> Column:
    """How many lines have a word, and how many of them equal an earlier line."""
    worded = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))
    return let(worded, lambda a: F.struct(F.size(a).cast("bigint").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("dup")))


def stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words.split()})


def _share(count: Column, of: Column) -> Column:
    return F.when(of > 0, count / of).otherwise(F.lit(0.0))


def _without(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def counts(text: Column) -> dict[str, Column]:
    """What is counted in one pass over the text; the rest is made of these numbers."""
    stop = f"(?:^|[{SPACES}])(?:{trie_pattern(stop_words(), whole=True)})(?=[{SPACES},.;:!?]|$)"
    return {
        "word_chars": F.length(F.regexp_replace(text, f"[{SPACES}]+", "")).cast("bigint"),
        "n_symbols": _without(text, "#*$%&|<>").cast("bigint"),
        "_bars": _without(text, "|"),
        "_bangs": _without(text, "!"),
        # Runs of other characters are fewer than letters, and capitals are few.
        "_letters": F.length(F.regexp_replace(text, "[^\\p{L}]+", "")),
        "_upper": F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", "")),
        "_stop": F.regexp_count(F.lower(text), F.lit(stop)),
        "_ellipses": F.when(F.contains(text, F.lit("...")) | F.contains(text, F.lit("…")), F.regexp_count(text, F.lit("(?m)(?:\\.\\.\\.|…)$"))).otherwise(0),
        "_lines": lines(text),
    }


def measures() -> dict[str, Column]:
    """What rules can name, over the counts."""
    n, c = F.col("n_words"), F.col
    return {
        "n_words": n,
        "mean_word_chars": _share(c("word_chars"), n),
        "symbols_per_word": _share(c("n_symbols"), n),
        "bars_per_word": _share(c("_bars"), n),
        "bangs_per_word": _share(c("_bangs"), n),
        "letter_share": _share(c("_letters"), c("word_chars")),
        "upper_share": _share(c("_upper"), c("_letters")),
        "stop_word_share": _share(c("_stop"), n),
        "dup_line_share": _share(c("_lines.dup"), c("_lines.n")),
        "repeat_word_share": _share(c("n_repeat_words"), n),
        "ellipsis_line_share": _share(c("_ellipses"), c("_lines.n")),
    }


def verdict(rules: tuple[Rule, ...], found: dict[str, Column]) -> Column:
    """Whether a text meets every rule."""
    ok = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            ok = ok & (found[rule.measure] >= rule.least)
        if rule.most is not None:
            ok = ok & (found[rule.measure] <= rule.most)
    return ok


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, with_measures: bool = False) -> DataFrame:
    """Counts and verdict for every document; ``with_measures`` adds every measure that a rule can name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents(docs).select("doc_id", text.alias("text"))
    words = words_of(F.col("text"))
    counted = own.select("doc_id", "text", let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("r"))).alias("c"))
    counted = counted.select("doc_id", "text", F.col("c.n").alias("n_words"), F.col("c.r").alias("n_repeat_words"))
    counted = counted.select("doc_id", "n_words", "n_repeat_words", *[c.alias(k) for k, c in counts(F.col("text")).items()])
    counted = counted.withColumn("n_dup_lines", F.col("_lines.dup"))
    found = measures()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    more = [c.alias(k) for k, c in found.items() if k != "n_words"] if with_measures else []
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules, found)).alias("kept"), *more)
