"""Text scalars: tokens, overlaps, truncation, labels, ids. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that never carry a correction.
FUNCTION_WORDS = "the and was has had are but for not with that this his her its their they she him who now then also very into from about been will".split()
# Words that say nothing about a topic.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on or our she that the their them then they this to up us was we "
    "were what when which who will with would you your"
).split()


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bag(text: Column) -> Column:
    """Distinct lower-case words; everything but ASCII word characters and white space separates."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+"), lambda w: w != ""))


def topic_words(text: Column) -> Column:
    """The bag without stop words and words of under three letters."""
    return F.array_except(F.filter(bag(text), lambda w: F.length(w) > 2), words(STOP_WORDS))


def sweep_tokens(text: Column) -> Column:
    """Distinct runs of at least three lower-case letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3))


def content_words(text: Column) -> Column:
    """Distinct runs of at least four letters that are no stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), words(STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the first set that the second has; 0 if the first is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def correction(a: Column, b: Column, least: float = 0.5, most: int = 4) -> Column:
    """Whether two bags say the same thing but for one to ``most`` content words."""
    differ = F.array_union(F.array_except(a, b), F.array_except(b, a))
    carrying = F.array_except(F.filter(differ, lambda w: F.length(w) >= 3), words(FUNCTION_WORDS))
    return (jaccard(a, b) >= least) & F.size(carrying).between(1, most)


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def cut_at_word(text: Column, most: int = 120) -> Column:
    """At most so many characters, cut at the last space among them."""
    head = F.substring(text, 1, most)
    at_space = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.when(at_space != "", at_space).otherwise(head))


def cut_with_mark(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def cut_at_sentence(text: Column, most: int = 600, least: int = 300) -> Column:
    """At most so many characters, cut after the last sentence end if that is late enough, else marked."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])[^.!?]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.when(F.length(sentence) > least, sentence).otherwise(F.concat(head, F.lit("…"))))


def label(text: Column) -> Column:
    """Lower case, trimmed, single spaces. (Compatibility forms: see ``matching.nfkc``.)"""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def slug(text: Column, most: int = 40, default: str = "character") -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(body == "", F.lit(default)).otherwise(F.substring(body, 1, most))


def beat_id(start: Column, end: Column, speaker: Column, text: Column) -> Column:
    """The same chunk always gets the same id."""
    return F.concat(F.lit("beat-"), F.substring(F.sha1(F.concat(start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), speaker, F.lit("\n"), text)), 1, 12))


def job_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\n", *[p.cast("string") for p in parts])), 1, 16)


def looks_incident(summary: Column) -> Column:
    return F.trim(summary).rlike(r"^\[\w+\]")


def is_compound(text: Column) -> Column:
    """Whether a label names several."""
    return F.lower(text).rlike(r"(^|[^a-z0-9_])(and|with|plus)([^a-z0-9_]|$)|[&,/+]")


def without_lead(text: Column) -> Column:
    """Without a scene lead between asterisks and the white space after it."""
    return F.regexp_replace(text, r"(?s)^\s*\*[^*]*\*\s*", "")


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; 0 where one has no length. The shorter one's positions count."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
