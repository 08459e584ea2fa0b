"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are native expressions over the whole text: densities of lexicons, how near the second
person stands to lexicon words, capitals, punctuation and obfuscation. Two lexicons are given;
two more are learnt: word beginnings that labelled toxic rows have far more often than others,
so that languages without a given lexicon are covered. They are counted over all labelled rows
outside the held-out fold, but for the part that calibrates. Trees are fitted to a bounded
sample of the same rows by MLlib, where Spark partitions the work; the scores of the part that
neither lexicons nor trees have seen are calibrated by an isotonic step function, which is
applied as a native expression with the trees. Identifiers, labels, language and source are never features.

Defined cases: null text is empty; an empty text has a score like any other; every row of the
input gets one, repeated rows the same one; a null id counts as held out of learning; without
labelled rows of both classes every score is the labelled share of toxic rows (0 without any);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convmem.llm.common import apart, checkpoint, documents, trie_pattern
from convmem.llm.quality import let

# Lexicons: fixed values.
INSULTS = "idiot moron loser scum clown stupid pathetic worthless disgusting trash fool dumb jerk imbecile cretin liar coward garbage filth vermin pig rat parasite disgrace".split()
INSULTS += "idiota imbécil estúpido estúpida basura asqueroso patético escoria payaso crétin imbécile stupide ordure débile minable pathétique dégoûtant dummkopf abschaum blödmann trottel dumm widerlich erbärmlich wertlos müll".split()
HARM = "hate kill die hurt destroy burn shut hell damn odio matar muere haine tuer crève hass töten stirb".split()
SECOND = "you your yours yourself u ur tu te toi vous du dich dir ihr euch usted ustedes vosotros".split()
#: Characters that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

FEATURES = (
    "insults",
    "harm",
    "learnt_sure",
    "learnt_likely",
    "learnt_density",
    "insult_density",
    "harm_density",
    "disguised_density",
    "spaced_density",
    "second_density",
    "second_near_insult",
    "upper_share",
    "upper_word_share",
    "bang_density",
    "punctuation_share",
    "repeated_letter_density",
    "mixed_word_density",
    "log_words",
)

#: Rows that the trees are fitted to, at most; the rest of the labelled rows only count in statistics.
SAMPLE = 60_000


def _any(words: list[str]) -> str:
    """A pattern for any of the words; it takes the character before, so only ends of words are looked at."""
    return f"(?:^|[^\\p{{L}}])(?:{trie_pattern(words, whole=True)})(?!\\p{{L}})"


@dataclass(frozen=True)
class Learnt:
    """Word beginnings that only toxic rows have, and those that they have far more often."""

    sure: tuple[str, ...] = ()
    likely: tuple[str, ...] = ()


def _begun(words: Column, length: int) -> Column:
    return F.transform(words, lambda w: F.substring(w, 1, length))


def learnt(rows: DataFrame, lengths: tuple[int, ...] = (5, 7)) -> Learnt:
    """From rows with ``text`` and ``toxic``: counts of documents for each word beginning, then all of each sort that are over chance."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), F.lit(0))
    words = let(found, lambda w: F.array_distinct(F.concat(*[_begun(w, k) for k in lengths])))
    toxic = F.col("toxic").cast("double")
    seen = rows.select(toxic.alias("t"), F.explode(words).alias("w")).groupBy("w").agg(F.sum("t").alias("yes"), F.sum(1 - F.col("t")).alias("no"))
    n, ones = rows.agg(F.count("*"), F.sum(toxic)).first()
    share = ones / n
    rate = F.col("yes") / (F.col("yes") + F.col("no"))
    # How many standard deviations the count is over what chance would give.
    over = (F.col("yes") - share * (F.col("yes") + F.col("no"))) / F.sqrt((F.col("yes") + F.col("no")) * share * (1 - share))
    scored = seen.where("yes >= 4").select("w", rate.alias("rate"), over.alias("over"))

    def chosen(where: Column) -> tuple[str, ...]:
        return tuple(sorted(r["w"] for r in scored.where(where).select("w").collect()))

    scored = checkpoint(scored.where((F.col("over") >= 6) & (F.col("rate") >= 2.5 * share)))
    return Learnt(chosen(F.col("rate") >= 0.9), chosen(F.col("rate") < 0.9))


def with_features(docs: DataFrame, known: Learnt) -> DataFrame:
    """The input's rows and columns and the dense features, each with a leading underscore, which the input's own columns may not have.

    What several features need is matched once, as columns of a projection of its own: all words
    of the lexicons in one pass, all beginnings in another; each match is then told apart by list.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stems = [*known.sure, *known.likely]
    words = f"(?:^|[^\\p{{L}}])({trie_pattern(INSULTS + HARM + SECOND, whole=True)})(?!\\p{{L}})"
    docs = docs.withColumn("_m_lower", F.lower(text)).withColumns(
        {
            "_m_words": F.regexp_extract_all("_m_lower", F.lit(words), F.lit(1)),
            "_m_begun": F.regexp_extract_all("_m_lower", F.lit(f"(?:^|[^\\p{{L}}])({trie_pattern(stems)})"), F.lit(1)) if stems else F.array().cast("array<string>"),
            "_m_capitals": F.regexp_extract_all(text, F.lit("\\p{Lu}+"), F.lit(0)),
        }
    )
    found = features(text, known)
    return docs.withColumns({f"_{k}": c for k, c in found.items()}).drop("_m_lower", "_m_words", "_m_begun", "_m_capitals")


def features(text: Column, known: Learnt) -> dict[str, Column]:
    """The dense features by name, over the text and what ``with_features`` has matched in it."""
    count = lambda t, p: F.regexp_count(t, F.lit(p)).cast("double")
    lower = F.col("_m_lower")
    chars = F.greatest(F.length(text).cast("double"), F.lit(1.0))
    words = F.length(text) - F.length(F.translate(text, " \t\n\x0b\f\r", "")) + F.lit(1.0)
    letters = F.greatest(F.length(F.regexp_replace(text, "[^\\p{L}]+", "")).cast("double"), F.lit(1.0))
    among = lambda column, chosen: F.size(F.filter(column, lambda m: m.isin(list(chosen)))).cast("double") if chosen else F.lit(0.0)
    insults, harm, second = (among("_m_words", x) for x in (INSULTS, HARM, SECOND))
    sure, likely = among("_m_begun", known.sure), among("_m_begun", known.likely)
    capitals = F.col("_m_capitals")
    plain = F.translate(lower, "".join(DISGUISE), "".join(DISGUISE.values()))
    near = f"{_any(SECOND)}(?:[^\\p{{L}}\\n]+\\p{{L}}+){{0,3}}?{_any(INSULTS)}|{_any(INSULTS)}(?:[^\\p{{L}}\\n]+\\p{{L}}+){{0,3}}?{_any(SECOND)}"
    gap = "[ .*_-]"
    spaced = f"(?:^|[^\\p{{L}}])(?:{trie_pattern([w for w in INSULTS if w.isascii()], whole=True, between=gap)})(?!\\p{{L}})"
    # Rare characters first: a pattern that begins with one is tried at few places.
    disguise = "[" + "".join(DISGUISE).replace("$", "\\$") + "]"
    doubled = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return {
        "learnt_sure": sure,
        "learnt_likely": likely,
        "learnt_density": (sure + likely) / words,
        "insults": insults,
        "harm": harm,
        "insult_density": insults / words,
        "harm_density": harm / words,
        "disguised_density": F.when(text.rlike(f"{disguise}(?:(?=\\p{{L}})|(?<=\\p{{L}}.))"), F.greatest(count(plain, _any(INSULTS)) - insults, F.lit(0.0))).otherwise(0.0) / words,
        "spaced_density": F.when(text.rlike(f"{gap}\\p{{L}}{gap}\\p{{L}}{gap}"), count(lower, spaced)).otherwise(0.0) / words,
        "second_density": second / words,
        "second_near_insult": F.when((insults > 0) & (second > 0), count(lower, near)).otherwise(0.0),
        "upper_share": F.length(F.array_join(capitals, "")) / letters,
        "upper_word_share": F.size(F.filter(capitals, lambda c: F.length(c) > 1)) / words,
        "bang_density": (doubled("!!") + doubled("??")) / words,
        "punctuation_share": (F.length(text) - F.length(F.regexp_replace(text, "\\p{P}+", ""))) / chars,
        "repeated_letter_density": count(lower, "([a-zà-ÿ])\\1\\1+") / words,
        "mixed_word_density": count(text, "[0-9@$!*](?<=\\p{L}.)[0-9@$!*]*+(?=\\p{L})") / words,
        "log_words": F.log1p(words),
    }


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def part(doc_id: Column) -> Column:
    """One of four parts of the rows to learn from, by hash of the id; part 0 calibrates."""
    return F.pmod(F.xxhash64(doc_id, F.lit(4)), F.lit(4))


@dataclass(frozen=True)
class Model:
    trees: GBTClassificationModel | None
    bounds: tuple[float, ...]
    values: tuple[float, ...]
    share: float

    def scored(self, featured: DataFrame) -> DataFrame:
        """Adds ``_score`` to a table that has the features."""
        if self.trees is None:
            return featured.withColumn("_score", F.lit(self.share))
        rows = VectorAssembler(inputCols=[f"_{k}" for k in FEATURES], outputCol="_features").transform(featured)
        trees = self.trees.setRawPredictionCol("_rawPrediction").setProbabilityCol("_probability").setPredictionCol("_prediction")
        rows = trees.transform(rows).withColumn("_raw", vector_to_array("_probability")[1])
        return rows.withColumn("_score", self._calibrated(F.col("_raw"))).drop("_features", "_raw", "_rawPrediction", "_probability", "_prediction")

    def _calibrated(self, raw: Column) -> Column:
        """Linear between the isotonic steps; blended with the raw score, so that ties keep the trees' order."""
        score = F.lit(self.values[-1])
        for i in range(len(self.bounds) - 1, -1, -1):
            if i == 0:
                below = F.lit(self.values[0])
            else:
                x0, x1, y0, y1 = self.bounds[i - 1], self.bounds[i], self.values[i - 1], self.values[i]
                below = F.lit(y0) + (raw - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)
            score = F.when(raw <= self.bounds[i], below).otherwise(score)
        return F.least(F.greatest(0.999 * score + 0.001 * raw, F.lit(0.0)), F.lit(1.0))


def fit(learn: DataFrame, trees: int = 20, depth: int = 3) -> Model:
    """From rows with ``doc_id``, ``toxic`` and the features. One part in four of them calibrates."""
    known = learn.where("toxic is not null")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("double")), F.lit(0.0))).first()
    share = ones / n if n else 0.0
    if not 0 < share < 1:
        return Model(None, (), (), share)
    rows = known.withColumn("label", F.col("toxic").cast("double")).withColumn("_part", part(F.col("doc_id")))
    rows = VectorAssembler(inputCols=[f"_{k}" for k in FEATURES], outputCol="_features").transform(rows).select("label", "_features", "_part")
    rows = checkpoint(rows).coalesce(6)  # the bounded sample fits few partitions
    grown = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, maxMemoryInMB=128, cacheNodeIds=False)
    if rows.where("_part > 0").agg(F.countDistinct("label")).first()[0] < 2:
        return Model(None, (), (), share)
    model = grown.fit(rows.where("_part > 0").select("label", "_features"))
    held = model.transform(rows.where("_part = 0")).select("label", vector_to_array("probability")[1].alias("raw"))
    if held.isEmpty():
        return Model(model, (0.0, 1.0), (0.0, 1.0), share)
    steps = IsotonicRegression(labelCol="label", featuresCol="raw").fit(held)
    bounds, values = steps.boundaries.toArray().tolist(), steps.predictions.toArray().tolist()
    return Model(model, tuple(bounds), tuple(values), share)


def sampled(known: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` of the labelled rows, chosen by hash: the same at every run, whatever the partitions."""
    n = known.count()
    if n <= sample:
        return F.broadcast(known)
    return F.broadcast(checkpoint(known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(1 << 20)) < int(sample / n * (1 << 20)))))


@dataclass(frozen=True)
class Scorer:
    """What has been learnt: the lexicon and the calibrated trees."""

    lexicon: Learnt
    model: Model

    def scored(self, docs: DataFrame) -> DataFrame:
        """The input's rows and columns and ``_score``, in one pass over the texts."""
        return self.model.scored(with_features(docs, self.lexicon)).drop(*[f"_{k}" for k in FEATURES])


def _known(labels: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, toxic) of the labelled rows outside the held-out fold: all, and a bounded sample that the trees are fitted to."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = checkpoint(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 0))
    return known, sampled(known, sample)


def _lexicon(docs: DataFrame, known: DataFrame) -> Learnt:
    known = known.where(part(F.col("doc_id")) > 0)
    both = known.agg(F.min("toxic"), F.max("toxic")).first()
    # The labels grow with the table, so at every size both sides are dealt by id.
    return learnt(documents(docs).where("text is not null").join(known.hint("merge"), "doc_id").drop("doc_id")) if tuple(both) == (0, 1) else Learnt()


def _featured(docs: DataFrame, lexicon: Learnt, *more: str) -> DataFrame:
    return with_features(docs, lexicon).select("doc_id", *more, *[f"_{k}" for k in FEATURES])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """What can be learnt from the labelled rows; the others are not looked at."""
    known, some = _known(labels, sample)
    lexicon = _lexicon(docs, known)
    return Scorer(lexicon, fit(_featured(documents(docs).join(some, "doc_id"), lexicon, "toxic")))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels are learnt from the rows outside the held-out fold only."""
    known, some = _known(labels, sample)
    rows = checkpoint(_featured(documents(docs), _lexicon(docs, known)))  # one pass over the texts for learning and scoring
    scored = fit(rows.join(some, "doc_id")).scored(rows)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of the input that are not rejected."""
    return learn(docs, labels, sample).scored(apart(docs, text=F.col("text"))).where(F.col("_score") < threshold).select("row.*")
