"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the votes.

Candidates are the spans of the base patterns and of looser ones (national phone numbers,
disguised addresses, number groups, titles with names, assigned secrets). Labelers of three
sorts vote for or against each, or abstain: patterns (is the form strict), gazetteers (known
domains, card issuers, reserved networks, cue words' lists) and contexts (what stands before it,
whether it stands alone). How often each combination of votes occurs is counted over all
documents; there are at most 3**6 of them for a kind, so this table, and no span, goes to the
driver. There expectation-maximisation estimates the labelers' reliabilities, and a logistic
classifier is fitted to its posteriors. The classifier is applied as one native expression.
Spans of the base patterns stay whatever it says.

Everything that touches texts or spans is a native expression: matches and the pieces between
them give positions, so no user function runs.

Defined cases: null text is empty and has no spans; positions count code points; repeated rows
are searched one by one; a null id is returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convmem.llm.common import apart, checkpoint
from convmem.llm.quality import let

#: Fixed order of the kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("email_disguised", "phone_national", "number_group", "name_titled", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

# The base patterns, written so that no start is tried twice in one run of characters: a run that
# fails at its first character fails at the others, too. \G lets a match begin where one ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "email_disguised": f"(?i)(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++\\x20?[\\[(]at[\\])]\\x20?[A-Za-z0-9-]++(?:\\x20?(?:[\\[(]dot[\\])]|\\.)\\x20?[A-Za-z0-9-]++)++",
    "phone_national": "(?<![0-9+.-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[\\x20.-])[0-9]{3}[\\x20.-][0-9]{4}(?![0-9.-])",
    "number_group": "(?<![0-9+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
    "name_titled": "(?<![\\p{L}])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\\.?\\x20\\p{Lu}\\p{Ll}++(?:\\x20\\p{Lu}\\p{Ll}++)?",
    "secret": "(?i)(?:token|secret|password|passwd|api[_-]?key)\\x20{0,3}[=:]\\x20{0,3}\"?[A-Za-z0-9_-]{16,}+\"?",
}
#: A character that every match of a kind has: texts without it are not searched.
NEEDED = {"email": "@", "phone": "+", "ip": "."}

# Gazetteers: fixed values.
TOP_DOMAINS = "com org net edu gov info io co uk de fr es eu it nl ch at be ca us mx ar au jp cn in br".split()
CUES = {
    "email": "mail email e-mail contact write courriel correo",
    "ip": "ip host server address adresse addr",
    "card": "card visa mastercard amex credit carte karte tarjeta",
    "phone": "phone tel call mobile fax telefon fon móvil teléfono",
    "name": "name contact signed dear from by nom nombre von",
    "secret": "token secret password key api",
}
AGAINST = "version release isbn issn order invoice section chapter page build"


def _cue(kind: str) -> str:
    return CUES[kind.split("_")[0] if kind != "number_group" else "phone"]


# Positions ------------------------------------------------------------------------------------


def running(values: Column, step: Callable[[Column, Column], Column], start: Column, chunk: int = 256) -> Column:
    """The fold of an array's values up to and including each; in chunks, so that many values stay cheap."""

    def total(a: Column) -> Column:
        return F.aggregate(a, start, step)

    def within(c: Column, base: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(c)), lambda j: step(base, total(F.slice(c, F.lit(1), j))))

    def all_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, total)
        return let(totals, lambda s: F.flatten(F.transform(chunks, lambda c, k: within(c, total(F.slice(s, F.lit(1), k))))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")), lambda k: F.slice(values, k * chunk + 1, F.lit(chunk)))
    return F.when(F.size(values) > 0, let(cut, all_chunks)).otherwise(F.array().cast("array<bigint>"))


def whole(n: int) -> Column:
    return F.lit(n).cast("bigint")


def matches(text: Column, kind: str, around: int = 40, following: int = 8) -> Column:
    """Leftmost, non-overlapping matches as an array of (start, end, value, before, after), in code points.

    Contexts are made of the pieces between matches, so that a text with many matches is not
    looked through for each; ``before`` goes no further back than to the match before.
    """
    pattern = F.lit(PATTERNS[kind])
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>")

    def place(m: Column) -> Column:
        def with_pieces(between: Column) -> Column:
            # A match starts after all that is before it: the pieces and the earlier matches.
            lengths = F.transform(m, lambda x, i: (F.length(F.get(between, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)).cast("bigint"))

            def one(x: Column, i: Column, starts: Column) -> Column:
                before = F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(between, i))
                after = F.concat(F.substring(F.get(between, i + 1), 1, following), F.substring(F.coalesce(F.get(m, i + 1), F.lit("")), 1, following))
                return F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(x)).alias("end"), x.alias("value"), F.substring(before, -around, around).alias("before"), F.substring(after, 1, following).alias("after"))

            return let(lengths, lambda v: let(running(v, lambda a, x: a + x, whole(0)), lambda starts: F.transform(m, lambda x, i: one(x, i, starts))))

        return let(F.split(text, PATTERNS[kind], -1), with_pieces)

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(empty))
    return F.when(F.contains(text, F.lit(NEEDED[kind])), found).otherwise(empty) if kind in NEEDED else found


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(value)

    def term(i: Column) -> Column:
        d = F.substring(value, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte_parts(value: Column) -> Column:
    small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) <= 3) & (F.when(s == "", 0).otherwise(F.substring(s, 1, 3).cast("int")) <= 255))
    return F.forall(F.split(value, "\\."), small)


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return _byte_parts(value)
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


# Labelers -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Labeler:
    """A vote of 1, -1 or 0 (abstains) on a candidate: a struct of kind, value, before, after."""

    name: str
    vote: Callable[[Column], Column]


def _either(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _one_of(c: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(0)
    for kind, vote in choices.items():
        out = F.when(c["kind"] == kind, vote).otherwise(out)
    return out


def _words(words: str) -> str:
    return f"(?<!\\p{{L}})(?:{'|'.join(words.split())})(?!\\p{{L}})"


def _strict_form(c: Column) -> Column:
    v = c["value"]
    return _one_of(c, {
        "email": _either(v.rlike("^[A-Za-z0-9].*@.*\\.[A-Za-z]{2,}$"), v.rlike("\\.\\.|@.*_|\\.[0-9]+$")),
        "ip": _either(v.rlike("^(?:0|[1-9][0-9]{0,2})(?:\\.(?:0|[1-9][0-9]{0,2})){3}$"), v.rlike("(?:^|\\.)0[0-9]")),
        "card": _either(valid("card", v), ~valid("card", v)),
        "phone": _either(v.rlike("^\\+[0-9]{1,3}[ (]"), v.rlike("[.-]{2,}|  ")),
        "email_disguised": _either(v.rlike("(?i)at[\\])].*[\\[(]dot[\\])]"), F.lit(False)),
        "phone_national": _either(v.rlike("^\\([2-9]|^[2-9][0-9]{2}-"), v.rlike("^\\(?[01]")),
        "number_group": _either(v.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), v.rlike("^(?:000|666|9)|-00-|-0000$")),
        "name_titled": F.lit(1),
        "secret": _either(v.rlike("[0-9]") & v.rlike("(?i)[=:].*[a-z]"), ~v.rlike("[0-9]")),
    })


def _gazetteer(c: Column) -> Column:
    v = c["value"]
    domain = f"(?i)(?:\\.|[\\[(]dot[\\])]\\x20?)(?:{'|'.join(TOP_DOMAINS)})$"
    return _one_of(c, {
        "email": _either(v.rlike(domain), F.lit(False)),
        "email_disguised": _either(v.rlike(domain), ~v.rlike(domain)),
        "ip": _either(~v.rlike("^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\\."), v.rlike("^0\\.")),
        "card": _either(digits(v).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), digits(v).rlike("^0")),
        "phone": _either(v.rlike("^\\+(?:1|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), v.rlike("^\\+0")),
        "secret": _either(v.rlike("(?i)^(?:token|api)"), F.lit(False)),
    })


def _cues(c: Column) -> Column:
    hit = F.lit(False)
    for kind in KINDS:
        hit = hit | ((c["kind"] == kind) & F.lower(c["before"]).rlike(_words(_cue(kind))))
    return _either(hit, F.lower(c["before"]).rlike(_words(AGAINST)))


def _alone(c: Column) -> Column:
    """Nothing of a word, number or path touches it."""
    return _either(~c["before"].rlike("[\\p{L}0-9_/=-]$") & ~c["after"].rlike("^[\\p{L}0-9_/@=-]"), c["before"].rlike("[\\p{L}0-9]$") | c["after"].rlike("^[\\p{L}0-9]"))


def _not_series(c: Column) -> Column:
    """Not one of several numbers in a row, as in tables."""
    return _either(~c["before"].rlike("[0-9][,;|\\t ]*$") & ~c["after"].rlike("^[,;|\\t ]*[0-9]"), c["before"].rlike("[0-9][,;|\\t]+\\x20*$") & c["after"].rlike("^\\x20*[,;|\\t]+\\x20*[0-9]"))


def _varied(c: Column) -> Column:
    """Not one character again and again, nor an example's counting digits."""
    v = c["value"]
    return _either(~v.rlike("(.)\\1{5,}") & ~v.rlike("123456|000000"), v.rlike("([0-9])\\1{7,}"))


LABELERS = (Labeler("strict_form", _strict_form), Labeler("gazetteer", _gazetteer), Labeler("cues", _cues), Labeler("alone", _alone), Labeler("not_series", _not_series), Labeler("varied", _varied))

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,base:boolean,votes:array<int>>>"


def candidates(docs: DataFrame, labelers: tuple[Labeler, ...] = LABELERS, into: str = "spans") -> DataFrame:
    """The input's columns and ``into``: all candidates of each document in the order of their starts, with the votes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def spans(text: Column, kind: str) -> Column:
        rank = KINDS.index(kind)

        def voted(m: Column) -> Column:
            c = F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))
            base = valid(kind, m["value"]) if kind in BASE_KINDS else F.lit(False)
            votes = let(c, lambda x: F.array(*[labeler.vote(x) for labeler in labelers]))
            return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), base.alias("base"), votes.alias("votes"))

        return F.transform(matches(text, kind), voted)

    every = let(text, lambda t: F.sort_array(F.concat(*[spans(t, k) for k in KINDS]))).cast(_SPAN)
    # Plain numbers of few digits match the card pattern but are nobody's candidate.
    return docs.withColumn(into, F.filter(every, lambda s: s["base"] | (s["kind"] != "card") | F.length(digits(s["value"])).between(14, 19)))


# Weighing the votes ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A logistic classifier: a weight for each kind, and for each labeler's yes and no."""

    kinds: dict[str, float]
    yes: tuple[float, ...]
    no: tuple[float, ...]

    def logit(self, span: Column) -> Column:
        out = F.lit(0.0)
        for kind, w in self.kinds.items():
            out = out + F.when(span["kind"] == kind, w).otherwise(0.0)
        for i, (y, n) in enumerate(zip(self.yes, self.no, strict=True)):
            vote = F.get(span["votes"], i)
            out = out + F.when(vote == 1, y).when(vote == -1, n).otherwise(0.0)
        return out


Counted = list[tuple[str, tuple[int, ...], int]]


def posteriors(counted: Counted, labelers: int, rounds: int = 60) -> list[float]:
    """How likely each combination (kind, votes, count) is personal data, by expectation-maximisation.

    Labelers are taken as independent given the truth; each has a rate for every vote under either
    truth, with pseudo-counts that hold it to be better than chance, and each kind its own share.
    """
    # The start: the majority of the votes.
    post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for _, v, _ in counted]
    for _ in range(rounds):
        share: dict[str, list[float]] = {}
        rate = [{t: {v: (4.0 if v == t else 1.0) for v in (-1, 0, 1)} for t in (1, -1)} for _ in range(labelers)]
        for (kind, votes, n), p in zip(counted, post, strict=True):
            s = share.setdefault(kind, [1.0, 1.0])
            s[0] += n * p
            s[1] += n * (1 - p)
            for i, v in enumerate(votes):
                rate[i][1][v] += n * p
                rate[i][-1][v] += n * (1 - p)
        for r in rate:
            for t in (1, -1):
                total = sum(r[t].values())
                r[t] = {v: x / total for v, x in r[t].items()}
        new = []
        for kind, votes, _ in counted:
            a, b = (math.log(x) for x in share[kind])
            for i, v in enumerate(votes):
                a += math.log(rate[i][1][v])
                b += math.log(rate[i][-1][v])
            new.append(1 / (1 + math.exp(max(-500.0, min(500.0, b - a)))))
        moved = max((abs(x - y) for x, y in zip(new, post, strict=True)), default=0.0)
        post = new
        if moved < 1e-6:
            break
    return post


def fitted(counted: Counted, labelers: int, rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> Model:
    """A logistic classifier of the posteriors, each combination weighted by the root of its count."""
    post = posteriors(counted, labelers)
    kinds = dict.fromkeys(sorted({k for k, _, _ in counted}), 0.0)
    yes, no = [1.0] * labelers, [-1.0] * labelers
    weights = [math.sqrt(n) for _, _, n in counted]
    total = sum(weights) or 1.0
    for _ in range(rounds):
        dk, dy, dn = dict.fromkeys(kinds, 0.0), [0.0] * labelers, [0.0] * labelers
        for (kind, votes, _), p, w in zip(counted, post, weights, strict=True):
            z = kinds[kind] + sum(yes[i] if v == 1 else no[i] if v == -1 else 0.0 for i, v in enumerate(votes))
            e = w / total * (p - 1 / (1 + math.exp(max(-500.0, min(500.0, -z)))))
            dk[kind] += e
            for i, v in enumerate(votes):
                if v == 1:
                    dy[i] += e
                elif v == -1:
                    dn[i] += e
        for k in kinds:
            kinds[k] += rate * (dk[k] - ridge * kinds[k])
        for i in range(labelers):
            yes[i] += rate * (dy[i] - ridge * yes[i])
            no[i] += rate * (dn[i] - ridge * no[i])
    return Model(kinds, tuple(yes), tuple(no))


def counted(found: DataFrame) -> Counted:
    """How often each combination of votes occurs: at most (kinds) * 3**(labelers) rows."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    return sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in rows)


def accepted(model: Model, threshold: float = 0.8) -> Callable[[Column], Column]:
    """Whether a span stays: a base span, or one that the classifier finds likely enough."""
    bound = math.log(threshold / (1 - threshold))
    return lambda s: s["base"] | (model.logit(s) >= bound)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, for every document."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find_without_text(own)
    base = F.filter("spans", lambda s: s["base"])
    n = [F.size(F.filter(base, of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *n, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def find_without_text(docs: DataFrame, labelers: tuple[Labeler, ...] = LABELERS) -> DataFrame:
    """As ``find``, with the ids and spans only, so that no text is written."""
    return _choose(checkpoint(candidates(docs, labelers).select("doc_id", "spans")), labelers)


#: Characters of the pieces that a text is cut into before parts of it are taken.
PIECE = 1024


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text that comes in pieces: only the pieces concerned are looked at."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    here = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    first = F.substring(here(a), (start % PIECE + 1).cast("int"), F.lit(PIECE))
    apart_ = F.concat(first, F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(here(b), F.lit(1), (end % PIECE).cast("int")))
    return F.when(a == b, F.substring(here(a), (start % PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise(apart_)


def _ends(spans: Column, chosen: Callable[[Column], Column] = lambda s: F.lit(True)) -> Column:
    """The greatest end of the chosen spans up to each."""
    return running(F.transform(spans, lambda s: F.when(chosen(s), s["end"]).otherwise(0).cast("bigint")), lambda a, x: F.greatest(a, x), whole(0))


def redacted(docs: DataFrame, labelers: tuple[Labeler, ...] = LABELERS) -> DataFrame:
    """The input with every span of ``text`` replaced by its kind in brackets; texts without a span, and nulls, as they are.

    Spans that overlap are replaced together, by the kind of the first.
    """
    keep = accepted(fitted(counted(candidates(docs.select("text"), labelers)), len(labelers)))
    found = candidates(apart(docs, text=F.col("text").cast("string")), labelers).withColumn("spans", _chosen(F.col("spans"), keep))

    def replaced(spans: Column, pieces: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            numbered = F.transform(spans, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["kind"].alias("kind")))
            heads = F.filter(numbered, lambda s: (s["i"] == 0) | (s["start"] >= F.get(ends, s["i"] - 1)))
            part = lambda h: F.concat(between(pieces, F.coalesce(F.get(ends, h["i"] - 1), whole(0)), h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))
            rest = between(pieces, F.element_at(ends, -1), F.length("text").cast("bigint"))
            return F.concat(F.array_join(F.transform(heads, part), ""), rest)

        return let(_ends(spans), with_ends)

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = F.when(F.size("spans") > 0, let(pieces, lambda p: replaced(F.col("spans"), p))).otherwise(F.col("text"))
    return found.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _chosen(spans: Column, keep: Callable[[Column], Column]) -> Column:
    """Base spans, and those that the classifier keeps and no base span overlaps; spans come in the order of their starts."""
    far = whole(1 << 62)

    def choose(spans: Column) -> Column:
        starts = F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(far)))
        following = F.reverse(running(starts, lambda a, x: F.least(a, x), far))

        def pick(before: Column, after: Column) -> Column:
            free = lambda s, i: (F.coalesce(F.get(before, i - 1), whole(0)) <= s["start"]) & (F.coalesce(F.get(after, i + 1), far) >= s["end"])
            return F.filter(spans, lambda s, i: s["base"] | (keep(s) & free(s, i)))

        return let(_ends(spans, lambda s: s["base"]), lambda before: let(following, lambda after: pick(before, after)))

    # A text with base spans only, or with none, needs no comparing.
    return let(spans, lambda s: F.when(F.forall(s, lambda x: x["base"]), s).otherwise(choose(s)))


def _choose(found: DataFrame, labelers: tuple[Labeler, ...]) -> DataFrame:
    keep = accepted(fitted(counted(found), len(labelers)))
    return found.withColumn("spans", _chosen(F.col("spans"), keep))
