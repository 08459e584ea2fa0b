"""Whose is it: labels, aliases, rosters, routing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convmem.functions import text as X
from convmem.operators import setjoin
from convmem.operators.graph import checkpoint


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def similarity(x: str | None, y: str | None) -> float | None:
    """Jaro similarity raised by a common beginning of up to four characters, whatever the similarity."""
    if x is None or y is None:
        return None
    s = _jaro(x, y)
    same = 0
    while same < min(4, len(x), len(y)) and x[same] == y[same]:
        same += 1
    return s + same * 0.1 * (1 - s)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)])


def labels_alike(a: str, b: str, least: float = 0.85) -> bool:
    """Two labels that are the same, or one's significant words among the other's, or nearly the same; a blank one matches nothing."""
    x, y = " ".join(a.lower().split()), " ".join(b.lower().split())
    if not x or not y:
        return False
    v, w = ({t for t in re.findall(r"[^\W_]+", z) if len(t) >= 3} for z in (x, y))
    inside = bool(v and w) and (v <= w or w <= v)
    return x == y or inside or similarity(x, y) >= least


@F.pandas_udf(T.StringType())
def nfkc(a: pd.Series) -> pd.Series:
    """Compatibility characters as their plain ones."""
    return a.str.normalize("NFKC")


def exact_matches(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label, identity_key, claimants): every identity that has a label for its own. aliases: (identity_key, label)."""
    known = aliases.select("identity_key", X.label(F.col("label")).alias("_n")).distinct()
    found = labels.select("label", X.label(F.col("label")).alias("_n")).distinct().join(known, "_n")
    return found.select("label", "identity_key", F.count("*").over(W.partitionBy("label")).alias("claimants"))


#: Two labels with so many first letters in common (none to four) and at least 0.85 by Jaro-Winkler have Jaro similarity s of (0.85 - n / 10) / (1 - n / 10)
#: or more, so at least 3 s - 1 = share of the one + share of the other in letters in common, and a Jaccard similarity of their letters of 3 s - 2 or more.
def letters_in_common(least: float, first: int) -> float:
    s = (least - 0.1 * first) / (1 - 0.1 * first)
    return max(0.01, 3 * s - 2)


def _letters(n: Column) -> Column:
    """The letters of a label, each with its number among its like, so that a set of them is the label's multiset of letters."""

    def one(i: Column) -> Column:
        c, head = F.substring(n, i, F.lit(1)), F.substring(n, F.lit(1), i)
        return F.concat(c, F.lit("#"), (F.length(head) - F.length(F.replace(head, c, F.lit("")))).cast("string"))

    return F.array_sort(F.transform(F.sequence(F.lit(1), F.length(n)), one))


def _alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(n, m): labels that may be ``least`` alike by Jaro-Winkler: an upper bound from their lengths and letters lets no pair be lost."""
    blocks = lambda c: F.filter(F.array(*[F.concat(F.lit(str(k)), F.substring(c, 1, k)) for k in range(5)]), lambda b: F.length(b) == F.substring(b, 1, 1).cast("int") + 1)
    asked, known = left.select("n").distinct().where("n <> ''"), right.select(F.col("m").alias("n")).distinct().where("n <> ''")
    rows = asked.withColumns({"probe": F.lit(True), "target": F.lit(False)}).unionByName(known.withColumns({"probe": F.lit(False), "target": F.lit(True)}))
    rows = checkpoint(rows.withColumns({"t": _letters(F.col("n")), "block": F.explode(blocks("n"))}))
    sets = setjoin.numbered_sets(rows)
    bound = F.element_at(F.array(*[F.lit(letters_in_common(least, k)) for k in range(5)]), F.substring("block", 1, 1).cast("int") + 1)
    pairs = setjoin.similar(sets, bound)
    named = rows.join(sets.select("block", "t", "set_id"), ["block", "t"])
    of = lambda who, end, name: named.where(who).select(F.col("set_id").alias(end), F.col("n").alias(name))
    return pairs.join(of("probe", "a", "n"), "a").join(of("target", "b", "m"), "b").select("n", "m").distinct()


def contained_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(v, w): sets of words of which one has all words of the other, found by the smaller one's rarest word. left: (v), right: (w), both distinct and none empty."""
    many = left.select(F.explode("v").alias("x")).unionByName(right.select(F.explode("w").alias("x"))).groupBy("x").agg(F.count("*").alias("c"))

    def inside(small: DataFrame, large: DataFrame, s: str, t: str) -> DataFrame:
        rare = small.select(s, F.explode(s).alias("x")).join(many, "x").groupBy(s).agg(F.min(F.struct("c", "x"))["x"].alias("x"))
        wide = large.select(t, F.explode(t).alias("x")).join(rare.select("x").distinct(), "x", "left_semi")
        return rare.join(wide, "x").where(F.size(F.array_except(s, t)) == 0).select("v", "w")

    return inside(left, right, "v", "w").unionByName(inside(right, left, "w", "v")).distinct()


def _contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """(n, m): labels of which one has all words of the other."""
    split = lambda rows, c, w: rows.select(F.col(c)).distinct().withColumn(w, F.array_sort(F.array_distinct(F.split(c, " "))))
    n, m = split(left, "n", "v"), split(right, "m", "w")
    return contained_sets(n.select("v").distinct(), m.select("w").distinct()).join(n, "v").join(m, "w").select("n", "m")


def fuzzy_suggestions(labels: DataFrame, aliases: DataFrame, least: float = 0.85) -> DataFrame:
    """(label, identity_key, score): the most similar alias of each label, of equal ones the first identity's; one that has all words of the other is 0.9 alike at least.

    Nothing is lost: pairs are found by the letters they must share, see ``_alike``, and by words, and only these are scored. A blank label matches nothing.
    """
    left = labels.select("label", X.label(F.col("label")).alias("n")).distinct().where("n <> ''")
    right = aliases.select("identity_key", X.label(F.col("label")).alias("m")).distinct().where("m <> ''")
    pairs = _alike(left, right, least).withColumn("c", F.lit(0.0)).unionByName(_contained(left, right).withColumn("c", F.lit(0.9)))
    scored = pairs.groupBy("n", "m").agg(F.max("c").alias("c"))
    scored = checkpoint(scored.withColumn("score", F.greatest("c", jaro_winkler("n", "m"))).where(F.col("score") >= least))
    best = left.join(scored, "n").join(right, "m").groupBy("label", "identity_key").agg(F.max("score").alias("score"))
    order = W.partitionBy("label").orderBy(F.desc("score"), "identity_key")
    return best.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def resolved(names: DataFrame, aliases: DataFrame, identities: DataFrame) -> DataFrame:
    """(name, identity_key): by alias, else by identity name, else by the one identity with an alias whose words it has or that has its words; where a step is ambiguous, null."""
    own = names.select("name", X.label(F.col("name")).alias("_n")).distinct()

    def step(table: DataFrame, column: str, tag: str) -> DataFrame:
        known = table.select("identity_key", X.label(F.col(column)).alias("_n")).distinct()
        return known.groupBy("_n").agg(F.min("identity_key").alias(f"_{tag}"), F.count("*").alias(f"_{tag}n"))

    rows = own.join(step(aliases, "label", "a"), "_n", "left").join(step(identities, "name", "b"), "_n", "left")
    # The significant words of one, in any order, are all words of the other. Labels with the same words are one set, with the first and
    # the last identity that has it: a step is ambiguous if these differ, so no identity is counted.
    significant = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)))
    asked = own.select("_n").distinct().withColumn("v", significant(F.col("_n")))
    known = aliases.select("identity_key", significant(X.label(F.col("label"))).alias("w")).where(F.size("w") > 0)
    known = checkpoint(known.groupBy("w").agg(F.min("identity_key").alias("_c"), F.max("identity_key").alias("_d")))
    found = contained_sets(asked.select("v").where(F.size("v") > 0).distinct(), known.select("w"))
    inside = found.join(known, "w").groupBy("v").agg(F.min("_c").alias("_c"), F.max("_d").alias("_d"))
    inside = asked.join(inside, "v").select("_n", "_c", "_d")
    rows = rows.join(inside, "_n", "left")
    key = (
        F.when(F.col("_an").isNotNull(), F.when(F.col("_an") == 1, F.col("_a")))
        .when(F.col("_bn").isNotNull(), F.when(F.col("_bn") == 1, F.col("_b")))
        .otherwise(F.when(F.col("_c") == F.col("_d"), F.col("_c")))
    )
    return rows.select("name", key.alias("identity_key"))


def roster(identities: DataFrame, aliases: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """(identity_key, label): names and aliases that are no ids, of the participants only if these are given."""
    every = identities.select("identity_key", F.col("name").alias("label")).unionByName(aliases.select("identity_key", "label"))
    every = every.where((F.trim("label") != "") & ~F.col("label").rlike("^[A-Za-z0-9_-]{20,}$")).distinct()
    return every if participants is None else every.join(participants.select("identity_key").distinct(), "identity_key", "left_semi")


def in_scene(scenes: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(scene_id, identity_key): whose label, of however many words, occurs in a scene as whole words.

    Labels are looked up by their first word; where that stands in a scene, the words from there on are compared.
    """
    plain = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_]", " "), " +"), lambda w: w != "")
    labels = names.select("identity_key", plain("label").alias("l")).where(F.length(F.array_join("l", " ")) >= least).distinct()
    labels = labels.select("identity_key", "l", F.get("l", F.lit(0)).alias("w"))
    spread = scenes.select("scene_id", plain("text").alias("p")).select("scene_id", "p", F.posexplode("p").alias("i", "w"))
    firsts = labels.select("w").distinct()
    longest = labels.agg(F.max(F.size("l")).alias("k"))
    # Only as many words as the longest label has go along with a first word.
    held = spread.join(firsts, "w", "left_semi").join(F.broadcast(longest)).select("scene_id", "w", F.slice("p", F.col("i") + 1, F.col("k")).alias("s"))  # one row
    found = held.join(labels, "w").where(F.slice("s", F.lit(1), F.size("l")) == F.col("l"))
    return found.select("scene_id", "identity_key").distinct()


def routed(orphans: DataFrame, aliases: DataFrame, user_key: str, suggest: bool = True) -> DataFrame:
    """(speaker, route, identity_key, suggestion): an exact alias of one identity is routed, the user's dropped, others held, with a suggestion where nobody claims the name.

    Suggestions decide no route; without ``suggest`` none are looked for, and that column is left out.
    """
    labels = orphans.select(F.col("speaker").alias("label")).distinct()
    exact = exact_matches(labels, aliases).groupBy("label").agg(F.min("identity_key").alias("k"), F.max("claimants").alias("n"), F.max(F.col("identity_key") == user_key).alias("u"))
    rows = labels.join(exact, "label", "left")
    if suggest:
        rows = rows.join(fuzzy_suggestions(labels.join(exact, "label", "left_anti"), aliases).select("label", F.col("identity_key").alias("suggestion")), "label", "left")
    route = F.when(F.col("u"), "dropped").when(F.col("n") == 1, "routed").otherwise("held")
    return rows.select(F.col("label").alias("speaker"), route.alias("route"), F.when(route == "routed", F.col("k")).alias("identity_key"), *["suggestion"] * suggest)


def unique_slugs(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``slug``: of equal ones the first keeps it and the others get the least numbers from 2 on with which no other row's own slug ends.

    Numbers that are taken are found by parsing the slugs themselves; the free ones of each slug are dealt in order.
    """
    base = rows.withColumn("_s", X.slug(F.col(name)))
    base = base.withColumn("_j", F.row_number().over(W.partitionBy("_s").orderBy(order)) - 1)
    own = base.groupBy("_s").agg(F.max("_j").alias("_more"))
    taken = own.select(F.regexp_extract("_s", "^(.*)_([1-9][0-9]{0,8})$", 1).alias("_s"), F.regexp_extract("_s", "^(.*)_([1-9][0-9]{0,8})$", 2).cast("int").alias("_k")).where("_s <> ''")
    wanted = own.where("_more > 0").join(taken.groupBy("_s").agg(F.count("*").alias("_t")), "_s", "left")
    free = wanted.select("_s", "_more", F.explode(F.sequence(F.lit(2), (F.col("_more") + F.coalesce("_t", F.lit(0)) + 1).cast("int"))).alias("_k")).join(taken, ["_s", "_k"], "left_anti")
    free = free.withColumn("_j", F.row_number().over(W.partitionBy("_s").orderBy("_k"))).where("_j <= _more").select("_s", "_j", "_k")
    return base.join(free, ["_s", "_j"], "left").withColumn("slug", F.when(F.col("_j") == 0, F.col("_s")).otherwise(F.concat("_s", F.lit("_"), F.col("_k").cast("string")))).drop("_s", "_j", "_k")


def without_pollution(aliases: DataFrame, user_key: str) -> DataFrame:
    """Without labels that name several or that are the user's; canonical names stay."""
    users = aliases.where(F.col("identity_key") == user_key).select(X.label(F.col("label")).alias("_n"), F.lit(True).alias("_u")).distinct()
    rows = aliases.withColumn("_n", X.label(F.col("label"))).join(users, "_n", "left")
    bad = (X.is_compound(F.col("label")) | (F.coalesce("_u", F.lit(False)) & (F.col("identity_key") != user_key))) & (F.col("label") != F.col("canonical_name"))
    return rows.where(~bad).drop("_n", "_u")
