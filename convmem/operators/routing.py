"""Where things belong and what goes with them: routing, pairing, presence, pools, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convmem.functions import text as X


def fact_targets(facts: DataFrame, resolved: DataFrame, own: list[str]) -> DataFrame:
    """Adds ``target`` and ``scope``: the user's words go to the own ledger, a known name's to its identity's, others to the chat with the name before the fact."""
    rows = facts.join(resolved.select(F.col("name").alias("subject"), "identity_key"), "subject", "left")
    mine = F.col("subject").isNull() | F.lower("subject").isin(own)
    known = F.col("identity_key").isNotNull()
    return rows.withColumns(
        {
            "scope": F.when(mine | known, "character").otherwise("chat"),
            "target": F.when(mine, F.lit("self")).when(known, F.col("identity_key")),
            "fact": F.when(mine | known, F.col("fact")).otherwise(F.concat(F.lit("[about: "), "subject", F.lit("] "), "fact")),
        }
    ).drop("identity_key")


def facts_for_ledgers(facts: DataFrame, resolved: DataFrame, own: list[str], most: int = 600) -> DataFrame:
    """Facts that passes agree on, as rows that can be taken into ledgers: each in its target's scope, those about a character as traits.

    facts: (scope_id, leader, lane, fact, subject). The content is the fact itself, cut at a sentence; arrival goes by scope and leader.
    """
    rows = fact_targets(facts, resolved, own)
    scope = F.when(F.col("target") == "self", F.concat(F.lit("self/"), "scope_id")).when(F.col("target").isNotNull(), F.concat(F.lit("character/"), "target")).otherwise(F.concat(F.lit("chat/"), "scope_id"))
    return rows.select(
        scope.alias("scope_id"), "lane", F.when(F.col("lane") == "character_topics", "trait").alias("kind"), F.concat("scope_id", F.lit("-"), F.col("leader").cast("string")).alias("id"), F.col("leader").cast("bigint").alias("pos"),
        F.col("fact").alias("summary"), X.cut_at_sentence(F.col("fact"), most).alias("content"), F.col("scope_id").alias("source_chat_id"), F.lit(None).cast("bigint").alias("turn_start"),
    )


def companions(beats: DataFrame, ledger: DataFrame, most: int = 100) -> DataFrame:
    """(beat_id, id): the one character topic whose summary begins as the beat's; none if there are several."""
    start = lambda c: F.substring(F.lower(F.regexp_replace(c, r"\s+", " ")), 1, most)
    rows = ledger.where("lane = 'character_topics'").groupBy("scope_id", start(F.col("summary")).alias("k")).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    return beats.select("beat_id", "scope_id", start(F.col("summary")).alias("k")).join(rows, ["scope_id", "k"]).select("beat_id", "id")


def companion_rows(beats: DataFrame) -> DataFrame:
    """The ledger row that goes with a beat: its emotion and what moved it."""
    emotion = F.coalesce(F.get("emotions", 0)["emotion"], F.col("emotion"))
    content = F.concat_ws("\n", F.concat(F.lit("Emotion: "), emotion), F.concat(F.lit("Why: "), "motivation"), F.concat(F.lit("Outcome: "), "outcome"), "text")
    return beats.select("beat_id", F.substring(F.concat(F.lit("["), emotion, F.lit("] "), "motivation"), 1, 140).alias("summary"), F.substring(content, 1, 700).alias("content"))


def recap_audit(recaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(recap_id, verdict): whether a stored recap says what its scene's summary says."""
    rows = recaps.join(pairs.select("recap_id", "expected"), "recap_id", "left")
    same = F.trim(X.without_lead(F.col("content"))) == F.trim(X.without_lead(F.col("expected")))
    return rows.select("recap_id", F.when(F.col("expected").isNull(), "unresolved").when(same, "ok").otherwise("mismatch").alias("verdict"))


def orphan_speakers(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks whose speaker matches no given name, equal or one within the other. Only distinct speakers meet the names."""
    who = chunks.select("speaker").distinct()
    known = names.select(F.lower("name").alias("_n")).distinct()
    hit = who.join(known, F.contains(F.lower("speaker"), F.col("_n")) | F.contains(F.col("_n"), F.lower("speaker")), "left_semi")
    return chunks.join(hit, "speaker", "left_anti")


def chats_of(chats: DataFrame, character: Column, current: Column) -> DataFrame:
    """Chats whose primary or participants include a character, but for the current one. chats: (chat_id, primary_id, participants)."""
    return chats.where((F.array_contains(F.array_union(F.array("primary_id"), "participants"), character)) & (F.col("chat_id") != current))


def presence(beats: DataFrame, names: DataFrame) -> DataFrame:
    """(beat_id, identity_key): whose one-word name a beat's text has, by its words."""
    spread = beats.select("beat_id", F.explode(X.bag(F.col("text"))).alias("w"))
    return spread.join(names.select("identity_key", F.lower("name").alias("w")).distinct(), "w").select("beat_id", "identity_key").distinct()


def shared_presence(found: DataFrame, least: int = 2, hot: int = 1000) -> DataFrame:
    """(a, b, shared): beats that have at least so many people in common. Found by pairs of people, each pair's beats forming a star."""
    pairs = found.groupBy("beat_id").agg(F.array_sort(F.collect_set("identity_key")).alias("k")).where(F.size("k") >= least)
    keys = pairs.select("beat_id", F.explode("k").alias("p"), "k").select("beat_id", "p", F.explode("k").alias("q")).where("p < q")
    star = keys.groupBy("p", "q").agg(F.min("beat_id").alias("a"))
    return keys.join(star, ["p", "q"]).where("a <> beat_id").select("a", F.col("beat_id").alias("b")).distinct()


def pending_speakers(pending: DataFrame) -> DataFrame:
    """(speaker_norm, held, label, suggestion): held beats by speaker, with the last spelling and the best suggestion, of equally good ones the first."""
    return pending.groupBy("speaker_norm").agg(F.count("*").alias("held"), F.max_by("speaker", "seq").alias("label"), F.max_by("suggestion", F.struct("score", -F.col("seq"))).alias("suggestion"))


def add_pending(pending: DataFrame, new: DataFrame) -> DataFrame:
    """With new beats that are not yet held under their speaker."""
    key = ["speaker_norm", "beat_id"]
    first = new.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy("seq"))).where("_rn = 1").drop("_rn")
    return pending.unionByName(first.join(pending.select(*key), key, "left_anti"))


def expired(ignored: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Ignored beats that are still kept."""
    return ignored.where(F.datediff(F.lit(as_of).cast("date"), F.to_date("ignored_at")) <= days)


def renamed(ledger: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scopes under their new keys. mapping: (old, new)."""
    rows = ledger.join(mapping.select(F.col("old").alias("scope_id"), "new"), "scope_id", "left")
    return rows.withColumn("scope_id", F.coalesce("new", "scope_id")).drop("new")


def added_aliases(aliases: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """With new labels; those that another identity has are refused unless forced."""
    norm = lambda df: df.withColumn("_n", X.label(F.col("label")))
    have = norm(aliases)
    fresh = norm(new).join(have.select("identity_key", "_n").distinct(), ["identity_key", "_n"], "left_anti")
    if not force:
        taken = have.select("_n", F.col("identity_key").alias("_k")).distinct()
        fresh = fresh.join(taken, (fresh["_n"] == taken["_n"]) & (fresh["identity_key"] != taken["_k"]), "left_anti")
    return aliases.unionByName(fresh.select(aliases.columns))


def recap_activation(recaps: DataFrame, queries: DataFrame, least: float = 0.5, most: int = 3) -> DataFrame:
    """(scope_id, recap_id, rank): the recaps nearest to a scope's query vector."""
    both = recaps.join(queries.select("scope_id", F.col("vector").alias("_q")), "scope_id").withColumn("_c", F.round(X.cosine(F.col("vector"), F.col("_q")), 9)).where(F.col("_c") >= least)
    order = W.partitionBy("scope_id").orderBy(F.desc("_c"), "recap_id")
    return both.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most).select("scope_id", "recap_id", "rank")


def surfaced_bookmarks(bookmarks: DataFrame, turn: Column, seed: int = 1) -> DataFrame:
    """Bookmarks whose weight beats a draw made of their id and the turn: the same at every run and on any partitioning."""
    draw = F.pmod(F.xxhash64("id", turn, F.lit(seed)), F.lit(1_000_000)) / 1e6
    return bookmarks.where(draw < F.col("weight"))


def bundles(ledger: DataFrame, identities: DataFrame) -> DataFrame:
    """(identity_key, bundle): an identity's entries as one portable JSON text, in order."""
    entries = ledger.groupBy("scope_id").agg(F.sort_array(F.collect_list(F.struct("entry_pos", "id", "summary", "lane", "status", "content"))).alias("entries"))
    rows = identities.join(entries, identities.identity_key == entries.scope_id, "left")
    return rows.select("identity_key", F.to_json(F.struct(F.lit(1).alias("version"), F.col("identity_key").alias("key"), "name", F.coalesce("entries", F.array()).alias("entries"))).alias("bundle"))


def imported(bundle_rows: DataFrame) -> DataFrame:
    """(scope_id, entry_pos, id, summary, lane, status, content) from bundles of version 1; use counters start anew."""
    kind = "version int, key string, name string, entries array<struct<entry_pos:bigint,id:string,summary:string,lane:string,status:string,content:string>>"
    rows = bundle_rows.select(F.from_json("bundle", kind).alias("b")).where("b.version = 1")
    return rows.select(F.col("b.key").alias("scope_id"), F.explode("b.entries").alias("e")).select("scope_id", "e.*")


def rebuilt(index: DataFrame, bodies: DataFrame) -> DataFrame:
    """Index rows made anew for scopes with more bodies than rows; counters of known rows stay. bodies: (scope_id, id, summary)."""
    bodies = bodies.where("id is not null and id <> ''")
    a = index.groupBy("scope_id").agg(F.count("*").alias("_a"))
    b = bodies.groupBy("scope_id").agg(F.count("*").alias("_b"))
    broken = b.join(a, "scope_id", "left").where(F.coalesce("_a", F.lit(0)) < F.col("_b")).select("scope_id")
    old = index.select("scope_id", "id", F.col("retrieval_count").alias("_n"))
    made = bodies.join(broken, "scope_id", "left_semi").join(old, ["scope_id", "id"], "left").select("scope_id", "id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("retrieval_count"))
    return index.join(broken, "scope_id", "left_anti").select("scope_id", "id", F.col("retrieval_count").cast("bigint").alias("retrieval_count")).unionByName(made)


def clock_signals(text: Column, phrases: dict[str, list[str]]) -> Column:
    """The first of the listed signals with a phrase in the text."""
    out = F.lit(None).cast("string")
    for name, words in reversed(list(phrases.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def is_cast_list(label: Column, names: Column) -> Column:
    """Whether every word of a label, but for joining ones, is a name."""
    parts = F.array_except(F.filter(F.split(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1), X.words(["and", "with", "the", "of", "vs"]))
    return (F.size(parts) > 0) & (F.size(F.array_except(parts, names)) == 0)
