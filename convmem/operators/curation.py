"""Consensus, votes, verdicts, merges, queues; arcs and recaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import similarity as S
from convmem.operators.graph import checkpoint


def _agreed(rows: DataFrame, keys: list[str], passes: int) -> DataFrame:
    """(keys, fact, subject, seen) of the groups that most of the passes have. rows: keys and pass, pos, fact, subject."""
    rows = rows.withColumn("_s", F.coalesce("subject", F.lit("?")))
    per_subject = rows.groupBy(*keys, "_s").agg(F.count("*").alias("c"), F.min(F.struct("pass", "pos")).alias("first"), F.min(F.struct((-F.length("fact")).alias("l"), "pass", "pos", "fact", "lane")).alias("rep"))
    best = per_subject.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "_s", "rep")).alias("b"))
    seen = rows.groupBy(*keys).agg(F.countDistinct("pass").alias("seen")).where(F.col("seen") >= passes // 2 + 1)
    return best.join(seen, keys).select(*[k for k in keys if k != "lane"], F.col("b.rep.lane").alias("lane"), F.col("b.rep.fact").alias("fact"), F.col("b._s").alias("subject"), "seen")


def consensus_facts(facts: DataFrame, passes: int) -> DataFrame:
    """(lane, fact, subject, seen) of facts found in most of the passes, by their normalised text.

    facts: (pass, pos, fact, lane, subject). The subject is the one most often given, of equals the
    first seen; the fact is the longest phrasing that has it.
    """
    return _agreed(facts.withColumn("_n", X.label(F.col("fact"))), ["lane", "_n"], passes).select("lane", "fact", "subject", "seen")


def leaders(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(id, leader): taken in order, a row joins the most similar earlier leader it is near to, of equals the last; near to none, it is a leader.

    rows: (id); near: (a, b, cosine) with a before b. Leaders are found in rounds, then every other row takes its best one.
    """
    first = checkpoint(independent_first(rows.select("id"), near))
    best = near.join(first.select(F.col("id").alias("a")), "a").join(first.select(F.col("id").alias("b")), "b", "left_anti").groupBy(F.col("b").alias("id")).agg(F.max(F.struct("cosine", "a"))["a"].alias("leader"))
    return first.select("id", F.col("id").alias("leader")).unionByName(best)


def consensus_by_meaning(facts: DataFrame, passes: int, least: float = 0.85, texts: DataFrame | None = None) -> DataFrame:
    """(scope_id, leader, lane, fact, subject, seen): as ``consensus_facts``, of facts that mean the same by their vectors.

    facts: (scope_id, id: bigint in the order of passes and places, pass, pos, fact, lane, subject, vector). A fact without a vector stands for itself.
    Where texts lie in a table of their own, ``texts``: (id, fact), facts have their length (``chars``) in place of ``fact``, and only the texts that are returned are looked up.
    """
    near = checkpoint(S.vector_pairs(facts.where("vector is not null"), "scope_id", "id", "vector", least).select("a", "b", "cosine"))
    if texts is None:
        facts, texts = facts.withColumn("chars", F.length("fact")), facts.select("id", "fact")
    rows = facts.join(leaders(facts, near), "id").withColumn("_s", F.coalesce("subject", F.lit("?")))
    keys = ["scope_id", "leader"]
    per_subject = rows.groupBy(*keys, "_s").agg(F.count("*").alias("c"), F.min(F.struct("pass", "pos")).alias("first"), F.min(F.struct((-F.col("chars")).alias("l"), "pass", "pos", "id", "lane")).alias("rep"))
    best = per_subject.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "_s", "rep")).alias("b"))
    seen = rows.groupBy(*keys).agg(F.countDistinct("pass").alias("seen")).where(F.col("seen") >= passes // 2 + 1)
    agreed = checkpoint(best.join(seen, keys).select(*keys, F.col("b.rep.id").alias("id"), F.col("b.rep.lane").alias("lane"), F.col("b._s").alias("subject"), "seen"))
    return agreed.join(texts, "id").select(*keys, "lane", "fact", "subject", "seen")


def kept_by_vote(items: DataFrame, votes: DataFrame) -> DataFrame:
    """Items that most of the passes that answered want to keep; all if none answered. votes: (task, pass, keep array, null if no answer)."""
    answered = votes.where("keep is not null")
    passes = answered.groupBy("task").agg(F.countDistinct("pass").alias("_p"))
    said = answered.select("task", F.explode("keep").alias("idx")).groupBy("task", "idx").agg(F.count("*").alias("_v"))
    rows = items.join(passes, "task", "left").join(said, ["task", "idx"], "left")
    return rows.where(F.col("_p").isNull() | (F.coalesce("_v", F.lit(0)) * 2 > F.col("_p"))).drop("_p", "_v")


def proposals(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(cluster, verdict, canonical_id, redundant_ids): verdicts held to their cluster's members; without a canonical or a redundant id they are distinct."""
    own = members.groupBy("cluster").agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    rows = own.join(verdicts, "cluster", "left")
    canonical = F.when(F.array_contains("_ids", F.col("canonical_id")), F.col("canonical_id"))
    redundant = F.array_sort(F.array_except(F.array_intersect("_ids", "redundant_ids"), F.array(canonical)))
    ok = (F.col("verdict") == "merge") & canonical.isNotNull() & (F.size(redundant) > 0)
    return rows.select("cluster", F.when(ok, "merge").otherwise("distinct").alias("verdict"), F.when(ok, canonical).alias("canonical_id"), F.when(ok, redundant).otherwise(F.array().cast("array<string>")).alias("redundant_ids"))


def coalesced(pending: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks of which no like one is pending; of several like ones the first."""
    key = ["scope_id", "against_id", "summary"]
    order = F.row_number().over(W.partitionBy(*key).orderBy("id"))
    first = tasks.withColumn("_rn", order).where("_rn = 1").drop("_rn")
    return first.join(pending.select(*key).distinct(), key, "left_anti")


def applied_verdicts(tasks: DataFrame, decisions: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(created, pairs to supersede, notes). Duplicates do nothing; updates and negations create and supersede; the rest only create."""
    rows = tasks.join(decisions, "task_id")
    made = rows.where(F.col("verdict") != "DUPLICATE").select(F.concat(F.lit("new-"), "task_id").alias("id"), "scope_id", "summary")
    known = ledger.select(F.col("id").alias("target_id"), F.lit(True).alias("_k"))
    targets = rows.where(F.col("verdict").isin("UPDATE", "NEGATE")).join(known, "target_id", "left")
    pairs = targets.where("_k").select(F.col("target_id").alias("id"), F.concat(F.lit("new-"), "task_id").alias("by"))
    notes = targets.where("_k is null").select("task_id", F.lit("target is missing").alias("note"))
    return made, pairs, notes


def drained(queue: DataFrame, decisions: DataFrame, most: int, shadow: bool) -> tuple[DataFrame, DataFrame]:
    """(handled with verdict and outcome, remaining): the oldest ``most`` tasks of each scope."""
    numbered = queue.withColumn("_rn", F.row_number().over(W.partitionBy("scope_id").orderBy("task_id")))
    now = numbered.where(F.col("_rn") <= most).drop("_rn").join(decisions.select("task_id", "verdict", "action"), "task_id", "left")
    outcome = F.when(F.col("verdict").isNull(), "failed").when(F.lit(shadow), "audit").when(F.col("action") == "hold", "held").otherwise("applied")
    return now.withColumn("outcome", outcome), numbered.where(F.col("_rn") > most).drop("_rn")


def independent_first(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Items kept when taken in order, each unless an earlier kept one conflicts with it. items: (id); conflicts: (a, b) with a before b.

    In rounds: whoever has no undecided earlier neighbour stays, and its later neighbours go. The
    number of rounds is that of the longest chain of dependencies, short in practice.
    """
    edges = checkpoint(conflicts.select("a", "b").distinct())
    gone = items.select("id").limit(0)
    while not edges.isEmpty():
        blocked = edges.select(F.col("b").alias("id")).distinct()
        free = checkpoint(edges.select(F.col("a").alias("id")).distinct().join(blocked, "id", "left_anti"))
        out = checkpoint(edges.join(free.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        gone = checkpoint(gone.unionByName(out))
        done = free.unionByName(out)
        edges = checkpoint(edges.join(done.select(F.col("id").alias("a")), "a", "left_anti").join(out.select(F.col("id").alias("b")), "b", "left_anti"))
    return items.join(gone, "id", "left_anti")


def cleanup(ledger: DataFrame, transient: str) -> DataFrame:
    """(id, action): entries without a summary are deleted; transient ones of little use are done. Duplicates: see ``independent_first``.

    The pattern is matched against the summary in lower case, letter by letter: a capital I with a dot is an i, no letter and a mark.
    """
    score = F.coalesce("retrieval_count", F.lit(0)) + 3 * F.coalesce("recitation_count", F.lit(0))
    ghost = F.trim("summary") == ""
    fleeting = F.lower(F.replace("summary", F.lit("\u0130"), F.lit("i"))).rlike(transient) & (score <= 5) & ~F.coalesce("tier", F.lit("short")).isin("core", "secondary_core")
    return ledger.select("id", F.when(ghost, "deleted").when(fleeting, "done").otherwise("kept").alias("action"))


def dormancy_gaps(members: DataFrame, days: int = 14) -> DataFrame:
    """(arc_id, gap_start, gap_end): pauses of more than so many days between an arc's beats. members: (arc_id, day, seq)."""
    order = W.partitionBy("arc_id").orderBy("day", "seq")
    rows = members.withColumn("gap_start", F.lag("day").over(order))
    return rows.where(F.datediff("day", "gap_start") > days).select("arc_id", "gap_start", F.col("day").alias("gap_end"))


def top_by(rows: DataFrame, group: str, most: int, *order) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def scene_members(beats: DataFrame, threads: DataFrame) -> DataFrame:
    """(scene_id, beat_id): beats of the scene, or of a thread that is active in it. By two equal joins."""
    own = beats.select(F.col("source_chat_id").alias("scene_id"), "beat_id").where("scene_id is not null")
    by_thread = beats.select("thread_id", "beat_id").join(threads.where("status = 'active'").select("thread_id", F.col("chat_id").alias("scene_id")), "thread_id").select("scene_id", "beat_id")
    return own.unionByName(by_thread).distinct()


def footnotes(recaps: DataFrame, beats: DataFrame) -> DataFrame:
    """(recap_id, lines): a recap's beats in the order of its footnotes; missing ones are skipped."""
    spread = recaps.select("recap_id", F.posexplode("footnote_ids").alias("pos", "beat_id"))
    found = spread.join(beats.select("beat_id", "line"), "beat_id")
    return found.groupBy("recap_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def recitations(surfaced: DataFrame, responses: DataFrame, least: float = 0.3) -> DataFrame:
    """(conv_id, turn, id): entries that surfaced the turn before and whose words the response has. surfaced: (conv_id, turn, id, summary)."""
    before = surfaced.select("conv_id", (F.col("turn") + 1).alias("turn"), "id", X.topic_words(F.col("summary")).alias("_w"))
    both = before.join(responses.select("conv_id", "turn", X.bag(F.col("text")).alias("_t")), ["conv_id", "turn"])
    return both.where(X.containment(F.col("_w"), F.col("_t")) >= least).select("conv_id", "turn", "id")


def tallies(audit: DataFrame) -> DataFrame:
    """(dimension, value, n) by mode, by verdict and by confidence, in one pass."""
    sets = audit.groupingSets([["mode"], ["verdict"], ["confidence"]], "mode", "verdict", "confidence").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "mode").when(F.col("g") == 5, "verdict").otherwise("confidence")
    return sets.select(dimension.alias("dimension"), F.coalesce("mode", "verdict", "confidence").alias("value"), "n")


def thread_health(threads: DataFrame) -> DataFrame:
    """(chat_id, threads, active, single): counts of a chat's threads, and how many have one beat."""
    return threads.groupBy("chat_id").agg(F.count("*").alias("threads"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("beats") == 1).alias("single"))


def ignored_groups(ignored: DataFrame) -> DataFrame:
    """(label, held, ignored_at): ignored beats by their speaker. ignored: (speaker, ignored_at)."""
    return ignored.groupBy(F.col("speaker").alias("label")).agg(F.count("*").alias("held"), F.max("ignored_at").alias("ignored_at"))


def scene_participants(scenes: DataFrame, identities: DataFrame) -> DataFrame:
    """(scene_id, identity_key, first): characters of a scene, in order, that are known. scenes: (scene_id, characters: array, senders first)."""
    spread = scenes.select("scene_id", F.posexplode("characters").alias("pos", "identity_key")).join(identities.select("identity_key").distinct(), "identity_key")
    once = spread.groupBy("scene_id", "identity_key").agg(F.min("pos").alias("pos"))
    return once.select("scene_id", "identity_key", (F.row_number().over(W.partitionBy("scene_id").orderBy("pos")) == 1).alias("first"))


def orphaned(beats: DataFrame, pending: DataFrame, gone: DataFrame) -> DataFrame:
    """(speaker_norm, beat_id): what is held once these identities are gone: what was held, and their beats under their speakers."""
    back = beats.join(gone, "identity_key", "left_semi").select(X.label(F.col("speaker")).alias("speaker_norm"), "beat_id")
    return pending.select("speaker_norm", "beat_id").unionByName(back).distinct()
