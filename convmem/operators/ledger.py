"""The life of ledger entries: tiers, archive, supersession, deletion, upsert. Ledger in, ledger out; the date is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_score(weight: int = 3) -> Column:
    return F.coalesce("retrieval_count", F.lit(0)) + weight * F.coalesce("recitation_count", F.lit(0))


def stale_days(as_of: str) -> Column:
    """Days since an entry was last retrieved or else accessed; null: never."""
    return F.datediff(F.lit(as_of).cast("date"), F.coalesce(F.to_date("last_retrieved"), F.to_date("last_accessed")))


def next_tier(ledger: DataFrame, as_of: str, long_at: int = 5, core_at: int = 25, demote_days: int = 30, cycles: int = 3, prune_days: int = 14) -> DataFrame:
    """Sets ``tier`` and ``cycle_count``; adds ``prune``, which nothing acts on. Core tiers stay; an entry without dates is endlessly stale."""
    tier, score = F.coalesce("tier", F.lit("short")), usage_score()
    stale = F.coalesce(stale_days(as_of), F.lit(1 << 30))
    n = F.coalesce("cycle_count", F.lit(0))
    demoted = (tier == "long") & (score < core_at) & (stale > demote_days)
    new = (
        F.when(tier.isin("core", "secondary_core"), tier)
        .when(score >= core_at, F.lit("core"))
        .when((tier == "short") & (score >= long_at), F.lit("long"))
        .when(demoted, F.when(n + 1 >= cycles, F.lit("secondary_core")).otherwise(F.lit("short")))
        .otherwise(tier)
    )
    prune = (tier == "short") & (score < long_at) & (stale > prune_days) & (F.coalesce("retrieval_count", F.lit(0)) > 0)
    return ledger.withColumns({"prune": prune, "cycle_count": F.when(demoted, n + 1).otherwise(n), "tier": new})


def archive_cold(ledger: DataFrame, threads: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Moves what is stale to the cold part. The members of a closed thread move together or not at all, those of an active one never.

    threads: (thread_id, thread_status). Entries of unknown threads are judged one by one. An entry that moves keeps its old tier.
    """
    moved = next_tier(ledger, as_of).withColumn("old_tier", F.lit(None).cast("string"))
    moved = moved.drop("old_tier")
    core = F.col("tier").isin("core", "secondary_core")
    stale = ~core & (F.coalesce(stale_days(as_of), F.lit(1 << 30)) > days)
    rows = moved.join(threads, "thread_id", "left").withColumn("_stale", stale)
    live = F.coalesce("status", F.lit("open")) != "done"
    unit = W.partitionBy("scope_id", "thread_id")
    all_stale = F.min(F.when(live, F.col("_stale"))).over(unit)
    known = F.col("thread_id").isNotNull() & F.col("thread_status").isNotNull()
    goes = live & F.when(known, (F.col("thread_status") == "closed") & F.coalesce(all_stale, F.lit(False))).otherwise(F.col("_stale"))
    return rows.withColumn("temp", F.when(goes, F.lit("cold")).otherwise(F.col("temp"))).drop("_stale", "thread_status")


def promote_all(ledger: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """The backfill: entries without a summary go, tiers are set, stale ones are archived one by one."""
    moved = next_tier(ledger.where(F.trim("summary") != ""), as_of)
    goes = ~F.col("tier").isin("core", "secondary_core") & (F.coalesce(stale_days(as_of), F.lit(1 << 30)) > days)
    return moved.withColumn("temp", F.when(goes, F.lit("cold")).otherwise(F.col("temp")))


def supersede(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (id, by). Those entries point to what replaced them and are cold; unknown ids change nothing."""
    pairs = pairs.groupBy("id").agg(F.min("by").alias("_by"))
    rows = ledger.join(pairs, "id", "left")
    hit = F.col("_by").isNotNull()
    return rows.withColumns({"superseded_by": F.coalesce("_by", "superseded_by"), "temp": F.when(hit, F.lit("cold")).otherwise(F.col("temp"))}).drop("_by")


def restore(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (id, flip). A superseded entry is live again; with ``flip`` its replacement is superseded by it instead. Others change nothing."""
    asked = requests.groupBy("id").agg(F.max("flip").alias("_flip"))
    rows = ledger.join(asked, "id", "left")
    back = F.col("_flip").isNotNull() & F.col("superseded_by").isNotNull()
    flips = rows.where(back & F.col("_flip")).select(F.col("superseded_by").alias("id"), F.col("id").alias("by"))
    rows = rows.withColumns({"temp": F.when(back, F.lit("hot")).otherwise(F.col("temp")), "superseded_by": F.when(~back, F.col("superseded_by"))}).drop("_flip")
    return supersede(rows, flips)


def soft_delete(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Marks entries as deleted and makes them cold."""
    rows = ledger.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return rows.withColumns({"deleted": F.col("deleted") | hit, "temp": F.when(hit, F.lit("cold")).otherwise(F.col("temp"))}).drop("_hit")


def restore_deleted(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted entries are live again; superseded ones are refused."""
    rows = ledger.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("deleted") & F.col("superseded_by").isNull()
    return rows.withColumns({"deleted": F.when(hit, F.lit(False)).otherwise(F.col("deleted")), "temp": F.when(hit, F.lit("hot")).otherwise(F.col("temp"))}).drop("_hit")


def purge(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Cold entries of these ids are gone."""
    rows = ledger.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return rows.where(~(F.coalesce("_hit", F.lit(False)) & (F.col("temp") == "cold"))).drop("_hit")


def recite(ledger: DataFrame, recited: DataFrame, as_of: str) -> DataFrame:
    """recited: (id), one row for each time. Counts go up, entries become hot, tiers are set once at the end."""
    n = recited.groupBy("id").agg(F.count("*").alias("_n"))
    rows = ledger.join(n, "id", "left")
    hit = F.col("_n").isNotNull()
    day = F.lit(as_of).cast("date")
    rows = rows.withColumns(
        {
            "recitation_count": F.coalesce("recitation_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
            "last_retrieved": F.when(hit, day).otherwise(F.to_date("last_retrieved")),
            "last_accessed": F.when(hit, day).otherwise(F.to_date("last_accessed")),
            "temp": F.when(hit, F.lit("hot")).otherwise(F.col("temp")),
        }
    )
    tiers = next_tier(rows.where(hit), as_of)
    return tiers.drop("_n", "prune").unionByName(rows.where(~hit).drop("_n"))


def stamp_retrievals(ledger: DataFrame, selected: DataFrame, as_of: str) -> DataFrame:
    """selected: (id, summoned). Loaded entries were accessed; summoned ones were retrieved once more."""
    chosen = selected.groupBy("id").agg(F.max("summoned").alias("_s"))
    rows = ledger.join(chosen, "id", "left")
    return rows.withColumns(
        {
            "last_accessed": F.when(F.col("_s").isNotNull(), F.lit(as_of).cast("date")).otherwise(F.to_date("last_accessed")),
            "retrieval_count": F.coalesce("retrieval_count", F.lit(0)) + F.coalesce(F.col("_s").cast("int"), F.lit(0)),
        }
    ).drop("_s")


def upsert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those with the same id; of several new ones the last by position counts."""
    last = new.withColumn("_rn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("entry_pos")))).where("_rn = 1").drop("_rn")
    return ledger.join(last.select("id"), "id", "left_anti").unionByName(last)


def without_chat(ledger: DataFrame, chats: DataFrame) -> DataFrame:
    """Without what was derived from these chats, but for recaps."""
    gone = chats.select(F.col("source_chat_id").alias("_c")).distinct()
    rows = ledger.join(gone, F.col("source_chat_id") == F.col("_c"), "left")
    return rows.where(F.col("_c").isNull() | F.col("id").startswith("recap-")).drop("_c")


def numbered(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(scope_id, id, seq): known ids keep their number, new ones of a scope go on from its greatest, in the order of ``entry_pos``."""
    most = existing.groupBy("scope_id").agg(F.max("seq").alias("_m"))
    fresh = new.join(existing.select("scope_id", "id"), ["scope_id", "id"], "left_anti").join(most, "scope_id", "left")
    order = F.row_number().over(W.partitionBy("scope_id").orderBy("entry_pos"))
    fresh = fresh.select("scope_id", "id", (F.coalesce("_m", F.lit(0)) + order).cast("bigint").alias("seq"))
    return existing.select("scope_id", "id", F.col("seq").cast("bigint").alias("seq")).unionByName(fresh)


def history(ledger: DataFrame) -> DataFrame:
    """(id, state, replaces): whether an entry is active, superseded or points to nothing, and which entries it replaced."""
    newer = ledger.select(F.col("id").alias("superseded_by"), F.lit(True).alias("_there"))
    older = ledger.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("replaces"))
    rows = ledger.join(newer, "superseded_by", "left").join(older, "id", "left")
    state = F.when(F.col("superseded_by").isNull(), "active").when(F.col("_there"), "superseded").otherwise("missing")
    return rows.select("id", state.alias("state"), F.coalesce("replaces", F.lit("")).alias("replaces"))


def newest_snapshots(snapshots: DataFrame, most: int = 5) -> DataFrame:
    """Rows of the newest snapshots of each scope."""
    order = F.dense_rank().over(W.partitionBy("scope_id").orderBy(F.desc("snapshot_id")))
    return snapshots.withColumn("_r", order).where(F.col("_r") <= most).drop("_r")


def validated(ledger: DataFrame, lanes: list[str], statuses: list[str], least_summary: int = 10) -> DataFrame:
    """Adds ``reasons``: why a row would be refused; none if it is fine."""
    checks = {
        "lane": ~F.col("lane").isin(lanes),
        "status": ~F.coalesce("status", F.lit("open")).isin(statuses),
        "id": F.col("id").rlike(r"[/\\]|\.\.") | (F.col("id") == ""),
        "summary": F.length(F.trim("summary")) < least_summary,
    }
    return ledger.withColumn("reasons", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])), ","))


def listed(ledger: DataFrame, lane: str | None = None, status: str | None = None) -> DataFrame:
    """Entries of a lane and status; done ones only if asked for; without a status an entry is open."""
    state = F.coalesce("status", F.lit("open"))
    rows = ledger if lane is None else ledger.where(F.col("lane") == lane)
    return rows if status == "all" else rows.where(state != "done" if status is None else state == status)


def patched(ledger: DataFrame, patches: DataFrame, as_of: str) -> DataFrame:
    """patches: (id, summary, status), null where a field stays. Tokens follow the summary."""
    p = patches.select("id", F.col("summary").alias("_s"), F.col("status").alias("_t"), F.lit(True).alias("_hit"))
    rows = ledger.join(p, "id", "left")
    rows = rows.withColumns({"summary": F.coalesce("_s", "summary"), "status": F.coalesce("_t", "status"), "last_accessed": F.when(F.col("_hit"), F.lit(as_of).cast("date")).otherwise(F.to_date("last_accessed"))})
    return rows.withColumn("tokens", F.ceil(F.length("summary") / 4).cast("bigint")).drop("_s", "_t", "_hit")


def inventory(ledger: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(scope_id, entries, bookmarks) of scopes that have either."""
    a = ledger.groupBy("scope_id").agg(F.count("*").alias("entries"))
    b = bookmarks.groupBy("scope_id").agg(F.count("*").alias("bookmarks"))
    return a.join(b, "scope_id", "full_outer").select("scope_id", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("bookmarks", F.lit(0)).alias("bookmarks"))


def decayed(bookmarks: DataFrame, turns: int, least: float = 0.1) -> DataFrame:
    """Bookmarks after so many turns; those whose weight has fallen too low are gone."""
    weight = F.col("weight") * F.pow("decay_rate", F.lit(turns))
    return bookmarks.withColumn("weight", weight).where(F.col("weight").isNotNull() & (F.col("weight") >= least))


def dormant(arcs: DataFrame, as_of: str, days: int = 21) -> DataFrame:
    """Active arcs that nothing was added to for so long are dormant."""
    idle = F.datediff(F.lit(as_of).cast("date"), F.to_date("last_promoted")) > days
    return arcs.withColumn("status", F.when((F.col("status") == "active") & idle, F.lit("dormant")).otherwise(F.col("status")))


def close_idle(threads: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Active threads that were idle for so long are closed; labels lose underscores and are cut."""
    idle = F.datediff(F.lit(as_of).cast("date"), F.coalesce(F.to_date("last_active"), F.to_date("created"))) > days
    text = F.substring(F.trim(F.regexp_replace(F.replace(F.col("label"), F.lit("_"), F.lit(" ")), r"\s+", " ")), 1, 80)
    return threads.withColumns({"status": F.when((F.col("status") == "active") & idle, F.lit("closed")).otherwise(F.col("status")), "label": text})
