"""Which entries come to mind: relevance, ranking, budgets, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators.graph import checkpoint
from convmem.operators.ledger import usage_score

LANES = ("open_threads", "user_topics", "character_topics")


def live(ledger: DataFrame) -> DataFrame:
    """Neither done nor superseded."""
    return ledger.where((F.coalesce("status", F.lit("open")) != "done") & F.col("superseded_by").isNull())


def relevance(ledger: DataFrame, talk: DataFrame, words_per_piece: int = 4096) -> DataFrame:
    """Adds ``relevance``: the share of a summary's topic words in the scope's recent talk. talk: (scope_id, talk), any number of rows.

    A scope's words come in pieces of bounded size, and an entry's words are sent once, as one set.
    Entries have an id of their own in a scope.
    """
    said = checkpoint(talk.select("scope_id", F.explode(X.bag(F.col("talk"))).alias("_w")).distinct())
    parts = said.groupBy("scope_id").agg(F.ceil(F.count("*") / words_per_piece).alias("_k"))
    pieces = said.join(parts, "scope_id").groupBy("scope_id", F.pmod(F.xxhash64("_w"), F.col("_k")).alias("_i")).agg(F.collect_list("_w").alias("_p")).drop("_i")
    topics = ledger.select("scope_id", "id", X.topic_words(F.col("summary")).alias("_t"))
    hits = topics.join(pieces, "scope_id").select("scope_id", "id", F.size("_t").alias("_n"), F.size(F.array_intersect("_t", "_p")).alias("_h")).where("_h > 0")
    shares = hits.groupBy("scope_id", "id").agg((F.sum("_h") / F.max("_n")).alias("_r"))
    return ledger.join(shares, ["scope_id", "id"], "left").withColumn("relevance", F.coalesce("_r", F.lit(0.0))).drop("_r")


def lifted(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """An entry of a thread is at least so far as relevant as the thread's best."""
    best = F.max(F.when(F.col("thread_id").isNotNull(), F.col("relevance"))).over(W.partitionBy("scope_id", "thread_id"))
    return rows.withColumn("relevance", F.greatest("relevance", F.when(F.col("thread_id").isNotNull(), share * best)))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: by relevance, recency, usage, lane and position."""
    lane = F.lit(len(LANES))
    for i, name in enumerate(LANES):
        lane = F.when(F.col("lane") == name, i).otherwise(lane)
    recent = F.coalesce(F.to_date("last_retrieved"), F.to_date("last_accessed"))
    order = W.partitionBy("scope_id").orderBy(F.desc("relevance"), F.desc_nulls_last(recent), F.desc(usage_score()), lane, "entry_pos")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint"))


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """The entries that fit when taken by rank, skipping what is too large: adds ``summoned``.

    What is left only shrinks, so of a scope's entries of one size those taken are its first, and
    no more than fit by themselves. The fold sees only these: some (budget * log budget) ranks,
    ids and sizes of a scope, however many entries it has. Entries of no tokens always fit.
    """
    per_size = F.row_number().over(W.partitionBy("scope_id", "tokens").orderBy("rank"))
    small = rows.where(F.col("tokens").between(1, budget)).select("scope_id", "rank", "id", "tokens", per_size.alias("_n"))
    small = small.where((F.col("_n") <= budget) & (F.col("_n") * F.col("tokens") <= budget))
    state = "struct<left:bigint,ids:array<string>>"

    def step(a, e):
        return F.when(e["tokens"] <= a["left"], F.struct((a["left"] - e["tokens"]).alias("left"), F.concat(a["ids"], F.array(e["id"])).alias("ids"))).otherwise(a)

    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<string>").alias("ids")).cast(state)
    taken = small.groupBy("scope_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.col("tokens").cast("bigint").alias("tokens")))).alias("e"))
    taken = taken.select("scope_id", F.explode(F.aggregate("e", start, step)["ids"]).alias("id"))
    taken = taken.unionByName(rows.where("tokens <= 0").select("scope_id", "id"))
    return rows.join(taken, ["scope_id", "id"], "left_semi").withColumn("summoned", F.col("relevance") > 0.1)


def cold_recall(hot: DataFrame, cold: DataFrame, miss: float = 0.1) -> DataFrame:
    """The best cold entry of each scope whose hot entries all miss. Both have ``relevance``."""
    scopes = hot.groupBy("scope_id").agg(F.max("relevance").alias("_best")).where(F.col("_best") < miss).select("scope_id")
    rows = live(cold).where(~F.col("deleted") & (F.col("relevance") > miss)).join(scopes, "scope_id", "left_semi")
    order = W.partitionBy("scope_id").orderBy(F.desc("relevance"), "entry_pos")
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def view(tasks: DataFrame, ledger: DataFrame, most: int = 50) -> DataFrame:
    """(task_id, id, rank, total): the focus first, then what is most like it. tasks: (task_id, scope_id, focus_id, summary)."""
    rows = ledger.where("superseded_by is null").select("scope_id", "id", "entry_pos", X.bag(F.col("summary")).alias("_b"))
    both = tasks.select("task_id", "scope_id", "focus_id", X.bag(F.col("summary")).alias("_a")).join(rows, "scope_id")
    both = both.withColumn("_s", F.round(X.jaccard(F.col("_a"), F.col("_b")), 9)).drop("_a", "_b")
    order = W.partitionBy("task_id").orderBy(F.desc(F.col("id") == F.col("focus_id")), F.desc("_s"), "entry_pos")
    counted = both.withColumns({"rank": F.row_number().over(order).cast("bigint"), "total": F.count("*").over(W.partitionBy("task_id"))})
    return counted.where(F.col("rank") <= most).select("task_id", "id", "rank", "total")


def block(rows: DataFrame, heads: dict[str, str]) -> DataFrame:
    """(scope_id, block): the chosen entries as text, lane by lane in a fixed order, each with its state unless open."""
    order = F.lit(len(heads))
    head = F.lit("")
    for i, (lane, title) in enumerate(heads.items()):
        order = F.when(F.col("lane") == lane, i).otherwise(order)
        head = F.when(F.col("lane") == lane, F.lit(title)).otherwise(head)
    state = F.when(F.coalesce("status", F.lit("open")) != "open", F.concat(F.lit(" ["), F.col("status"), F.lit("]"))).otherwise(F.lit(""))
    lines = rows.select("scope_id", order.alias("o"), head.alias("h"), "rank", F.concat(F.lit("- "), F.col("summary"), state).alias("line"))
    parts = lines.groupBy("scope_id", "o", "h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))
    parts = parts.select("scope_id", F.struct("o", F.concat_ws("\n", "h", "body").alias("p")).alias("p"))
    return parts.groupBy("scope_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["p"]), "\n\n").alias("block"))
