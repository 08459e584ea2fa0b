"""Through-lines: beats that belong together, and arcs that go on from pass to pass.

An arc pass takes beats of weight that no arc has yet, clusters them by three relations in one
graph, matches clusters to arcs before new ones are made, and keeps the members that a rendering
keeps. Arcs are a table, so the next pass goes on from it; a pass with nothing new changes nothing.

Unlike a loop, clusters of one pass are matched to the arcs as they were before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convmem.operators import commands as C
from convmem.operators import composites as M
from convmem.operators import similarity as S
from convmem.operators.graph import checkpoint, components

ARC = "scope_id string, arc_id string, pos bigint, status string, label string, threads array<string>, entities array<string>, centroid array<double>, covered_through bigint, version bigint, promoted_at date"
MEMBER = "scope_id string, arc_id string, beat_id string, role string, salience double"


def beat_edges(beats: DataFrame, least: float = 0.62) -> DataFrame:
    """(a, b): pairs that connect beats of a scope as three relations do.

    The same thread, and two entities in common, are stars around the first beat that has the
    thread, or the pair of entities; close vectors are pairs. beats: (scope_id, n: bigint, thread_id, entities, vector).
    """
    star = lambda rows: rows.withColumn("a", F.min("n").over(W.partitionBy("scope_id", "k"))).where("a <> n").select("a", F.col("n").alias("b"))
    threads = beats.where("thread_id is not null and thread_id <> ''").select("scope_id", "n", F.col("thread_id").alias("k"))
    named = beats.select("scope_id", "n", F.array_sort(F.array_distinct("entities")).alias("e")).where(F.size("e") > 1)
    one = named.select("scope_id", "n", "e", F.posexplode("e").alias("i", "x"))
    pairs = one.select("scope_id", "n", "x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y")).select("scope_id", "n", F.struct("x", "y").alias("k"))
    close = S.vector_pairs(beats.where("vector is not null"), "scope_id", "n", "vector", least).select("a", "b")
    return star(threads).unionByName(star(pairs)).unionByName(close).distinct()


def beat_clusters(beats: DataFrame, least: float = 0.62, size: int = 3) -> DataFrame:
    """(scope_id, cluster, beat_id): beats that hang together, from ``size`` of them on; a cluster is called by its first beat's ``n``."""
    roots = components(beat_edges(beats, least))
    rows = beats.select("scope_id", "n", "beat_id").join(roots, F.col("n") == F.col("node")).select("scope_id", F.col("component").alias("cluster"), "beat_id")
    return rows.withColumn("_s", F.count("*").over(W.partitionBy("scope_id", "cluster"))).where(F.col("_s") >= size).drop("_s")


def _mean(vector: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(vector)), lambda x: x["m"])


def _signatures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Threads, entities and mean vector of each group. rows: keys, thread_id, entities, vector."""
    sets = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("thread_id")).alias("threads"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))).alias("entities"), F.max("seq").alias("last_seq"), F.count("*").alias("n_beats"))
    spread = rows.where("vector is not null").select(*keys, F.posexplode("vector").alias("p", "x")).groupBy(*keys, "p").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("c"))
    means = spread.groupBy(*keys).agg(_mean(F.struct("p", F.struct("s", "c").alias("m"))).alias("sums"))
    return sets.join(means, keys, "left")


def promoted(beats: DataFrame, arcs: DataFrame, members: DataFrame, renderings: DataFrame, at: str, salient: float = 0.55, newest: int = 80, least: float = 0.62, size: int = 3, dormant_days: int = 45, most_notes: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs, members, recaps) after a pass.

    beats: (scope_id, beat_id, n: bigint, seq, salience, thread_id, entities, vector, created); arcs and members as ``ARC`` and ``MEMBER``;
    renderings: (scope_id, beat_id, keep, role, label, lead, body), where label, lead and body of a cluster are its first kept beat's.
    A new arc needs ``size`` kept members. An arc is called by its first member, so a pass that is run again makes the same.
    """
    bound = members.select("scope_id", "beat_id").distinct()
    free = beats.where(F.col("salience") >= salient).join(bound, ["scope_id", "beat_id"], "left_anti")
    free = checkpoint(free.withColumn("_r", F.row_number().over(W.partitionBy("scope_id").orderBy(F.desc("seq"), "n"))).where(F.col("_r") <= newest).drop("_r"))
    grouped = checkpoint(free.join(beat_clusters(free, least, size), ["scope_id", "beat_id"]))
    signed = _signatures(grouped, ["scope_id", "cluster"])
    centroid = F.transform(F.coalesce("sums", F.array()), lambda m: m["s"] / m["c"])
    matched = checkpoint(M.matched_arcs(signed.select("scope_id", "cluster", "threads", "entities", centroid.alias("centroid")), arcs))

    said = grouped.join(renderings, ["scope_id", "beat_id"]).where("keep").join(matched, ["scope_id", "cluster"])
    heads = said.groupBy("scope_id", "cluster").agg(F.count("*").alias("kept"), F.min(F.struct("n", "beat_id", "label", "lead", "body")).alias("h"), F.max("seq").alias("through"))
    good = heads.join(matched, ["scope_id", "cluster"]).where((F.col("kept") >= size) | F.col("arc_id").isNotNull())
    named = good.withColumns({"is_new": F.col("arc_id").isNull(), "arc_id": F.coalesce("arc_id", F.concat(F.lit("arc-"), F.substring(F.sha1(F.concat_ws("/", "scope_id", "h.beat_id")), 1, 10)))})
    named = checkpoint(named)

    # Several clusters may go on in one arc: their signatures come together.
    gained = _signatures(grouped.join(named.select("scope_id", "cluster", "arc_id"), ["scope_id", "cluster"]), ["scope_id", "arc_id"]).withColumnRenamed("threads", "t2").withColumnRenamed("entities", "e2")
    told = named.groupBy("scope_id", "arc_id").agg(F.max("through").alias("through"), F.min(F.struct("cluster", "h"))["h"].alias("h"))
    none = F.array().cast("array<string>")
    held = arcs.join(gained.join(told, ["scope_id", "arc_id"]), ["scope_id", "arc_id"], "full")
    new_sums = F.coalesce("sums", F.array())
    old = F.coalesce("centroid", F.array().cast("array<double>"))
    # The new mean counts the old one as one vector among the new members'.
    mean = F.when(F.size(new_sums) == 0, old).when(F.size(old) == 0, F.transform(new_sums, lambda m: m["s"] / m["c"])).otherwise(F.zip_with(new_sums, old, lambda m, o: (m["s"] + o) / (m["c"] + 1)))
    touched = F.col("through").isNotNull()
    idle = (F.col("status") == "active") & (F.datediff(F.lit(at).cast("date"), "promoted_at") > dormant_days)
    last = arcs.groupBy("scope_id").agg(F.max("pos").alias("last_pos"))
    after = held.join(last, "scope_id", "left").withColumn("_k", F.row_number().over(W.partitionBy("scope_id", F.col("pos").isNull()).orderBy("arc_id")))
    after = after.select(
        "scope_id", "arc_id", F.coalesce("pos", F.coalesce("last_pos", F.lit(0)) + F.col("_k")).cast("bigint").alias("pos"),
        F.when(touched, "active").when(idle, "dormant").otherwise(F.col("status")).alias("status"),
        F.coalesce(F.nullif("h.label", F.lit("")), "label", F.lit("unnamed arc")).alias("label"),
        F.array_sort(F.array_union(F.coalesce("threads", none), F.coalesce("t2", none))).alias("threads"), F.array_sort(F.array_union(F.coalesce("entities", none), F.coalesce("e2", none))).alias("entities"),
        F.when(touched, mean).otherwise(F.col("centroid")).alias("centroid"), F.greatest("covered_through", "through").cast("bigint").alias("covered_through"),
        (F.coalesce("version", F.lit(0)) + touched.cast("int")).cast("bigint").alias("version"), F.when(touched, F.lit(at).cast("date")).otherwise(F.col("promoted_at")).alias("promoted_at"),
    )
    after = checkpoint(after)

    added = said.join(named.select("scope_id", "cluster", F.col("arc_id").alias("to")), ["scope_id", "cluster"]).join(after.select("scope_id", F.col("arc_id").alias("to"), F.col("entities").alias("_e")), ["scope_id", "to"])
    shared = F.when((F.size("_e") > 0) & (F.size("entities") > 0), F.least(F.lit(1.0), F.size(F.array_intersect("entities", "_e")) / F.size("entities"))).otherwise(0.5)
    days = F.greatest(F.lit(0), F.datediff(F.lit(at).cast("date"), "created"))
    edges = added.select("scope_id", F.col("to").alias("arc_id"), "beat_id", F.coalesce("role", F.lit("minor")).alias("role"), C.edge_salience(F.col("salience"), shared, days).alias("salience"))
    everyone = checkpoint(members.unionByName(edges))
    ranked = everyone.withColumn("_r", F.row_number().over(W.partitionBy("scope_id", "arc_id").orderBy(F.desc("salience"), "beat_id"))).where(F.col("_r") <= most_notes)
    notes = ranked.groupBy("scope_id", "arc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "beat_id"))), lambda x: x["beat_id"]).alias("footnotes"))
    recap = told.join(after.select("scope_id", "arc_id", F.col("label").alias("name")), ["scope_id", "arc_id"]).join(notes, ["scope_id", "arc_id"])
    summary = F.substring(F.concat(F.lit("[arc recap] "), "name", F.lit(" — "), F.coalesce("h.lead", F.lit(""))), 1, 200)
    recaps = recap.select("scope_id", F.concat(F.lit("recap-"), "arc_id").alias("id"), "arc_id", summary.alias("summary"), F.coalesce("h.body", F.lit("")).alias("content"), "footnotes")
    return after, everyone, recaps
