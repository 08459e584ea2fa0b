"""What is made of several steps: merges that are applied, held beats that move, beats that find their ledger."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import commands as C
from convmem.operators import ledger as L
from convmem.operators import setjoin
from convmem.operators import similarity as S
from convmem.operators.curation import independent_first
from convmem.operators.graph import checkpoint
from convmem.operators.identity import jaro_winkler


def clock_line(time: Column, day: Column, previous: Column, presence: Column, returns: Column) -> Column:
    """One line on when a session takes place and whether the user is there; empty if nothing is known."""
    plain = lambda c: F.regexp_replace(c, "_", " ")
    known = lambda c: F.coalesce(c, F.lit("unknown")) != "unknown"
    when = F.concat_ws(", ", F.when(known(time), plain(time)), F.when(known(day), F.initcap(day)))
    after = F.when(previous.isNotNull(), F.concat(F.lit(" (morning after "), plain(previous), F.lit(")"))).otherwise("")
    there = F.when(presence == "away", "the user has stepped away and will return when ready").when(F.coalesce(returns, F.lit(0)) > 0, "the user steps away and comes back on their own schedule — they manage their own time")
    line = F.concat_ws(" · ", F.when(when != "", F.concat(when, after)), there)
    return F.when(line == "", "").otherwise(F.concat(F.lit("Session context: "), line))


def significant(label: Column) -> Column:
    """The distinct words of three letters or more of a normal label."""
    return F.array_distinct(F.filter(F.split(label, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def labels_match(a: Column, b: Column, least: float) -> Column:
    """Whether two labels are equal, one has all significant words of the other, or they are similar; a blank one matches nothing."""
    x, y = X.label(a), X.label(b)
    v, w = significant(x), significant(y)
    inside = (F.least(F.size(v), F.size(w)) > 0) & (F.size(F.array_intersect(v, w)) == F.least(F.size(v), F.size(w)))
    return F.coalesce((x != "") & (y != "") & ((x == y) | inside | (jaro_winkler(x, y) >= least)), F.lit(False))


def first_thread(asked: DataFrame, threads: DataFrame, least: float = 0.85) -> DataFrame:
    """(chat_id, label, thread_id): the first of a chat's active threads that matches the label asked; null where a new one is due.

    asked: (chat_id, label); threads: (chat_id, thread_id, label, pos, status). A chat's pairs are compared, and reduced to a minimum before any shuffle.
    """
    own = threads.where(F.col("status") == "active").select("chat_id", "thread_id", F.col("label").alias("_l"), "pos")
    pairs = asked.select("chat_id", "label").distinct().join(own, "chat_id", "left")
    hit = labels_match(F.col("label"), F.col("_l"), least)
    return pairs.groupBy("chat_id", "label").agg(F.min_by("thread_id", F.when(hit, F.col("pos"))).alias("thread_id"))


def label_relevance(threads: DataFrame, talk: DataFrame) -> DataFrame:
    """(chat_id, thread_id, relevance): the share of a label's topic words in its chat's recent talk, where there is any. By words, for all chats at once."""
    said = talk.select("chat_id", F.explode(X.bag(F.col("talk"))).alias("w")).distinct()
    topics = threads.select("chat_id", "thread_id", X.topic_words(F.col("label")).alias("t"))
    hits = topics.select("chat_id", "thread_id", F.size("t").alias("n"), F.explode("t").alias("w")).join(said, ["chat_id", "w"])
    return hits.groupBy("chat_id", "thread_id").agg((F.count("*") / F.max("n")).alias("relevance"))


def routed_beats(beats: DataFrame, resolved: DataFrame, bucket: str, session: str, assigned: list[str], live: bool = False) -> DataFrame:
    """(beat_id, route, identity_key, speaker): which ledger a beat belongs to by its subject.

    beats: (beat_id, subject, speaker); resolved: (name, identity_key), one row per name. Of the user or the session's character, or nobody: bucket.
    Of somebody known: theirs, under the subject's name. Of somebody unknown: pending if the speaker is not assigned, or always in a live turn.
    """
    known = resolved.where(F.col("identity_key").isNotNull()).select(F.col("name").alias("subject"), "identity_key")
    rows = beats.withColumn("subject", F.trim("subject")).join(known, "subject", "left")
    own = F.coalesce(F.col("subject"), F.lit("")).eqNullSafe("") | (X.label(F.col("subject")) == "user") | labels_match(F.col("subject"), F.lit(session), 0.9)
    spoken = F.lower(F.trim("speaker"))
    near = F.lit(False)
    for name in assigned:
        near = near | spoken.contains(name.lower()) | F.lit(name.lower()).contains(spoken)
    route = (
        F.when(own, "bucket")
        .when(F.col("identity_key").isNotNull(), F.when(F.col("identity_key") == bucket, "bucket").otherwise("routed"))
        .when(F.lit(live) | ~F.coalesce(near, F.lit(False)), "pending")
        .otherwise("bucket")
    )
    rows = rows.withColumn("route", route)
    key = F.when(F.col("route") == "routed", F.col("identity_key")).when(F.col("route") == "bucket", F.lit(bucket))
    return rows.select("beat_id", "route", key.alias("identity_key"), F.when(F.col("route") == "bucket", F.col("speaker")).otherwise(F.col("subject")).alias("speaker"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; what is missing, or shorter than the longest, is zero."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    return out


def _close_arcs(clusters: DataFrame, arcs: DataFrame, least: float, rows_per_tile: int) -> DataFrame:
    """(scope_id, cluster, first): the first arc of a scope whose centroid is close to a cluster's.

    Clusters and arcs of a scope are dealt to tiles; a task multiplies two tiles and returns a row per cluster at most.
    """
    tiles = lambda rows, n: rows.groupBy("scope_id").agg(F.ceil(F.count("*") / rows_per_tile).cast("int").alias(n))
    a, b = clusters.where(F.size("centroid") > 0), arcs.where(F.size("centroid") > 0)
    counts = tiles(a, "_m").join(tiles(b, "_n"), "scope_id")
    vector = F.col("centroid").cast("array<double>").alias("v")
    deal = lambda rows, key, own, other, i, j: rows.join(counts, "scope_id").select("*", F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(i), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j))
    left = deal(a, "cluster", "_m", "_n", "i", "j").select("scope_id", "i", "j", "cluster", vector)
    right = deal(b, "arc_id", "_n", "_m", "j", "i").select("scope_id", "i", "j", "pos", "arc_id", vector)
    kind = dict(left.dtypes) | dict(right.dtypes)

    def first(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if x.num_rows == 0 or y.num_rows == 0:
            return pa.table({"scope_id": x["scope_id"], "cluster": x["cluster"], "pos": y["pos"], "arc_id": y["arc_id"]}).slice(0, 0)
        y = y.sort_by([("pos", "ascending"), ("arc_id", "ascending")])
        p, q = _matrix(x["v"]), _matrix(y["v"])
        p, q = (np.pad(m, ((0, 0), (0, max(p.shape[1], q.shape[1]) - m.shape[1]))) for m in (p, q))
        with np.errstate(all="ignore"):
            sizes = [np.sqrt(np.cumsum(m * m, 1)[:, -1]) for m in (p, q)]
            size = sizes[0][:, None] * sizes[1]
            c = np.where(size == 0, 0.0, p @ q.T / size)
            i, j = np.nonzero(np.abs(c - least) < 1e-9)  # at the bound the order of the sum decides
            for at in range(0, len(i), 4096):
                k, m = i[at : at + 4096], j[at : at + 4096]
                c[k, m] = np.cumsum(p[k] * q[m], 1)[:, -1] / size[k, m]
        hit = (c >= least) | np.isnan(c)
        at = np.flatnonzero(hit.any(1))
        best = y.take(hit[at].argmax(1))
        return pa.table({"scope_id": x["scope_id"].take(at), "cluster": x["cluster"].take(at), "pos": best["pos"], "arc_id": best["arc_id"]})

    key = ("scope_id", "i", "j")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(first, ", ".join(f"{c} {kind[c]}" for c in ("scope_id", "cluster", "pos", "arc_id")))
    return found.select("scope_id", "cluster", F.struct("pos", "arc_id").alias("first"))


def matched_arcs(clusters: DataFrame, arcs: DataFrame, cosine: float = 0.7, shared: float = 0.5, rows_per_tile: int = 2048) -> DataFrame:
    """(scope_id, cluster, arc_id): the first arc by ``pos`` that goes on in a cluster, or null where one is to be made.

    Both have scope_id, threads, entities and centroid; arcs arc_id, pos and status. A thread in common or centroids
    that are close decide; of active arcs also entities. Each relation is looked up by itself, threads and sets of entities
    by the first arc that has them, so a scope's clusters and arcs are never paired as rows. Both bounds are above 0.
    """
    first = F.struct("pos", "arc_id")
    by_thread = arcs.select("scope_id", F.explode("threads").alias("k"), first.alias("first")).groupBy("scope_id", "k").agg(F.min("first").alias("first"))
    hits = clusters.select("scope_id", "cluster", F.explode("threads").alias("k")).join(by_thread, ["scope_id", "k"]).select("scope_id", "cluster", "first")

    words = F.array_sort(F.array_distinct(F.transform("entities", lambda e: F.to_json(F.struct(e.alias("e"))))))
    asked = clusters.select(F.col("scope_id").alias("block"), words.alias("t"), "cluster")
    known = arcs.where("status = 'active'").select(F.col("scope_id").alias("block"), words.alias("t"), first.alias("first")).groupBy("block", "t").agg(F.min("first").alias("first"))
    roles = lambda rows, probe: rows.select("block", "t", F.lit(probe).alias("probe"), F.lit(not probe).alias("target"))
    sets = setjoin.numbered_sets(roles(asked, True).unionByName(roles(known, False)))
    named = sets.select("block", "t", "set_id")
    by_set = setjoin.similar(sets, shared).join(known.join(named, ["block", "t"]).select(F.col("set_id").alias("b"), "first"), "b").groupBy("a").agg(F.min("first").alias("first"))
    hits = hits.unionByName(asked.join(named, ["block", "t"]).join(by_set, F.col("set_id") == F.col("a")).select(F.col("block").alias("scope_id"), "cluster", "first"))

    hits = hits.unionByName(_close_arcs(clusters, arcs, cosine, rows_per_tile))
    every = hits.unionByName(clusters.select("scope_id", "cluster", F.lit(None).cast(hits.schema["first"].dataType).alias("first")))
    return every.groupBy("scope_id", "cluster").agg(F.min("first")["arc_id"].alias("arc_id"))


def applied_merges(ledger: DataFrame, merges: DataFrame, domains: dict[str, list[str]], at: str, gated: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, held, audit): proposed merges applied to a ledger, or held for a review with the reasons.

    merges: (cluster, canonical_id, redundant_ids, confidence, rationale), as read from the table of proposals: nothing is
    proposed anew, and rows deleted there are not applied. The gate sees the summaries entry by entry, so no cluster's texts
    come together in one row. Redundant ids that the ledger lacks are not superseded.
    """
    wanted = merges.select("cluster", "canonical_id", "confidence", "rationale", F.explode(F.array_distinct(F.concat(F.array("canonical_id"), "redundant_ids"))).alias("id"))
    seen = wanted.join(ledger.select("id", "summary"), "id")
    gate = C.gated(F.concat_ws(" ", "summary", "rationale"), F.col("confidence"), domains)
    reasons = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.split(gate["reasons"], ","))), lambda r: r != "")))
    done = F.array_sort(F.collect_set(F.when(F.col("id") != F.col("canonical_id"), F.col("id"))))
    found = seen.groupBy("cluster").agg(reasons.alias("_reasons"), done.alias("_done"))
    none = F.array().cast("array<string>")
    rows = merges.join(found, "cluster", "left").withColumns({"_reasons": F.coalesce("_reasons", none), "_done": F.coalesce("_done", none)})
    rows = rows.withColumn("_hold", F.lit(gated) & (F.size("_reasons") > 0))
    pairs = rows.where("not _hold").select(F.explode("_done").alias("id"), F.col("canonical_id").alias("by"))
    retire = F.concat(F.lit("merge: keep "), "canonical_id", F.lit(" ⟵ retire ["), F.array_join("redundant_ids", ", "), F.lit("]"))
    held = rows.where("_hold").select("cluster", F.lit("sweep").alias("source"), retire.alias("summary"), "confidence", F.col("_reasons").alias("reasons"), F.lit(at).alias("at"))
    why = F.when(F.col("_hold"), F.concat(F.lit("HELD for review ("), F.array_join("_reasons", ", "), F.lit(")"))).otherwise(F.col("rationale"))
    audit = rows.select(F.lit("apply").alias("mode"), "cluster", F.lit("merge").alias("verdict"), "canonical_id", "redundant_ids", "confidence", why.alias("rationale"), F.when(F.col("_hold"), none).otherwise(F.col("_done")).alias("superseded_ids"), F.lit(at).alias("at"))
    return L.supersede(ledger, pairs), held, audit


def append_audit(rows: DataFrame, path: str) -> None:
    """Add records to an audit folder of JSON lines, one folder for each kind (live, sweep, held, rollback)."""
    rows.write.mode("append").json(path)


def migrated(pending: DataFrame, mapping: DataFrame, beats: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(beats, pending, aliases): held beats of the speakers mapped become beats of an identity.

    pending: (speaker_norm, speaker, beat_id); mapping: (speaker_norm, identity_key), one row per speaker; beats: (identity_key, beat_id);
    aliases: (identity_key, label). A beat that is there already is not added again, and a second run changes nothing.
    The label is learnt as an alias unless another identity has it.
    """
    gone = mapping.select("speaker_norm", "identity_key")
    moved = pending.join(gone, "speaker_norm").select("identity_key", "beat_id").distinct()
    added = moved.join(beats.select("identity_key", "beat_id"), ["identity_key", "beat_id"], "left_anti")
    taken = aliases.select(X.label(F.col("label")).alias("speaker_norm")).distinct()
    asked = gone.join(pending.select("speaker_norm").distinct(), "speaker_norm", "left_semi")
    learnt = asked.join(taken, "speaker_norm", "left_anti").select("identity_key", F.col("speaker_norm").alias("label"))
    return beats.select("identity_key", "beat_id").unionByName(added), pending.join(gone, "speaker_norm", "left_anti"), aliases.select("identity_key", "label").unionByName(learnt)


def completed_cache(rows: DataFrame, cache: DataFrame, key: str, infer, schema: str) -> DataFrame:
    """The cache with what it lacks of the rows; only those are given to ``infer``. cache has the key and the columns of ``schema``."""
    new = S.batch_infer(rows.join(cache.select(key), key, "left_anti"), infer, schema)
    return cache.unionByName(new.select(*cache.columns))


def duplicates(ledger: DataFrame, least: float = 0.35) -> DataFrame:
    """(id): open entries that a stronger one of their scope and lane with a similar summary replaces; a clean-up marks them done.

    Stronger is a structured summary, then more use, then the earlier row; entries are taken from the strongest on, and who
    has lost eliminates no one. Of equal summaries only the strongest is compared, so copies never multiply. Ids are unique.
    """
    open_rows = ledger.where((F.coalesce("status", F.lit("open")) != "done") & (F.trim("summary") != ""))
    use = F.coalesce("retrieval_count", F.lit(0)) + 3 * F.coalesce("recitation_count", F.lit(0))
    order = F.struct((-F.when(F.col("summary").startswith("["), 2).otherwise(1)).alias("rich"), (-use).alias("use"), "entry_pos", "id")
    rows = open_rows.select(F.struct("scope_id", "lane").alias("block"), "id", "summary", order.alias("order"))
    bag = X.bag(F.col("summary"))
    classes = checkpoint(S.set_classes(rows, "block", "id", bag, "order"))
    best = checkpoint(classes.groupBy("block", "rep").agg(F.min("order").alias("order")))
    side = lambda n: best.select("block", F.col("rep").alias(n), F.col("order").alias(f"_{n}"))
    pairs = S.set_similarity_pairs(rows, "block", "id", bag, least, classes).join(side("a"), ["block", "a"]).join(side("b"), ["block", "b"])
    conflicts = pairs.select(F.least("_a", "_b")["id"].alias("a"), F.greatest("_a", "_b")["id"].alias("b"))
    kept = independent_first(best.select(F.col("order")["id"].alias("id")), conflicts)
    return classes.select(F.col("key").alias("id")).join(kept, "id", "left_anti")
