"""One-to-one pairing of scenes and summaries: scored by words, greedy without a loop over rows, nearest in time where words say nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convmem.operators.graph import checkpoint

# Words that do not tell scenes apart.
COMMON = (
    "the and that with from their them they this have been were into your what when where while would could should about after before then than because both each other some more very over under again still "
    "just like only also back down onto him her his hers had has was are not for you she it of in on at to we us our as is be by or an so no do did does my me one two out off up all can will who how why said "
    "says say there here them what something nothing"
).split()


def word_scores(scenes: DataFrame, summaries: DataFrame, common: list[str] = COMMON) -> DataFrame:
    """(origin, scene, summary, score): the share of a summary's words of four letters or more that the scene's text has, also inside words; pairs without any are left out.

    scenes: (origin, scene, text); summaries: (origin, summary, text). Words are looked up in the distinct letter runs of all
    scenes by their first four letters, so texts are never compared pair by pair.
    """
    runs = lambda least: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))
    wanted = summaries.select("origin", "summary", F.array_except(runs(4), F.array(*[F.lit(w) for w in common])).alias("w")).where(F.size("w") > 0)
    wanted = wanted.select("origin", "summary", F.size("w").alias("n"), F.explode("w").alias("w"))
    held = scenes.select("origin", "scene", F.explode(runs(4)).alias("run"))
    grams = held.select("run").distinct().select("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 3), lambda i: F.substring("run", i, F.lit(4))))).alias("gram"))
    found = wanted.select("w", F.substring("w", 1, 4).alias("gram")).distinct().join(grams, "gram").where(F.contains("run", "w")).select("w", "run")
    has = held.join(found, "run").select("origin", "scene", "w").distinct()
    return wanted.join(has, ["origin", "w"]).groupBy("origin", "scene", "summary").agg((F.count("*") / F.max("n")).alias("score"))


def best_first(edges: DataFrame, *order) -> DataFrame:
    """Edges (a, b, …) that a greedy walk in the given total order takes, each node once.

    In rounds: an edge that is the first one of both its ends is taken, and all others at these ends
    go. The first edge of all is always taken, so this ends.
    """
    left = checkpoint(edges)
    taken = left.limit(0)
    while not left.isEmpty():
        mine = lambda n: F.row_number().over(W.partitionBy(n).orderBy(*order))
        ranked = left.withColumns({"_ra": mine("a"), "_rb": mine("b")})
        now = checkpoint(ranked.where("_ra = 1 and _rb = 1").drop("_ra", "_rb"))
        taken = checkpoint(taken.unionByName(now))
        left = checkpoint(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select(*edges.columns))
    return taken


def nearest(scenes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(origin, scene, summary): the summary of the origin that is nearest in time, the first one by ``pos`` of equally near ones. Both have origin, ``at`` (seconds) and, summaries, ``pos``.

    Scenes and summaries are put on one line of time; a scene looks at the last summary before and the first after.
    """
    points = summaries.where("at is not null").groupBy("origin", "at").agg(F.min(F.struct("pos", "summary")).alias("s"))
    line = scenes.where("at is not null").select("origin", "at", "scene", F.lit(None).cast(dict(points.dtypes)["s"]).alias("s")).unionByName(points.select("origin", "at", F.lit(None).cast(dict(scenes.dtypes)["scene"]).alias("scene"), "s"))
    own = F.when(F.col("s").isNotNull(), F.struct("at", "s"))
    by = W.partitionBy("origin").orderBy("at")
    seen = line.withColumn("before", F.last(own, ignorenulls=True).over(by.rangeBetween(W.unboundedPreceding, 0))).withColumn("after", F.first(own, ignorenulls=True).over(by.rangeBetween(0, W.unboundedFollowing)))
    away = lambda c: F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("d"), F.col(f"{c}.s.pos").alias("pos"), F.col(f"{c}.s.summary").alias("summary"))
    near = F.array_min(F.array_compact(F.array(F.when(F.col("before").isNotNull(), away("before")), F.when(F.col("after").isNotNull(), away("after")))))
    return seen.where("s is null").select("origin", "scene", near["summary"].alias("summary")).where("summary is not null")


def paired(scenes: DataFrame, summaries: DataFrame, least: float = 0.25, fallback: bool = False, common: list[str] = COMMON) -> DataFrame:
    """(origin, scene, summary, score): every scene with its summary, by words; with ``fallback`` also by time, then without a score.

    scenes: (origin, scene, pos, text, at); summaries: (origin, summary, pos, text, at). Pairs are taken best first, of equal
    scores the earlier scene's and summary's; one under ``least`` is none. Ids are unique in an origin.
    """
    scored = word_scores(scenes, summaries, common).where(F.col("score") >= least)
    edges = scored.join(scenes.select("origin", "scene", F.col("pos").alias("pa")), ["origin", "scene"]).join(summaries.select("origin", "summary", F.col("pos").alias("pb")), ["origin", "summary"])
    edges = edges.select(F.struct("origin", "scene").alias("a"), F.struct("origin", "summary").alias("b"), "score", "pa", "pb")
    taken = best_first(edges, F.desc("score"), "pa", "pb", "a", "b").select("a.origin", "a.scene", "b.summary", "score")
    if not fallback:
        return taken
    rest = scenes.join(taken.select("origin", "scene"), ["origin", "scene"], "left_anti")
    return taken.unionByName(nearest(rest, summaries).withColumn("score", F.lit(None).cast("double")))
