"""From messages to speaker turns, chunks and scored chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convmem.functions import text as X

PREFIX = r"^([A-Za-z][A-Za-z0-9 _'-]{0,40})(?:\s*\([^)]*\))?\s*:\s*"


def messages(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of messages that say something."""
    return table.where(F.trim("text") != "").select("conv_id", "turn", "role", F.trim("text").alias("text"))


def parse_turns(rows: DataFrame, character: str = "Character") -> DataFrame:
    """(conv_id, turn_index, speaker, text): a name and a colon begin a turn, narration between asterisks is one, other lines go on.

    Lines are exploded; running values over a conversation's messages find each line's speaker and
    turn, and a turn's lines are put together in order.
    """
    pieces = rows.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\n+")).alias("pos", "line"))
    pieces = pieces.withColumn("line", F.trim("line")).where("line <> ''")
    name = F.regexp_extract("line", PREFIX, 1)
    narration = F.col("line").rlike(r"^\*[^*]+\*$") & (name == "")
    pieces = pieces.select("conv_id", "turn", "role", "pos", F.when(name != "", F.trim(name)).alias("name"), narration.alias("narration"), F.trim(F.regexp_replace("line", PREFIX, "")).alias("said"), F.trim("line").alias("line"))
    w = W.partitionBy("conv_id", "turn").orderBy("pos")
    before = F.lag("narration", 1, False).over(w)
    opens = F.col("name").isNotNull() | F.col("narration") | before | (F.row_number().over(w) == 1)
    default = F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit(character))
    pieces = pieces.withColumn("opens", opens.cast("int")).withColumn("speaker", F.coalesce(F.last("name", ignorenulls=True).over(w), default)).withColumn("island", F.sum("opens").over(w))
    said = F.when(F.col("name").isNotNull(), F.col("said")).otherwise(F.col("line"))
    turns = pieces.groupBy("conv_id", "turn", "island").agg(
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"]), " ")).alias("text"),
        F.max("narration").alias("narration"),
        F.max("speaker").alias("speaker"),
    )
    turns = turns.where("text <> ''").withColumn("speaker", F.when(F.col("narration"), F.lit("Narrator")).otherwise(F.col("speaker")))
    order = W.partitionBy("conv_id").orderBy("turn", "island")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("bigint").alias("turn_index"), "speaker", "text")


def chunks(turns: DataFrame, most: int = 6, breaks: Column | None = None) -> DataFrame:
    """(conv_id, chunk_id, speaker, text, turn_start, turn_end): runs of one speaker's turns, at most ``most`` in a chunk.

    ``breaks``: a further condition, over a turn and its window, that ends a run before the turn.
    """
    order = W.partitionBy("conv_id").orderBy("turn_index")
    changed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order))
    changed = changed if breaks is None else changed | breaks
    runs = turns.withColumn("run", F.sum(changed.cast("int")).over(order))
    place = F.row_number().over(W.partitionBy("conv_id", "run").orderBy("turn_index")) - 1
    runs = runs.withColumn("part", F.floor(place / most))
    found = runs.groupBy("conv_id", "run", "part").agg(
        F.first("speaker").alias("speaker"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("turn_index").alias("turn_start"),
        F.max("turn_index").alias("turn_end"),
    )
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn_start")) - 1
    return found.select("conv_id", number.cast("bigint").alias("chunk_id"), "speaker", "text", "turn_start", "turn_end")


def apart_in_meaning(least: float, vector: str = "vector") -> Column:
    """A break for ``chunks``: where a turn's vector is less like the one before than ``least``; without a vector it is like nothing."""
    before = F.lag(vector).over(W.partitionBy("conv_id").orderBy("turn_index"))
    return F.coalesce(X.cosine(before, F.col(vector)), F.lit(0.0)) < least


@dataclass(frozen=True)
class Scoring:
    """Weights of the keyword score; lanes in the order in which ties are decided."""

    lanes: dict[str, float]
    per_hit: float = 0.55
    two_hits: float = 1.3
    three_hits: float = 1.5
    short_words: int = 10
    short_boost: float = 1.2
    deflection: float = 0.15
    together: float = 1.5


def lane_hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur: single words at word boundaries, longer ones anywhere."""
    hit = F.lit(0)
    for p in phrases:
        found = F.contains(text, F.lit(p)) if " " in p else text.rlike(rf"(^|[^A-Za-z0-9_]){p}([^A-Za-z0-9_]|$)")
        hit = hit + found.cast("int")
    return hit


def score(rows: DataFrame, lexicon: dict[str, list[str]], cfg: Scoring, direct: list[str] = (), deflection: list[str] = (), attachment: list[str] = ()) -> DataFrame:
    """Adds a score for each lane and ``dysregulation``, ``hits``, ``salience`` and ``primary_emotion``. Native; the lexicon is a parameter."""
    text = F.lower("text")
    hits = {lane: lane_hits(text, lexicon.get(lane, [])) for lane in cfg.lanes}
    d, f, a = lane_hits(text, list(direct)), lane_hits(text, list(deflection)), lane_hits(text, list(attachment))
    brief = F.size(F.split(F.trim("text"), r"\s+")) <= cfg.short_words
    found = {f"_h_{k}": h for k, h in hits.items()} | {"_d": d, "_f": f, "_a": a, "_brief": brief}
    # A generator of one row: filters on the score stay above it, so that no phrase is looked for twice.
    rows = rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))
    cap = lambda c: F.least(F.lit(1.0), c)
    total = sum((F.col(f"_h_{k}") for k in cfg.lanes), F.lit(0)) + F.col("_d") + F.col("_f") + F.col("_a")
    base = {k: cap(F.col(f"_h_{k}") * cfg.per_hit * w) for k, w in cfg.lanes.items() if k != "dysregulation"}
    own = cap(cap(F.col("_d") * cfg.per_hit * cfg.lanes.get("dysregulation", 0.9)) + F.col("_f") * cfg.deflection)
    base["dysregulation"] = F.when((F.col("_f") > 0) & (F.col("_a") > 0), cap(own * cfg.together)).otherwise(own)
    compound = F.when(total >= 3, cfg.three_hits).when(total >= 2, cfg.two_hits).otherwise(1.0)
    short = F.when(F.col("_brief"), cfg.short_boost).otherwise(1.0)
    scored = rows.withColumns({"hits": total.cast("bigint")} | {k: cap(cap(b * compound) * short) for k, b in base.items()})
    names = list(base)
    scored = scored.withColumn("salience", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    primary = F.lit(None).cast("string")
    for k in reversed(names):
        primary = F.when(F.col(k) == F.col("salience"), F.lit(k)).otherwise(primary)
    scored = scored.withColumn("primary_emotion", F.when(F.col("salience") > 0, primary))
    return scored.drop(*[f"_h_{k}" for k in cfg.lanes], "_d", "_f", "_a", "_brief")


def gate(scored: DataFrame, threshold: float = 0.4) -> DataFrame:
    return scored.where(F.col("salience") >= threshold)


def late_boost(scored: DataFrame, share: float = 0.2, factor: float = 1.3) -> DataFrame:
    """Chunks that begin in the last part of a conversation's turns count more."""
    last = F.max("turn_end").over(W.partitionBy("conv_id"))
    return scored.withColumn("salience", F.when(F.col("turn_start") >= (last + 1) * (1 - share), F.least(F.lit(1.0), F.col("salience") * factor)).otherwise(F.col("salience")))


def neighbours(rows: DataFrame, most: int = 400) -> DataFrame:
    """Adds the texts of the chunks before and after, shortened; to be called before any filter."""
    order = W.partitionBy("conv_id").orderBy("chunk_id")
    return rows.withColumn("before", F.substring(F.lag("text").over(order), 1, most)).withColumn("after", F.substring(F.lead("text").over(order), 1, most))


def last_messages(rows: DataFrame, most: int) -> DataFrame:
    """The last ``most`` messages of each conversation."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("rn") <= most).drop("rn")


def fact_windows(rows: DataFrame, size: int = 5) -> DataFrame:
    """(conv_id, window_id, text): so many chunks together, each labelled by who speaks."""
    labelled = F.concat(F.when(F.col("speaker") == "user", F.lit("User: ")).otherwise(F.lit("Scene: ")), F.col("text"))
    numbered = rows.withColumn("window_id", F.floor(F.col("chunk_id") / size).cast("bigint"))
    return numbered.groupBy("conv_id", "window_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", labelled.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def top_chunks(scored: DataFrame, most: int = 3) -> DataFrame:
    order = W.partitionBy("conv_id").orderBy(F.desc("salience"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)
