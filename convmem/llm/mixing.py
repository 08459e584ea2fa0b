"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, gone through ``most`` times. An
occurrence's virtual finish time is the queue's tokens up to its end divided by the source's
target. All occurrences of all sources are range-sorted by that time, and the mix is what comes
before the total budget is spent: at each moment every source has got nearly the same share of
its target, and at the end nearly all of it.

Targets: sources weigh 1, 2, 3, repeating, in the order of their names by code point, null last.
They share the budget, the sum of all sizes, by weight; none gets more than ``most`` times its own
size, and what is too much is shared again by weight.

No queue is summed up by one task. The order within a source is that of a digest, whose beginning
is a bucket: buckets are summed first, sums of buckets are added up (a row for each source and
bucket), and within a bucket documents are. The same goes for the ranges of the final order. All
steps are native.

Defined cases: a null text has no words; documents without words, and sources without, take
nothing; a null ``doc_id`` is kept; repeated rows stand in the queue once each, and which of two
equal rows is taken once more is left open, for they cannot be told apart; an empty table gives
an empty result; other columns are ignored by ``allotted`` and kept by ``mixed``. The table of
sources has a row for each and is ordered by one task; a source may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convmem.llm.common import SPACES, apart, shuffle_partitions, stored

#: Documents of a bucket, and occurrences of a range of the final order, at most about.
ROWS = 16_384
#: Buckets of a source at least, so that one source is never one task's work.
BUCKETS = 256


def words(text: Column) -> Column:
    """Words of a text; null has none. What is left when words are cut to one letter each is counted, which needs no array."""
    text = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(text, f"[^{SPACES}]+", "x"), f"[{SPACES}]+", "")).cast("bigint")


def place(doc_id: Column, text: Column, seed: str) -> Column:
    """Where a document stands in its source's queue: a digest of what it is."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``queue``, ``source_size``, ``target`` of a table with ``queue``, ``source`` and ``size``.

    The level of the water that fills all sources alike, each up to its cap: in the order of cap
    by weight, the first source whose share of what earlier caps leave is within its cap sets it.
    """
    sums = sized.groupBy("queue", "source").agg(F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(name)) - 1) % len(weights) + 1).cast("int"))
    known = sums.withColumn("weight", weight.cast("bigint")).withColumn("cap", most * F.col("source_size"))
    known = known.withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", name).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("full_at", name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = lambda what, gone: F.sum(what).over(whole) - F.coalesce(F.sum(gone).over(before), F.lit(0))
    known = known.withColumn("level", rest("source_size", "cap") / rest("weight", "weight"))
    first = F.struct(F.row_number().over(Window.orderBy("full_at", name)).alias("n"), "level")
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.col("first"))).over(whole)["level"]
    return known.withColumn("first", first).withColumn("level", level).select("queue", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


class Plan:
    """All documents in their queues, and the last occurrence of the mix.

    ``queued`` has ``upto``, the tokens of the queue up to and with the document, ``source_size``
    and ``target``, and with ``rows`` the whole row of the input as a struct.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[int], most: int, seed: str, rows: bool):
        text, source = F.col("text").cast("string"), F.col("source").cast("string")
        own = {"doc_id": F.col("doc_id").cast("bigint"), "source": source, "size": words(text), "place": place(F.col("doc_id"), text, seed)}
        self.spark, self.most = docs.sparkSession, most
        sized = apart(docs, **own).withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        sized = self._written(sized if rows else sized.drop("row"))
        total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        self.budget, self.n_rows = int(total[0]), int(total[1])
        self.queued = self._written(self._queues(sized, targets(sized, weights, most)))
        self.last = self._last()

    def _written(self, df: DataFrame) -> DataFrame:
        return stored(df)[0]

    def _queues(self, sized: DataFrame, shares: DataFrame) -> DataFrame:
        n = max(BUCKETS, self.n_rows // ROWS)
        bucket = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") * n / (1 << 32)).cast("int")
        dealt = sized.withColumn("bucket", bucket)
        earlier = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = dealt.groupBy("queue", "bucket").agg(F.sum("size").alias("held"))
        buckets = buckets.select("queue", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base")).join(shares, "queue")
        own = Window.partitionBy("queue", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        summed = dealt.withColumn("upto", F.sum("size").over(own)).join(buckets, ["queue", "bucket"])
        return summed.withColumn("upto", F.col("base") + F.col("upto")).drop("base", "bucket", "queue")

    def finish(self, turn: Column) -> Column:
        """The virtual finish time of a document's occurrence in a turn of its queue, counted from 0."""
        return F.try_divide(turn * F.col("source_size") + F.col("upto"), F.col("target"))

    def _last(self) -> tuple | None:
        """Finish time, place and turn of the last occurrence before the budget is spent.

        Occurrences are range-sorted and written with their range's number. Ranges are summed;
        only the one in which the budget ends is summed row by row.
        """
        order = ["finish", "place", "turn"]
        items = self.queued.where("size > 0 and target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        items = items.select(self.finish(F.col("turn")).alias("finish"), "place", "turn", "size")
        parts = max(shuffle_partitions(self.spark), self.most * self.n_rows // ROWS)
        ranged = self._written(items.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
        upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        sums = ranged.groupBy("range").agg(F.sum("size").alias("held"), F.max(F.struct(*order)).alias("last")).withColumn("upto", F.sum("held").over(upto))
        within = F.when(F.col("upto") <= self.budget, F.col("last"))
        beyond = F.when(F.col("upto") > self.budget, F.struct("range", (F.col("upto") - F.col("held")).alias("base")))
        found = sums.agg(F.max(within).alias("last"), F.min(beyond).alias("beyond")).first()
        last = tuple(found["last"]) if found["last"] else None
        if found["beyond"]:
            number, base = found["beyond"]
            running = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            own = ranged.where(F.col("range") == number).withColumn("upto", base + running).where(F.col("upto") <= self.budget).agg(F.max(F.struct(*order)).alias("last")).first()
            last = tuple(own["last"]) if own["last"] else last
        return last

    def in_mix(self, turn: Column) -> Column:
        if self.last is None:
            return F.lit(False)
        finish, at, number = (F.lit(x) for x in self.last)
        own = self.finish(turn)
        before = (own < finish) | ((own == finish) & ((F.col("place") < at) | ((F.col("place") == at) & (turn <= number))))
        return (F.col("size") > 0) & (F.col("target") > 0) & before

    def turns(self) -> Column:
        """How often a document is in the mix: its turns come one after the other."""
        return sum((F.when(self.in_mix(F.lit(k)), 1).otherwise(0) for k in range(self.most)), F.lit(0))


def allotted(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "1") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` of the source and ``taken``, the words the mix takes, for every document."""
    plan = Plan(docs, weights, most, seed, rows=False)
    return plan.queued.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * plan.turns()).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "1") -> DataFrame:
    """The mix itself: rows of the input, as often as they are taken and in the order of their finish times."""
    plan = Plan(docs, weights, most, seed, rows=True)
    taken = plan.queued.withColumn("turn", F.explode(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), plan.in_mix)))
    return taken.withColumn("finish", plan.finish(F.col("turn"))).orderBy("finish", "place", "turn").select("row.*")
