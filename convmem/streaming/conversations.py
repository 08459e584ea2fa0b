"""State that follows conversations: turn de-duplication, bookmarks, clocks, threads, snapshots, recitations, micro-batches.

Every operator takes a streaming (or static) DataFrame of turns (conv_id, turn, role, text, ts).
State is kept for each conversation, see ``state``: bookmarks until they fade, one clock, threads until they close.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convmem.functions import signals
from convmem.functions.text import STOP_WORDS
from convmem.operators.graph import checkpoint
from convmem.operators.identity import labels_alike
from convmem.streaming.state import Follower, followed

LATE = "1 hour"


def new_turns(turns: DataFrame, late: str = LATE) -> DataFrame:
    """Every turn once; state is dropped when the watermark has passed."""
    return turns.withWatermark("ts", late).dropDuplicatesWithinWatermark(["conv_id", "turn"])


def activity(turns: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Turns by window and role."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return turns.withWatermark("ts", late).groupBy(window.alias("w"), "role").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "role", "n")


def sessions(turns: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Runs of turns of a conversation without a longer pause."""
    return turns.withWatermark("ts", late).groupBy("conv_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("conv_id", F.col("w.start").alias("start"), "n")


class Bookmarks(Follower):
    """Bookmarks that fade with every turn."""

    def __init__(self, decay: float, least: float, **kw):
        super().__init__(**kw)
        self.decay, self.least = decay, least

    def open(self, handle):
        self.state = handle.getMapState("marks", "turn long, k long", "topic string, weight double, why string")

    def load(self):
        self.held = {tuple(k): tuple(v) for k, v in self.state.iterator()}
        self.before = dict(self.held)

    def save(self):
        for key in self.before.keys() - self.held.keys():
            self.state.removeKey(key)
        for key, value in self.held.items():
            if self.before.get(key) != value:
                self.state.updateValue(key, value)

    def forget(self):
        self.state.clear()

    def take(self, row, at):
        faded = {k: (t, w * self.decay, why) for k, (t, w, why) in self.held.items()}
        self.held = {k: m for k, m in faded.items() if m[1] >= self.least}
        for k, params in enumerate(_MARK.findall(row.text or "")):
            topic, weight = _parameter(params, "topic"), _parameter(params, "weight")
            try:
                number = 0.5 if weight is None else float(weight)
            except ValueError:
                continue
            if topic and number == number:
                self.held[(int(row.turn), k)] = (topic, max(0.0, min(1.0, number)), _parameter(params, "why") or "unspecified")
        return [(topic, weight) for topic, weight, _ in self.held.values()]


_MARK = re.compile(r"\[bookmark:([^\]]*)\]")


def _parameter(params: str, name: str) -> str | None:
    found = re.search(rf'(?:^|[\s,]){name}\s*=\s*(?:"([^"]*)"|([^",\s]+))', params)
    return None if found is None else found[1] if found[1] is not None else found[2]


def bookmark_state(turns: DataFrame, decay: float = 0.9, least: float = 0.1, late: str = LATE) -> DataFrame:
    """(conv_id, turn, topic, weight): after each turn all bookmarks that still hold. A turn first fades what is there, then adds its own; what has faded below ``least`` goes."""
    return followed(turns, Bookmarks(decay, least), "conv_id long, turn long, topic string, weight double", late)


WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Plain words as signals.
PLAIN = ({p: [p] for p in ("morning", "afternoon", "evening", "night")}, {d: [d] for d in WEEK})


class Clock(Follower):
    """The time that a story is at, and whether its user is there."""

    def __init__(self, times: dict[str, list[str]], days: dict[str, list[str]], away: list[str], **kw):
        super().__init__(**kw)
        self.times, self.days, self.away = times, days, away

    def open(self, handle):
        self.state = handle.getValueState("clock", "day string, part string, presence string, returns long")

    def load(self):
        self.now = tuple(self.state.get()) if self.state.exists() else (None, None, None, 0)

    def save(self):
        self.state.update(self.now)

    def forget(self):
        self.state.clear()

    def take(self, row, at):
        day, part, presence, returns = self.now
        text = (row.text or "").lower()
        found = lambda signals: next((k for k, phrases in signals.items() if any(p in text for p in phrases)), None)
        if row.role == "user" and text:
            if any(p in text for p in self.away):
                presence = "away"
            elif presence == "away":
                presence, returns = "present", returns + 1
        told, named, after = found(self.times), found(self.days), None
        if told == "morning" and part in signals.LATE:
            after = part
            day = WEEK[(WEEK.index(day) + 1) % 7] if day else day
        self.now = (named or day, told or part, presence, returns)
        return [(self.now[0], self.now[1], after, presence, returns)]


def soft_clock(turns: DataFrame, times: dict[str, list[str]] = PLAIN[0], days: dict[str, list[str]] = PLAIN[1], away: list[str] = signals.AWAY, late: str = LATE) -> DataFrame:  # noqa: B006
    """(conv_id, turn, day, part, after, presence, returns): the time that a story is at.

    A morning after an evening or later is the next day, if the day is known, and ``after`` says so
    for that turn only. Only a user's own words make them away; any later ones of theirs bring them back.
    """
    return followed(turns, Clock(times, days, away), "conv_id long, turn long, day string, part string, after string, presence string, returns long", late)


class Threads(Follower):
    """Active threads by their label."""

    def __init__(self, same: Callable[[str, str], bool], idle: int, **kw):
        super().__init__(**kw)
        self.same, self.idle_thread = same, idle * 1000

    def open(self, handle):
        self.state = handle.getMapState("threads", "n long", "label string, beats long, at long, participants array<string>")
        self.count = handle.getValueState("count", "n long")

    def load(self):
        self.live = {} if self.fresh else {k[0]: tuple(v) for k, v in self.state.iterator()}
        self.before = dict(self.live)
        self.n = self.counted = 0 if self.fresh else self.count.get()[0]

    def save(self):
        for n in self.before.keys() - self.live.keys():
            self.state.removeKey((n,))
        for n, v in self.live.items():
            if self.before.get(n) != v:
                self.state.updateValue((n,), v)
        if self.fresh or self.n != self.counted:
            self.count.update((self.n,))

    def forget(self):
        self.state.clear()
        self.count.clear()

    def _closed(self, at):
        gone = {n: v for n, v in sorted(self.live.items()) if v[2] + self.idle_thread <= at}
        self.live = {n: v for n, v in self.live.items() if n not in gone}
        return [(f"t{n}", v[0], v[1], sorted(v[3]), "closed") for n, v in gone.items()]

    def next_due(self, last):
        return min([last + self.idle_ms, *(v[2] + self.idle_thread for v in self.live.values())])

    def idle(self, at):
        return self._closed(at)

    def take(self, row, at):
        at = at or 0
        out = self._closed(at)
        label = re.sub(r"\s+", " ", str(row.label or "").replace("_", " ")).strip()[:80]
        if not label:
            return out
        who = getattr(row, "participant", None) or row.role
        found = next((n for n in sorted(self.live) if self.same(self.live[n][0], label)), None)
        if found is None:
            self.n += 1
            found = self.n
            self.live[found] = (label, 0, at, [])
        name, beats, last, people = self.live[found]
        people = list(people) if who in people else [*people, who]
        self.live[found] = (name, beats + 1, max(at, last), people)
        return [*out, (f"t{found}", name, beats + 1, sorted(people), "known" if beats else "new")]


def threads(turns: DataFrame, similar: Callable[[str, str], bool] | None = None, idle: int = 14 * 86400, late: str = LATE) -> DataFrame:
    """(conv_id, turn, thread, label, beats, participants, state): the thread of each turn's ``label``.

    It is the first active one whose label matches, or new. What nothing has come to for ``idle`` seconds is closed, by
    a later turn or by a timer (``turn`` is null then). Turns may name who takes part (``participant``), else their role does.
    """
    return followed(turns, Threads(similar or labels_alike, idle), "conv_id long, turn long, thread string, label string, beats long, participants array<string>, state string", late)


class Snapshots(Follower):
    """The last messages, now and then."""

    def __init__(self, every: int, last: int, **kw):
        super().__init__(**kw)
        self.every, self.last = every * 1000, last

    def open(self, handle):
        self.fired = handle.getValueState("fired", "at long")
        self.state = handle.getListState("recent", "message string")

    def load(self):
        self.at = self.fired.get()[0] if self.fired.exists() else None
        self.recent = [v[0] for v in self.state.get()]

    def save(self):
        self.state.put([(m,) for m in self.recent])
        if self.at is not None:
            self.fired.update((self.at,))

    def forget(self):
        self.state.clear()
        self.fired.clear()

    def take(self, row, at):
        self.recent = [*self.recent, f"{row.role}: {row.text}"][-self.last :]
        if self.at is None or at is None:
            self.at = at if self.at is None else self.at
            return []
        if at - self.at < self.every:
            return []
        self.at = at
        return [("\n".join(self.recent),)]


def snapshots(turns: DataFrame, every: int = 30 * 60, last: int = 40, late: str = LATE) -> DataFrame:
    """(conv_id, turn, messages): the last messages, when a turn comes so long after the last snapshot. The first turn starts the time."""
    return followed(turns, Snapshots(every, last), "conv_id long, turn long, messages string", late)


class Recited(Follower):
    """What surfaced with the turn before."""

    def __init__(self, least: float, **kw):
        super().__init__(**kw)
        self.least = least

    def open(self, handle):
        self.state = handle.getListState("surfaced", "id string, summary string")

    def load(self):
        self.before = [tuple(v) for v in self.state.get()]

    def save(self):
        if self.before:
            self.state.put(self.before)
        else:
            self.state.clear()

    def forget(self):
        self.state.clear()

    @staticmethod
    def words(text):
        return {w for w in re.sub(r"[^\w\s]", " ", (text or "").lower(), flags=re.ASCII).split() if len(w) > 2 and w not in STOP_WORDS}

    def take(self, row, at):
        said = self.words(row.text)
        out = [(i,) for i, summary in self.before if (w := self.words(summary)) and len(w & said) / len(w) >= self.least]
        self.before = [(p["id"], p["summary"]) for p in (row.surfaced if row.surfaced is not None else [])]
        return out


def recited(turns: DataFrame, least: float = 0.3, late: str = LATE) -> DataFrame:
    """(conv_id, turn, id): what surfaced with the turn before (``surfaced``: id and summary pairs) and is said again, by topic words."""
    return followed(turns, Recited(least), "conv_id long, turn long, id string", late)


def ingest(batch: Callable[[DataFrame], DataFrame], path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: applies ``batch`` and appends rows with keys that the table at ``path`` has not; a repeated batch changes nothing."""

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = batch(rows).withColumn("batch", F.lit(number))
        try:
            known = spark.read.parquet(path).where(F.col("batch") != number).select(*key)
        except Exception as e:  # noqa: BLE001 - there is no table before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            new = new.join(known, key, "left_anti")
        # The batch's own folder is replaced, so a batch that is run again leaves its rows once.
        new.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def committed(batch: Callable[[DataFrame], DataFrame], path: str, key: list[str], parts: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: as ``ingest``, for tables that grow: rows lie in parts by a hash of their key, and a batch reads only the parts of its own keys.

    A batch writes its own folders, part by part, and replaces them if it is run again, as after a crash between its write and the stream's
    own record of it; what earlier batches have is left out. ``parts`` must stay as it is for a table.
    """

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = batch(rows).dropDuplicates(key).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
        new = checkpoint(new)
        own = [r.part for r in new.select("part").distinct().collect()]  # no more than parts
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            known = spark.read.parquet(path)
            new = new.join(known.where(F.col("part").isin(own) & (F.col("batch") != number)).select(*key), key, "left_anti")
        new.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)

    return write
