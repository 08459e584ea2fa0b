"""Processors that follow conversations: typed state, event-time timers, nothing capped.

A conversation's rows of a micro-batch are taken in the order of their time and turn. Its state is
read once for them and written once, for each call to the state store costs about as much as a turn: turns that were taken are
kept in runs of numbers, and a conversation that has no state yet is asked for none. A turn that was taken before is ignored, in whatever batch it
comes again; one that comes late, but within the watermark, is taken when it comes. When a
conversation has been idle for long enough, a timer lets the processor say its last word and drops
the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: So many turns, by their number, are one entry of what was taken.
TURNS_PER_ENTRY = 64


class Follower(StatefulProcessor):
    """``take`` makes rows of a turn; ``load`` and ``save`` move the state; ``idle`` makes rows when nothing has come for ``idle_ms``."""

    names: tuple[str, ...] = ()
    #: Whether the conversation has no state yet.
    fresh = False

    def __init__(self, idle_ms: int = 14 * DAY_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("taken", "entry long", "turns array<long>")
        self.timer = handle.getValueState("timer", "last long, due long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...
    def load(self) -> None: ...
    def save(self) -> None: ...
    def forget(self) -> None: ...

    def take(self, row: Any, at: int | None) -> list[tuple]:
        return []

    def idle(self, at: int) -> list[tuple]:
        return []

    def next_due(self, last: int) -> int:
        """When the timer should go off."""
        return last + self.idle_ms

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["conv_id", *self.names])

    def _wait(self, last: int | None, before: int | None) -> None:
        """Sets the timer anew if it is due at another time than before; without any time, only notes that there is state."""
        due = None if last is None else self.next_due(last)
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)
        self.timer.update((last, due))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns = [row for frame in rows for row in frame.itertuples(index=False)]
        turns.sort(key=lambda r: (True, 0, r.turn) if pd.isna(r.ts) else (False, r.ts, r.turn))
        self.fresh = not self.timer.exists()
        last, due = (None, None) if self.fresh else self.timer.get()
        self.load()
        out: list[tuple] = []
        taken: dict[int, set[int]] = {}
        changed = set()
        for row in turns:
            turn = int(row.turn)
            entry = turn // TURNS_PER_ENTRY
            if entry not in taken:
                taken[entry] = set(self.seen.getValue((entry,))[0]) if not self.fresh and self.seen.containsKey((entry,)) else set()
            if turn in taken[entry]:
                continue
            taken[entry].add(turn)
            changed.add(entry)
            at = None if pd.isna(row.ts) else int(row.ts.timestamp() * 1000)
            out += [(turn, *made) for made in self.take(row, at)]
            last = at if last is None else max(last, at or last)
        for entry in changed:
            self.seen.updateValue((entry,), (sorted(taken[entry]),))
        self.save()
        self._wait(last, due)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.fresh = not self.timer.exists()
        last = at if self.fresh else self.timer.get()[0]
        last = at if last is None else last
        self.load()
        out = [(None, *made) for made in self.idle(at)]
        if last + self.idle_ms <= at:
            self.forget()
            self.seen.clear()
            self.timer.clear()
        else:
            self.save()
            self._wait(last, None)
        yield self._frame(key, out)

    def close(self) -> None: ...


def followed(turns: DataFrame, processor: Follower, schema: str, late: str) -> DataFrame:
    """The processor over the turns of each conversation. State is kept by RocksDB, which the session is told if it still has Spark's default."""
    conf = turns.sparkSession.conf
    if "HDFSBacked" in conf.get("spark.sql.streaming.stateStore.providerClass"):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor.names = tuple(f.split()[0] for f in schema.split(","))[1:]
    return turns.withWatermark("ts", late).groupBy("conv_id").transformWithStateInPandas(processor, schema, "append", "EventTime")
