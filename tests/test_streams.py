"""State that follows conversations: late and repeated turns, timers, no caps."""

from __future__ import annotations

import datetime as dt

import pytest

from convmem.functions import signals
from convmem.streaming import conversations as ST

TURN = "conv_id long, turn long, role string, text string, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def played(spark, tmp_path):
    """Runs a streaming operator over one file for each batch, and returns what it has written."""

    def run(operator, batches, schema=TURN):
        for i, part in enumerate(batches):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream = operator(source)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()

    return run


def test_bookmarks_without_a_cap(played):
    """Many bookmarks of a turn all hold; repeated turns and batches change nothing; a late turn counts when it comes."""
    many = " ".join(f'[bookmark: topic="place {k}", weight=0.9]' for k in range(450))
    first = [(1, 0, "user", many, at(0)), (1, 1, "user", "x", at(1)), (2, 0, "user", "[bookmark: topic=a] [bookmark: topic=a, weight=0.15]", at(0))]
    got = played(ST.bookmark_state, [first, first, [(1, 3, "user", "y", at(3))], [(1, 2, "user", "late", at(2)), (2, 1, "user", None, at(5))]])
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.turn), []).append(round(r.weight, 6))
    assert by[(1, 0)] == [0.9] * 450 and by[(1, 1)] == [0.81] * 450
    assert by[(1, 3)] == [0.729] * 450 and by[(1, 2)] == [0.6561] * 450
    assert sorted(by[(2, 0)]) == [0.15, 0.5] and sorted(by[(2, 1)]) == [0.135, 0.45]
    assert len(by) == 6


def test_bookmarks_go_below_the_threshold(played):
    got = played(ST.bookmark_state, [[(1, t, "user", "[bookmark: topic=a, weight=0.12]" if t == 0 else "x", at(t)) for t in range(4)]])
    assert [(r.turn, round(r.weight, 4)) for r in got] == [(0, 0.12), (1, 0.108)]


def test_clock_with_phrases(played):
    lines = [("user", "TGIF! Dinner soon"), ("assistant", "brb"), ("user", "brb"), ("assistant", "Just woke up"), ("user", "hello"), ("user", None), ("assistant", "can't sleep"), ("user", "breakfast")]
    got = {r.turn: tuple(r)[2:] for r in played(lambda t: ST.soft_clock(t, signals.TIMES, signals.DAYS), [[(1, i, role, s, at(i)) for i, (role, s) in enumerate(lines)]])}
    assert got[0] == ("friday", "evening", None, None, 0)
    assert got[1] == got[0]
    assert got[2] == ("friday", "evening", None, "away", 0)
    assert got[3] == ("saturday", "morning", "evening", "away", 0)
    assert got[4] == ("saturday", "morning", None, "present", 1)
    assert got[6] == ("saturday", "late_night", None, "present", 1)
    assert got[7] == ("sunday", "morning", "late_night", "present", 1)


LABELLED = TURN + ", label string"


def test_threads_are_found_and_closed_by_a_timer(played):
    day = 1440
    turns = [
        [(1, 0, "user", "", at(0), "the lost_key"), (1, 1, "assistant", "", at(1), "Lost key of the tower"), (1, 2, "user", "", at(2), "a wedding"), (1, 3, "user", "", at(3), None)],
        [(1, 4, "user", "", at(10 * day), "weddings")],
        [(2, 0, "user", "", at(15 * day), "something else")],
        [(2, 1, "user", "", at(16 * day), "something else")],
        [(1, 5, "user", "", at(17 * day), "the lost key")],
    ]
    got = played(lambda t: ST.threads(t), turns, LABELLED)
    rows = {(r.conv_id, r.turn, r.thread): (r.label, r.beats, list(r.participants), r.state) for r in got}
    assert rows[(1, 0, "t1")] == ("the lost key", 1, ["user"], "new")
    assert rows[(1, 1, "t1")] == ("the lost key", 2, ["assistant", "user"], "known")
    assert rows[(1, 4, "t2")] == ("a wedding", 2, ["user"], "known")
    assert rows[(1, None, "t1")] == ("the lost key", 2, ["assistant", "user"], "closed")  # nothing came for it for 14 days
    assert rows[(1, 5, "t3")] == ("the lost key", 1, ["user"], "new")
    assert (1, None, "t2") not in rows


def test_more_threads_than_any_cap(played):
    names = [f"{a}{b} quest" for a in "bcdfghjklmnpqrstvwxz" for b in (f"{k:02d}"[::-1] * 3 for k in range(40))]
    turns = [(1, i, "user", "", at(i), n) for i, n in enumerate(names)] + [(1, 5000, "user", "", at(3000), names[0])]
    got = played(lambda t: ST.threads(t, similar=lambda a, b: a == b), [turns], LABELLED)
    assert len({r.thread for r in got}) == len(names) == 800
    assert [r.thread for r in got if r.turn == 5000] == ["t1"]


def test_snapshots_over_batches(played):
    turns = [[(1, i, "user", f"m{i}", at(11 * i))] for i in range(7)]
    got = {r.turn: r.messages for r in played(lambda t: ST.snapshots(t, last=3), [*turns, turns[-1]])}
    assert got == {3: "user: m1\nuser: m2\nuser: m3", 6: "user: m4\nuser: m5\nuser: m6"}


def test_recitations(played):
    schema = TURN + ", surfaced array<struct<id: string, summary: string>>"
    turns = [(1, 0, "user", "x", at(0), [("a", "The silver locket of Anna"), ("b", "")]), (1, 1, "assistant", "your LOCKET, silver?", at(1), None), (1, 2, "user", "silver locket", at(2), [])]
    assert [tuple(r) for r in played(ST.recited, [turns[:1], turns[1:]], schema)] == [(1, 1, "a")]


def test_new_turns(played):
    rows = [(1, 0, "user", "x", at(0)), (1, 1, "user", "y", at(1))]
    assert len(played(lambda t: ST.new_turns(t), [rows, rows + rows, [(1, 2, "user", "z", at(2))]])) == 3


def test_nothing_comes(played, spark):
    assert played(ST.bookmark_state, [[]]) == []


def test_commits_are_repeated_without_effect(spark, tmp_path, monkeypatch):
    """A batch that is run again, whole or after it broke off half-way, leaves its rows once; a batch reads only the parts of its keys."""
    schema = "conv_id long, turn long, text string"
    write = ST.committed(lambda df: df, str(tmp_path / "t"), ["conv_id", "turn"], parts=8)
    first = spark.createDataFrame([(1, t, "x") for t in range(20)], schema)
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([(1, 5, "again"), (2, 0, "new"), (2, 0, "new")], schema), 1)
    rows = lambda: sorted((r.conv_id, r.turn, r.text) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    want = [(1, t, "x") for t in range(20)] + [(2, 0, "new")]
    assert rows() == want
    # The third batch broke off when half of its folders were there.
    third = spark.createDataFrame([(3, t, "y") for t in range(12)], schema)
    write(third.where("turn < 6"), 2)
    write(third, 2)
    write(third, 3)
    assert rows() == want + [(3, t, "y") for t in range(12)]
    write(third.limit(0), 4)
    assert rows() == want + [(3, t, "y") for t in range(12)]


class Store:
    """A state store in memory that counts what it is asked."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _state(self, is_map):
        held, store = {}, self

        class State:
            def __getattr__(self, name):
                store.calls += 1
                key = lambda k: tuple(k) if is_map else 0
                ways = {
                    "exists": lambda: bool(held), "get": lambda: held.get(0), "update": lambda v: held.__setitem__(0, v), "clear": held.clear,
                    "containsKey": lambda k: key(k) in held, "getValue": lambda k: held.get(key(k)), "updateValue": lambda k, v: held.__setitem__(key(k), v), "removeKey": lambda k: held.pop(key(k)), "iterator": lambda: iter(list(held.items())),
                }
                return ways[name]

        return State()

    def getMapState(self, *_):  # noqa: N802
        return self._state(True)

    def getValueState(self, *_):  # noqa: N802
        return self._state(False)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def test_state_is_asked_by_conversation_not_by_turn():
    import pandas as pd

    store, follower = Store(), ST.Threads(lambda a, b: a == b, 14 * 86400)
    follower.names = ("turn", "thread", "label", "beats", "participants", "state")
    follower.init(store)
    frame = lambda turns, timed=True: pd.DataFrame([(1, t, "user", "", pd.Timestamp(at(t)) if timed else pd.NaT, "a tower") for t in turns], columns=["conv_id", "turn", "role", "text", "ts", "label"])
    taken = lambda *frames: [int(t) for made in follower.handleInputRows((1,), iter(frames), None) for t in made.turn]
    assert taken(frame([3, 1]), frame([2, 1, *range(4, 130)])) == list(range(1, 130))
    assert store.calls <= 12  # 129 turns
    store.calls = 0
    assert taken(frame([63, 64, 129, 130])) == [130] and store.calls <= 16
    assert len(store.timers) == 1
    # Without times there is no timer, but what was taken is known.
    other, again = Store(), ST.Threads(lambda a, b: a == b, 14 * 86400)
    again.names, follower = follower.names, again
    follower.init(other)
    assert taken(frame([5, 6], timed=False)) == [5, 6] and taken(frame([6, 7], timed=False)) == [7] and not other.timers
    assert set(taken(frame([7, 8]))) == {8} and len(other.timers) == 1
