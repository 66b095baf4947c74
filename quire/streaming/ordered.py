"""What the stateful processors share: a key's rows in the order of their numbers, however batches deal them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ValueState


class Ordered(StatefulProcessor):
    """A processor whose rows are numbered by seq from 0; one that comes before its turn waits in state, one that comes again is left out.

    Each call to the state is a trip to the JVM, so a key makes a fixed number of them for a batch, however many rows
    it has: rows that wait are kept together, an entry for each batch that left some.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "seq long, waiting int")
        self.early = handle.getListState("early", "rows string")

    def in_order(self, frames: Iterator[pd.DataFrame]) -> list[dict[str, Any]]:
        self.known = self.turn.exists()
        start, held = self.turn.get() if self.known else (0, 0)
        waiting = {row["seq"]: row for (rows,) in self.early.get() for row in json.loads(rows)} if held else {}
        came: dict[int, dict[str, Any]] = {}
        for frame in frames:
            for values in zip(*(frame[c].tolist() for c in frame.columns)):
                row = dict(zip(frame.columns, values))
                if row["seq"] >= start and row["seq"] not in waiting:
                    came.setdefault(row["seq"], row)
        turn, ready = start, []
        while turn in came or turn in waiting:
            ready.append(came.pop(turn) if turn in came else waiting.pop(turn))
            turn += 1
        left = len(waiting) + len(came)
        if held and not left:
            self.early.clear()
        elif len(waiting) < held:
            self.early.put([(json.dumps(list((waiting | came).values())),)])
        elif came:
            self.early.appendValue((json.dumps(list(came.values())),))
        if (turn, left) != (start, held):
            self.turn.update((turn, left))
        return ready

    def told(self, state: ValueState, none: tuple) -> tuple:
        """What a state says of the key, none where it is new or the state was cleared; behind in_order()."""
        return (state.get() if self.known else None) or none

    def close(self) -> None:
        pass


#: What a key's state begins with: the number that is due, and the rows that came before theirs.
TURN = "seq long, early string"


def arranged(turn: int, early: str, rows: Iterator[tuple]) -> tuple[int, str, list[tuple]]:
    """(turn, early, rows whose turn it is, without their numbers) behind more rows (seq, ...) of a key; early are rows as JSON, '' where none waits."""
    waiting = {seq: values for seq, *values in json.loads(early)} if early else {}
    before, ready = len(waiting), []
    for seq, *values in rows:
        if seq >= turn:
            waiting.setdefault(seq, values)
    while turn in waiting:
        ready.append(waiting.pop(turn))
        turn += 1
    if ready or len(waiting) != before:
        early = json.dumps([(seq, *values) for seq, values in waiting.items()]) if waiting else ""
    return turn, early, ready


#: body(doc_id, own state, rows or None when the clock strikes, now in ms) -> (own state, rows that go out).
Body = Callable[[Any, tuple, list[tuple] | None, int], tuple[tuple, list[tuple]]]


class Keyed(StatefulProcessor):
    """body for each key, over rows in the order of their numbers: one value of state, which is read once and written once a batch, however many rows a key has. Of a timed one the last field of the state says when the clock strikes next, 0 for never."""

    def __init__(self, body: Body, names: list[str], state: str, none: tuple, timed: bool):
        self.body, self.names, self.state, self.none, self.timed = body, names, state, none, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held, self.out = handle, handle.getValueState("held", f"{TURN}, {self.state}"), Row(*self.names)

    def _step(self, key: tuple, rows: Iterator[Row] | None, timerValues: Any) -> Iterator[Row]:
        turn, early, *own = self.held.get() or (0, "", *self.none)
        ready = None
        if rows is not None:
            turn, early, ready = arranged(turn, early, (row[1:] for row in rows))
        new, found = self.body(key[0], tuple(own), ready, timerValues.getCurrentProcessingTimeInMs() if self.timed else 0)
        if self.timed and own[-1] != new[-1]:
            if own[-1] and rows is not None:
                self.handle.deleteTimer(own[-1])
            if new[-1]:
                self.handle.registerTimer(new[-1])
        self.held.update((turn, early, *new))
        return (self.out(*values) for values in found)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return self._step(key, rows, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._step(key, None, timerValues)

    def close(self) -> None:
        pass


def by_key(rows: DataFrame, columns: tuple[str, ...], out: str, state: str, none: tuple, body: Body, timed: bool = False) -> DataFrame:
    """Rows (doc_id, seq, columns) through Keyed(), without pandas; what waits in a key's state is written again with each batch of the key."""
    names = [c.split()[0] for c in out.split(", ")]
    own = rows.select("doc_id", "seq", *columns).groupBy("doc_id")
    return own.transformWithState(Keyed(body, names, state, none, timed), out, "Append", "ProcessingTime" if timed else "None")
