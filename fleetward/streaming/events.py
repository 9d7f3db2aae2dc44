"""Alert events of an unbounded stream: dilation, least length and cooldown as events.eventize() has them.

A device's rows may come out of order by up to a delay. Its clock is the greatest time that it
has sent, alerts or not; an alert is settled once the clock is a delay ahead of it, and then
extends the open block, or ends it and begins another. An ended block that is long enough joins
the event before it or begins one, and an event comes out once no later block can join it.
Alerts behind what is settled are counted and come out as such, not dropped unseen.

State is what is not settled yet: alerts of one delay, a block and an event for each device.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetward.operators.events import PARAMETERS

#: kind: event, with start, end and alarms; or late, with the number of late alerts of a batch as alarms.
SCHEMA = "client_id string, kind string, start double, end double, alarms long"
_SPAN = "start double, end double, alarms long"


class Settled:
    """Settled alerts of one device, in time order, to events; block and event are (start, end, alarms) or None."""

    def __init__(self, parameters: tuple[float, ...], block: tuple | None = None, event: tuple | None = None) -> None:
        self.gap, self.least, self.cooldown = max(parameters[0], parameters[1]), parameters[2], parameters[3]
        self.block, self.event = block, event
        self.out: list[tuple[float, float, int]] = []

    def alert(self, t: float) -> None:
        if self.block and t - self.block[1] <= self.gap:
            self.block = (self.block[0], t, self.block[2] + 1)
            return
        self._end()
        self.block = (t, t, 1)

    def clock(self, now: float) -> None:
        """All alerts before now are settled."""
        if self.block and now - self.block[1] > self.gap:
            self._end()
        # The next block to end is the open one, or begins at now or later.
        if self.event and (self.block[0] if self.block else now) - self.event[1] >= self.cooldown:
            self.out.append(self.event)
            self.event = None

    def _end(self) -> None:
        block, self.block = self.block, None
        if not block or block[1] - block[0] < self.least:
            return
        if self.event and block[0] - self.event[1] < self.cooldown:
            self.event = (self.event[0], max(self.event[1], block[1]), self.event[2] + block[2])
            return
        if self.event:
            self.out.append(self.event)
        self.event = block


class _Events(StatefulProcessor):
    def __init__(self, parameters: tuple[float, ...], delay: float) -> None:
        self.parameters, self.delay = parameters, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.greatest = handle.getValueState("clock", "t double")
        self.pending = handle.getListState("pending", "t double")
        self.block = handle.getValueState("block", _SPAN)
        self.event = handle.getValueState("event", _SPAN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.greatest.get()
        clock = held[0] if held else float("-inf")
        # What is settled by now: times of this batch are judged by the clock before it.
        settled, late, times = clock - self.delay, 0, [x[0] for x in self.pending.get()] if self.pending.exists() else []
        for r in rows:
            if r["t"] is None:
                continue
            clock = max(clock, r["t"])
            if r["alert"] and r["t"] <= settled:
                late += 1
            elif r["alert"]:
                times.append(r["t"])
        if clock == float("-inf"):
            return
        now, machine = clock - self.delay, Settled(self.parameters, self._get(self.block), self._get(self.event))
        times.sort()
        rest = [t for t in times if t > now]
        for t in times[: len(times) - len(rest)]:
            machine.alert(t)
        machine.clock(now)
        self.greatest.update((clock,))
        if rest:
            self.pending.put([(t,) for t in rest])
        else:
            self.pending.clear()
        self._put(self.block, machine.block)
        self._put(self.event, machine.event)
        for start, end, alarms in machine.out:
            yield Row(client_id=key[0], kind="event", start=start, end=end, alarms=alarms)
        if late:
            yield Row(client_id=key[0], kind="late", start=None, end=None, alarms=late)

    @staticmethod
    def _get(state) -> tuple | None:
        found = state.get()
        return tuple(found) if found else None

    @staticmethod
    def _put(state, value: tuple | None) -> None:
        if value is None:
            state.clear()
        else:
            state.update(value)

    def close(self) -> None:
        pass


def alert_events(rows: DataFrame, delay: float, parameters: tuple[float, ...] = PARAMETERS) -> DataFrame:
    """rows (client_id, t, alert), a stream, to (client_id, kind, start, end, alarms) as they are settled.

    parameters: dilation, merge gap, least length and cooldown in seconds. Rows that are no alerts move a device's
    clock on; a device that sends nothing more keeps its last event open. Null times are left out. The session
    needs the RocksDB state store.
    """
    own = rows.select("client_id", rows["t"].cast("double").alias("t"), rows["alert"].cast("boolean").alias("alert"))
    return own.groupBy("client_id").transformWithState(_Events(parameters, float(delay)), SCHEMA, "Append", "None")
