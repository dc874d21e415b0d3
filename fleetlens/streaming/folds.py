"""Folds over streams: the same steps as the batch folds, with each key's state typed in the state store, and timers.

Within a micro-batch a key's rows go in order; a row that comes in a later one goes after those before it, whatever its order,
as a registry that gets it late would take it. So a stream whose files are in order ends as the batch fold does. What is due
without any row (silences, ends of ticks) is given by event-time timers once the watermark has passed it, and names the tick at
which it was due, so results don't depend on where micro-batches end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators import ha, registry

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Where ticks stand for event time, a tick is so many milliseconds, and tick 0 the first of them: Spark drops rows at time 0,
#: as it does any at or before the watermark. So a tick whose rows may come in two micro-batches needs a lateness of one.
TICK = 1000


def time_of(tick: int) -> int:
    return (tick + 1) * TICK


def use_store(spark: SparkSession) -> None:
    """Timers and typed states need a store that holds several state variables."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def native(value):
    """A stored value as steps know it: structs are tuples, arrays are lists, null is None."""
    if isinstance(value, (Row, tuple)):
        return tuple(native(v) for v in value)
    return [native(v) for v in value] if isinstance(value, list) else value


class Folding(StatefulProcessor):
    """One key's state machine. due(state): milliseconds of its next timer, or None; lapse(key, state, now): rows due until now
    (milliseconds), with which the state may end (it returns (rows, ended))."""

    def __init__(self, order: list[str], start: Callable[[], dict], step: Callable, schema: str, state: str, due: Callable | None = None, lapse: Callable | None = None):
        self.order, self.start, self.step, self.due, self.lapse = order, start, step, due, lapse
        self.names, self.state = T.StructType.fromDDL(schema).names, T.StructType.fromDDL(state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.state)

    def read(self) -> dict:
        return dict(zip(self.state.names, map(native, self.held.get()))) if self.held.exists() else self.start()

    def write(self, s: dict) -> None:
        self.held.update(tuple(s[n] for n in self.state.names))
        if self.due:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if (at := self.due(s)) is not None:
                self.handle.registerTimer(at)

    def rows(self, found) -> Iterator[Row]:
        for x in [] if found is None else found if isinstance(found, list) else [found]:
            yield Row(**dict(zip(self.names, x)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self.read()
        for r in sorted((r.asDict() for r in rows), key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            yield from self.rows(self.step(s, r))
        self.write(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            s = self.read()
            found, ended = self.lapse(tuple(key), s, timerValues.getCurrentWatermarkInMs())
            yield from self.rows(found)
            if ended:
                self.held.clear()
            else:
                self.write(s)

    def close(self) -> None:
        pass


def stream_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], tuple | list[tuple] | None], schema: str, state: str, due: Callable | None = None, lapse: Callable | None = None) -> DataFrame:
    """A row of schema for each row of the stream that step(state, row) answers, and for what lapses; states are of the type
    `state` names. Timers need a watermark on rows."""
    use_store(rows.sparkSession)
    processor = Folding(order, start, step, schema, state, due, lapse)
    return rows.groupBy(*keys).transformWithState(processor, T.StructType.fromDDL(schema), "Append", "EventTime" if due else "None")


def timed(rows: DataFrame, tick: str, late: str) -> DataFrame:
    """rows with their tick's event time `at`."""
    return rows.withColumn("at", F.timestamp_millis((F.col(tick) + 1) * TICK)).withWatermark("at", late)


def detect(beats: DataFrame, detector: ha.Detector = ha.Detector()) -> DataFrame:
    """ha.detect() of a stream of registrations and pulses (node, event_id, op, versions, health, pressure, tick)."""
    return stream_fold(beats, ["node"], ["tick", "event_id"], ha.unseen, ha.observe(detector), ha.DETECTED, ha.MEMBER)


def timeline(beats: DataFrame, detector: ha.Detector = ha.Detector(), late: str = "1 second") -> DataFrame:
    """ha.timeline() of a stream: a member that falls silent turns suspect, then dead, once the watermark passes the tick."""

    def due(s: dict) -> int | None:
        return time_of(at[0]) if (at := ha.next_lapse(s, detector)) else None

    def lapse(key: tuple, s: dict, now: int) -> tuple[list[tuple], bool]:
        return [(*key, *at, "silence") for at in ha.lapses(s, now // TICK - 1, detector)], False

    return stream_fold(timed(beats, "tick", late), ["node"], ["tick", "event_id"], ha.unseen, ha.changes(["node"], detector), ha.timeline_schema(beats, ["node"]), ha.MEMBER, due, lapse)


def task_registry(commands: DataFrame) -> DataFrame:
    """registry.task_registry() of a stream of commands."""
    return stream_fold(commands, ["task_id"], ["pos"], registry.new_task, registry.command, registry.COMMANDED, registry.TASK)


def tick_budgets(rows: DataFrame, tick: str, cost: str, order: list[str], limit: float, late: str = "1 second") -> DataFrame:
    """tick, offered and used of each tick (a number) once it is over: what the rows of a tick were admitted for. A tick's budget
    starts anew; rows of a tick that is over are dropped by the watermark."""

    def step(s: dict, r: dict) -> None:
        s.update(tick=r[tick], offered=s["offered"] + 1)
        if s["used"] + r[cost] <= limit:
            s["used"] += r[cost]

    def lapse(key: tuple, s: dict, now: int) -> tuple[list[tuple], bool]:
        return [(s["tick"], s["offered"], s["used"])], True

    start = lambda: dict(tick=None, offered=0, used=0.0)
    state = "tick long, offered long, used double"
    return stream_fold(timed(rows, tick, late), [tick], order, start, step, state, state, lambda s: time_of(s["tick"] + 1), lapse)
