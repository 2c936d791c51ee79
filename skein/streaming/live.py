"""Live changes: events of files, coalesced, eligible, held back until it is quiet, applied to the cache by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from skein.functions.glob import matches_any

#: Fixed values of the debounce: quiet time, and the longest that a batch waits.
QUIET, LONGEST = "500 milliseconds", "2 seconds"
#: The same in milliseconds.
QUIET_MS, LONGEST_MS = 500, 2_000
EVENT = "path string, type string, ts timestamp, event_id long"


def coalesced(events: DataFrame) -> DataFrame:
    """The last event of each path (path, type, ts, event_id), and how many there were."""
    return events.groupBy("path").agg(F.max_by("type", F.struct("ts", "event_id")).alias("type"), F.count("*").alias("events"))


def eligible(patterns: list[str]) -> Column:
    """Paths that no exclusion matches."""
    return ~matches_any(F.col("path"), patterns, "full")


def sessions(events: DataFrame, gap: str = QUIET, late: str | None = None) -> DataFrame:
    """Batches of each path's events that lie less than ``gap`` apart; ``late``: the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max_by("type", "ts").alias("type"))
    return out.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "type")


_ROWS = [("start", pa.int64()), ("flush", pa.int64()), ("path", pa.string()), ("type", pa.string()), ("events", pa.int64())]


class _Pending:
    """The batch of a group that is open: its paths' last events and their number."""

    def __init__(self, quiet: int, longest: int):
        self.quiet, self.longest, self.first, self.last = quiet, longest, None, None
        self.paths: dict[str, tuple[str, int]] = {}

    @property
    def flush(self) -> int:
        """When it is handed on: quiet after its last event, longest after its first at most."""
        return min(self.last + self.quiet, self.first + self.longest)

    def take(self) -> list[tuple]:
        rows = [(self.first, self.flush, p, t, n) for p, (t, n) in self.paths.items()] if self.paths else []
        self.first = self.last = None
        self.paths = {}
        return rows

    def add(self, ms: int, path: str, type_: str) -> list[tuple]:
        """Put an event into the open batch; the rows of the batch before, if that was due by then."""
        out = self.take() if self.first is not None and ms >= self.flush else []
        self.first = ms if self.first is None else self.first
        self.last = ms
        self.paths[path] = (type_, self.paths.get(path, ("", 0))[1] + 1)
        return out


def batches(events: DataFrame, quiet: int = QUIET_MS, longest: int = LONGEST_MS) -> DataFrame:
    """What the debounce makes of events that are all there: root, start, flush, path, type (its last) and events, a row for
    each path of a batch.

    ``events`` has root, path, type, ts and event_id. A batch of a root is handed on when ``quiet`` milliseconds have passed
    since its last event, or ``longest`` since its first. Events are sorted by root in tasks and read once, so only the open
    batch's paths are held."""
    schema = pa.schema([("root", pa.string()), *_ROWS])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, pending = None, _Pending(quiet, longest)
        for frame in frames:
            out = []
            for r, path, type_, ms in zip(*(frame.column(c).to_pylist() for c in ("root", "path", "type", "ms"))):
                if r != root:
                    out += [(root, *x) for x in pending.take()]
                    root = r
                out += [(root, *x) for x in pending.add(ms, path, type_)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if out := [(root, *x) for x in pending.take()]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = events.select("root", "path", "type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id")
    rows = rows.repartition("root").sortWithinPartitions("root", "ms", "event_id")
    out = rows.mapInArrow(run, "root string, start long, flush long, path string, type string, events long")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("start", "flush")})


class _Debounce(StatefulProcessor):
    """The open batch of a root as state, and a timer at the time when it is due."""

    def __init__(self, quiet: int, longest: int, by_event: bool):
        self.quiet, self.longest, self.by_event = quiet, longest, by_event

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
        self.paths = handle.getMapState("paths", "path string", "type string, events long")

    def _load(self) -> _Pending:
        out = _Pending(self.quiet, self.longest)
        if self.times.exists():
            out.first, out.last = self.times.get()
            out.paths = {k[0]: (v[0], v[1]) for k, v in self.paths.iterator()}
        return out

    def _store(self, pending: _Pending) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.times.clear()
        self.paths.clear()
        if pending.first is not None:
            self.times.update((pending.first, pending.last))
            for path, value in pending.paths.items():
                self.paths.updateValue((path,), value)
            self.handle.registerTimer(pending.flush)

    def _frame(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame([(key[0], *r) for r in rows], columns=["root", *(n for n, _ in _ROWS)])
            for c in ("start", "flush"):
                out[c] = pd.to_datetime(out[c], unit="ms")
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pending, out = self._load(), []
        now = None if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        events = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "event_id"], kind="stable")
        for path, type_, ms in zip(events["path"], events["type"], events["ms"]):
            out += pending.add(int(ms) if now is None else now, path, type_)
        self._store(pending)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = self._load()
        out = pending.take() if pending.first is not None and pending.flush <= expiredTimerInfo.getExpiryTimeInMs() else []
        self._store(pending)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, quiet: int = QUIET_MS, longest: int = LONGEST_MS, late: str | None = None) -> DataFrame:
    """``batches`` of a stream (root, path, type, ts, event_id), by arbitrary state with timers.

    Without ``late`` times are those of the machine when events arrive. With it they are the events' own, and a batch is
    handed on when the watermark, so much behind the latest event, has passed its time. The state store must be RocksDB's."""
    rows = stream.select("root", "path", "type", "ts", F.unix_millis("ts").alias("ms"), "event_id")
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("root").transformWithStateInPandas(
        _Debounce(quiet, longest, late is not None), "root string, start timestamp, flush timestamp, path string, type string, events long",
        "append", "eventtime" if late else "processingtime",
    )


#: The state store that timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, patterns: list[str] = (), trigger: str = QUIET, once: bool = False) -> StreamingQuery:
    """Call ``apply`` with each micro-batch's last event a path; batch ids let it skip one that it has seen."""

    def batch(events: DataFrame, number: int) -> None:
        apply(coalesced(events.where(eligible(list(patterns)))), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()
