"""Coalescing of raw file events: one ordered queue per device, in batch and as a stream.

An event waits for the quiet time after its own time and is then final. While it waits, later
events of the same path may take it up. A device has one queue for all its directories."""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stateful import frame, plain, with_state

# Fixed value: an event is final so many ms after its own time.
QUIET = 500
EVENT = "device string, directory string, seq long, at long, op string, path string, to string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


class _Queue:
    """Waiting events (directory, seq, at, op, path, to) in order, indexed by op and path (by
    ``to`` for whole renames), so that each new event costs the same in a queue of any length."""

    def __init__(self, events: list = ()):
        self.waiting, self.index, self.count = OrderedDict(), defaultdict(list), 0
        for event in events:
            self._push(tuple(event))

    @staticmethod
    def _key(event: tuple) -> tuple | None:
        directory, _, _, op, path, to = event
        if op == "move":
            return (directory, op, to) if path is not None and to is not None else None
        return directory, op, path

    def _push(self, event: tuple) -> None:
        self.waiting[self.count] = event
        self.index[self._key(event)].append(self.count)
        self.count += 1

    def _drop(self, n: int) -> tuple:
        event = self.waiting.pop(n)
        key = self._key(event)
        self.index[key].remove(n)
        if not self.index[key]:
            del self.index[key]
        return event

    def _replace(self, n: int, op: str, path: str) -> None:
        """Another op and path for a waiting event, which keeps its place and time."""
        directory, seq, at, *_ = self.waiting[n]
        old = self._key(self.waiting[n])
        self.index[old].remove(n)
        self.waiting[n] = (directory, seq, at, op, path, None)
        places = self.index[directory, op, path]
        places.append(n)
        places.sort()

    def _last(self, directory: str, op: str, path: str) -> int | None:
        places = self.index.get((directory, op, path))
        return places[-1] if places else None

    def add(self, event: tuple) -> None:
        directory, _, _, op, path, to = event
        made = self._last(directory, "create", path)
        if op == "modify":
            if made is None and self._last(directory, "modify", path) is None:
                self._push(event)
        elif op == "remove":
            for n in list(self.index.get((directory, "modify", path), ())):
                if made is None or n > made:
                    self._drop(n)
            if made is not None:
                self._drop(made)
                return
            away = self._last(directory, "move", path)
            if away is not None:
                source = self.waiting[away][4]
                again = self._last(directory, "create", source)
                if again is not None and again > away:  # an editor's save
                    self._drop(away)
                    self._replace(again, "modify", source)
                    return
            self._push(event)
        elif op == "move" and path is not None and to is not None:
            halves = [n for n, _ in zip(reversed(self.waiting), range(2))]
            if len(halves) == 2:
                first, second = self.waiting[halves[1]], self.waiting[halves[0]]
                if (first[0], *first[3:]) == (directory, "move", path, None) and (second[0], *second[3:]) == (directory, "move", None, to):
                    for n in halves:
                        self._drop(n)
            if made is not None:
                self._replace(made, "create", to)
            else:
                self._push(event)
        else:
            self._push(event)

    def final(self, now: float) -> Iterator[tuple]:
        """Takes out the events whose quiet time is over at ``now``."""
        while self.waiting:
            n = next(iter(self.waiting))
            if now - self.waiting[n][2] <= QUIET:
                return
            yield self._drop(n)


def _usable(df: DataFrame) -> DataFrame:
    whole = F.col("op").isin("create", "modify", "remove") & F.col("path").isNotNull() | (F.col("op") == "move") & F.coalesce("path", "to").isNotNull()
    return df.where(whole & F.col("device").isNotNull() & F.col("at").isNotNull()).select(*COLUMNS)


def coalesce_events(df: DataFrame) -> DataFrame:
    """Final events of a table (device, directory, seq, at, op, path, to). A rename may be
    half: without ``to`` the path left the directory, without ``path`` it came in.

    In order of at and seq: a remove takes out waiting modifies of its path, and cancels a
    waiting create; rename away, create and remove (an editor's save) is a modify; two halves
    directly before their whole rename go; a create takes up a rename and later modifies;
    repeated modifies are one. Events of another op, without device or time, or without any
    path are dropped; other columns are not read; an empty table gives none.

    A device's events are cut where a whole half second has none: nothing waits beyond it.
    The cuts come from one row for each half second, and a task holds what waits, no more."""
    known = _usable(df).withColumn("slot", F.floor(F.col("at") / QUIET))
    w = Window.partitionBy("device").orderBy("slot")
    slots = known.select("device", "slot").distinct()
    fresh = F.coalesce((F.col("slot") - F.lag("slot").over(w) > 1).cast("long"), F.lit(0))
    runs = slots.withColumn("fresh", fresh).select("device", "slot", F.sum("fresh").over(w).alias("run"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queue, done = None, _Queue(), []
        for batch in batches:
            for device, run, *event in zip(*(c.to_pylist() for c in batch.columns)):
                if (device, run) != key:
                    done += [(key[0], *e) for e in queue.final(float("inf"))] if key else []
                    key, queue = (device, run), _Queue()
                done += [(device, *e) for e in queue.final(event[2])]
                queue.add(tuple(event))
            yield _batch(done)
            done = []
        yield _batch([(key[0], *e) for e in queue.final(float("inf"))] if key else [])

    parts = known.join(runs, ["device", "slot"]).select("device", "run", *COLUMNS[1:]).repartition("device", "run")
    return parts.sortWithinPartitions("device", "run", "at", "seq").mapInArrow(settle, EVENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if " long" in c else pa.string() for c in EVENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], COLUMNS)


class _Waiting(StatefulProcessor):
    """What waits in a device's queue, as a list of events. A device's clock is the time of
    its own events; a timer gives out what is left when nothing comes from it any more."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT.partition(", ")[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue, done = _Queue([tuple(e) for e in self.waiting.get()]), []
        for event in sorted(plain(rows, COLUMNS[1:]), key=lambda e: (e[2], e[1] is not None, e[1])):
            done += queue.final(event[2])
            queue.add(event)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if queue.waiting:
            self.waiting.put(list(queue.waiting.values()))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        else:
            self.waiting.clear()
        if done:
            yield frame([(*key, *e) for e in done], EVENT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = [(*key, *e) for e in self.waiting.get()]
        self.waiting.clear()
        if done:
            yield frame(done, EVENT)

    def close(self) -> None:
        pass


def stream_coalesce(events: DataFrame, idle: int = 10 * QUIET) -> DataFrame:
    """coalesce_events of a stream, with what waits as a device's state. An event is given
    out when a later event of its own device is past its quiet time, or when nothing has come
    from the device for ``idle`` ms of processing time, which should be longer than a batch
    takes. There is no watermark: devices may lag behind each other by any time. Agrees with
    the batch form as long as at grows from batch to batch within a device."""
    return with_state(_usable(events), ["device"], _Waiting(idle), EVENT, "Append", clock=True)
