"""Keyed state over streams: file state, operations, and requests with their replies.

Each fold keeps a few values per key. Its batch twin runs the same rules over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunks import KEY, TTL
from ..operators.folds import fold_sorted
from .stateful import fold_by_key, frame, plain, with_state

FILE_STATE = "born boolean, path string, path_at long, version long, hash string, observed_at long, deleted boolean, deleted_at long, restored_at long"
FILE_OUT = "file_id string, logical_path string, logical_path_modified_at long, version_number long, content_hash string, observed_at long, deleted boolean, deleted_at long, restored_at long"


def _fold_files(now: tuple | None, key: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    born, path, path_at, version, digest, observed, deleted, deleted_at, restored_at = now or (False, None, None, 0, None, 0, False, 0, 0)
    for _, op, to, content, at in sorted(rows, key=lambda r: r[0]):
        if op == "add" and not born or op == "move" and born and at > path_at:
            born, path, path_at = True, to, at
        elif op == "edit" and (content is None or content != digest):
            if content is not None:
                version, digest = version + 1, content
            observed, deleted = at, deleted and at <= deleted_at
        elif op == "delete" and not deleted and at > max(observed, restored_at):
            deleted, deleted_at = True, at
        elif op == "restore":
            restored_at = max(restored_at, at)
            deleted = deleted and restored_at <= deleted_at
    out = [(*key, path, path_at, version, digest, observed, deleted, deleted_at, restored_at)] if born else []
    return (born, path, path_at, version, digest, observed, deleted, deleted_at, restored_at), out


def stream_files(changes: DataFrame) -> DataFrame:
    """Latest state of each file of a stream (seq, file_id, op, path, content_hash, at); op
    add, move, edit, delete, restore.

    Agrees with replay_paths and replay_tombstones as long as seq grows from batch to batch.
    An edit to the latest content again changes nothing; any other with a hash is one more
    version. A file is given out from its first add on. Rows without file_id, seq or at are
    ignored."""
    known = changes.where("file_id is not null and seq is not null and at is not null")
    return fold_by_key(known, ["file_id"], _fold_files, ["seq", "op", "path", "content_hash", "at"], FILE_STATE, FILE_OUT)


# Statuses that end an operation.
ENDS = ("completed", "failed", "aborted", "dropped")
OPERATION_OUT = "op_id string, kind string, status string, done long, total long, started_at long, at long, finished boolean"


def _fold_operations(now: tuple | None, key: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    for at, end, done, kind, status, total in sorted(((at, status in ENDS, done, kind, status, total) for at, status, done, total, kind in rows), key=lambda r: (r[0], r[1], r[2] is not None, r[2])):
        if now is not None and now[6]:
            break
        now = (kind, "aborted" if status == "dropped" else status, done, total, at if now is None else now[4], at, end)
    return now, [(*key, *now)]


def stream_operations(events: DataFrame) -> DataFrame:
    """Latest state of each operation of a stream (op_id, kind, status, done, total, at);
    what comes after its end is ignored. Agrees with operations_state as long as at grows
    from batch to batch. Rows without op_id, status or at are ignored."""
    known = events.where("op_id is not null and status is not null and at is not null")
    return fold_by_key(known, ["op_id"], _fold_operations, ["at", "status", "done", "total", "kind"], OPERATION_OUT.partition(", ")[2], OPERATION_OUT)


REQUEST_KEY = [*KEY, "offset"]
REQUEST_STATE = "opened_at long, waiting array<string>, left array<string>, asked int"
REQUEST_OUT = "file_id string, content_hash string, offset long, opened_at long, closed_at long, outcome string, waiting int, asked int"
# Order of messages of one time.
RANK = {"request": 0, "ask": 1, "data": 2, "miss": 3, "drop": 4}


def _correlate(entry: tuple | None, messages: list[tuple], ttl: int = TTL) -> tuple[tuple | None, list[tuple]]:
    """The open request of one key after messages (at, msg, link), and the requests that they
    closed as (opened_at, closed_at, outcome, waiting, asked)."""
    closed: list[tuple] = []
    for at, msg, link in sorted(messages, key=lambda m: (m[0], RANK[m[1]], m[2])):
        outcome = None
        if entry and at >= entry[0] + ttl:
            closed.append(_expired(entry, ttl))
            entry = None
        if entry is None:
            if msg == "request":
                entry = (at, [link], [], 0)
            continue
        opened, waiting, left, asked = entry
        if msg == "request":
            waiting = waiting + [link]
        elif msg == "ask":
            left, asked = left + [link], asked + 1
        elif msg == "data":
            outcome = "data"
        else:
            left = [x for x in left if x != link]
            if msg == "drop":
                waiting = [x for x in waiting if x != link]
            if not waiting:
                outcome = "abandoned"
            elif asked and not left:
                outcome = "missed"
        entry = (opened, waiting, left, asked)
        if outcome:
            closed.append((opened, at, outcome, len(waiting), asked))
            entry = None
    return entry, closed


def _expired(entry: tuple, ttl: int) -> tuple:
    return entry[0], entry[0] + ttl, "expired", len(entry[1]), entry[3]


def _answers(key: tuple, closed: list[tuple]) -> pd.DataFrame:
    return frame([(*key, *c) for c in closed], REQUEST_OUT)


def _messages(log: DataFrame) -> DataFrame:
    return log.where(F.col("msg").isin(*RANK) & F.col("at").isNotNull()).select(*REQUEST_KEY, "at", "msg", F.coalesce("link", F.lit("")).alias("link"))


def request_outcomes(log: DataFrame, now: int | None = None, ttl: int = TTL) -> DataFrame:
    """Closed requests of a log (file_id, content_hash, offset, at, msg, link) up to ``now``:
    opened_at, closed_at, outcome, how many waited and how many upstreams were asked. Without
    ``now`` the clock of a key is the time of its last message.

    The first request opens, later ones within the time to live join without extending it.
    Data closes it for all; a miss or a dropped link takes an upstream away, and it is missed
    when none is left; it is abandoned when nobody waits any more, expired after its time.
    Replies to no open request are ignored, as are other messages and rows without a time.
    The messages of a key pass in order; only its open request is kept."""

    def run(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        entry = None
        for row in rows:
            entry, closed = _correlate(entry, [row[:3]], ttl)
            yield from ((*key, *c) for c in closed)
        if entry and now is not None and entry[0] + ttl <= now:
            yield (*key, *_expired(entry, ttl))

    known = _messages(log).withColumn("at", F.col("at").cast("long"))
    rank = F.coalesce(*[F.when(F.col("msg") == m, F.lit(k)) for m, k in RANK.items()])
    known = (known if now is None else known.where(F.col("at") <= now)).select(*REQUEST_KEY, "at", "msg", "link", rank.alias("rank"))
    return fold_sorted(known, REQUEST_KEY, ["at", "rank", "link"], run, REQUEST_OUT)


class _Requests(StatefulProcessor):
    """The open request of a key, and a timer that runs for its time to live from when it was
    first seen; requests that join do not start it anew."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", f"{REQUEST_STATE}, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.entry.get()) if self.entry.exists() else None
        before = (old[0], list(old[1]), list(old[2]), old[3]) if old else None
        entry, closed = _correlate(before, plain(rows, ["at", "msg", "link"]), self.ttl)
        timer = old[4] if old else None
        if old and (closed or entry is None):
            self.handle.deleteTimer(timer)
            timer = None
        if entry:
            if timer is None:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.ttl
                self.handle.registerTimer(timer)
            self.entry.update((*entry, timer))
        elif old:
            self.entry.clear()
        if closed:
            yield _answers(tuple(key), closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            closed = _expired(tuple(self.entry.get()), self.ttl)
            self.entry.clear()
            yield _answers(tuple(key), [closed])

    def close(self) -> None:
        pass


def stream_requests(log: DataFrame, ttl: int = TTL) -> DataFrame:
    """request_outcomes of a stream. There is no watermark: a message counts whenever it
    comes. A request expires by the time of a later message of its own key, or when ``ttl``
    ms have gone by on the processing clock since it was first seen, which joining requests
    do not extend. Agrees with the batch form as long as at grows from batch to batch within
    a key and batches come faster than ``ttl``."""
    return with_state(_messages(log), REQUEST_KEY, _Requests(ttl), REQUEST_OUT, "Append", clock=True)
