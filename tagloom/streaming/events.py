"""File events: own writes, translation to changes, operation reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stateful import frame, plain, with_state

WRITE = "device string, directory string, seq long, op string, path string, to string, content_hash string"
FIELDS = [c.split()[0] for c in WRITE.split(", ")]


def suppress_self_writes(events: DataFrame, writes: DataFrame) -> DataFrame:
    """Events (device, directory, seq, op, path, to, content_hash) without those that an own
    write (device, directory, seq, path, content_hash) explains.

    A path has at most one record pending, the newest write before the event. Any create,
    remove, move in or whole rename that finds one uses it up and goes; a whole rename asks
    both its paths. A modify does so only if the hashes agree or one is unknown, or else the
    record stays. A move out asks nothing. seq orders events and writes of a device, a write
    before an event of the same seq, and is unique among its events. Rows without device,
    directory or seq match nothing and stay. Renames within a universal directory have no
    meaning and should be left out before."""
    key = ["device", "directory", "at_path"]
    asks = F.when((F.col("op") == "move") & F.col("to").isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array("path", "to"))))
    touches = events.select("device", "directory", "seq", F.lit(False).alias("own"), "op", "content_hash", F.explode(asks).alias("at_path"))
    records = writes.where("path is not null").select("device", "directory", "seq", F.lit(True).alias("own"), F.lit(None).cast("string").alias("op"), "content_hash", F.col("path").alias("at_path"))
    w = Window.partitionBy(*key).orderBy("seq", F.desc("own"), "content_hash")
    newest = F.last(F.when(F.col("own"), F.struct("seq", "content_hash")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    asked = touches.unionByName(records).withColumn("record", newest).where("not own and record is not null")
    fits = (F.col("op") != "modify") | F.coalesce(F.col("content_hash") == F.col("record.content_hash"), F.lit(True))
    before = F.count("*").over(Window.partitionBy(*key, "record.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    gone = asked.where(fits).withColumn("n", before).where("n = 1").select("device", "directory", "seq").distinct()
    return events.select(*FIELDS).join(gone, ["device", "directory", "seq"], "left_anti").select(*FIELDS)


class _Writes(StatefulProcessor):
    """The pending own writes of a directory as a map from path to hash: an event reads and
    changes the entries of its own paths and no others."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "path string", "content_hash string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for own, *event in sorted(plain(rows, ["own", *FIELDS]), key=lambda r: (r[3], not r[0])):
            _, _, _, op, path, to, digest = event
            if own:
                self.pending.updateValue((path,), (digest,))
                continue
            asks = [] if op == "move" and to is None else [p for p in dict.fromkeys((path, to)) if p is not None and self.pending.containsKey((p,))]
            used = [p for p in asks if op != "modify" or digest is None or (self.pending.getValue((p,))[0] or digest) == digest]
            for p in used:
                self.pending.removeKey((p,))
            if not used:
                out.append(tuple(event))
        if out:
            yield frame(out, WRITE)

    def close(self) -> None:
        pass


def stream_suppress(log: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """suppress_self_writes of one stream of events and own writes, told apart by a boolean
    column ``own``. The pending records of a directory are its state, one entry a path; with
    ``keep_ms`` a record that no event has used up goes after so much processing time. Agrees
    with the batch form as long as seq grows from batch to batch; rows without device,
    directory, seq or own and writes without a path are dropped."""
    known = log.where("device is not null and directory is not null and seq is not null and own is not null and (not own or path is not null)")
    processor = _Writes(keep_ms)
    return with_state(known.select(*FIELDS, "own"), ["device", "directory"], processor, WRITE, "Append", clock=keep_ms is not None)


def _above(path: Column) -> Column:
    """All directories that a path lies in, itself aside."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), "/")))


def events_to_changes(events: DataFrame, placements: DataFrame, dirs: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Changes (device, directory, seq, change, file_id, path, tags) for final events (device,
    directory, seq, op, path, to) by the kind of the directory and what is placed there.

    create and move in: a new file, with the directory's tags unless it is universal. Whole
    rename: nothing in a universal directory, else a move of the file, or of every file below
    a renamed directory. Move out: delete of the file, or of every file below. modify and
    remove: edit and delete; of a path that is not placed, ``rejected`` without a file_id. A
    path that is moved in and has files below it in ``listing`` (device, directory, path) is a
    directory and gives one new file each. Events of an unknown directory and of another op
    give nothing; new ids are derived from device, directory, seq and path."""
    where, keys = ["device", "directory"], ["device", "directory", "seq", "op", "path", "to", "kind", "tags"]
    e = events.select(*keys[:6]).join(F.broadcast(dirs.select(*where, "kind", "tags")), where)
    e = e.where(~((F.col("op") == "move") & F.col("path").isNotNull() & F.col("to").isNotNull() & (F.col("kind") == "universal")))
    known = placements.select(*where, F.col("physical_path").alias("path"), "file_id")
    old = e.where("path is not null and op <> 'create'").join(known, [*where, "path"], "left")
    hit = F.col("file_id").isNotNull()
    change = F.when(hit & (F.col("op") == "modify"), "edit").when(hit & ((F.col("op") == "remove") | F.col("to").isNull()), "delete").when(hit, "move").when(F.col("op").isin("modify", "remove"), "rejected")
    none = F.array().cast("array<string>")
    single = old.where(F.col("op").isin("modify", "remove", "move")).select(*where, "seq", change.alias("change"), "file_id", F.coalesce("to", "path").alias("path"), none.alias("tags")).where("change is not null")
    # every placed file under each directory above it, met by equal paths
    below = known.select(*where, F.col("path").alias("inner"), F.col("file_id").alias("inner_id"), F.explode(_above(F.col("path"))).alias("path")).where("path is not null")
    many = old.where("op = 'move' and file_id is null").join(below, [*where, "path"])
    moved = F.concat("to", F.expr("substring(inner, length(path) + 1)"))
    many = many.select(*where, "seq", F.when(F.col("to").isNull(), "delete").otherwise("move").alias("change"), F.col("inner_id").alias("file_id"), F.coalesce(moved, "inner").alias("path"), none.alias("tags"))
    fresh = e.where("op = 'create' or (op = 'move' and path is null and to is not null)").select(*where, "seq", "kind", "tags", F.coalesce("to", "path").alias("path"), (F.col("op") == "move").alias("inside"))
    if listing is not None:
        files = listing.select(*where, F.col("path").alias("inner"), F.explode(_above(F.col("path"))).alias("path"), F.lit(True).alias("inside")).where("path is not null")
        fresh = fresh.join(files, [*where, "path", "inside"], "left").withColumn("path", F.coalesce("inner", "path"))
    tags = F.when(F.col("kind") == "universal", none).otherwise(F.coalesce("tags", none))
    new = fresh.select(*where, "seq", F.lit("create").alias("change"), F.md5(F.concat_ws("\x1f", *where, F.col("seq").cast("string"), "path")).alias("file_id"), "path", tags.alias("tags"))
    return single.unionByName(many).unionByName(new)


def operations_state(events: DataFrame) -> DataFrame:
    """Latest state of each operation in events (op_id, kind, status, done, total, at); what
    comes after the first terminal status is ignored, a dropped handle is aborted."""
    ends = ["completed", "failed", "aborted", "dropped"]
    end = events.where(F.col("status").isin(ends)).groupBy("op_id").agg(F.min("at").alias("end"))
    real = events.join(end, "op_id", "left").where("end is null or at <= end")
    order = F.struct("at", F.col("status").isin(ends).alias("e"), "done")
    s = real.groupBy("op_id").agg(F.max_by(F.struct("kind", "status", "done", "total"), order).alias("v"), F.min("at").alias("started_at"), F.max("at").alias("at"))
    status = F.when(F.col("v.status") == "dropped", "aborted").otherwise(F.col("v.status"))
    return s.select("op_id", "v.kind", status.alias("status"), "v.done", "v.total", "started_at", "at", status.isin("completed", "failed", "aborted").alias("finished"))


def operation_report(events: DataFrame) -> DataFrame:
    """(kind, operations, completed, mean_ms, bytes, newest) of finished operations."""
    s = operations_state(events).where("finished")
    return s.groupBy("kind").agg(F.count("*").alias("operations"), F.count_if(F.col("status") == "completed").alias("completed"), F.avg(F.col("at") - F.col("started_at")).alias("mean_ms"), F.sum("done").alias("bytes"), F.max("at").alias("newest")).orderBy(F.desc("newest"))
