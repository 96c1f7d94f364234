"""A catalog table that follows a change stream: base files and the changes since.

Below ``top`` lie ``base-N`` (the whole table after batch N) and ``delta-L-A-N`` (what the
batches A to N changed, of level L), each dealt to folders by bucket of the key. A batch
writes its own changes only. FAN deltas of one level become one of the next level, and when
the deltas weigh a share of the base, a new base is written; so a row is rewritten a few
times, not once a batch. The newest KEEP bases stay for those who still read them.

Every folder is complete when its _SUCCESS file is there. What replaces others is written
before those go, and reading prefers it, so a stop at any point loses nothing; a batch that
runs again finds its changes already in or writes the same folder again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import delete

FAN, SHARE, KEEP, BUCKETS = 8, 0.5, 2, 8


@dataclass(frozen=True)
class Part:
    name: str
    level: int  # -1 for a base
    first: int
    last: int
    size: int


class Snapshots:
    """``merge(base, changes)`` is a last-writer-wins merge over ``keys``; ``schema`` is the
    table's."""

    def __init__(self, spark: SparkSession, top: str, keys: list[str], schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame], fan: int = FAN, share: float = SHARE, keep: int = KEEP, buckets: int = BUCKETS):
        self.spark, self.top, self.keys, self.schema, self.merge = spark, top.rstrip("/"), keys, schema, merge
        self.fan, self.share, self.keep, self.buckets = fan, share, keep, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")

    def parts(self) -> list[Part]:
        """All complete folders. One file status a folder, as many as bases and deltas."""
        root = self._path("")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        out = []
        for status in fs.listStatus(root):
            kind, *numbers = status.getPath().getName().split("-")
            if kind in ("base", "delta") and fs.exists(self._path(f"{status.getPath().getName()}/_SUCCESS")):
                level, first, last = (-1, 0, int(numbers[0])) if kind == "base" else map(int, numbers)
                out.append(Part(status.getPath().getName(), level, first, last, fs.getContentSummary(status.getPath()).getLength()))
        return out

    def _chosen(self, before: int | None = None) -> list[Part]:
        """The folders that make up the table (after the last batch below ``before``): the
        newest base, then for each stretch of batches the widest delta, in order."""
        known = [p for p in self.parts() if before is None or p.last < before]
        base = max((p for p in known if p.level < 0), key=lambda p: p.last, default=None)
        out, at = [base] if base else [], base.last if base else -1
        for p in sorted((p for p in known if p.level >= 0), key=lambda p: (p.first, -p.last)):
            if p.first > at:
                out.append(p)
                at = p.last
        return out

    def last_batch(self) -> int | None:
        return max((p.last for p in self.parts()), default=None)

    def _load(self, part: Part) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.top}/{part.name}").drop("bucket")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table, or as it was before a batch; None where there is none yet. The plan has
        one merge for each delta since the base, FAN - 1 a level at most."""
        out = None
        for part in self._chosen(before):
            out = self._load(part) if out is None else self.merge(out, self._load(part))
        return out

    def _write(self, df: DataFrame, name: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        df.withColumn("bucket", bucket).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.top}/{name}")

    def add(self, changes: DataFrame, batch: int) -> None:
        """Takes over a batch. An empty one leaves an empty delta, so that its number is known."""
        if any(p.last >= batch and (p.level != 0 or p.first != batch) for p in self.parts()):
            return  # already in a later base or delta
        self._write(self.merge(changes.limit(0), changes), f"delta-0-{batch}-{batch}")
        self._compact()

    def _compact(self) -> None:
        parts = self._chosen()
        deltas = [p for p in parts if p.level >= 0]
        base = parts[0].size if parts and parts[0].level < 0 else 0
        if len(deltas) > 1 and sum(p.size for p in deltas) >= self.share * base and (base or len(deltas) >= self.fan):
            self._write(self.read(), f"base-{deltas[-1].last}")
            self._retain()
            return
        tail = deltas[-self.fan:]
        if len(tail) == self.fan and len({p.level for p in tail}) == 1:
            merged = self._load(tail[0])
            for part in tail[1:]:
                merged = self.merge(merged, self._load(part))
            self._write(merged, f"delta-{tail[0].level + 1}-{tail[0].first}-{tail[-1].last}")

    def _retain(self) -> None:
        bases = sorted((p for p in self.parts() if p.level < 0), key=lambda p: p.last)
        if len(bases) < self.keep:
            return
        oldest = bases[-self.keep].last
        for part in self.parts():
            if part.last < oldest or part.level >= 0 and part.last <= oldest:
                delete(self.spark, f"{self.top}/{part.name}")

    def changed_keys(self, batch: int) -> DataFrame:
        """The keys that a batch wrote. They are known until a compaction takes them up."""
        return self._load(Part(f"delta-0-{batch}-{batch}", 0, batch, batch, 0)).select(*self.keys)


class Journal:
    """The last batch that a consumer has had, beside the data: it survives a restart."""

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def last(self) -> int | None:
        fs, root = self._files()
        done = [int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()] if fs.exists(root) else []
        return max(done, default=None)

    def record(self, batch: int) -> None:
        """An empty file named by the batch; older ones go after it is there."""
        fs, root = self._files()
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(root, str(batch)), True).close()
        if fs.exists(root):
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if name.isdigit() and int(name) < batch:
                    fs.delete(status.getPath(), False)


def change_feed(emit: Callable[[int, str, DataFrame], None], snapshot: Callable[[], DataFrame], journal: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that passes batches on; where a batch id was skipped, before
    or after a restart, it first gives a snapshot under the mark ``resynced``. A batch that
    the journal has is not passed on again; one that stopped half way is (at least once)."""

    def batch(df: DataFrame, number: int) -> None:
        log = Journal(df.sparkSession, journal)
        last = log.last()
        if last is not None and number <= last:
            return
        if last is not None and number > last + 1:
            emit(number, "resynced", snapshot())
        emit(number, "changes", df)
        log.record(number)

    return batch
