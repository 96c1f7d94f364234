"""Difference-cover sort of suffixes, as far as their first ``length`` bytes decide.

Of three places in a row two are sampled: those that leave 1 or 2 on division by 3. Sampled
places are sorted by triples of words of bytes, and the ranks of the triples are their names.
The next round sorts triples of names, which reach three times as far, and so on until three
names span a window. A place that is not sampled is merged in by its first bytes and the
names that follow: any two places have a shift of 0, 1 or 2 after which both are sampled, so
all windows are compared at three shifts, each with its own two kinds of places. What is
compared are bytes and names of equal bytes, no hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

WORD = 8
SHIFTS = ((1, 2), (0, 1), (0, 2))  # for each shift the places modulo 3 that are sampled after it
HEAD, TAIL = 2, 4  # bytes of a window beside its names, at most


class Reach:
    """Which bytes names stand for. ``rounds`` holds the step between the names of a triple
    for each round after the first; in the end the three names of a window start at
    ``offsets`` and leave two to four bytes over."""

    def __init__(self, length: int):
        if length < 5:
            raise ValueError("windows have at least five bytes")
        self.length, self.word, self.rounds = length, min(WORD, (length - 2) // 3), []
        reach = 3 * self.word
        while 3 * reach < length - 2:
            self.rounds.append(reach)
            reach *= 3
        last = (length - 2 - reach) // 3 * 3
        self.offsets = (0, min(reach, last), last)
        self.end = last + reach
        self.masks = [sum(0xFF << 8 * (HEAD + TAIL - 1 - k) for k in (*range(d), *range(HEAD + d, HEAD + TAIL))) for d in range(3)]

    def needed(self, at: np.ndarray) -> np.ndarray:
        """The sampled places whose triples the windows at ``at`` need."""
        for steps in ((0, 1, 2), self.offsets, *[(0, r, 2 * r) for r in self.rounds]):
            at = np.unique(at[:, None] + np.array(steps))
        return at[at % 3 != 0]

    def edge(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bytes of windows that names may leave over, packed."""
        out = np.zeros(len(at), np.int64)
        for k in (0, 1, *range(self.end, self.end + TAIL)):
            out = out << 8 | (data[at + k] if k < self.length else 0)
        return out

    def words(self, data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(k * self.word, (k + 1) * self.word):
            out = out << np.uint64(8) | data[at + j].astype(np.uint64)
        return (out ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the order of the bytes


def triples(reach: Reach):
    """Function of a text and its ranges (a, b, n): columns at, n, edge, k0, k1, k2 of the
    windows (n above 0) and of the sampled places that they need (with their words)."""

    def make(text: bytes, ranges: list[dict]) -> tuple[np.ndarray, ...]:
        data = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(WORD * 3 + TAIL, np.uint8)]).astype(np.int64)
        starts = np.concatenate([np.arange(r["a"], r["b"] + 1) for r in ranges])
        count = np.concatenate([np.full(r["b"] - r["a"] + 1, r["n"]) for r in ranges])
        sampled = reach.needed(starts)
        at = np.union1d(starts, sampled)
        n, edge = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        i = np.searchsorted(at, starts)
        n[i], edge[i] = count, reach.edge(data, starts)
        words = [np.zeros(len(at), np.int64) for _ in range(3)]
        i = np.searchsorted(at, sampled)
        for k, w in enumerate(words):
            w[i] = reach.words(data, sampled, k)
        return at, n, edge, *words

    return make


def _batch(**cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of triples that come in order: equal ones share a name, later ones have a
    larger one, and the partitions follow each other in the order of their triples."""
    name, before = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        if not batch.num_rows:
            continue
        row, at, *k = [c.to_numpy() for c in batch.columns]
        new = np.zeros(len(row), bool)
        for x in k:
            new[1:] |= x[1:] != x[:-1]
        new[0] = before != tuple(int(x[0]) for x in k)
        names = name + np.cumsum(new)
        name, before = int(names[-1]), tuple(int(x[-1]) for x in k)
        yield _batch(row=row, at=at, name=names)


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by row, cut only between rows."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        cols = [np.concatenate(both) for both in zip(held, cols)] if held else cols
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held:
        yield held


def _spots(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One ascending number for each place of the given rows."""
    new = np.zeros(len(row), np.int64)
    new[1:] = row[1:] != row[:-1]
    return np.cumsum(new) << 32 | at.astype(np.int64)


def _next_triples(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, at, name in _whole_rows(batches):
            spots = _spots(row, at)
            i = [np.minimum(np.searchsorted(spots, spots + k * step), len(spots) - 1) for k in (1, 2)]
            ok = (spots[i[0]] == spots + step) & (spots[i[1]] == spots + 2 * step)
            yield _batch(row=row[ok], at=at[ok], k0=name[ok], k1=name[i[0]][ok], k2=name[i[1]][ok])

    return run


def _keys(reach: Reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, at, n, name, edge in _whole_rows(batches):
            spots = _spots(row, at)
            for shift, kinds in enumerate(SHIFTS):
                w = np.flatnonzero((n > 0) & np.isin(at % 3, kinds))
                k = [name[np.searchsorted(spots, spots[w] + shift + o)] for o in reach.offsets]
                yield _batch(shift=np.full(len(w), shift, np.int32), row=row[w], at=at[w], n=n[w], edge=edge[w] & reach.masks[shift], k0=k[0], k1=k[1], k2=k[2])

    return run


def repeated(places: DataFrame, length: int) -> DataFrame:
    """(row, at) of the windows of places with n = 1 whose bytes another window has as well.

    places is what triples() makes, with the row of each text. A window with n above 1 takes
    part, but is not given out. Writes tables named repeats-*; an empty table gives none."""
    reach = Reach(length)
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def named(keys: DataFrame) -> DataFrame:
        ordered = keys.repartitionByRange(tasks, "k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2")
        return stage(ordered.mapInArrow(_number, "row long, at int, name long"), "repeats-names")

    names = named(places.where("at % 3 <> 0").select("row", "at", "k0", "k1", "k2"))
    for step in reach.rounds:
        by_row = names.repartition(tasks, "row").sortWithinPartitions("row", "at")
        further = stage(by_row.mapInArrow(_next_triples(step), "row long, at int, k0 long, k1 long, k2 long"), "repeats-triples")
        discard(places.sparkSession, "repeats-names")
        names = named(further)
        discard(places.sparkSession, "repeats-triples")
    none = F.lit(0).cast("long")
    windows = places.where("n > 0").select("row", "at", "n", none.alias("name"), "edge")
    merged = names.select("row", "at", F.lit(0).alias("n"), "name", none.alias("edge")).unionByName(windows)
    # a sampled place comes before the window that starts there
    merged = merged.repartition(tasks, "row").sortWithinPartitions("row", "at", "n")
    keys = stage(merged.mapInArrow(_keys(reach), "shift int, row long, at int, n int, edge long, k0 long, k1 long, k2 long"), "repeats-keys")
    discard(places.sparkSession, "repeats-names", "repeats-places")
    key = ["k0", "k1", "k2", "edge"]
    out = None
    for shift in range(len(SHIFTS)):
        now = keys.where(F.col("shift") == shift)
        again = now.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").select(*key)
        found = stage(now.where("n = 1").join(again, key, "left_semi").select("row", "at"), "repeats-single")
        out = found if out is None else out.unionByName(found)
    discard(places.sparkSession, "repeats-keys")
    return out.distinct()
