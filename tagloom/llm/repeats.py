"""Removal of byte strings that repeat anywhere in the corpus.

A window of 200 bytes repeats if the same bytes start at another place too. Ranges of
windows that share a key are narrowed down, so that only what may repeat is looked at:

1. leaders: each window has one leading 32-byte gram (the smallest hash in it); a window
   can only repeat if its leader occurs twice;
2. cores: each window's bytes from its first to its last anchor (smallest hashes of its
   first and last part) must occur twice;
3. blocks: windows of one core are cut at the same distances from the core, into blocks of
   16 and then of 2 windows; the bytes that all windows of a block hold must occur twice;
4. windows: what is left is compared by a difference-cover sort of the windows' suffixes.

At each step ranges whose whole bytes (the cover) are equal repeat as a whole and are
settled by one key, a cryptographic digest of the bytes; one of them goes on to be compared
with the others of its key, if that has different covers. Ranges that are alone with their
key end there. Equal windows have equal leaders, cores at equal offsets and equal blocks, so
nothing is missed, and a chance collision of a key only leaves more to compare. Texts with a
repeated leader are written once, bucketed by row; later joins read them in place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, discard, scratch, shared_dir, shuffles_given_up, stage, table
from .suffix_sort import Reach, repeated, triples

LENGTH = 200
BLOCKS = (16, 2)
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone modulo 2^64
BYTES = np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64)
_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers and inverse powers of the base up to n at least, kept for the next text."""
    if not _TABLES or len(_TABLES[0]) <= n:
        size = 1 << max(16, n.bit_length())
        _TABLES[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _TABLES


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) if x.dtype == np.int64 else x
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """64-bit hashes of any ranges of one text, from sums of powers modulo 2^64."""

    def __init__(self, data: bytes):
        x = np.frombuffer(data, np.uint8)
        self.n = len(x)
        power, self.inverse = _tables(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(BYTES[x] * power[: self.n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """The hash of each ``size`` bytes."""
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: self.n - size + 1] + np.uint64(size))


def _anchors(h: Hashes, gram: int, span: int) -> np.ndarray:
    """For each start of ``span`` bytes the place of the smallest gram hash within them."""
    at = np.arange(h.n - gram + 1)
    packed = (h.grams(gram) >> np.uint64(32) << np.uint64(31)) | at.astype(np.uint64)
    width, have = span - gram + 1, 1
    out = packed
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return (out & np.uint64((1 << 31) - 1)).astype(np.int64)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run in which all keys stay the same."""
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(change)
    return first, np.append(first[1:], len(change)) - 1


def _lists(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each row's list of ranges, an array each."""
    at = column.offsets.to_numpy().tolist()
    fields = {f.name: column.values.field(k).to_numpy() for k, f in enumerate(column.type.value_type)}
    for a, b in zip(at, at[1:]):
        yield {k: v[a:b] for k, v in fields.items()}


def _rows(schema: pa.Schema, make):
    """A mapInArrow function: make(text, ranges) gives the columns of a text's rows, the
    row's number excepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out: list[list] = [[] for _ in schema]
            n = 0
            for row, text, ranges in zip(batch.column(0).to_pylist(), texts, _lists(batch.column(2))):
                got = make(text, ranges)
                out[0].append(np.full(len(got[0]), row))
                for o, g in zip(out[1:], got):
                    o.append(g)
                n += len(got[0])
                if n > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(f.type.to_pandas_dtype())) for o, f in zip(out, schema)], schema=schema)
                    out, n = [[] for _ in schema], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(f.type.to_pandas_dtype())) for o, f in zip(out, schema)], schema=schema)

    return run


def _leaders(length: int, gram: int, schema: pa.Schema, together: int = 1 << 15):
    """A mapInArrow function of (row, text): leaders with the first and last window that each
    has. Short texts are hashed together, windows over their ends left out."""

    def of(rows: list[int], texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        h = Hashes(b"".join(texts))
        lead = _anchors(h, gram, length)
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(lead)]
        at = np.flatnonzero(np.arange(len(lead)) + length <= ends[owner])
        i, j = _runs(lead[at], owner[at])
        a, b, owner = at[i], at[j], owner[at[i]]
        begin, first = (ends - sizes)[owner], lead[a]
        cols = (np.array(rows)[owner], h(first, first + gram).view(np.int64), (a - begin).astype(np.int32), (b - begin).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, size = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if len(text) >= length:
                    rows.append(row)
                    texts.append(text)
                    size += len(text)
                if size > together:
                    yield of(rows, texts)
                    rows, texts, size = [], [], 0
        if rows:
            yield of(rows, texts)

    return run


def _schema(**cols: str) -> pa.Schema:
    return pa.schema([("row", pa.int64())] + [(k, {"long": pa.int64(), "int": pa.int32()}[v]) for k, v in cols.items()])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)


#: Ranges of windows that share a key: first is the place that the distances of its windows
#: count from, n the number of ranges that this one stands for (2 for more than that too).
RANGES = _schema(key="long", cover="long", cover2="long", a="int", b="int", first="int", n="int")


def _digests(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    whole = b"".join([hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(whole, np.int64).reshape(-1, 2)


def _leader_ranges(length: int):
    def make(text: bytes, ranges: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        a, b = ranges["a"], ranges["b"]
        cover = _digests(text, a, b + length)
        return ranges["g"], cover[:, 0], cover[:, 1], a, b, a, np.ones(len(a), np.int64)

    return make


def _core_ranges(length: int, core: int, span: int):
    def make(text: bytes, ranges: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        h = Hashes(text)
        ends = _anchors(h, core, span)
        order = np.argsort(ranges["a"])
        a, size = ranges["a"][order].astype(np.int64), (ranges["b"] + 1 - ranges["a"])[order]
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        n = np.repeat(ranges["n"][order], size)
        first, last = ends[at], ends[at + length - span]
        i, j = _runs(first, last, n, at - np.arange(len(at)))
        a, b, first, last = at[i], at[j], first[i], last[i]
        cover = _digests(text, a, b + length)
        return h(first, last + core).view(np.int64), cover[:, 0], cover[:, 1], a, b, first, n[i]

    return make


def _block_ranges(length: int, size: int):
    def make(text: bytes, ranges: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        a, b, first = (ranges[k].astype(np.int64) for k in ("a", "b", "first"))
        start = first + (a - first) // size * size
        blocks = (b - start) // size + 1
        i = np.repeat(np.arange(len(a)), blocks)
        start = start[i] + size * (np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        a, b = np.maximum(a[i], start), np.minimum(b[i], start + size - 1)
        # all windows of a block hold the bytes from the last start to the first end
        inner, cover = _digests(text, start + size - 1, start + length), _digests(text, a, b + length)
        return inner[:, 0], cover[:, 0], cover[:, 1], a, b, first[i], ranges["n"][i]

    return make


def _settled(ranges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of ranges those that repeat as a whole (row, a, b), and one range for each cover of the
    keys that have several covers, as lists: (row, ranges)."""
    ranges = stage(ranges, f"repeats-{name}")
    one = [F.first(k).alias(k) for k in ("key", "row", "a", "b", "first")]  # of one and the same range, whichever; fixed once it is written
    classes = ranges.groupBy("cover", "cover2").agg(*one, F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.count("*").alias("m"))
    classes = stage(classes, "repeats-classes")
    again = classes.where("m > 1").select("cover", "cover2")
    whole = stage(ranges.where("n = 1").select("cover", "cover2", "row", "a", "b").join(again, ["cover", "cover2"], "left_semi").select("row", "a", "b"), f"repeats-whole-{name}")
    discard(ranges.sparkSession, f"repeats-{name}")
    mixed = classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    apart = classes.join(mixed, "key", "left_semi").select("row", F.struct("a", "b", "first", "n").alias("r")).groupBy("row").agg(F.collect_list("r").alias("ranges"))
    apart = stage(apart, f"repeats-apart-{name}")
    discard(ranges.sparkSession, "repeats-classes")
    return whole, apart


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it starts at another place
    of the corpus too, the same text included; all is judged on the input. A null text is
    empty; texts shorter than ``length`` keep all. Repeated rows are copies of each other.
    Other columns are not read."""
    spark = docs.sparkSession
    name = f"repeats_{uuid.uuid4().hex}"
    try:
        with scratch(spark) as keep:
            return keep(_remove_repeats(docs, length, name), "repeats")
    finally:  # the bucketed texts go with the other steps' tables
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, f"{shared_dir(spark)}/{name}")


def _remove_repeats(docs: DataFrame, length: int, name: str) -> DataFrame:
    spark = docs.sparkSession
    gram, core = max(4, length * 4 // 25), max(4, length // 25)  # 32 and 8 bytes of 200
    span = length // 2 + 4
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbered once and written: a repeated scan may split the files in another way
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(numbered, "repeats-rows")
    digests = stage(rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256")), "repeats-digests")

    schema = _schema(g="long", a="int", b="int")
    led = stage(rows.select("row", "text").mapInArrow(_leaders(length, gram, schema), _ddl(schema)), "repeats-leaders")
    # both written by themselves: a leader that a third of all texts hold can then be split
    # in the join, and the shuffles of each step are gone before the next one starts
    twice = stage(led.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "repeats-twice")
    ranges = stage(led.join(twice, "g", "left_semi").groupBy("row").agg(F.collect_list(F.struct("g", "a", "b")).alias("ranges")), "repeats-ranges")

    # rows that may lose something, bucketed by number: later joins read them in place
    found = rows.join(ranges, "row")
    with shuffles_given_up(spark):
        found.write.bucketBy(buckets, "row").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    corpus = spark.table(name)
    discard(spark, "repeats-rows", "repeats-leaders", "repeats-twice", "repeats-ranges")

    texts = corpus.select("row", "text")
    lost, apart = _settled(corpus.select("row", "text", "ranges").mapInArrow(_rows(RANGES, _leader_ranges(length)), _ddl(RANGES)), "leader-ranges")
    for step, make in (("cores", _core_ranges(length, core, span)), *[(f"blocks{size}", _block_ranges(length, size)) for size in BLOCKS]):
        whole, apart = _settled(texts.join(apart, "row").mapInArrow(_rows(RANGES, make), _ddl(RANGES)), step)
        lost = lost.union(whole)

    schema = _schema(at="int", n="int", edge="long", k0="long", k1="long", k2="long")
    sort = triples(Reach(length))

    def windows(text: bytes, ranges: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        return sort(text, [dict(zip("abn", r)) for r in zip(*(ranges[k].tolist() for k in "abn"))])

    places = texts.join(apart, "row").mapInArrow(_rows(schema, windows), _ddl(schema))
    single = repeated(stage(places, "repeats-places"), length).select("row", F.col("at").alias("a"), F.col("at").alias("b"))
    lost = lost.union(single)
    gone = lost.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), _lists(batch.column(2))):
                data = np.frombuffer(text, np.uint8)
                edge = np.bincount(ranges["a"], minlength=len(data) + 1) - np.bincount(ranges["b"] + length, minlength=len(data) + 1)
                off = np.cumsum(edge)[:-1] > 0
                cols[0].append(len(data))
                cols[1].append(int(off.sum()))
                cols[2].append(int((off[1:] & ~off[:-1]).sum() + off[:1].sum()))
                cols[3].append(hashlib.sha256(data[~off].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3])], schema=out)

    changed = corpus.drop("ranges").join(gone, "row").select("doc_id", "text", "ranges").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    same = digests.join(lost.select("row").distinct(), "row", "left_anti")
    zero = F.lit(0).cast("long")
    return changed.unionByName(same.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256"))


def op3_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
