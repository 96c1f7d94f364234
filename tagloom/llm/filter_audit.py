"""What each of five quality filters removes, in every order of applying them.

A table-driven byte transducer reads the UTF-8 bytes of all texts of a batch in one pass:
a table gives each byte its class, a second one, of the states before and after it, says
where words start and end. Sums of the classes are the capitals, code points and symbols
of a text; the word spans go into a hash table whose every match is verified on the bytes.
The filters leave a mask of failures per document, and masks are counted; all orders are
read off these counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage, table

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SEPARATORS, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"
BATCH_BYTES = 1 << 20  # bytes that are read in one pass; longer texts go in pieces
# classes of bytes, as bits: in a word, capital, start of a code point, symbol
IN_WORD, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
CLASS = np.array([(b not in SEPARATORS) * IN_WORD + (65 <= b <= 90) * CAPITAL + (b & 0xC0 != 0x80) * POINT + (b in SYMBOLS) * SYMBOL for b in range(256)], np.uint8)
# what a step from one state (outside 0, inside 1) to the next puts out: 1 a word starts, 2 it ends
STEP = np.array([[0, 1], [2, 0]], np.uint8)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Transducer:
    """Reads texts that lie one behind the other in one array of bytes."""

    def __init__(self, size: int = BATCH_BYTES, hash_bits: int = 64):
        self.size, self.mask = size, np.uint64((1 << hash_bits) - 1)
        self.up, self.down = _powers(BASE, 1), _powers(INVERSE, 1)

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each byte, and starts and ends of all words; no word crosses a text."""
        kind = CLASS[data]
        state = kind & IN_WORD
        before = np.empty_like(state)
        before[:1], before[1:] = 0, state[:-1]
        borders = offsets[:-1][np.diff(offsets) > 0]
        step = STEP[before, state]
        step[borders] = state[borders]  # each text begins outside
        starts = np.flatnonzero(step == 1)
        after = np.empty_like(state)
        after[-1:], after[:-1] = 0, state[1:]
        after[borders[1:] - 1] = 0
        return kind, starts, np.flatnonzero(state & ~after & 1) + 1

    def _distinct(self, data: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Indexes of the first-inserted span of each distinct (text, word)."""
        if not len(starts):
            return np.empty(0, np.int64)
        if len(self.up) <= len(data):
            self.up, self.down = _powers(BASE, len(data) + 1), _powers(INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
        hashes = ((sums[ends] - sums[starts]) * self.down[starts]) & self.mask
        size = ends - starts
        bits = max(4, int(2 * len(starts)).bit_length())
        slot = ((hashes ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(BASE)) >> np.uint64(64 - bits)
        slots = np.full(1 << bits, -1, np.int64)
        slot, pending, owners = slot.astype(np.int64), np.arange(len(starts)), []
        while len(pending):
            at = slot[pending]
            free = pending[slots[at] == -1]
            slots[slot[free]] = free  # of several, the last one written has the slot
            owner = slots[at]
            owners.append(pending[owner == pending])
            same = (owner != pending) & (text[owner] == text[pending]) & (hashes[owner] == hashes[pending]) & (size[owner] == size[pending])
            same[same] = self._equal(data, starts[pending[same]], starts[owner[same]], size[pending[same]])
            pending = pending[(owner != pending) & ~same]
            slot[pending] = (slot[pending] + 1) & ((1 << bits) - 1)
        return np.concatenate(owners)

    @staticmethod
    def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of spans of one size are the same, for all pairs at once."""
        if not len(a):
            return np.empty(0, bool)
        first = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        return np.logical_and.reduceat(data[np.repeat(a, size) + inside] == data[np.repeat(b, size) + inside], first)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per text: words, distinct words, capitals, code points, symbols."""
        n = len(offsets) - 1
        out = np.zeros((n, 5), np.int64)
        if not len(data):
            return out
        kind, starts, ends = self._spans(data, offsets)
        text = np.searchsorted(offsets, starts, side="right") - 1
        out[:, 0] = np.bincount(text, minlength=n)
        out[:, 1] = np.bincount(text[self._distinct(data, text, starts, ends)], minlength=n)
        full = np.flatnonzero(np.diff(offsets) > 0)
        for column, bit in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            out[full, column] = np.add.reduceat((kind & bit) > 0, offsets[full], dtype=np.int64)
        return out

    def read_long(self, data: np.ndarray) -> np.ndarray:
        """The same for one text of any length, in pieces that end where a word ends; only
        its distinct words are held from piece to piece."""
        total, seen, at = np.zeros(5, np.int64), set(), 0
        while at < len(data):
            end = min(len(data), at + self.size)
            while end < len(data) and CLASS[data[end]] & IN_WORD:
                ahead = np.flatnonzero(~CLASS[data[end:end + self.size]] & IN_WORD)
                end = end + int(ahead[0]) if len(ahead) else min(len(data), end + self.size)
            piece = data[at:end]
            offsets = np.array([0, len(piece)])
            kind, starts, ends = self._spans(piece, offsets)
            first = self._distinct(piece, np.zeros(len(starts), np.int64), starts, ends)
            seen.update(piece[a:b].tobytes() for a, b in zip(starts[first], ends[first]))
            total += [len(starts), 0, *(int(np.count_nonzero(kind & bit)) for bit in (CAPITAL, POINT, SYMBOL))]
            at = end
        total[1] = len(seen)
        return total


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column without nulls, not copied."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def measures(docs: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """Per row of docs: doc_id, part, words, distinct, capitals, points, symbols, digest."""
    names = ["words", "distinct", "capitals", "points", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Transducer(size)
        for batch in batches:
            data, offsets = _texts(batch.column(2))
            rows, at = np.zeros((batch.num_rows, 5), np.int64), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
                part = data[offsets[at]:offsets[end]]
                rows[at:end] = reader.read(part, offsets[at:end + 1] - offsets[at]) if len(part) <= size else reader.read_long(part)
                at = end
            digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, k]) for k in range(5)), pa.array(digests, pa.binary())], names=["doc_id", "part", *names, "digest"])

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, "doc_id long, part string, " + ", ".join(f"{n} long" for n in names) + ", digest binary")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters that they
    fail (bit k for the k-th of ABCDE), and how many of them are of quality 1 and toxic 1.

    A row fails E if a smaller doc_id has the same text; a row without doc_id neither fails
    E nor makes another fail. The rows of a hot text meet as counts, never as rows."""
    fails = [F.col("words") < MIN_WORDS, 100 * F.col("distinct") < DISTINCT_PERCENT * F.col("words"), 100 * F.col("capitals") > CAPITAL_PERCENT * F.col("points"), F.col("symbols") > 0]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = stage(measures(docs).select("doc_id", "part", mask.alias("mask"), "digest"), "audit-masks")  # texts are read once
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    one = rows.withColumn("n", F.lit(1).cast("long"))
    plain = one.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    marked = one.where("doc_id is not null").join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    known = marked.groupBy("doc_id", *kind).agg(F.sum("n").alias("n")).unionByName(plain)
    groups = known.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_low"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"))
    first = F.when(F.col("low") == F.min("low").over(Window.partitionBy("digest")), F.col("at_low")).otherwise(0) + F.col("without")
    split = groups.withColumn("first", first).withColumn("half", F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))))
    split = split.select("part", "half.mask", "half.n", "good", "toxic").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _orders() -> list[tuple]:
    """What a mask counts for in each step of each order: 120 orders x 5 steps x 32 masks."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        for mask in range(32):
            failed = [f for f in order if mask >> FILTERS.index(f) & 1]
            for step, f in enumerate(order, 1):
                fails, removed = f in failed, failed[:1] == [f]
                gone = bool(failed) and order.index(failed[0]) < step  # by now, this step included
                out.append((mask, order, step, int(not gone), int(removed), int(fails and not removed), int(failed == [f]), 120 // len(failed) if fails else 0))
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang, null as empty string), order of ABCDE and step; the columns
    are those of ``op12_filter_audit``'s contract.

    A null text counts as empty, which fails A alone. Repeated rows count each; equal rows
    of one doc_id do not fail E by each other. Of several labels of a document any 1
    counts; null labels are none. Other columns are not read, an empty table of documents
    gives an empty result. Beyond the texts' pass, rows of some 60 bytes are shuffled."""
    spark = docs.sparkSession
    orders = spark.createDataFrame(_orders(), "mask int, filter_order string, step int, kept int, removed int, redundant int, alone int, share int")
    with scratch(spark) as keep:
        masks = keep(failures(docs, labels), "audit-counts")
    counts = masks.join(F.broadcast(orders), "mask")  # a fixed table of 19 200 rows
    total = lambda flag, n="n": F.sum(F.col(flag) * F.col(n)).cast("long")
    return counts.groupBy("part", "filter_order", "step").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("alone").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), total("share").alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = {
    "op12_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT d.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
 coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
 FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(good::INT) AS good, sum(bad::INT) AS bad FROM f GROUP BY 1, 2),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, o[step:step] AS x, o[1:step - 1] AS earlier FROM o, range(1, 6) r(step) WHERE length(o) = 5),
j AS (SELECT part, filter_order, step::INT AS step, n, good, bad, fails, contains(fails, x) AS hit, x = fails AS alone, translate(fails, earlier, '') <> fails AS gone FROM m, s)
SELECT part, filter_order, step, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND hit THEN bad ELSE 0 END)::BIGINT AS toxic_lost,
 sum(CASE WHEN hit THEN n * 120 // length(fails) ELSE 0 END)::BIGINT AS shapley
FROM j GROUP BY 1, 2, 3"""
}
