"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets
and star-shaped candidate edges, confirmed on full shingle sets.

Texts of one shingle set form a class; only class representatives go further. In the first
round each bucket links its members to its smallest one (a star), so a bucket of m members
gives m - 1 candidates. Stars alone can miss a link between two members that are not
both like the centre; the second round therefore compares signatures of those members of a
bucket that are still in different components. Those that may reach the threshold with
another one are compared on their full sets within the bucket, which gives out a spanning
forest of the links: at most one link less than it has members, and no pair besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, table
from .components import components

WORDS, BINS, ROWS = 5, 128, 4
THRESHOLD = 0.85
SIGMAS = 4.5  # a signature may fall short of the threshold by so much of its own spread
SMALL = 64  # pairs with a set up to this size are compared in full inside their bucket
BLOCK = 1024
GROUP = ("band", "key", "x", "y")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles. Word hashes are kept for a bounded number of words."""

    def __init__(self, words: int = WORDS, most: int = 400_000):
        self.words, self.most, self.known = words, most, {}

    def word(self, w: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self.known) < self.most:
            self.known[w] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; empty without words."""
        tokens = (text or "").encode().translate(_FOLD).split()
        if not tokens:
            return np.empty(0, np.uint64)
        get, new = self.known.get, self.word
        h = np.array([get(w) or new(w) for w in tokens], np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, np.uint64(len(tokens) if k < self.words else self.words), np.uint64)
        for i in range(k):
            out = mix(out + _MIX + h[i:len(h) - k + 1 + i])
        return np.unique(out)


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One permutation split into bins; an empty bin takes over the value of a filled one,
    tried in an order that depends on bin and attempt only (optimal densification)."""
    x = mix(shingles + np.uint64(0x1234567))
    where = (x >> np.uint64(57)).astype(np.int64) if bins == 128 else (x % np.uint64(bins)).astype(np.int64)
    value = x & np.uint64((1 << 57) - 1)
    sig = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(sig, where, value)
    empty = np.flatnonzero(sig == np.iinfo(np.uint64).max)
    filled, attempt, todo = sig != np.iinfo(np.uint64).max, 1, empty
    while len(todo):
        probe = (mix(todo.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[probe]
        sig[todo[hit]] = sig[probe[hit]]
        todo, attempt = todo[~hit], attempt + 1
    return sig


def _sign(words: int, bins: int, rows: int):
    """Signatures and buckets of texts. ``sig`` holds 16 bits of each bin, then 32 of each band."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("sig", pa.binary()), ("small", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        salt = np.arange(1, bins + 1, dtype=np.uint64) * _MIX
        for batch in batches:
            n, one, two, sigs, small, bands = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler(text)
                n.append(len(s))
                if not len(s):
                    one.append(0), two.append(0), sigs.append(b""), small.append(b""), bands.append([])
                    continue
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                one.append(int.from_bytes(d[:8], "little", signed=True)), two.append(int.from_bytes(d[8:], "little", signed=True))
                sig = signature(s, bins)
                small.append(s.tobytes() if len(s) <= 2 * SMALL else b"")
                keys = mix(sig + salt).reshape(-1, rows)
                band = np.full(len(keys), 7, np.uint64)
                for j in range(rows):
                    band = mix(band + _MIX + keys[:, j])
                bands.append(band.view(np.int64))
                sigs.append((sig & np.uint64(0xFFFF)).astype(np.uint16).tobytes() + band.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary()), pa.array(small, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return run


def _may_link(threshold: float):
    """Whether two sets may reach the threshold, by their sizes and signatures."""

    def test(na: np.ndarray, nb: np.ndarray, same: np.ndarray, sa, sb) -> np.ndarray:
        least, most = np.minimum(na, nb), np.maximum(na, nb)
        own = BINS * (1 - np.exp(-least / BINS))  # bins that are filled, not taken over
        out = (least >= threshold * most - 1e-9) & (same >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(own, 1)))
        full = (least <= SMALL) & (most <= 2 * SMALL)
        for i in np.flatnonzero(out & full):
            both = len(np.intersect1d(np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64), assume_unique=True))
            out[i] = both >= threshold * (na[i] + nb[i] - both) - 1e-9
        return out

    return test


def _by_group(columns: dict[str, pa.DataType], made):
    """A mapInArrow function over rows that are sorted by (band, key, x, y): made gets whole
    groups, many at a time, and gives the columns. The last group of a batch waits for the next."""
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if kept is not None:
                part = pa.concat_tables([kept, part])
            if not part.num_rows:
                continue
            ends = np.zeros(part.num_rows, bool)
            for k in GROUP:
                col = part.column(k).to_numpy()
                ends |= col != col[-1]
            cut = int(ends.sum())  # sorted, so the last group is the rest
            kept = part.slice(cut)
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made(part.slice(0, cut)), columns.values())], schema=schema)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made(kept), columns.values())], schema=schema)

    return run


def _starts(part: pa.Table) -> np.ndarray:
    """Where a new group begins, and the end of the last one."""
    new = np.ones(part.num_rows, bool)
    new[1:] = False
    for k in GROUP:
        col = part.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.append(np.flatnonzero(new), part.num_rows)


def _open_members(rows: int, threshold: float):
    """Of rows (band, key, x, y, blk, rep, comp, centre, n, sig, small), those that may reach
    the threshold with another one of their group that is in a different component. Pairs
    with the bucket's centre were compared as stars; a pair is asked for in its first shared
    bucket only."""
    may = _may_link(threshold)

    def made(part: pa.Table) -> list[np.ndarray]:
        bounds = _starts(part)
        band, key, x, y, blk, rep, comp, centre, n = (part.column(k).to_numpy() for k in (*GROUP, "blk", "rep", "comp", "centre", "n"))
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(key))  # rows of the group from here on
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(len(key), -1)
        bins = sig.shape[1] * rows // (rows + 2)
        sig, bands = sig[:, :bins], np.ascontiguousarray(sig[:, bins:]).view(np.uint32)
        small = part.column("small").to_pylist()
        wanted = np.zeros(len(key), bool)
        at = np.flatnonzero(left > 1)
        for step in range(1, int(left.max(initial=1))):
            at = at[left[at] > step]
            other = at + step
            ask = (comp[at] != comp[other]) & (rep[at] != rep[other]) & ((x[at] == y[at]) | (blk[at] != blk[other]))
            ask &= (rep[at] != centre[at]) & (rep[other] != centre[at])
            ask &= np.minimum(n[at], n[other]) >= threshold * np.maximum(n[at], n[other]) - 1e-9
            for i in np.array_split(at[ask], ask.sum() // 8192 + 1):
                if not len(i):
                    continue
                j = i + step
                fresh = (bands[i] == bands[j]).argmax(axis=1) >= band[i]  # earlier shared buckets have dealt with the others
                i, j = i[fresh], j[fresh]
                if len(i):
                    ok = may(n[i], n[j], (sig[i] == sig[j]).mean(axis=1), [small[k] for k in i], [small[k] for k in j])
                    wanted[i[ok]] = wanted[j[ok]] = True
        return [c[wanted] for c in (band, key, x, y, blk, rep, comp)]

    return _by_group({"band": pa.int32(), "key": pa.int64(), "x": pa.int32(), "y": pa.int32(), "blk": pa.int32(), "rep": pa.int64(), "comp": pa.int64()}, made)


def overlaps(sets: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """How many elements each two of the sets share. The sets are columns of a 0/1 matrix that
    is multiplied with itself piece by piece, so memory stays bounded by ``cells``."""
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1  # what only one set holds is in no intersection
    _, col = np.unique(col[shared], return_inverse=True)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[shared][order]
    width = max(1, cells // m)
    for at in range(0, int(col.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(col, (at, at + width))
        piece = np.zeros((m, width), np.float32)
        piece[owner[a:b], col[a:b] - at] = 1
        both += piece @ piece.T
    return both.astype(np.int64)


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    seen, a, b = np.zeros(len(linked), bool), [], []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(linked[i] & ~seen)
            seen[found] = True
            a += [i] * len(found)
            b += found.tolist()
            todo += found.tolist()
    return a, b


def _links_in_groups(num: int, den: int):
    """Links (a, b) among rows (band, key, x, y, blk, rep, comp, s) of one group, decided on
    the full sets s: a spanning forest of them, at most one less than the group has rows."""

    def made(part: pa.Table) -> list[np.ndarray]:
        bounds = _starts(part)
        x, y, blk, rep, comp = (part.column(k).to_numpy() for k in ("x", "y", "blk", "rep", "comp"))
        sets, out_a, out_b = part.column("s"), [rep[:0]], [rep[:0]]
        for at, to in zip(bounds, bounds[1:]):
            if to - at < 2:
                continue
            own = [np.frombuffer(v.as_py(), np.uint64) for v in sets.slice(at, to - at)]
            both, n = overlaps(own), np.array([len(s) for s in own])
            ok = (den * both >= num * (n[:, None] + n - both)) & (comp[at:to, None] != comp[at:to])
            if x[at] != y[at]:
                ok &= blk[at:to, None] != blk[at:to]
            i, j = _forest(ok)
            out_a.append(rep[at:to][i]), out_b.append(rep[at:to][j])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return [np.minimum(a, b), np.maximum(a, b)]

    return _by_group({"a": pa.int64(), "b": pa.int64()}, made)


def _sets(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s): the shingle sets of the wanted doc_ids. wanted is written first: its size
    is then known when the join with the texts is planned, so that texts are shuffled only
    where the ids are too many to broadcast."""

    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(words)
        for texts in batches:
            yield pd.Series([shingler(t).tobytes() for t in texts])

    wanted = stage(wanted.distinct(), "near-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return stage(texts.select("doc_id", F.pandas_udf(sets, "binary")("text").alias("s")), "near-sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets have den * |intersection| >= num * |union|."""

    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) and len(y) else 0
            out.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
        return pd.Series(out, dtype=bool)

    full = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, words)
    both = pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
    return both.where(F.pandas_udf(linked, "boolean")("sa", "sb")).select("a", "b")


def near_dedup(docs: DataFrame, words: int = WORDS, num: int = 85, den: int = 100, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """Links rows whose shingle sets have den * |intersection| >= num * |union|.

    Returns one row per input row: doc_id, n_shingles, component_id, kept. A null or empty
    text has no shingles and is linked with nothing. Rows that repeat a doc_id belong
    together when their texts do; a repeated doc_id with different texts is compared by its
    largest text. A row without doc_id keeps a null component and is kept. Other columns are
    not read; an empty table gives an empty result."""
    with scratch(docs.sparkSession) as keep:
        return keep(_near_dedup(docs, words, num, den, bins, rows), "near-dedup")


def _near_dedup(docs: DataFrame, words: int, num: int, den: int, bins: int, rows: int) -> DataFrame:
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(rows_.mapInArrow(_sign(words, bins, rows), "doc_id long, n long, set1 long, set2 long, sig binary, small binary, bands array<long>"), "near-signed")
    full = signed.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.min("small").alias("small"), F.min("bands").alias("bands"))
    reps = stage(classes, "near-classes")
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("rep").alias("centre")).where("m > 1")
    members = stage(buckets.join(shared, ["band", "key"]).select("band", "key", "rep", "centre", "m"), "near-members")
    may = _may_link(num / den)

    def plausible(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series, fa: pd.Series, fb: pd.Series) -> pd.Series:
        if not len(na):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1)[:, :bins] for s in (sa, sb))
        return pd.Series(may(na.to_numpy(), nb.to_numpy(), (a == b).mean(axis=1), list(fa), list(fb)))

    sigs = reps.select("rep", "n", "sig", "small")
    stars = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(sigs.toDF("a", "na", "siga", "fa"), "a").join(sigs.toDF("b", "nb", "sigb", "fb"), "b")
    stars = stars.where(F.pandas_udf(plausible, "boolean")("na", "nb", "siga", "sigb", "fa", "fb")).select("a", "b")
    done = stage(stars, "near-stars")
    links = stage(_confirmed(done, docs, words, num, den), "near-links")
    comps = stage(components(links), "near-comps")

    # second round: members of one bucket that are still apart
    now = members.join(comps, members.rep == comps.node, "left").select("band", "key", "rep", "centre", "m", F.coalesce("component", "rep").alias("comp"))
    others = now.where("rep <> centre").groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band", "key")
    open_ = now.join(others, ["band", "key"]).join(sigs, "rep")
    # a large bucket is compared block by block, each pair of blocks in a group of its own
    open_ = open_.withColumn("nb", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("band", "key", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk", "rep", "comp", "centre", "n", "sig", "small")

    # all comparisons of a group lie together and in order, many groups to a batch
    open_ = open_.repartition(*GROUP).sortWithinPartitions(*GROUP)
    rest = stage(open_.mapInArrow(_open_members(rows, num / den), "band int, key long, x int, y int, blk int, rep long, comp long"), "near-rest")
    if not rest.isEmpty():
        full = _sets(rest.select(F.col("rep").alias("doc_id")), docs, words)
        grouped = rest.join(full.toDF("rep", "s"), "rep").repartition(*GROUP).sortWithinPartitions(*GROUP)
        more = grouped.select(*GROUP, "blk", "rep", "comp", "s").mapInArrow(_links_in_groups(num, den), "a long, b long")
        comps = stage(components(stage(links.unionByName(more), "near-all")), "near-final")
    named = reps.join(comps, reps.rep == comps.node, "left").select("n", "set1", "set2", F.coalesce("component", "rep").alias("component_id"))
    same = [signed[k] == named[k] for k in ("n", "set1", "set2")]
    out = signed.join(named, same, "left").select("doc_id", signed["n"].alias("n_shingles"), F.when((signed["n"] > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group of near copies, with all columns: that of the smallest
    doc_id. Rows of a doc_id that is null or occurs more than once are told apart by their
    text, so none of them is judged by the text of another."""
    with scratch(docs.sparkSession) as keep:
        odd = keep(docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").select(F.col("doc_id").alias("_odd"), F.lit(True).alias("_is_odd")), "near-odd-ids")
        own = -1 - F.abs(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) % (1 << 62))
        keyed = docs.join(odd, docs.doc_id.eqNullSafe(odd._odd), "left").withColumn("_key", F.when(F.col("_is_odd"), own).otherwise(F.col("doc_id").cast("long"))).drop("_odd", "_is_odd")
        gone = keep(near_dedup(keyed.select(F.col("_key").alias("doc_id"), "text"), **how).where("not kept").select(F.col("doc_id").alias("_key")).distinct(), "near-gone")
    return keyed.join(gone, "_key", "left_anti").select(docs.columns)


def op1_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op1_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(len(w), w)] ELSE list_distinct([hash(5, w[i:i + 4]) FOR i IN range(1, len(w) - 3)]) END AS t FROM d),
n AS (SELECT doc_id, len(t) AS n FROM s),
x AS (SELECT doc_id, unnest(t) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.node)
SELECT n.doc_id, n::BIGINT AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n"""
}
