"""Hard negatives: for each anchor and each of its nearest rows of the same label, the
nearest rows of other labels within a window of scores below that positive.

All rows are indexed by a GNAT-style tree (``gnat.py``) that is fitted on a bounded sample;
each leaf is kept as blocks of packed vectors. Queries travel in packs. A search first asks
the leaf where a query itself lies, which raises the lower end of its windows, and then
every leaf that the distance ranges cannot rule out; leaves are scored exactly, and the
best of each window are merged pack by pack. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, table
from .gnat import Tree

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90  # the window in hundredths of the positive's score
SAMPLE, SAMPLE_VALUES = 16_384, 1 << 21  # the tree is fitted on so many rows, and so many numbers, at most
BLOCK_ROWS, PACK_ROWS, MAX_LEAVES = 2048, 256, 4096
LEAF_SHARE, PACK_SHARE = 8, 64  # blocks and packs that one task of a leaf takes
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # MOST also stands for a null id
_VECTORS = pa.schema([("leaf", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary())])
_BLOCK = "leaf int, n int, ids binary, labels binary, vecs binary, low array<double>, high array<double>"
_PACK = "n int, ids binary, labels binary, homes binary, vecs binary"
_FOUND = "pack long, q binary, w binary, id binary, score binary"
_f8, _i8 = np.dtype("<f8"), np.dtype("<i8")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, labels changed as the contract says."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # false for null and NaN
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    label = F.col("label").cast("long")
    return rows.select(F.col("vec_id").cast("long"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of a list column; shorter lists end in zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = np.floor(np.clip(256 * np.asarray(column.flatten(), dtype=_f8), -np.finfo(_f8).max, np.finfo(_f8).max))
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; those beyond a long become its ends."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
        return np.clip(exact, LEAST, MOST).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(MOST))


def _routed(rows: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """rows as (leaf, vec_id, label, vec), vec as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            cols = [pa.array(tree.leaf_of(x)), batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=_VECTORS)

    return rows.mapInArrow(run, "leaf int, vec_id long, label long, vec binary")


def _dealt(routed: DataFrame, n: int, a_task: int) -> DataFrame:
    """Rows in the order of leaves, a hot leaf dealt to several tasks. The second number
    only says which task of this one shuffle takes a row."""
    tasks = max(8, n // a_task)
    return routed.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange(tasks, "leaf", "deal").coalesce(tasks).drop("deal").sortWithinPartitions("leaf")


def _groups(batches: Iterator[pa.RecordBatch], size: int, by_leaf: bool) -> Iterator[tuple]:
    """(leaves, ids, labels, vectors) of up to ``size`` successive rows, of one leaf if asked."""
    held: list[tuple] = []
    for batch in batches:
        leaf, ids, labels = np.asarray(batch.column(0)), _ids(batch.column(1)), np.asarray(batch.column(2))
        for row in zip(leaf, ids, labels, batch.column(3).to_pylist()):
            if held and (len(held) == size or by_leaf and held[0][0] != row[0]):
                yield _columns(held)
                held = []
            held.append(row)
    if held:
        yield _columns(held)


def _columns(held: list[tuple]) -> tuple:
    leaf, ids, labels, vecs = zip(*held)
    return np.array(leaf, np.int32), np.array(ids, _i8), np.array(labels, _i8), np.frombuffer(b"".join(vecs), _f8).reshape(len(held), -1)


def _narrow(x: np.ndarray) -> bytes:
    """Two bytes a number where that holds them; the reader tells by the length."""
    return (x.astype("<i2") if not x.size or np.abs(x).max() < 32768 else x).tobytes()


def _wide(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * dims else _f8).reshape(n, dims).astype(_f8)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class Index:
    """All usable rows of a table, packed by leaf in a staged table."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS, fanout: int = 8):
        n, dims = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        self.n, self.dims = n, max(dims or 0, 1)
        wanted = max(1, min(SAMPLE, SAMPLE_VALUES // self.dims))
        share = min(1.0, wanted / max(n, 1))
        picked = rows.where(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec").distinct()
        sample = picked.limit(2 * wanted).toArrow()  # the limit only guards the driver's memory
        points = np.concatenate([_matrix(c, self.dims) for c in sample.column(0).chunks] or [np.zeros((0, self.dims))])
        points = points[np.lexsort(points.T)] if len(points) else points
        leaves = min(MAX_LEAVES, max(1, n // block_rows))
        self.tree = Tree(points, max(8, len(points) // leaves), fanout)
        tree = self.tree

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for leaf, ids, labels, x in _groups(batches, block_rows, True):
                low, high = tree.ranges(int(leaf[0]), x)
                yield _batch([(int(leaf[0]), len(ids), ids.tobytes(), labels.tobytes(), _narrow(x), low.tolist(), high.tolist())], _BLOCK)

        blocks = _dealt(_routed(rows, tree, self.dims), n, 4 * block_rows).mapInArrow(pack, _BLOCK)
        self.blocks = stage(blocks.withColumn("block", F.monotonically_increasing_id()), "negatives-blocks")
        self._read_directory()

    def _read_directory(self) -> None:
        """What the tree keeps: ranges and numbers of blocks by leaf, not more than the
        tree has leaves whatever the table's size."""
        pairs = self.blocks.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "r"))
        low, high = {}, {}
        for r in pairs.groupBy("leaf", "at").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect():
            low.setdefault(r.leaf, {})[r["at"]] = r.low
            high.setdefault(r.leaf, {})[r["at"]] = r.high
        listed = lambda d: {k: np.array([v[i] for i in range(len(v))]) for k, v in d.items()}
        self.tree.set_ranges(listed(low), listed(high))
        self.shares = {r.leaf: -(-r.n // LEAF_SHARE) for r in self.blocks.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    def packs(self, anchors: DataFrame) -> DataFrame:
        """The queries, neighbours in the tree together, with numbers."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for leaf, ids, labels, x in _groups(batches, PACK_ROWS, False):
                yield _batch([(len(ids), ids.tobytes(), labels.tobytes(), leaf.astype(_i8).tobytes(), _narrow(x))], _PACK)

        dealt = _dealt(_routed(anchors, self.tree, self.dims), self.n // 100, 4 * PACK_ROWS)
        return stage(dealt.mapInArrow(pack, _PACK).withColumn("pack", F.monotonically_increasing_id()), "negatives-packs")

    def best(self, packs: DataFrame, n_packs: int, same_label: bool, k: int, name: str) -> DataFrame:
        """The first k rows of each window of each query, as one row a pack. ``packs`` has
        the windows in lo and hi, packed as longs."""
        tree, dims, shares = self.tree, self.dims, self.shares
        deals = -(-n_packs // PACK_SHARE)
        asked = "pack long, leaf int, slot int, deal int, n int, q binary, ids binary, labels binary, vecs binary, lo binary, hi binary"

        def visit(home: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for r in batch.to_pylist():
                        ids, labels, homes = (np.frombuffer(r[c], _i8) for c in ("ids", "labels", "homes"))
                        x = _wide(r["vecs"], r["n"], dims)
                        lo, hi = (np.frombuffer(r[c], _i8).reshape(r["n"], -1) for c in ("lo", "hi"))
                        if home:
                            open_ = (lo <= hi).any(1)
                            leaves = {int(f): np.flatnonzero((homes == f) & open_) for f in np.unique(homes[open_])}
                        else:
                            leaves = tree.visits(x, lo, hi)
                        for leaf, rows in leaves.items():
                            part = (len(rows), rows.astype(_i8).tobytes(), ids[rows].tobytes(), labels[rows].tobytes(), _narrow(x[rows]), lo[rows].tobytes(), hi[rows].tobytes())
                            for slot in range(1 if home else shares[leaf]) if leaf in shares else ():
                                yield _batch([(r["pack"], leaf, slot, r["pack"] % deals, *part)], asked)

            return run

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    q, ids, labels = (np.frombuffer(r[c], _i8) for c in ("q", "ids", "labels"))
                    lo, hi = (np.frombuffer(r[c], _i8).reshape(r["n"], -1) for c in ("lo", "hi"))
                    own_ids, own_labels = np.frombuffer(r["b_ids"], _i8), np.frombuffer(r["b_labels"], _i8)
                    s = scores(_wide(r["vecs"], r["n"], dims), _wide(r["b_vecs"], r["b_n"], dims))
                    found = []
                    for i in range(r["n"]):
                        allowed = (own_labels == labels[i]) & (own_ids != ids[i]) if same_label else own_labels != labels[i]
                        for w in np.flatnonzero(lo[i] <= hi[i]):
                            at = np.flatnonzero(allowed & (s[i] >= lo[i, w]) & (s[i] <= hi[i, w]))
                            if len(at) > k:
                                at = at[s[i][at] >= np.partition(s[i][at], -k)[-k]]
                                at = at[np.lexsort((own_ids[at], -s[i][at]))[:k]]
                            if len(at):
                                found.append((np.full(len(at), q[i]), np.full(len(at), w), own_ids[at], s[i][at]))
                    if found:
                        yield _batch([(r["pack"], *(np.concatenate(c).astype(_i8).tobytes() for c in zip(*found)))], _FOUND)

        blocks = self.blocks.select("leaf", F.col("n").alias("b_n"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("vecs").alias("b_vecs"), "block")
        sizes = packs.sparkSession.createDataFrame(list(shares.items()) or [(0, 1)], "leaf int, shares int")  # one row a leaf
        ranked = blocks.join(F.broadcast(sizes), "leaf").withColumn("slot", F.pmod(F.xxhash64("block"), F.col("shares").cast("long")).cast("int"))
        keyed = ranked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).drop("shares", "block")

        def run(asking: DataFrame, home: bool) -> DataFrame:
            met = asking.mapInArrow(visit(home), asked).join(keyed.hint("shuffle_hash"), ["leaf", "slot", "deal"]).drop("leaf", "slot", "deal")
            parts = met.mapInArrow(score, _FOUND)
            merged = parts.repartition("pack").sortWithinPartitions("pack").mapInArrow(lambda b: _merged(b, k), _FOUND)
            return stage(merged, f"negatives-{name}")

        def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    lo = np.frombuffer(r["lo"], _i8).reshape(r["n"], -1).copy()
                    q, w, _, s = _unpacked(r)
                    # the k-th of a window within these rows bounds the k-th of all from below
                    last = np.flatnonzero(_rank(q, w) == k - 1)
                    lo[q[last], w[last]] = s[last]
                    yield _batch([(*(r[f.split(" ")[0]] for f in _PACK.split(", ")), r["pack"], lo.tobytes(), r["hi"])], f"{_PACK}, pack long, lo binary, hi binary")

        first = run(packs, True)
        return run(packs.join(first, "pack", "left").mapInArrow(raised, f"{_PACK}, pack long, lo binary, hi binary"), False)


def _unpacked(r: dict) -> list[np.ndarray]:
    return [np.frombuffer(r[c] or b"", _i8) for c in ("q", "w", "id", "score")]


def _rank(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Place within its query and window of each row of sorted rows."""
    if not len(q):
        return q
    new = np.r_[True, (q[1:] != q[:-1]) | (w[1:] != w[:-1])]
    at = np.arange(len(q))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row a pack of rows in the order of packs; only the first k of each window are held."""
    pack, held = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if pack is not None and r["pack"] != pack:
                yield _batch([(pack, *(c.tobytes() for c in held))], _FOUND)
                held = None
            new = _unpacked(r)
            cols = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            order = np.lexsort((cols[2], -cols[3], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            keep = _rank(cols[0], cols[1]) < k
            pack, held = r["pack"], [c[keep] for c in cols]
    if pack is not None:
        yield _batch([(pack, *(c.tobytes() for c in held))], _FOUND)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS, fanout: int = 8) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id ``every`` divides, those equal in id, label and vector
    once. Other rows are those of another vec_id; a row that occurs twice counts twice as
    a positive or negative. A null vec_id (for which 2^63 - 1 stands) is no anchor and comes
    last among ties. Vectors may differ in length, the shorter ones end in zeros. Scores
    beyond a long become its ends. An anchor without positives, or a positive without rows
    in its window (its score is not above 0, for one), gives no row; an empty table gives
    none at all. Other columns are not read.

    Copies of one vector fill many blocks of one leaf, and both its blocks and the packs
    that ask it are dealt to tasks by LEAF_SHARE and PACK_SHARE. The driver sees the
    sample and one entry a leaf."""
    with scratch(vectors.sparkSession) as keep:
        rows = usable(vectors)
        index = Index(rows, block_rows, fanout)
        packs = index.packs(rows.where(F.col("vec_id") % every == 0).distinct())
        n_packs = max(1, packs.count())
        whole = packs.mapInArrow(_windows_of_all, f"{_PACK}, pack long, lo binary, hi binary")
        found = index.best(whole, n_packs, True, positives, "positives")
        below = f"{_PACK}, pack long, lo binary, hi binary, pos_id binary, pos_score binary"
        asked = stage(packs.join(found, "pack").mapInArrow(_windows_below(positives), below), "negatives-windows")
        got = index.best(asked.drop("pos_id", "pos_score"), n_packs, False, negatives, "found")
        out = asked.select("pack", "n", "ids", "pos_id", "pos_score").join(got, "pack").mapInArrow(_listed, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return keep(out, "hard-negatives")


def _windows_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ends = (np.full(r["n"], x, _i8).tobytes() for x in (LEAST, MOST))
            yield _batch([(*(r[f.split(" ")[0]] for f in _PACK.split(", ")), r["pack"], *ends)], f"{_PACK}, pack long, lo binary, hi binary")


def _windows_below(positives: int):
    """The windows below the positives that were found, one each; others stay empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, w, ids, s = _unpacked(r)
                at = _rank(q, w)
                cells = {c: np.full((r["n"], positives), x, _i8) for c, x in (("lo", 1), ("hi", 0), ("pos_id", MOST), ("pos_score", 0))}
                cells["pos_id"][q, at], cells["pos_score"][q, at] = ids, s
                cells["lo"][q, at] = [-(-LOW * int(x) // 100) for x in s]
                cells["hi"][q, at] = [HIGH * int(x) // 100 for x in s]
                yield _batch([(*(r[f.split(" ")[0]] for f in _PACK.split(", ")), r["pack"], *(c.tobytes() for c in cells.values()))], f"{_PACK}, pack long, lo binary, hi binary, pos_id binary, pos_score binary")

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    null = lambda x: pa.array(x, mask=x == MOST)
    for batch in batches:
        for r in batch.to_pylist():
            q, w, ids, s = _unpacked(r)
            pos_id, pos_score = (np.frombuffer(r[c], _i8).reshape(r["n"], -1)[q, w] for c in ("pos_id", "pos_score"))
            cols = [pa.array(np.frombuffer(r["ids"], _i8)[q]), null(pos_id), pa.array((_rank(q, w) + 1).astype(np.int32)), null(ids), pa.array(pos_score), pa.array(s)]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
 SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score) WHERE rank <= 10"""
}
