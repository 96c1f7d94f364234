"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks. Each chunk gets polynomial hashes modulo two
primes; hashes of neighbouring chunks combine as h(ab) = h(a) * base^|b| + h(b), so the
chunks of a huge document can be hashed anywhere and in any order. Texts of equal
fingerprint are then compared byte for byte, chunk against chunk, and only texts found
equal are treated as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
CHUNK = 65536
SALTS = 16  # parts of a group of equal fingerprints
_CHUNKS = pa.list_(pa.struct([(k, pa.int64()) for k in ("h1", "h2", "w1", "w2")]))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1) ... base^0 modulo prime, by doubling."""
    out = np.ones(1, dtype=np.int64)
    while len(out) < n:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * step % prime])
    return out[:n][::-1].copy()


def _hasher(chunk: int, primes: tuple[int, int]):
    tables = [powers(b, p, chunk) for b, p in zip(BASES, primes)]

    def chunks(data: bytes) -> list[dict]:
        found = []
        for at in range(0, len(data), chunk):
            part = np.frombuffer(data, np.uint8, min(chunk, len(data) - at), at).astype(np.int64)
            hashes = [int(part @ t[chunk - len(part):] % p) for t, p in zip(tables, primes)]
            weights = [pow(b, len(part), p) for b, p in zip(BASES, primes)]
            found.append(dict(zip(("h1", "h2", "w1", "w2"), hashes + weights)))
        return found

    return chunks


def fingerprints(docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, fp1, fp2, text_sha256 (and text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunks", _CHUNKS), ("text_sha256", pa.string())] + [("text", pa.string())] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hasher(chunk, primes)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            cols = [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashed(x) for x in texts], _CHUNKS)]
            if not keep_text:
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in texts]))
            else:
                cols += [pa.nulls(len(texts), pa.string()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, n_bytes long, chunks array<struct<h1:long,h2:long,w1:long,w2:long>>, text_sha256 string" + ", text string" * keep_text
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ddl)

    def folded(h: str, w: str, prime: int):
        return F.aggregate("chunks", F.lit(0).cast("long"), lambda acc, c: (acc * c[w] + c[h]) % prime)

    return rows.select("doc_id", "n_bytes", folded("h1", "w1", primes[0]).alias("fp1"), folded("h2", "w2", primes[1]).alias("fp2"), *(["text"] if keep_text else ["text_sha256"]))


def exact_dedup(docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Groups rows of equal text (null counts as empty); the largest doc_id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    Rows that repeat a doc_id with equal text share its fate; a null doc_id stays only in
    a group without any other id. Other columns of docs are not read. An empty table
    gives an empty result. A hot group is never gathered: it is counted by partial
    aggregation, and its chunks are compared by partial minima and maxima."""
    key = ["n_bytes", "fp1", "fp2"]
    prints = stage(fingerprints(docs, chunk, primes), "exact-prints")
    many = prints.groupBy(*key).agg(F.count("*").alias("group_size")).where("group_size > 1 and n_bytes > 0").drop("group_size")
    # the texts of a hot group are dealt to several tasks, and meet as partial minima and maxima
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = fingerprints(docs, chunk, primes, keep_text=True).where("n_bytes > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(many, [*key, "salt"], "left_semi")
    parts = texts.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(chunk)), lambda at: F.substring(F.encode("text", "utf-8"), at.cast("int") + 1, chunk))).alias("chunk_no", "part"))
    unlike = parts.groupBy(*key, "chunk_no").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select(*key).distinct()
    unlike = stage(unlike, "exact-unlike")
    rows = prints.withColumn("other", F.lit(None).cast("string"))
    if not unlike.isEmpty():  # different texts met in one fingerprint: these few groups go by the text itself
        split = fingerprints(docs, chunk, primes, keep_text=True).join(unlike, key, "left_semi")
        split = split.select("doc_id", *key, F.sha2("text", 256).alias("text_sha256"), F.col("text").alias("other"))
        rows = prints.join(unlike, key, "left_anti").withColumn("other", F.lit(None).cast("string")).unionByName(split)
    groups = rows.groupBy(*key, "other").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = [rows[k].eqNullSafe(groups[k]) if k == "other" else rows[k] == groups[k] for k in (*key, "other")]
    return rows.join(groups, same).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group of equal texts, with all columns: that of the largest
    doc_id. Of rows that repeat both doc_id and text one stays; rows that share a doc_id and
    differ in text are judged each by its own text."""
    judged = exact_dedup(docs, **how)
    key = ["doc_id", "text_sha256"]
    marks = judged.groupBy(*key).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).where("not _kept or _n > 1")
    marks = stage(marks.toDF("_id", "_sha", "_kept", "_n"), "exact-marks")
    rows = docs.withColumn("_text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = (rows["_text_sha"] == marks["_sha"]) & rows["doc_id"].cast("long").eqNullSafe(marks["_id"])
    out = rows.join(marks, same, "left_anti").select(docs.columns)
    repeated = marks.where("_kept")
    if repeated.isEmpty():
        return out
    again = rows.join(repeated, same).groupBy(marks["_id"], marks["_sha"]).agg(F.first(F.struct(*[rows[c] for c in docs.columns])).alias("_row"))
    return out.unionByName(again.select("_row.*"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
 count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
}
