"""Chunk transfers: plans, coverage and request logs."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted

# Chunk length in bytes, time a request lives and a receiver waits in ms.
CHUNK, TTL = 65536, 8000
KEY = ["file_id", "content_hash"]


def chunk_plan(versions: DataFrame) -> DataFrame:
    """(file_id, content_hash, offset, length) of each version; no bytes, one empty chunk."""
    v = versions.select(*KEY, F.col("size").cast("long").alias("size")).distinct()
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(CHUNK).cast("long")))
    return v.select(*KEY, "size", at.alias("offset")).select(*KEY, "offset", F.least(F.col("size") - F.col("offset"), F.lit(CHUNK)).alias("length"))


def _beside(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of both tables, told apart by ``is_row``; a column that one lacks is null there.
    Rows without a key are left out, as in a join.

    Tables meet by unions and aggregations within a key, not by joins: input that lies by
    file_id already is not shuffled again, and any other input once, by its key."""
    some = lambda df, flag: df.where("file_id is not null and content_hash is not null").withColumn("is_row", F.lit(flag))
    return some(rows, True).unionByName(some(known, False), allowMissingColumns=True)


def clean_chunks(log: DataFrame, versions: DataFrame) -> DataFrame:
    """First data reply per receiver, key and offset (link, at, ...), without misaligned or
    past-end offsets."""
    data = log.where(f"msg = 'data' and offset % {CHUNK} = 0 and offset >= 0").select("receiver", *KEY, "offset", "at", "length")
    largest = F.max("size").over(Window.partitionBy(*KEY))
    both = _beside(data, versions.select(*KEY, F.col("size").cast("long").alias("size"))).withColumn("size", largest)
    ok = both.where("is_row and size >= 0 and offset < greatest(size, 1)")
    return ok.groupBy("receiver", *KEY, "offset").agg(F.min("at").alias("at"), F.min_by("length", F.struct("at", "length")).alias("length"))


def chunk_coverage(plan: DataFrame, got: DataFrame) -> DataFrame:
    """Per receiver and key: bytes from the start without a gap, missing chunks, complete."""
    both = _beside(got.select("receiver", *KEY, "offset"), plan.select(*KEY, "offset", "length"))
    # receivers as structs, as a collected null would vanish
    receiver = F.when(F.col("is_row"), F.struct("receiver"))
    both = both.withColumn("who", F.collect_set(receiver).over(Window.partitionBy(*KEY)))
    offsets = both.groupBy(*KEY, "offset").agg(F.sum("length").alias("length"), F.count_if(~F.col("is_row")).alias("n"), F.collect_set("receiver").alias("have"), F.any_value("who").alias("who")).where("n > 0")
    each = offsets.select("*", F.explode("who").alias("w")).select(F.col("w.receiver").alias("receiver"), *KEY, "offset", "length", "n", F.coalesce(F.array_contains("have", F.col("w.receiver")), F.lit(False)).alias("has"))
    g = each.groupBy("receiver", *KEY).agg(F.min(F.when(~F.col("has"), F.col("offset"))).alias("gap"), F.sum("length").alias("size"), F.sum(F.when(F.col("has"), 0).otherwise(F.col("n"))).alias("missing"))
    return g.select("receiver", *KEY, F.coalesce("gap", "size").alias("contiguous"), "missing", (F.col("missing") == 0).alias("complete"))


def verify_chunks(chunks: DataFrame) -> DataFrame:
    """(file_id, content_hash, state) of chunks (…, offset, bytes): ok or mismatch. The chunks
    of a file pass a running hash in order of their offsets, so a file may be of any size."""

    def run(batches):
        key = digest = None
        for batch in batches:
            done = []
            for file_id, content_hash, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file_id, content_hash) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (file_id, content_hash), hashlib.sha256()
                digest.update(part or b"")
            yield _digests(done)
        yield _digests([(*key, digest.hexdigest())] if key else [])

    def _digests(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], [*KEY, "digest"])

    ordered = chunks.select(*KEY, "bytes", "offset").repartition(*KEY).sortWithinPartitions(*KEY, "offset")
    found = ordered.select(*KEY, "bytes").mapInArrow(run, "file_id string, content_hash string, digest string")
    return found.select(*KEY, F.when(F.col("digest") == F.col("content_hash"), "ok").otherwise("mismatch").alias("state"))


def receive_outcomes(coverage: DataFrame, got: DataFrame, verified: DataFrame, misses: DataFrame, now: int) -> DataFrame:
    """Per receiver and key: complete, hash_mismatch, unavailable, stalled (no write for the
    time a receiver waits) or running."""
    w = Window.partitionBy("receiver", *KEY).orderBy("at")
    quiet = got.withColumn("gap", F.col("at") - F.lag("at").over(w)).groupBy("receiver", *KEY).agg(F.max("gap").alias("gap"), F.max("at").alias("last"), F.lit(True).alias("timed"))
    lost = misses.select("receiver", *KEY).distinct().withColumn("lost", F.lit(True))
    parts = coverage.select("receiver", *KEY, "complete").unionByName(quiet, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    one = parts.where("receiver is not null").groupBy("receiver", *KEY).agg(*[F.max(c).alias(c) for c in ("complete", "gap", "last", "timed", "lost")])
    state = F.min("state").over(Window.partitionBy(*KEY))
    j = _beside(one.where("complete is not null and timed"), verified.select(*KEY, "state")).withColumn("state", state).where("is_row")
    out = F.when((F.col("gap") > TTL) | (~F.col("complete") & (F.lit(now) - F.col("last") > TTL) & F.col("lost").isNull()), "stalled").when(F.col("complete") & (F.col("state") == "mismatch"), "hash_mismatch").when(F.col("complete"), "complete").when(F.col("lost"), "unavailable").otherwise("running")
    return j.select("receiver", *KEY, out.alias("outcome"))


def _fold_requests(key: tuple, rows) -> list[tuple]:
    requests = fetches = widest = 0
    until, links = None, set()
    for at, link in rows:
        if until is None or at >= until:
            until, links, fetches = at + TTL, set(), fetches + 1
        links.add(link)
        requests, widest = requests + 1, max(widest, len(links))
    return [(*key, requests, fetches, widest)]


def coalescing(log: DataFrame) -> DataFrame:
    """(file_id, content_hash, offset, requests, fetches, widest): how many requests came, how
    many fetches they took, and how many links the widest one served. A first request opens
    a fetch for the time to live; later ones within it join and do not extend it. The
    requests of a key pass in order of time; one fetch's links are all that is kept.
    Requests without a time are ignored."""
    key = [*KEY, "offset"]
    asked = log.where("msg = 'request' and at is not null").select(*key, F.col("at").cast("long").alias("at"), "link")
    return fold_sorted(asked, key, ["at", "link"], _fold_requests, "file_id string, content_hash string, offset long, requests long, fetches long, widest int")


def miss_exhaustion(requests: DataFrame) -> DataFrame:
    """(file_id, content_hash, offset, opened_at, exhausted) of closed requests
    (streaming.keyed, request_outcomes): whether one ended without data although somebody
    still waited, as all asked upstreams missed or dropped, or as its time was over."""
    return requests.select(*KEY, "offset", "opened_at", F.col("outcome").isin("missed", "expired").alias("exhausted"))


def hash_memo(listing: DataFrame, memo: DataFrame) -> DataFrame:
    """listing (path, mtime, size) with the stored content_hash where all three agree, null
    where the content has to be read again."""
    m = memo.select(F.col("path").alias("p"), F.col("mtime").alias("m"), F.col("size").alias("s"), "content_hash")
    return listing.join(m, listing.path.eqNullSafe(m.p) & listing.mtime.eqNullSafe(m.m) & listing["size"].eqNullSafe(m.s), "left").select(listing["*"], "content_hash")
