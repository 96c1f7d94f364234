"""Best-fit packing of documents into training sequences under conflicts.

Two pieces of one source, or of one duplicate cluster, never share a bin. Rows are dealt
to shards of bounded size; within a shard, pieces are placed in decreasing size. Bins are
kept in order of residual space and carry bitmaps of their sources and clusters; the search
starts at the smallest residual that holds the piece and goes on to the next one until a
bin without conflict is found, so it always takes the tightest compatible bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, table

CAPACITY, SHARD_ROWS = 2048, 2048
TOKEN = r"[^\x20\x09-\x0D]+"


def best_fit(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece (size, source, cluster), placed in the given order.
    None as source or cluster conflicts with nothing."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    bits: dict = {}

    def bit(kind: str, x) -> int:
        return 0 if x is None else 1 << bits.setdefault((kind, x), len(bits))

    placed = []
    for size, source, cluster in pieces:
        s, c = bit("s", source), bit("c", cluster)
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & s or clusters[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            residual, k = open_bins.pop(at)
        else:
            residual, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed.append((k, capacity - residual))
        sources[k] |= s
        clusters[k] |= c
        if residual > size:
            insort(open_bins, (residual - size, k))
    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, bin_id, bin_offset, n_tokens.

    A text of more tokens than a bin holds is cut into full pieces and a rest. An empty or
    null text gives one row without a bin. A null source or cluster conflicts with
    nothing. The cluster is the hash of the text unless a column is named. Repeated rows
    are copies of one cluster, are dealt to all shards and go to different bins. Other
    columns are not read; an empty table gives an empty result."""
    with scratch(docs.sparkSession) as keep:
        return keep(_pack(docs, capacity, shard_rows, cluster), "packed")


def _pack(docs: DataFrame, capacity: int, shard_rows: int, cluster: str | None) -> DataFrame:
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n"), (F.col(cluster).cast("string") if cluster else F.md5(F.col("text").cast("binary"))).alias("cluster"))
    # written once, so that the salt of a row stays what it is; repeated rows get salts of their own
    rows = stage(rows.withColumn("salt", F.rand(1)), "packing-rows")
    shards = 1 + rows.count() // shard_rows
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "salt"), F.lit(shards)).cast("long")).drop("salt")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable")
        items, rest, empty = [], [], []
        for doc, source, n, copy in zip(group.doc_id, group.source, group.n, group.cluster):
            doc = None if pd.isna(doc) else int(doc)
            items += [(doc, p, capacity, source, copy) for p in range(n // capacity)]
            if n % capacity:
                rest.append((doc, n // capacity, n % capacity, source, copy))
            elif not n:
                empty.append((doc, 0, None, None, 0))
        items += sorted(rest, key=lambda x: -x[2])
        placed = best_fit([(n, s, c) for _, _, n, s, c in items], capacity)
        out = [(d, p, (key[0] << 32) + k, at, n) for (d, p, n, _, _), (k, at) in zip(items, placed)] + empty
        return pd.DataFrame(out, columns=["doc_id", "piece", "bin_id", "bin_offset", "n_tokens"]).astype({c: "Int64" for c in ("doc_id", "bin_id", "bin_offset")})

    return rows.groupBy("shard").applyInPandas(run, "doc_id long, piece int, bin_id long, bin_offset long, n_tokens long")


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
