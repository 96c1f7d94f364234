"""Reconciliation of replicas: manifests, decisions and plans, as joins of two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_id_prefix
from ..sources.staging import stage, steps
from .lww import EDGE
from .reads import version_history


def file_manifest(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Every file with a version, tombstones too, with its history in order. One aggregation
    gives both the history and the latest version."""
    latest = [F.max_by(c, "version_number").alias(name) for c, name in (("observed_at", "latest_observed_at"), ("content_hash", "latest_hash"), ("size", "latest_size"))]
    return files.withColumnRenamed("id", "file_id").join(version_history(versions, *latest), "file_id")


def unlisted_files(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files that a manifest leaves out because they have no version."""
    return files.join(versions.select(F.col("file_id").alias("id")), "id", "left_anti").select("id")


def tag_manifest(cat: dict) -> DataFrame:
    return cat["tags"].select("id", "name", "color", "modified_at", "deleted")


def edge_manifest(cat: dict) -> DataFrame:
    return cat["entries"].select(*EDGE, "modified_at", "deleted")


def _pair(ours: DataFrame, theirs: DataFrame, by: tuple = ()) -> DataFrame:
    keys = [*by, "file_id"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    return side(theirs, "t").join(side(ours, "o"), keys, "full_outer")


def _decision():
    knows = lambda p, q: F.exists(f"{p}_history", lambda v: v.content_hash == F.col(f"{q}_latest_hash"))
    newer = F.col("t_latest_observed_at") > F.col("o_latest_observed_at")
    return (
        F.when(F.col("o_latest_hash").isNull(), "unknown")
        .when(F.col("t_latest_hash").isNull(), "theirs_missing")
        .when(F.col("t_latest_hash") == F.col("o_latest_hash"), "equal")
        .when(knows("o", "t"), "they_behind")
        .when(knows("t", "o"), "we_behind")
        .when(newer, "divergent_theirs")
        .otherwise("divergent_ours")
    )


def content_decisions(ours: DataFrame, theirs: DataFrame, by: tuple = ()) -> DataFrame:
    """(file_id, decision) of two manifests; of equal clocks ours stays. ``by`` names columns
    of both that tell several pairs of manifests apart; they lead the result."""
    return _pair(ours, theirs, by).select(*by, "file_id", _decision().alias("decision"))


def plan_file_sync(ours: DataFrame, theirs: DataFrame, by: tuple = ()) -> DataFrame:
    """(file_id, action, content_hash, size, path): what we do about the peer's files.

    A newer tombstone comes first, then a newer restore, then move and content side by side.
    One join serves all; clocks of a file that we do not know count as 0. ``by`` names
    columns of both that tell several pairs of manifests apart; they lead the result."""
    return _plan(_pair(ours, theirs, by), by)


def _plan(pairs: DataFrame, by: tuple) -> DataFrame:
    """The actions of plan_file_sync for pairs of rows, of which ours (o_*) may be missing."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    p = pairs.where("t_latest_hash is not null").withColumn("decision", _decision())
    dead = F.coalesce(F.col("o_deleted"), F.lit(False))
    p = p.withColumn("kill", F.col("t_deleted") & ~dead & (F.col("t_deleted_at") > F.greatest(z("o_latest_observed_at"), z("o_restored_at"))))
    p = p.withColumn("raise", ~F.col("t_deleted") & dead & (F.col("t_restored_at") > z("o_deleted_at")))
    free = ~F.col("t_deleted") & ~F.col("kill") & ~F.col("raise")
    move = free & F.col("o_latest_hash").isNotNull() & (F.col("t_logical_path_modified_at") > F.col("o_logical_path_modified_at"))
    pull = free & F.col("decision").isin("unknown", "we_behind", "divergent_theirs")
    placing = F.when(F.col("decision") == "unknown", "create").otherwise("change")
    none, num = F.lit(None).cast("string"), F.lit(None).cast("long")
    act = lambda name, h, s, path: F.struct(name.alias("action"), h.alias("content_hash"), s.alias("size"), path.alias("path"))
    actions = F.array_compact(F.array(
        F.when(F.col("kill"), act(F.lit("delete"), none, num, none)),
        F.when(F.col("raise"), act(F.lit("restore"), F.col("t_latest_hash"), F.col("t_latest_size"), none)),
        F.when(move, act(F.lit("move"), none, num, F.col("t_logical_path"))),
        F.when(pull, act(F.concat(F.lit("pull_"), placing), F.col("t_latest_hash"), F.col("t_latest_size"), none)),
    ))
    return p.select(*by, "file_id", F.explode(actions).alias("a")).select(*by, "file_id", "a.*")


def _actions(ours, theirs, *names):
    return plan_file_sync(ours, theirs).where(F.col("action").isin(*names))


def plan_pulls(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return _actions(ours, theirs, "pull_create", "pull_change").select("file_id", "content_hash", "size", F.substring("action", 6, 10).alias("placing"))


def plan_deletions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return _actions(ours, theirs, "delete").select("file_id")


def plan_restores(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return _actions(ours, theirs, "restore").select("file_id")


def plan_moves(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return _actions(ours, theirs, "move").select("file_id", "path")


def divergent_files(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    d = content_decisions(ours, theirs).where("decision like 'divergent%'")
    return d.select("file_id", F.substring("decision", 11, 10).alias("winner"))


def plan_tag_definitions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, action): request a newer or unknown live tag, apply a newer tombstone."""
    o = ours.select("id", F.col("modified_at").alias("own"))
    newer = F.col("own").isNull() | (F.col("modified_at") > F.col("own"))
    return theirs.join(o, "id", "left").where(newer & ~(F.col("deleted") & F.col("own").isNull())).select("id", F.when(F.col("deleted"), "remove").otherwise("request").alias("action"))


def plan_entries(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, bad): tag and untag rows that are newer than ours; rows whose target is no
    id are reported instead."""
    good = F.coalesce(F.length(normalize_id_prefix("target_id")) == 32, F.lit(False))
    o = ours.select(*EDGE, F.col("modified_at").alias("own"))
    newer = theirs.where(good).join(o, EDGE, "left").where(F.col("own").isNull() | (F.col("modified_at") > F.col("own")))
    return newer.select(*EDGE, "modified_at", F.when(F.col("deleted"), "untag").otherwise("tag").alias("op")), theirs.where(~good)


def answer_tag_requests(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Each requested id with its definition, or found = false."""
    return requests.select("id").distinct().join(tags.withColumn("found", F.lit(True)), "id", "left").fillna(False, ["found"])


def sweep_files(announced: DataFrame, pulls: DataFrame) -> DataFrame:
    return announced.select("file_id").distinct().join(pulls.select("file_id"), "file_id", "left_anti")


PAIR = ("ours", "theirs")
#: Columns of a manifest that a plan needs beside the hashes of its history.
PLANNED = ("logical_path", "logical_path_modified_at", "deleted", "deleted_at", "restored_at", "latest_observed_at", "latest_hash", "latest_size")


def bucket_digests(manifests: DataFrame, buckets: int) -> DataFrame:
    """(device, bucket, n, d1, d2): a digest of all that a device knows about the files of a
    bucket, whatever their order, from sums of two hashes a row."""
    row = [c for c in manifests.columns if c != "device"]
    keyed = manifests.select("device", _bucket(buckets), F.xxhash64(*row).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *row).cast("decimal(38,0)").alias("b"))
    return keyed.groupBy("device", "bucket").agg(F.count("*").alias("n"), F.sum("a").alias("d1"), F.sum("b").alias("d2"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int").alias("bucket")


def unequal_buckets(manifests: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """(ours, theirs, bucket) of the pairs(ours, theirs) of devices whose digests differ."""
    d = bucket_digests(manifests, buckets)
    both = None
    for side, other in (PAIR, PAIR[::-1]):
        one = pairs.select(*PAIR).distinct().join(d, F.col(side) == F.col("device")).select(*PAIR, "bucket", F.struct("n", "d1", "d2").alias("d"))
        both = one if both is None else both.unionAll(one)
    # a bucket that one device lacks has one digest, two equal devices' have two equal ones
    return both.groupBy(*PAIR, "bucket").agg(F.count("*").alias("k"), F.min("d").alias("low"), F.max("d").alias("high")).where("k = 1 or low <> high").select(*PAIR, "bucket")


def plan_fleet(manifests: DataFrame, pairs: DataFrame, buckets: int = 4096) -> DataFrame:
    """(ours, theirs, file_id, action, content_hash, size, path): plan_file_sync for all
    pairs(ours, theirs) of devices at once. ``manifests`` are those of all devices (device,
    then the columns of file_manifest).

    Buckets of files on which the two devices agree in all columns plan nothing and are not
    joined: first the digests of buckets are compared, then only rows of unequal buckets are
    given out to the pairs. A device paired with itself plans nothing.

    Both rows of a pair meet in one aggregation by pair and file, so manifests that lie by
    file_id are read once for both sides and not shuffled."""
    with steps(manifests.sparkSession) as keep:
        apart = stage(unequal_buckets(manifests, pairs.where("ours <> theirs"), buckets), "apart")
        sides = F.explode(F.array(*[F.struct(F.col(side).alias("device"), F.lit(side == "ours").alias("own")) for side in PAIR]))
        sides = apart.select(*PAIR, "bucket", sides.alias("s")).select(*PAIR, "bucket", "s.*")
        knows = F.transform("history", lambda v: F.struct(v.content_hash.alias("content_hash"))).alias("history")
        row = F.struct(*PLANNED, knows)
        keyed = manifests.select("device", "file_id", _bucket(buckets), row.alias("row"))
        met = keyed.join(sides, ["device", "bucket"]).groupBy(*PAIR, "file_id").agg(F.collect_list(F.when(F.col("own"), F.col("row"))).alias("o"), F.collect_list(F.when(~F.col("own"), F.col("row"))).alias("t"))
        both = met.select(*PAIR, "file_id", "o", F.explode("t").alias("t")).select(*PAIR, "file_id", "t", F.explode_outer("o").alias("o"))
        both = both.select(*PAIR, "file_id", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "to" for c in (*PLANNED, "history")])
        return keep(_plan(both, PAIR), "fleet-plan")


def _newest(snapshots: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of all snapshots by key with the newest modified_at, of equal ones that of the
    first snapshot: one aggregation for any number of them."""
    columns = snapshots[0].columns
    every = reduce(DataFrame.unionAll, [s.select(columns).withColumn("_rank", F.lit(-k)) for k, s in enumerate(snapshots)])
    rest = [c for c in columns if c not in key]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("modified_at", "_rank")).alias("v")).select(*key, "v.*").select(columns)


def merge_fleet(tags: list[DataFrame], entries: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The tags and edges on which devices with these snapshots converge."""
    return _newest(tags, ["id"]), _newest(entries, EDGE)


def merge_fleet_files(files: list[DataFrame], versions: list[DataFrame]) -> DataFrame:
    """(id, logical_path, logical_path_modified_at, deleted, deleted_at, restored_at,
    content_hash, size, observed_at): the files on which devices with these snapshots
    converge, in one aggregation over all of them.

    The path has one clock, content another (when its latest version was observed), deletion
    and restoring one each; each part takes its newest value, of equal clocks that of the
    first device. A file is deleted if that clock is set and not behind the other two. A file
    that no device has a version of keeps null content."""
    names = ["logical_path", "logical_path_modified_at", "deleted_at", "restored_at", "content_hash", "size", "observed_at"]
    parts = []
    for k, (f, v) in enumerate(zip(files, versions)):
        last = v.groupBy(F.col("file_id").alias("id")).agg(F.max_by(F.struct("content_hash", "size", "observed_at"), "version_number").alias("v")).select("id", "v.*")
        nothing = {c: F.lit(None).cast(kind) for c, kind in (("logical_path", "string"), ("logical_path_modified_at", "long"), ("deleted_at", "long"), ("restored_at", "long"), ("content_hash", "string"), ("size", "long"), ("observed_at", "long"))}
        parts.append(f.select("id", *[(F.col(c) if c in f.columns else nothing[c]).alias(c) for c in names], F.lit(True).alias("listed"), F.lit(-k).alias("_rank")))
        parts.append(last.select("id", *[(F.col(c) if c in last.columns else nothing[c]).alias(c) for c in names], F.lit(False).alias("listed"), F.lit(-k).alias("_rank")))
    every = reduce(DataFrame.unionAll, parts)
    path = F.max_by("logical_path", F.when(F.col("listed"), F.struct("logical_path_modified_at", "_rank")))
    content = F.max_by(F.struct("content_hash", "size"), F.when(~F.col("listed"), F.struct("observed_at", "_rank")))
    zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    m = every.groupBy("id").agg(path.alias("logical_path"), F.max("logical_path_modified_at").alias("logical_path_modified_at"), zero("deleted_at"), zero("restored_at"), content.alias("c"), F.max("observed_at").alias("observed_at"), F.max("listed").alias("listed")).where("listed")
    dead = (F.col("deleted_at") > 0) & (F.col("deleted_at") >= F.greatest(F.coalesce("observed_at", F.lit(0)), F.col("restored_at")))
    return m.select("id", "logical_path", "logical_path_modified_at", dead.alias("deleted"), "deleted_at", "restored_at", "c.content_hash", "c.size", "observed_at")


def lag_report(merged: DataFrame, snapshots: DataFrame, key: list[str]) -> DataFrame:
    """(device, behind): rows of the merged table that a device's snapshot lacks or has with
    another clock."""
    have = snapshots.select("device", *key, "modified_at").distinct().join(merged.select(*key, "modified_at"), [*key, "modified_at"], "left_semi")
    n = have.groupBy("device").agg(F.count("*").alias("have"))
    # counted, not paired: no row is copied for every device
    total = F.broadcast(merged.agg(F.count("*").alias("total")))
    devices = snapshots.select("device").distinct().join(n, "device", "left").join(total, F.lit(True))
    return devices.select("device", (F.col("total") - F.coalesce("have", F.lit(0))).alias("behind")).where("behind > 0")


def fan_out(changes: DataFrame, peers: DataFrame) -> DataFrame:
    """Each change for each configured peer(peer, connected) but its origin."""
    to = F.broadcast(peers.select("peer", "connected"))  # the configured peers of one device
    return changes.join(to, F.coalesce(F.col("origin") != F.col("peer"), F.lit(True))).withColumn("dropped", ~F.col("connected")).drop("connected")
