"""Catalog reads: listings, latest versions, sizes and audits.

``cat`` is a dict of DataFrames (files, versions, tags, entries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shortid import short_ids


def alive(df: DataFrame, deleted: str = "exclude") -> DataFrame:
    return {"exclude": df.where(~F.col("deleted")), "include": df, "only": df.where("deleted")}[deleted]


def latest_versions(versions: DataFrame) -> DataFrame:
    """The row of the highest version_number of each file; partial aggregation, no sort."""
    rest = [c for c in versions.columns if c != "file_id"]
    return versions.groupBy("file_id").agg(F.max_by(F.struct(*rest), "version_number").alias("v")).select("file_id", "v.*")


def list_files(cat: dict, deleted: str = "exclude", short: bool = False) -> DataFrame:
    """Files with their latest version and first and latest observed_at; files without a
    version are left out. With ``short`` also short_len, which looks at the ids of all files."""
    v = cat["versions"].groupBy("file_id").agg(F.max_by(F.struct("content_hash", "observed_at", "version_number", "size"), "version_number").alias("v"), F.min_by("observed_at", "version_number").alias("created_at"))
    listed = cat["files"].join(v, F.col("id") == F.col("file_id")).select(cat["files"]["*"], "created_at", F.col("v.observed_at").alias("modified_at"), "v.content_hash", "v.version_number", "v.size")
    listed = alive(listed, deleted)
    return listed.join(short_ids(cat["files"], "id"), "id") if short else listed


def version_history(versions: DataFrame, *more: Column) -> DataFrame:
    """(file_id, history) with the versions in order; ``more`` are further aggregates."""
    return versions.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("version_number", "content_hash", "size"))).alias("history"), *more)


def record_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows of new (file_id, arrival, ...) numbered on from each file's highest."""
    top = versions.groupBy("file_id").agg(F.max("version_number").alias("top"))
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("arrival"))
    more = new.withColumn("n", n).join(top, "file_id", "left").withColumn("version_number", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long"))
    return versions.unionByName(more.select(versions.columns))


def reverts(versions: DataFrame) -> DataFrame:
    """Versions whose content was the file's before, but not just before."""
    w = Window.partitionBy("file_id").orderBy("version_number")
    first = F.min("version_number").over(Window.partitionBy("file_id", "content_hash"))
    seen = versions.withColumn("previous", F.lag("content_hash").over(w)).withColumn("first_seen", first)
    return seen.where("first_seen < version_number and not previous <=> content_hash").drop("previous")


def drop_noop_versions(versions: DataFrame, announced: DataFrame) -> DataFrame:
    """Announced (file_id, arrival, content_hash, ...) that change the content at their turn."""
    now = latest_versions(versions).select("file_id", F.col("content_hash").alias("now"))
    before = F.lag("content_hash").over(Window.partitionBy("file_id").orderBy("arrival"))
    return announced.withColumn("before", before).join(now, "file_id", "left").where(~F.col("content_hash").eqNullSafe(F.coalesce("before", "now"))).drop("before", "now")


def list_tags(cat: dict, deleted: str = "exclude") -> DataFrame:
    return alive(cat["tags"], deleted)


def catalog_size(cat: dict, deleted: str = "exclude") -> DataFrame:
    sizes = latest_versions(cat["versions"].select("file_id", "version_number", "size"))
    files = alive(cat["files"], deleted).select(F.col("id").alias("file_id"))
    return files.join(sizes, "file_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def size_of(cat: dict, ids: DataFrame, deleted: str = "exclude") -> DataFrame:
    """As catalog_size, for the files in ids(file_id)."""
    some = cat["files"].join(ids.select(F.col("file_id").alias("id")), "id", "left_semi")
    return catalog_size({**cat, "files": some}, deleted)


def storage_stats(cat: dict, placements: DataFrame) -> DataFrame:
    """Bytes and distinct live files held by each device, beside the catalog's totals."""
    sizes = latest_versions(cat["versions"].select("file_id", "version_number", "size")).join(alive(cat["files"]).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    held = placements.select("device", "file_id").distinct().join(sizes, "file_id")
    total = F.broadcast(sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count("*").alias("total_files")))  # one row
    return held.groupBy("device").agg(F.sum("size").alias("local_bytes"), F.count("*").alias("local_files")).join(total, F.lit(True))


def audit_deleted_flag(cat: dict) -> DataFrame:
    """Files whose stored flag differs from what their three clocks say."""
    seen = latest_versions(cat["versions"].select("file_id", "version_number", "observed_at"))
    j = cat["files"].join(seen, F.col("id") == F.col("file_id"), "left")
    dead = F.col("deleted_at") >= F.greatest(F.coalesce("observed_at", F.lit(0)), "restored_at")
    return j.select("id", "deleted", (dead & (F.col("deleted_at") > 0)).alias("should_be")).where("deleted <> should_be")


def find_by_path(cat: dict, paths: DataFrame) -> DataFrame:
    return alive(cat["files"]).join(paths.select(F.col("path").alias("logical_path")).distinct(), "logical_path").select(F.col("logical_path").alias("path"), "id")


def find_tags_by_name(cat: dict, names: DataFrame) -> DataFrame:
    return alive(cat["tags"]).join(names.select("name").distinct(), "name").select("name", "id")


def name_collisions(cat: dict) -> DataFrame:
    """Names that live tags share and paths that live files share, with the ids."""
    both = alive(cat["tags"]).select(F.lit("tag").alias("kind"), "name", "id").union(alive(cat["files"]).select(F.lit("file"), "logical_path", "id"))
    return both.groupBy("kind", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids")).where("n > 1")


def files_under(placements: DataFrame, prefix: str) -> DataFrame:
    """Placed files at or below a path, by whole components."""
    p = prefix.rstrip("/")
    return placements.where((F.col("physical_path") == p) | F.col("physical_path").startswith(p + "/"))


def tag_names(cat: dict, kind: int) -> DataFrame:
    """Sorted names of the live tags put on each target directly; kind 0 files, 1 tags."""
    edges = alive(cat["entries"]).where(F.col("type") == kind).select("tag_id", "target_id")
    names = alive(cat["tags"]).select(F.col("id").alias("tag_id"), "name")
    return edges.join(names, "tag_id").groupBy("target_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
