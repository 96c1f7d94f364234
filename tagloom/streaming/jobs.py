"""Structured Streaming jobs over change records: keyed state, tables that follow a stream,
standing searches over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import files_of_tags
from ..operators.lww import EDGE, merge_entries, merge_tags
from ..operators.search import search_files
from ..sources.catalog import SCHEMAS
from ..sources.staging import stage, steps
from .snapshots import Snapshots
from .stateful import fold_by_key

TAG_STATE = "born boolean, top long, name string, color string, deleted boolean"
TAG_OUT = "id string, name string, color string, modified_at long, deleted boolean"


def _fold_tags(now: tuple | None, key: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    born, top, name, color, deleted = now or (False, None, None, None, False)
    for _, op, value, at in sorted(rows, key=lambda r: r[0]):
        if not born and op != "add" or top is not None and at <= top:
            continue
        born, top = True, at
        if op in ("add", "rename"):
            name = value
        if op == "recolor":
            color = value
        if op in ("add", "remove"):
            deleted = op == "remove"
    return (born, top, name, color, deleted), [(*key, name, color, top, deleted)] if born else []


def stream_tags(changes: DataFrame) -> DataFrame:
    """Latest state of each tag of a change stream (seq, id, op, value, modified_at), keyed
    state by tag; agrees with replay_tags as long as seq grows from batch to batch. Rows
    without id, seq or modified_at are ignored."""
    known = changes.where("id is not null and seq is not null and modified_at is not null")
    return fold_by_key(known, ["id"], _fold_tags, ["seq", "op", "value", "modified_at"], TAG_STATE, TAG_OUT)


ENTRY_OUT = "tag_id string, target_id string, type int, modified_at long, deleted boolean"


def _fold_entries(now: tuple | None, key: tuple, rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
    for _, op, at in sorted(rows, key=lambda r: r[0]):
        if now is None and op == "tag" or now is not None and at > now[0]:
            now = (at, op == "untag")
    return now, [(*key, *now)] if now else []


def stream_entries(changes: DataFrame) -> DataFrame:
    """Latest state of each edge of a stream (seq, tag_id, target_id, type, op, modified_at);
    agrees with replay_entries as long as seq grows from batch to batch. Rows without seq or
    modified_at are ignored."""
    known = changes.where("seq is not null and modified_at is not null")
    return fold_by_key(known, ["tag_id", "target_id", "type"], _fold_entries, ["seq", "op", "modified_at"], "modified_at long, deleted boolean", ENTRY_OUT)


def tag_snapshots(spark: SparkSession, top: str, **how) -> Snapshots:
    return Snapshots(spark, f"{top}/tags", ["id"], SCHEMAS["tags"], merge_tags, **how)


def entry_snapshots(spark: SparkSession, top: str, **how) -> Snapshots:
    return Snapshots(spark, f"{top}/entries", EDGE, SCHEMAS["entries"], merge_entries, **how)


def snapshot_batch(table: Snapshots, after: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that takes a batch over into a table. after(batch id, before,
    now, keys) sees the table before and after it, and the keys that it changed."""

    def batch(df: DataFrame, number: int) -> None:
        keys = df.select(*table.keys).distinct()
        table.add(df, number)
        if after:
            now, before = table.read(number + 1), table.read(number)
            after(number, df.limit(0).select(now.columns) if before is None else before, now, keys)

    return batch


def run_snapshots(stream: DataFrame, table: Snapshots, checkpoint: str, after: Callable | None = None):
    """Keep a table up to date with a stream of its rows."""
    return stream.writeStream.foreachBatch(snapshot_batch(table, after)).option("checkpointLocation", checkpoint)


def standing_search(search: Callable[[DataFrame], DataFrame], emit: Callable[[int, DataFrame], None], key: str = "id") -> Callable:
    """For run_snapshots(after=...): the hits that a search gained and lost by a batch, as
    (id, change). The search looks at each row alone, so only rows that the batch touched are
    searched, before and after it."""

    def after(number: int, before: DataFrame, now: DataFrame, keys: DataFrame) -> None:
        old, new = (search(t.join(keys.select(key).distinct(), key, "left_semi").select(t.columns)).select("id").distinct() for t in (before, now))
        emit(number, _gained_and_lost(old, new))

    return after


def _gained_and_lost(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, "id", "left_anti").withColumn("change", F.lit("added")).union(old.join(new, "id", "left_anti").withColumn("change", F.lit("removed")))


def touched_files(cat: dict, touched: dict[str, DataFrame], include_subtags: bool) -> DataFrame:
    """(id) of the files whose answer to a search may hang on a batch's keys, in one state of
    the catalog: its files and versions, files at its edges, and files of its tags and, with
    include_subtags, of all that lies below a tag or edge that it changed."""
    none = cat["files"].select("id").limit(0)
    ids = none
    if "files" in touched:
        ids = ids.union(touched["files"].select("id"))
    if "versions" in touched:
        ids = ids.union(touched["versions"].select(F.col("file_id").alias("id")))
    tags = none
    if "tags" in touched:
        tags = tags.union(touched["tags"].select("id"))
    if "entries" in touched:
        e = touched["entries"]
        ids = ids.union(e.where("type = 0").select(F.col("target_id").alias("id")))
        if include_subtags:  # a file below the edge's lower end gains or loses its upper one
            tags = tags.union(e.where("type = 1").select(F.col("target_id").alias("id")))
    roots = tags.select(F.col("id").alias("root")).distinct()
    return ids.union(files_of_tags(cat, roots, include_subtags).select(F.col("file_id").alias("id"))).distinct()


def standing_file_search(before: dict, now: dict, touched: dict[str, DataFrame], terms: list[dict], include_subtags: bool = False, deleted: str = "exclude") -> DataFrame:
    """(id, change) of a file search between two states of a catalog, of which a batch changed
    the keys in ``touched`` (by table, with the tables' key columns). Only files that the
    batch can have touched are searched, in both states; all others answer as before."""
    with steps(next(iter(now.values())).sparkSession) as keep:
        ids = stage(touched_files(before, touched, include_subtags).union(touched_files(now, touched, include_subtags)).distinct(), "touched")

        def hits(cat: dict) -> DataFrame:
            near = {**cat, "files": cat["files"].join(ids, "id", "left_semi"), "versions": cat["versions"].join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi")}
            edges = cat["entries"]
            near["entries"] = edges.where("type = 1").unionByName(edges.where("type = 0").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(edges.columns))
            return stage(search_files(near, terms, include_subtags, deleted).select("id").distinct(), "hits")

        return keep(_gained_and_lost(hits(before), hits(now)), "standing")
