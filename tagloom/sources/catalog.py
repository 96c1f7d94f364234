"""Catalog tables, change records, file listings and exports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage, steps

READ_BLOCK = 10_000  # paths that one reading job takes

SCHEMAS = {
    "files": "id string, logical_path string, logical_path_modified_at bigint, deleted boolean, deleted_at bigint, restored_at bigint",
    "versions": "file_id string, content_hash string, observed_at bigint, version_number bigint, origin string, size bigint",
    "tags": "id string, name string, color string, modified_at bigint, deleted boolean",
    "entries": "tag_id string, target_id string, type int, modified_at bigint, deleted boolean",
}
CHANGE = "seq bigint, op string, id string, tag_id string, target_id string, type int, name string, color string, path string, content_hash string, size bigint, version_number bigint, modified_at bigint, at bigint, origin string"
# Kinds of change record.
OPS = ["add", "edit", "move", "delete", "restore", "tag", "untag", "tag_add", "tag_rename", "tag_recolor", "tag_remove"]

# Variants of a wire change record and the fields each of them must have.
VARIANTS = {
    "FileMetadataAdded": ["file_id", "logical_path", "logical_path_modified_at", "content_hash", "size", "tags"],
    "FileMoved": ["file_id", "logical_path", "modified_at"],
    "FileMetadataChanged": ["file_id", "content_hash", "size"],
    "FileDeleted": ["file_id", "deleted_at"],
    "FileRestored": ["file_id", "content_hash", "size", "restored_at"],
    "TagAdded": ["tag_id", "tag_name", "color", "modified_at"],
    "TagRenamed": ["tag_id", "tag_name", "modified_at"],
    "TagRecolored": ["tag_id", "color", "modified_at"],
    "TagChanged": ["tag_id", "modified_at"],
    "TagRemoved": ["tag_id", "modified_at"],
    "FileTagged": ["file_id", "tag_id", "modified_at"],
    "FileTagChanged": ["file_id", "tag_id", "modified_at"],
    "FileUntagged": ["file_id", "tag_id", "modified_at"],
    "TagTagged": ["taggee_id", "tag_id", "modified_at"],
    "TagTagChanged": ["taggee_id", "tag_id", "modified_at"],
    "TagUntagged": ["taggee_id", "tag_id", "modified_at"],
}
FIELDS = "file_id string, logical_path string, logical_path_modified_at bigint, content_hash string, size bigint, tags array<string>, modified_at bigint, deleted_at bigint, restored_at bigint, tag_id string, taggee_id string, tag_name string, color string, metadata string"


def upgrade_files(df: DataFrame) -> DataFrame:
    """A files table of the first version, which has no restored_at, with that clock at 0."""
    return df if "restored_at" in df.columns else df.withColumn("restored_at", F.lit(0).cast("long"))


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables below path; a missing or retyped column is an error."""
    out = {}
    for name, ddl in SCHEMAS.items():
        df = spark.read.parquet(f"{path}/{name}")
        df = upgrade_files(df) if name == "files" else df
        want = T.StructType.fromDDL(ddl)
        have = dict(df.dtypes)
        wrong = [f.name for f in want if have.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ValueError(f"{name}: columns missing or of another type: {', '.join(wrong)}")
        out[name] = df.select(*want.fieldNames())
    return out


def write_catalog(cat: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    for name in SCHEMAS:
        cat[name].write.mode(mode).parquet(f"{path}/{name}")


def read_changes(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a column of JSON change records, batch or stream. A record that is no
    JSON, or of an unknown op, or without seq, is bad and keeps its text."""
    parsed = lines.select(F.col(col).alias("raw"), F.from_json(col, CHANGE + ", _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    ok = F.coalesce(F.col("r._corrupt_record").isNull() & F.col("r.op").isin(OPS) & F.col("r.seq").isNotNull(), F.lit(False))
    return parsed.where(ok).select("r.*").drop("_corrupt_record"), parsed.where(~ok).select("raw")


def read_wire_changes(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a column of JSON records {seq, at, origin, change}, batch or stream.
    change is an object with one key, the variant, and its fields as value. good has seq, at
    (the time of arrival), origin, op (the variant) and all fields, null where the variant
    has none; metadata stays JSON text. A record that is no JSON, lacks seq or at, is of no
    or several variants, or lacks a field of its variant is bad and keeps its text."""
    schema = f"seq bigint, at bigint, origin string, change map<string, struct<{FIELDS.replace(' string', ': string').replace(' bigint', ': bigint').replace(' array', ': array')}>>, _corrupt_record string"
    parsed = lines.select(F.col(col).alias("raw"), F.from_json(col, schema, {"mode": "PERMISSIVE"}).alias("r"))
    flat = parsed.select("raw", "r.seq", "r.at", "r.origin", "r._corrupt_record", F.size("r.change").alias("variants"), F.try_element_at(F.map_keys("r.change"), F.lit(1)).alias("op"), F.try_element_at(F.map_values("r.change"), F.lit(1)).alias("f"))
    complete = F.lit(False)
    for op, need in VARIANTS.items():
        all_there = F.lit(True)
        for c in need:
            all_there = all_there & F.col(f"f.{c}").isNotNull()
        complete = complete | ((F.col("op") == op) & all_there)
    ok = F.coalesce(F.col("_corrupt_record").isNull() & (F.col("variants") == 1) & F.col("seq").isNotNull() & F.col("at").isNotNull() & complete, F.lit(False))
    return flat.where(ok).select("seq", "at", "origin", "op", "f.*"), flat.where(~ok).select("raw")


def list_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime) of every file below root; no file is opened. Spark's file sources
    leave out files of no bytes, and so does this."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.unix_millis("modificationTime").alias("mtime"))


def _literal(path: str) -> str:
    """A path that stands for itself where a pattern may stand."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def hash_files(spark: SparkSession, paths: DataFrame, block: int = READ_BLOCK) -> DataFrame:
    """(path, content_hash) of the files in paths(path), which are opened, and no others. The
    paths pass the driver in blocks; each block is one job whose tasks read the contents."""
    out, some, it = [], [], paths.select("path").distinct().toLocalIterator(prefetchPartitions=True)
    with steps(spark) as keep:
        for row in it:
            some.append(_literal(row.path))
            if len(some) == block:
                out.append(_hashed(spark, some))
                some = []
        if some:
            out.append(_hashed(spark, some))
        if not out:
            return spark.createDataFrame([], "path string, content_hash string")
        return keep(reduce(DataFrame.union, out), "hashes")


def _hashed(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return stage(files.select("path", F.sha2("content", 256).alias("content_hash")), "hashes")


def scan_listing(spark: SparkSession, root: str, memo: DataFrame | None = None, block: int = READ_BLOCK) -> DataFrame:
    """(path, length, mtime, content_hash) of every file below root. With a memo (path, mtime,
    size, content_hash) of an earlier scan, files that agree with it in all three keep its
    hash unread. A file that goes between listing and reading has no hash."""
    with steps(spark) as keep:
        listed = stage(list_metadata(spark, root), "listing")
        known = listed.withColumn("content_hash", F.lit(None).cast("string"))
        if memo is not None:
            once = memo.where("content_hash is not null").groupBy(F.col("path"), F.col("mtime"), F.col("size").alias("length")).agg(F.max("content_hash").alias("content_hash"))
            known = listed.join(once, ["path", "length", "mtime"], "left")
        known = stage(known, "listing")
        fresh = hash_files(spark, known.where("content_hash is null"), block).withColumnRenamed("content_hash", "fresh")
        return keep(known.join(fresh, "path", "left").select("path", "length", "mtime", F.coalesce("content_hash", "fresh").alias("content_hash")), "scan")


def export_results(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(kind, json): one JSON document for each hit, to be written line by line."""
    return files.select(F.lit("file").alias("kind"), F.to_json(F.struct(*files.columns)).alias("json")).union(tags.select(F.lit("tag"), F.to_json(F.struct(*tags.columns))))
