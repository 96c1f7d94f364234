"""Placement of files in directories: which directory wants what, under which name.

dirs: (device, directory, ordinal, kind, keep_deleted, tags); kind universal or tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import tags_of_files
from .reads import alive, latest_versions

DIR = ["device", "directory"]
CHUNK = 16_384  # ranks of one path that a task takes


def wanted(files: DataFrame, files_tags: DataFrame, dirs: DataFrame) -> DataFrame:
    """(device, directory, file_id): a directory wants a file that carries all its tags;
    a universal one, or one without tags, wants every file. Directories are configuration."""
    few = dirs.select(*DIR, F.when(F.col("kind") == "universal", F.array().cast("array<string>")).otherwise(F.array_distinct("tags")).alias("tags"))
    need = F.broadcast(few.where("size(tags) > 0").select(*DIR, F.size("tags").alias("need"), F.explode("tags").alias("tag_id")))
    some = files_tags.join(need, "tag_id").groupBy(*DIR, "need", "file_id").agg(F.count("*").alias("n")).where("n = need").select(*DIR, "file_id")
    some = some.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(*DIR, "file_id")
    every = F.broadcast(few.where("size(tags) = 0").select(*DIR)).join(files.select(F.col("id").alias("file_id")), F.lit(True))
    return some.union(every.select(*DIR, "file_id"))


def effective_tags(carried: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_id, tags): carried tags first, then stored ones that are new."""
    none = F.array().cast("array<string>")
    j = carried.select("file_id", F.col("tags").alias("c")).join(stored.select("file_id", F.col("tags").alias("s")), "file_id", "full_outer")
    return j.select("file_id", F.array_union(F.coalesce("c", none), F.coalesce("s", none)).alias("tags"))


def physical_path(kind, file_id, logical_path):
    return F.when(kind == "universal", file_id).otherwise(logical_path)


def _numbered(path, n):
    """`` (n)`` before the last extension of the final component; n = 0 is the path itself."""
    head = F.regexp_extract(path, r"^(.*/)?[^/]*\z", 1)
    last = F.regexp_extract(path, r"([^/]*)\z", 1)
    ext = F.regexp_extract(last, r"^.+(\.[^.]*)\z", 1)
    stem = F.substr(last, F.lit(1), F.length(last) - F.length(ext))
    return F.when(n == 0, path).otherwise(F.concat(head, stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext))


def _ranked(df: DataFrame, key: list[str], rank: str) -> DataFrame:
    """df with the rank of each row within key by file_id, from 0. The rows of a key are
    counted in parts by the start of file_id, so that no task sorts all rows of one key."""
    parts = df.withColumn("_part", F.substring("file_id", 1, 2))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy(*key, "_part").agg(F.count("*").alias("_n")).withColumn("_before", before)
    within = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("file_id"))
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in (*key, "_part")], "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, "_part")]
    return parts.withColumn(rank, within).join(sizes, on).select(*df.columns, (F.col(rank) - 1 + F.col("_before")).cast("long").alias(rank))


def _running(df: DataFrame, key: list[str], order: str, weight: str, name: str) -> DataFrame:
    """df with the sum of weight over the rows of a key up to an order, itself included. Sums
    of stretches of CHUNK orders are added up first, then the rows within each stretch, so
    that the rows of one key are dealt to many tasks."""
    parts = df.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.groupBy(*key, "_chunk").agg(F.sum(weight).alias("_s")).withColumn("_before", before)
    sums = sums.select(*[F.col(c).alias(f"_of_{c}") for c in (*key, "_chunk")], "_before")
    within = F.sum(weight).over(Window.partitionBy(*key, "_chunk").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*key, "_chunk")]
    return parts.withColumn(name, within).join(sums, on).select(*df.columns, (F.col(name) + F.col("_before")).cast("long").alias(name))


def resolve_collisions(placed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(device, directory, file_id, physical_path) for candidates (device, directory,
    file_id, path): each gets the lowest free number, in order of file_id; placed rows keep
    their names. A name is taken if a placed row has it, or if it is the own path of other
    candidates; of one path's candidates the k-th takes the k-th number that is not taken.
    Rows with a null path or file_id get no name; repeated rows each get one."""
    key = [*DIR, "path"]
    todo = candidates.select(*key, "file_id").where("path is not null and file_id is not null")
    paths = todo.select(*key).distinct()
    used = placed.select(*DIR, F.col("physical_path").alias("name"))
    # which number of which path a taken name is: "a (3).b" is the third of "a.b"
    number = F.regexp_extract("name", r"^(?:.*/)?[^/]* \(([1-9][0-9]{0,8})\)(?:\.[^./]*)?\z", 1)
    base = F.regexp_replace("name", r" \([1-9][0-9]{0,8}\)((?:\.[^./]*)?)\z", "$1")
    literal = used.select(*DIR, F.col("name").alias("path"), F.lit(0).alias("n"), "name")
    names = used.unionByName(paths.select(*DIR, F.col("path").alias("name")))
    spelt = names.where(number != "").select(*DIR, base.alias("path"), number.cast("int").alias("n"), "name")
    taken = literal.unionByName(spelt).where(_numbered(F.col("path"), F.col("n")) == F.col("name")).select(*key, "n").distinct()
    taken = taken.join(paths, key, "left_semi")
    # so many numbers are free below a taken one; a candidate of rank r skips those with at most r
    ranks = _running(taken.withColumn("one", F.lit(1)), key, "n", "one", "rank")
    marks = ranks.groupBy(*key, (F.col("n") - F.col("rank") + 1).cast("long").alias("r")).agg(F.count("*").alias("skip"))
    both = _ranked(todo, key, "r").withColumn("skip", F.lit(0).cast("long")).unionByName(marks.withColumn("file_id", F.lit(None).cast("string")))
    out = _running(both, key, "r", "skip", "skipped").where("file_id is not null")
    return out.select(*DIR, "file_id", _numbered(F.col("path"), F.col("r") + F.col("skipped")).alias("physical_path"))


def placement_diff(cat: dict, dirs: DataFrame, placements: DataFrame) -> DataFrame:
    """(device, directory, file_id, action): add, remove, keep or fetch (wanted, but no
    device holds a copy) for the tag directories."""
    own = dirs.where("kind <> 'universal'")
    want = wanted(alive(cat["files"]), tags_of_files(cat), own).withColumn("w", F.lit(True))
    held = placements.join(F.broadcast(own.select(*DIR)), DIR, "left_semi").select(*DIR, "file_id").distinct().withColumn("h", F.lit(True))
    any_ = placements.select("file_id").distinct().withColumn("a", F.lit(True))
    j = want.join(held, [*DIR, "file_id"], "full_outer").join(any_, "file_id", "left")
    action = F.when(F.col("w").isNull(), "remove").when(F.col("h").isNotNull(), "keep").when(F.col("a").isNull(), "fetch").otherwise("add")
    return j.select(*DIR, "file_id", action.alias("action"))


def copy_source(placements: DataFrame, dirs: DataFrame) -> DataFrame:
    """(device, file_id, directory): the first holding directory in order of configuration."""
    return placements.join(F.broadcast(dirs.select(*DIR, "ordinal")), DIR).groupBy("device", "file_id").agg(F.min_by("directory", "ordinal").alias("directory"))


def change_targets(changes: DataFrame, files_tags: DataFrame, dirs: DataFrame) -> DataFrame:
    """Directories to update for changes (file_id, device, origin_directory), without the origin."""
    return _targets(changes, files_tags, dirs).where("not directory <=> origin_directory").drop("kind", "keep_deleted")


def create_targets(changes: DataFrame, files_tags: DataFrame, dirs: DataFrame) -> DataFrame:
    """As change_targets, but a universal origin still gets the file."""
    return _targets(changes, files_tags, dirs).where("not directory <=> origin_directory or kind = 'universal'").drop("kind", "keep_deleted")


def delete_targets(changes: DataFrame, files_tags: DataFrame, dirs: DataFrame) -> DataFrame:
    """Directories that lose a deleted file; a universal one that keeps deleted files does not."""
    return _targets(changes, files_tags, dirs).where("not (kind = 'universal' and keep_deleted)").drop("kind", "keep_deleted")


def _targets(changes, files_tags, dirs):
    want = wanted(changes.select(F.col("file_id").alias("id")).distinct(), files_tags, dirs)
    return changes.join(want, ["device", "file_id"]).join(F.broadcast(dirs.select(*DIR, "kind", "keep_deleted", "ordinal")), DIR)


def assign_transfer(targets: DataFrame) -> DataFrame:
    """The last target of each file, in order of configuration, moves; all others copy."""
    w = Window.partitionBy("device", "file_id").orderBy(F.desc("ordinal"))
    return targets.withColumn("transfer", F.when(F.row_number().over(w) == 1, "move").otherwise("copy"))


def directory_drift(listing: DataFrame, placements: DataFrame, versions: DataFrame) -> DataFrame:
    """(device, directory, physical_path, file_id, drift) of a listing (device, directory,
    physical_path, content_hash): deleted, added, changed or unchanged."""
    now = latest_versions(versions.select("file_id", "version_number", "content_hash")).select("file_id", F.col("content_hash").alias("known"))
    j = listing.join(placements.join(now, "file_id", "left"), [*DIR, "physical_path"], "full_outer")
    drift = F.when(F.col("content_hash").isNull(), "deleted").when(F.col("file_id").isNull(), "added").when(F.col("content_hash").eqNullSafe(F.col("known")), "unchanged").otherwise("changed")
    return j.select(*DIR, "physical_path", "file_id", "content_hash", drift.alias("drift"))


def drift_changes(drift: DataFrame, dirs: DataFrame) -> DataFrame:
    """Change rows for drifted files; an added file gets a tag directory's tags and an id
    made from its place."""
    op = F.when(F.col("drift") == "added", "create").when(F.col("drift") == "changed", "modify").otherwise("remove")
    j = drift.where("drift <> 'unchanged'").join(F.broadcast(dirs.select(*DIR, "kind", "tags")), DIR)
    tags = F.when((F.col("drift") == "added") & (F.col("kind") != "universal"), F.col("tags")).otherwise(F.array().cast("array<string>"))
    return j.select(*DIR, F.coalesce("file_id", F.md5(F.concat_ws("\x00", *DIR, "physical_path"))).alias("file_id"), op.alias("op"), F.col("physical_path").alias("path"), "content_hash", tags.alias("tags"))


def rename_tree(placements: DataFrame, renames: DataFrame) -> DataFrame:
    """Moves for directory renames (device, directory, old, new): every placed file below
    ``old`` gets a new path. Joined on each of a path's own ancestors, not by a prefix scan."""
    parts = F.split("physical_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    j = placements.withColumn("old", F.explode(above)).join(renames, [*DIR, "old"])
    return j.select(*DIR, "file_id", "physical_path", F.concat("new", F.substr("physical_path", F.length("old") + 1)).alias("new_path"))


def recoverable(cat: dict, holders: DataFrame) -> DataFrame:
    """Deleted files whose latest content some holder (file_id, content_hash) still has."""
    now = latest_versions(cat["versions"].select("file_id", "version_number", "content_hash"))
    dead = alive(cat["files"], "only").select(F.col("id").alias("file_id"))
    return now.join(dead, "file_id", "left_semi").join(holders.select("file_id", "content_hash"), ["file_id", "content_hash"], "left_semi").select("file_id", "content_hash")


def replication(cat: dict, placements: DataFrame) -> DataFrame:
    """(file_id, holders): devices that hold each live file, 0 included."""
    n = placements.select("file_id", "device").distinct().groupBy("file_id").agg(F.count("*").alias("holders"))
    return alive(cat["files"]).select(F.col("id").alias("file_id")).join(n, "file_id", "left").fillna(0, ["holders"])
