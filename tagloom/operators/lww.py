"""Last-writer-wins merge and replay. seq is the order of arrival at one replica; of equal
clocks the earlier arrival stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import validate_tags

EDGE = ["tag_id", "target_id", "type"]


def _merge(base: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; an incoming row wins by a strictly newer clock only."""
    both = base.withColumn("_r", F.lit(0)).unionByName(incoming.select(base.columns).withColumn("_r", F.lit(-1)))
    rest = [c for c in base.columns if c not in key]
    won = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("modified_at", "_r")).alias("v"))
    return won.select(*key, "v.*").select(base.columns)


def merge_tags(base: DataFrame, incoming: DataFrame) -> DataFrame:
    return _merge(base, incoming, ["id"])


def merge_entries(base: DataFrame, incoming: DataFrame) -> DataFrame:
    return _merge(base, incoming, EDGE)


def _accepted_tags(changes: DataFrame) -> DataFrame:
    """Changes with ``accepted``: from the first add on, each strictly newer than all before."""
    past = Window.partitionBy("id").orderBy("seq")
    born = changes.withColumn("born", F.min(F.when(F.col("op") == "add", F.col("seq"))).over(Window.partitionBy("id")))
    real = F.col("seq") >= F.col("born")
    top = F.max(F.when(real, F.col("modified_at"))).over(past.rowsBetween(Window.unboundedPreceding, -1))
    return born.withColumn("accepted", F.coalesce(real & (top.isNull() | (F.col("modified_at") > top)), F.lit(False))).drop("born")


def replay_tags(changes: DataFrame) -> DataFrame:
    """Tags from changes (seq, id, op, value, modified_at); op add, rename, recolor, remove.

    All four share one clock. What comes before the first add is ignored; a rename or
    recolour does not bring a removed tag back, an add does. value is the name (the colour
    for recolor); an add sets the colour too if changes have a column color."""
    ok = _accepted_tags(changes).where("accepted")
    when = lambda *ops: F.when(F.col("op").isin(*ops), F.col("seq"))
    color = F.max_by("value", when("recolor"))
    if "color" in changes.columns:
        color = F.max_by(F.when(F.col("op") == "add", F.col("color")).otherwise(F.col("value")), when("add", "recolor"))
    out = ok.groupBy("id").agg(F.max_by("value", when("add", "rename")).alias("name"), color.alias("color"), F.max("modified_at").alias("modified_at"), (F.max_by("op", when("add", "remove")) == "remove").alias("deleted"))
    return out


def replay_entries(changes: DataFrame) -> DataFrame:
    """Edges from changes (seq, tag_id, target_id, type, op, modified_at); op tag or untag.
    Untags before the first tag are ignored, then the newest wins."""
    born = F.min(F.when(F.col("op") == "tag", F.col("seq"))).over(Window.partitionBy(*EDGE))
    real = changes.withColumn("born", born).where("seq >= born")
    won = real.groupBy(*EDGE).agg(F.max_by(F.struct("modified_at", "op"), F.struct("modified_at", -F.col("seq"))).alias("v"))
    return won.select(*EDGE, "v.modified_at", (F.col("v.op") == "untag").alias("deleted"))


def replay_paths(changes: DataFrame) -> DataFrame:
    """Paths from changes (seq, file_id, op, path, modified_at); op add or move. The first
    add sets path and clock; after it a strictly newer move wins, later adds are ignored."""
    born = F.min(F.when(F.col("op") == "add", F.col("seq"))).over(Window.partitionBy("file_id"))
    real = changes.withColumn("born", born).where("seq = born or (seq > born and op = 'move')")
    won = real.groupBy("file_id").agg(F.max_by(F.struct("path", "modified_at"), F.struct("modified_at", -F.col("seq"))).alias("v"))
    return won.select("file_id", F.col("v.path").alias("logical_path"), F.col("v.modified_at").alias("logical_path_modified_at"))


def resolve_tombstones(df: DataFrame) -> DataFrame:
    """Convergent form: the newest of each clock by file; dead where the deletion is not
    older than both the last edit and the last restore."""
    top = df.groupBy("file_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("observed_at", "deleted_at", "restored_at")])
    return top.withColumn("deleted", (F.col("deleted_at") > 0) & (F.greatest("observed_at", "restored_at") <= F.col("deleted_at")))


def replay_tombstones(changes: DataFrame) -> DataFrame:
    """State of each file after its changes (seq, file_id, op, at) in order; op edit, delete,
    restore. A delete of a dead file is skipped and one not newer than the last edit and
    restore does not count; the restore clock only goes forward and revives if newer than
    the deletion; so does an edit. A restore of what a live file holds already does nothing;
    it is marked by a true column ``same``, if there is one. The fold runs on a file's own
    short list of changes."""
    return _fold_tombstones(changes).select("file_id", "s.deleted", "s.observed_at", "s.deleted_at", "s.restored_at")


def _fold_tombstones(changes: DataFrame) -> DataFrame:
    """(file_id, s): the state, and under ``rejected`` the seq of deletes that did nothing."""
    same = F.coalesce("same", F.lit(False)) if "same" in changes.columns else F.lit(False)
    ordered = changes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "at", same.alias("same")))).alias("c"))
    zero = F.struct(F.lit(False).alias("deleted"), *[F.lit(0).cast("long").alias(k) for k in ("observed_at", "deleted_at", "restored_at")], F.array().cast("array<bigint>").alias("rejected"))

    def step(s, c):
        kills = (c.op == "delete") & ~s.deleted & (c["at"] > F.greatest(s.observed_at, s.restored_at))
        edited = F.when(c.op == "edit", c["at"]).otherwise(s.observed_at)
        restores = (c.op == "restore") & (s.deleted | ~c.same)
        restored = F.when(restores & (c["at"] > s.restored_at), c["at"]).otherwise(s.restored_at)
        revives = ((c.op == "edit") & (c["at"] > s.deleted_at)) | (restores & (F.greatest(restored, s.observed_at) > s.deleted_at))
        return F.struct((kills | (s.deleted & ~revives)).alias("deleted"), edited.alias("observed_at"), F.when(kills, c["at"]).otherwise(s.deleted_at).alias("deleted_at"), restored.alias("restored_at"), F.when((c.op == "delete") & ~kills, F.concat(s.rejected, F.array(c.seq.cast("bigint")))).otherwise(s.rejected).alias("rejected"))

    return ordered.select("file_id", F.aggregate("c", zero, step).alias("s"))


def replay(changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A catalog from change tables by kind: tags, entries, paths, tombstones."""
    paths, states = replay_paths(changes["paths"]), replay_tombstones(changes["tombstones"])
    files = paths.join(states, "file_id", "left").select(F.col("file_id").alias("id"), "logical_path", "logical_path_modified_at", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("deleted_at", F.lit(0)).alias("deleted_at"), F.coalesce("restored_at", F.lit(0)).alias("restored_at"))
    return {"tags": replay_tags(changes["tags"]), "entries": replay_entries(changes["entries"]), "files": files}


def replay_log(log: DataFrame) -> dict[str, DataFrame]:
    """files, versions, tags and entries from one log of wire changes (sources.catalog,
    read_wire_changes), in order of seq.

    A file exists from its first FileMetadataAdded on, which also carries its tags; what
    comes before it is ignored. FileMetadataAdded and FileMetadataChanged append a version,
    observed on arrival, unless the file holds that content already; a restore appends none.
    Changes of metadata are taken note of nowhere. Rows without their id are ignored."""
    born = F.min(F.when(F.col("op") == "FileMetadataAdded", F.col("seq"))).over(Window.partitionBy("file_id"))
    known = log.where(F.col("op").isin("FileMetadataAdded", "FileMetadataChanged", "FileMoved", "FileDeleted", "FileRestored") & F.col("file_id").isNotNull()).withColumn("born", born).where("seq >= born")
    announces = F.col("op").isin("FileMetadataAdded", "FileMetadataChanged")
    before = F.last(F.when(announces, F.col("content_hash")), ignorenulls=True).over(Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    known = known.withColumn("same", F.coalesce(F.col("content_hash") == before, F.lit(False)))
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("seq")).cast("long")
    versions = known.where(announces & ~F.col("same")).select("file_id", "content_hash", F.col("at").alias("observed_at"), number.alias("version_number"), "origin", "size")

    paths = known.where(F.col("op").isin("FileMetadataAdded", "FileMoved")).select("seq", "file_id", F.when(F.col("op") == "FileMoved", "move").otherwise("add").alias("op"), F.col("logical_path").alias("path"), F.coalesce("modified_at", "logical_path_modified_at").alias("modified_at"))
    kind = F.when(announces & ~F.col("same"), "edit").when(F.col("op") == "FileDeleted", "delete").when(F.col("op") == "FileRestored", "restore")
    when = F.when(announces, F.col("at")).otherwise(F.coalesce("deleted_at", "restored_at"))
    clocks = known.select("seq", "file_id", kind.alias("op"), when.alias("at"), "same").where("op is not null")

    tag_ops = {"TagAdded": "add", "TagRenamed": "rename", "TagRecolored": "recolor", "TagRemoved": "remove"}
    ops = F.create_map(*[F.lit(x) for pair in tag_ops.items() for x in pair])
    value = F.when(F.col("op") == "TagRecolored", F.col("color")).otherwise(F.col("tag_name"))
    tags = log.where(F.col("op").isin(*tag_ops) & F.col("tag_id").isNotNull()).select("seq", F.col("tag_id").alias("id"), ops[F.col("op")].alias("op"), value.alias("value"), "color", "modified_at")

    tagged = log.where(F.col("op").isin("FileTagged", "FileUntagged", "TagTagged", "TagUntagged"))
    of_file = F.col("op").startswith("File")
    edges = tagged.select("seq", "tag_id", F.when(of_file, F.col("file_id")).otherwise(F.col("taggee_id")).alias("target_id"), F.when(of_file, 0).otherwise(1).alias("type"), F.when(F.col("op").endswith("Untagged"), "untag").otherwise("tag").alias("op"), "modified_at")
    carried = known.where("seq = born").select("seq", F.explode("tags").alias("tag_id"), F.col("file_id").alias("target_id"), F.lit(0).alias("type"), F.lit("tag").alias("op"), F.col("logical_path_modified_at").alias("modified_at"))
    edges = edges.unionByName(carried).where("tag_id is not null and target_id is not null")
    return {**replay({"tags": tags, "entries": edges, "paths": paths, "tombstones": clocks}), "versions": versions}


def rejected_changes(changes: DataFrame) -> DataFrame:
    """Tag changes that the replay does not accept."""
    return _accepted_tags(changes).where("not accepted").drop("accepted")


def _not_newest(changes: DataFrame, key: list[str], first: str, later: list[str]) -> DataFrame:
    """Changes before the first one of op ``first`` of their key; after it those of ``later``
    that are not strictly newer than all accepted so far; and any of another op."""
    past = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    born = F.min(F.when(F.col("op") == first, F.col("seq"))).over(Window.partitionBy(*key))
    counts = (F.col("seq") == F.col("born")) | (F.col("seq") > F.col("born")) & F.col("op").isin(later)
    top = F.max(F.when(counts, F.col("modified_at"))).over(past)  # what is not newer does not raise it
    ok = F.coalesce(counts & (top.isNull() | (F.col("modified_at") > top)), F.lit(False))
    return changes.withColumn("born", born).withColumn("ok", ok).where("not ok").drop("born", "ok")


def rejected_entries(changes: DataFrame) -> DataFrame:
    """Edge changes (seq, tag_id, target_id, type, op, modified_at) that replay_entries does
    not accept: an untag before the first tag, and what is no newer than the edge."""
    return _not_newest(changes, EDGE, "tag", ["tag", "untag"])


def rejected_paths(changes: DataFrame) -> DataFrame:
    """Path changes (seq, file_id, op, path, modified_at) that replay_paths does not accept:
    all before the first add, later adds, and moves that are no newer than the path."""
    return _not_newest(changes, ["file_id"], "add", ["move"])


def rejected_tombstones(changes: DataFrame) -> DataFrame:
    """(file_id, seq) of deletes that replay_tombstones does not accept: no newer than the
    last edit or restore before them, or of a file that is deleted already."""
    return _fold_tombstones(changes).select("file_id", F.explode("s.rejected").alias("seq"))


def apply_declared_tags(tags: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared tags that no row has, under the lowest clock, beside all rows of tags."""
    good, _ = validate_tags(declared)
    new = good.dropDuplicates(["id"]).join(tags.select("id"), "id", "left_anti")
    return tags.unionByName(new.select("id", "name", "color", F.lit(-(1 << 63)).cast("long").alias("modified_at"), F.lit(False).alias("deleted")))


def restore_tags(tags: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """The deleted tags in ids(id), announced again under a new clock."""
    return tags.where("deleted").join(ids.select("id").distinct(), "id", "left_semi").withColumn("deleted", F.lit(False)).withColumn("modified_at", F.lit(now).cast("long"))


def tombstones(cat: dict, now: int, day: int = 86_400_000) -> DataFrame:
    """(kind, age, n): tombstones by kind and age class (week, month, year, older)."""
    both = cat["files"].where("deleted").select(F.lit("file").alias("kind"), F.col("deleted_at").alias("at"))
    for kind, name in (("tag", "tags"), ("entry", "entries")):
        both = both.union(cat[name].where("deleted").select(F.lit(kind), F.col("modified_at")))
    days = (F.lit(now) - F.col("at")) / day
    age = F.when(days < 7, "week").when(days < 30, "month").when(days < 365, "year").otherwise("older")
    return both.groupBy("kind", age.alias("age")).agg(F.count("*").alias("n"))
