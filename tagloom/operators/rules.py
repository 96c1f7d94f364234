"""Tag rules: regex rules on paths. rules: plan-time list of (ordinal, pattern, tags)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import java_pattern, matches_regex
from .graph import tags_of_files
from .reads import alive


def _ordered(rules):
    return sorted(rules, key=lambda r: r[0])


def apply_rules(files: DataFrame, rules, path: str = "logical_path") -> DataFrame:
    """files with ``tags``: those of all matching rules in order of declaration, each once.
    Patterns are searched with case; an invalid one matches nothing."""
    hits = [F.when(matches_regex(path, p, ignore_case=False), F.array(*[F.lit(t) for t in tags])) for _, p, tags in _ordered(rules) if tags]
    if not hits:
        return files.withColumn("tags", F.array().cast("array<string>"))
    return files.withColumn("tags", F.array_distinct(F.flatten(F.array_compact(F.array(*hits)))))


def tag_new_files(changes: DataFrame, rules) -> DataFrame:
    """Creations (file_id, origin, path, tags): local ones get the rules' tags after their own."""
    named = apply_rules(changes.withColumnRenamed("tags", "own"), rules, "path")
    return named.withColumn("tags", F.when(F.col("origin") == "local", F.array_union("own", "tags")).otherwise(F.col("own"))).drop("own")


def retag_plan(cat: dict, rules) -> DataFrame:
    """(file_id, tag_id) that live files lack. Files without a match are dropped before the join."""
    want = apply_rules(alive(cat["files"]), rules).where(F.size("tags") > 0).select(F.col("id").alias("file_id"), F.explode("tags").alias("tag_id"))
    return want.join(tags_of_files(cat), ["file_id", "tag_id"], "left_anti")


def retag_summary(cat: dict, rules) -> DataFrame:
    plan = retag_plan(cat, rules).agg(F.countDistinct("file_id").alias("changed"), F.count("*").alias("applied"))
    return alive(cat["files"]).agg(F.count("*").alias("scanned")).join(plan, F.lit(True))


def rule_report(rules, tags: DataFrame) -> DataFrame:
    """(ordinal, pattern, active, unknown_tags); a deleted tag still counts as known."""
    spark = tags.sparkSession
    rows = [(o, p, java_pattern(p) is not None, list(t)) for o, p, t in _ordered(rules)]
    table = spark.createDataFrame(rows, "ordinal int, pattern string, active boolean, tags array<string>")
    used = table.select("ordinal", F.explode("tags").alias("id"))
    lost = used.join(tags.select("id"), "id", "left_anti").groupBy("ordinal").agg(F.array_sort(F.collect_set("id")).alias("unknown_tags"))
    return table.join(lost, "ordinal", "left").select("ordinal", "pattern", "active", F.coalesce("unknown_tags", F.array().cast("array<string>")).alias("unknown_tags"))


def rule_hits(files: DataFrame, rules, path: str = "logical_path") -> DataFrame:
    """(file_id, ordinals): the rules that match each file."""
    return files.select(F.col("id").alias("file_id"), F.array_compact(F.array(*[F.when(matches_regex(path, p, False), F.lit(o)) for o, p, _ in _ordered(rules)])).alias("ordinals"))


def rule_coverage(files: DataFrame, rules) -> DataFrame:
    """(a, b, files): files that rules a and b both match; a = b is a rule's own count, also
    where it is 0. Pairs are counted within each file's short list."""
    hits = rule_hits(files, rules)
    pairs = hits.select(F.explode("ordinals").alias("a"), "ordinals").select("a", F.explode("ordinals").alias("b")).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("files"))
    spark = files.sparkSession
    own = spark.createDataFrame([(o, o) for o, _, _ in _ordered(rules)], "a int, b int")
    return own.join(pairs, ["a", "b"], "full_outer").fillna(0, ["files"])


def first_rule_by_tag(cat: dict, rules) -> DataFrame:
    """(file_id, ordinal): the first rule one of whose tags the file carries."""
    spark = cat["files"].sparkSession
    table = spark.createDataFrame([(o, t) for o, _, tags in _ordered(rules) for t in tags], "ordinal int, tag_id string")
    return tags_of_files(cat).join(F.broadcast(table), "tag_id").groupBy("file_id").agg(F.min("ordinal").alias("ordinal"))
