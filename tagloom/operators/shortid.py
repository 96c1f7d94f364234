"""Shortest unique id prefixes, and prefixes back to ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import matches_regex, name_like_ascii, normalize_id_prefix

BUCKET = 4


def _common(a, b):
    """Length of the longest common prefix of two strings of hexadecimal digits."""
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k), k).otherwise(0))), F.lit(0))


def short_ids(df: DataFrame, id_col: str, bucket: int = BUCKET) -> DataFrame:
    """(id, short_len): the least prefix length that no other id shares, at least 1.

    Neighbours are compared within buckets of the first digits, so nothing is sorted as a
    whole; across buckets the few bucket keys are compared. An id alone needs one digit."""
    ids = df.select(F.col(id_col).alias("id")).distinct().withColumn("b", F.substring("id", 1, bucket))
    w = Window.partitionBy("b").orderBy("id")
    near = ids.withColumn("p", F.lag("id").over(w)).withColumn("n", F.lead("id").over(w))
    own = F.greatest(F.coalesce(_common(F.col("id"), F.col("p")), F.lit(0)), F.coalesce(_common(F.col("id"), F.col("n")), F.lit(0)))
    keys = ids.select("b").distinct()
    pw = Window.partitionBy(F.substring("b", 1, 1)).orderBy("b")
    keys = keys.withColumn("kp", F.lag("b").over(pw)).withColumn("kn", F.lead("b").over(pw))
    outside = F.greatest(F.coalesce(_common(F.col("b"), F.col("kp")), F.lit(0)), F.coalesce(_common(F.col("b"), F.col("kn")), F.lit(0)))
    keys = keys.select("b", outside.alias("outside"))  # at most 16^bucket rows
    need = F.greatest(F.when(F.col("p").isNull() & F.col("n").isNull(), F.lit(0)).otherwise(own), "outside") + 1
    return near.join(F.broadcast(keys), "b").select("id", F.least(need, F.length("id")).cast("int").alias("short_len"))


def resolve_prefixes(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, status, id): unique, not_found, ambiguous or invalid for each prefix."""
    asked = prefixes.select("prefix", normalize_id_prefix("prefix").alias("p")).distinct()
    lengths = [r[0] for r in asked.where("p is not null").select(F.length("p")).distinct().collect()]  # at most 32
    keyed = ids.select("id", F.explode(F.array(*[F.substring("id", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("p"))
    hits = keyed.join(asked.select("p").distinct(), "p", "left_semi").distinct().groupBy("p").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    status = F.when(F.col("p").isNull(), "invalid").when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return asked.join(hits, "p", "left").select("prefix", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def resolve_tag_tokens(tags: DataFrame, terms: list[tuple[str, bool]], deleted: str = "exclude") -> DataFrame:
    """(term, id): tags that a token (text, regex) names: by part of the name or prefix of
    the id; a regex by name only. Terms are plan-time constants."""
    from .reads import alive

    pool, out = alive(tags, deleted), None
    for text, regex in terms:
        if regex:
            hit = matches_regex("name", text)
        else:
            p = text.replace("-", "").lower()
            is_id = bool(p) and all(c in "0123456789abcdef" for c in p)
            hit = name_like_ascii("name", text) | (F.col("id").startswith(p) if is_id else F.lit(False))
        part = pool.where(hit).select(F.lit(text).alias("term"), "id")
        out = part if out is None else out.union(part)
    return out
