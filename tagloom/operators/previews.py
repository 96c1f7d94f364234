"""Preview tables: (file_id, content_hash, kind, data, width, height, generated_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import kind_by_extension, looks_like_text, text_snippet
from .reads import alive, latest_versions

KEY = ["file_id", "content_hash"]
HEAD = 512  # first bytes in which the start of a document in markup is looked for
# What documents in markup start with, after white space and in any case.
MARKUP = r"(?is)\A[\t\n\f\r ]*(<\?xml|<(!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P)[ >])"
# Bytes of known formats, by place. "other" are formats without a preview.
MAGIC = [
    ("image", {0: "89504E470D0A1A0A"}), ("image", {0: "FFD8FF"}), ("image", {0: "47494638"}), ("image", {0: "424D"}), ("image", {0: "52494646", 8: "57454250"}), ("image", {0: "49492A00"}), ("image", {0: "4D4D002A"}), ("image", {0: "00000100"}),
    ("image", {4: "6674797068656963"}), ("image", {4: "6674797061766966"}),
    ("video", {0: "1A45DFA3"}), ("video", {4: "66747970"}), ("video", {0: "52494646", 8: "41564920"}), ("video", {0: "464C5601"}), ("video", {0: "000001BA"}), ("video", {0: "000001B3"}), ("video", {0: "3026B2758E66CF11"}),
    ("pdf", {0: "25504446"}),
    ("other", {0: "504B0304"}), ("other", {0: "1F8B08"}), ("other", {0: "377ABCAF271C"}), ("other", {0: "526172211A07"}), ("other", {0: "FD377A585A00"}), ("other", {0: "425A68"}), ("other", {0: "28B52FFD"}), ("other", {0: "7F454C46"}), ("other", {0: "494433"}), ("other", {0: "4F676753"}), ("other", {0: "664C6143"}),
    ("other", {0: "52494646", 8: "57415645"}), ("other", {0: "4D546864"}), ("other", {0: "464F524D", 8: "41494646"}), ("other", {0: "2321414D520A"}), ("other", {0: "FFFB"}), ("other", {0: "FFF1"}), ("other", {0: "FFF9"}), ("other", {0: "2321"}),
]


def _now(cat: dict) -> DataFrame:
    live = alive(cat["files"]).select(F.col("id").alias("file_id"))
    return latest_versions(cat["versions"].select("file_id", "version_number", "content_hash")).join(live, "file_id", "left_semi").select(*KEY)


def _beside(cat: dict, previews: DataFrame) -> DataFrame:
    """The content of each live file (file_id, content_hash, row, kind), where row says that
    it has a preview. Both sides meet in one aggregation, which takes rows that lie by
    file_id as they lie; a join by both columns would shuffle them."""
    now = _now(cat).select(*KEY, F.lit(True).alias("now"), F.lit(False).alias("row"), F.lit(None).cast("string").alias("kind"))
    known = previews.where("file_id is not null and content_hash is not null").select(*KEY, F.lit(False).alias("now"), F.lit(True).alias("row"), F.col("kind").cast("string").alias("kind"))
    return now.unionAll(known).groupBy(*KEY).agg(F.max("now").alias("now"), F.max("row").alias("row"), F.max("kind").alias("kind")).where("now")


def preview_lookup(cat: dict, previews: DataFrame) -> DataFrame:
    """(file_id, content_hash, state): hit, negative (known to have none) or miss."""
    return _beside(cat, previews).select(*KEY, F.when(~F.col("row"), "miss").when(F.col("kind").isNull(), "negative").otherwise("hit").alias("state"))


def merge_previews(base: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (with arrival) replace rows of the same key; the last arrival wins."""
    both = base.withColumn("arrival", F.lit(-1).cast("long")).unionByName(new.withColumn("arrival", F.col("arrival").cast("long")))
    rest = [c for c in base.columns if c not in KEY]
    return both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "arrival").alias("v")).select(*KEY, "v.*").select(base.columns)


def invalidate_previews(previews: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, purged count) after the files in changed(file_id) got a version or were deleted."""
    gone = changed.select("file_id").distinct()
    return previews.join(gone, "file_id", "left_anti"), previews.join(gone, "file_id", "left_semi").agg(F.count("*").alias("purged"))


def preview_backlog(cat: dict, previews: DataFrame) -> DataFrame:
    return _beside(cat, previews.select(*KEY, F.lit(None).cast("string").alias("kind"))).where(~F.col("row")).select(*KEY)


def classify(df: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """df with ``kind``: by first bytes, else by extension, else text if it looks like it. A
    format that is known and has no preview (archives, sound, scripts with an interpreter line,
    documents in XML or HTML) is null, whatever its extension; so is a null content."""
    raw, out = F.col(content), F.lit(None).cast("string")
    for kind, marks in reversed(MAGIC):
        hit = F.lit(True)
        for at, magic in marks.items():
            hit = hit & (F.substr(raw, F.lit(at + 1), F.lit(len(magic) // 2)) == F.lit(bytes.fromhex(magic)))
        out = F.when(hit, kind).otherwise(out)
    markup = F.regexp_like(F.decode(F.substr(raw, F.lit(1), F.lit(HEAD)), "iso-8859-1"), F.lit(MARKUP))
    known = df.withColumn("kind", F.coalesce(out, F.when(markup, "other")))
    return known.withColumn("kind", F.when(raw.isNull(), F.lit(None)).when(F.col("kind").isNotNull(), F.nullif(F.col("kind"), F.lit("other"))).otherwise(F.coalesce(kind_by_extension(path), F.when(looks_like_text(content), "text"))))


def text_previews(df: DataFrame) -> DataFrame:
    """(file_id, content_hash, kind, data): a snippet for text, else a negative row."""
    text = F.col("kind") == "text"
    return classify(df).select(*KEY, F.when(text, "text").alias("kind"), F.when(text, text_snippet("content")).alias("data"))


def resolve_preview_replies(log: DataFrame) -> DataFrame:
    """(file_id, content_hash, state, link) of a log (at, link, msg asked/data/miss, ...):
    the first data reply wins; unavailable where every asked link missed; else waiting."""
    g = log.groupBy(*KEY).agg(F.min_by("link", F.when(F.col("msg") == "data", F.struct("at", "link"))).alias("link"), F.count_if(F.col("msg") == "data").alias("n"), F.countDistinct(F.when(F.col("msg") == "asked", F.col("link"))).alias("asked"), F.countDistinct(F.when(F.col("msg") == "miss", F.col("link"))).alias("missed"))
    return g.select(*KEY, F.when(F.col("n") > 0, "data").when(F.col("missed") >= F.col("asked"), "unavailable").otherwise("waiting").alias("state"), "link")
