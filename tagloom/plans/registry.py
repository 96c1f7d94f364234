"""Registered catalog queries with their SQL. Every query reads the given tables through the
derived catalog of ``fixtures``; rules, searches and directories are configuration."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunks as L
from ..operators import graph as E
from ..operators import lww as G
from ..operators import placement as J
from ..operators import previews as K
from ..operators import reads as C
from ..operators import reconcile as H
from ..operators import rules as I
from ..operators import search as X
from ..operators import shortid as D
from ..sources import catalog as A
from ..streaming import coalesce as Q
from ..streaming import events as M
from ..streaming import keyed as R
from .fixtures import catalog, oracle

QUERIES: dict = {}
ORACLES: dict = {}
md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
REGIONS = [md5(f"r{k}") for k in range(5)]
RULES = [(0, r"\.md$", [md5("n1"), md5("n2")]), (1, "^photos/", [md5("n2"), md5("zz")]), (2, "*.md", [md5("n3")]), (3, r"(^work/|\.tmp$)", [md5("n4")]), (4, "^nothing", [md5("n5")])]
DIRS = [("dev0", "d0", 0, "universal", True, []), ("dev0", "d1", 1, "tag", False, [md5("bBrand#11")]), ("dev1", "d0", 0, "tag", False, [md5("n1"), md5("bBrand#12")]), ("dev1", "d1", 1, "tag", False, []), ("dev2", "d0", 0, "tag", False, [md5("n7")])]
DIRS_SCHEMA = "device string, directory string, ordinal int, kind string, keep_deleted boolean, tags array<string>"
NOW = 1_000_000_000_000


def query(name: str, sql: str | None = None):
    """Register a function of (catalog, spark) under a name, with its SQL over the derived tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(catalog(spark, sf_dir), spark)
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def _dirs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIRS, DIRS_SCHEMA)


def _roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in REGIONS[:2]], "root string")


LATEST = "SELECT file_id, max(version_number) AS version_number, max_by(content_hash, version_number) AS content_hash, max_by(observed_at, version_number) AS observed_at, max_by(size, version_number) AS size, min_by(observed_at, version_number) AS created_at FROM {} GROUP BY file_id"
LV = f"lv AS ({LATEST.format('versions')})"
DOWN = "e AS (SELECT DISTINCT tag_id AS src, target_id AS dst FROM entries WHERE type = 1 AND NOT deleted AND target_id NOT IN (SELECT id FROM tags WHERE deleted))"
UP = "e AS (SELECT DISTINCT target_id AS src, tag_id AS dst FROM entries WHERE type = 1 AND NOT deleted AND tag_id NOT IN (SELECT id FROM tags WHERE deleted))"
RAW = "e AS (SELECT DISTINCT tag_id AS src, target_id AS dst FROM entries WHERE type = 1 AND NOT deleted)"
CLOSE = "c AS (SELECT src AS root, dst AS node FROM e UNION SELECT c.root, e.dst FROM c JOIN e ON c.node = e.src)"
SHORT = "sid AS (SELECT id, p, n FROM (SELECT id, lag(id) OVER (ORDER BY id) AS p, lead(id) OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM files) q) r), sh AS (SELECT id, least(32, 1 + greatest(coalesce(len(list_filter(range(1, 33), lambda k: id[1:k] = p[1:k])), 0), coalesce(len(list_filter(range(1, 33), lambda k: id[1:k] = n[1:k])), 0)))::INT AS short_len FROM sid)"

# sources and scalar functions


@query("a2_upgrade_files", "SELECT id, logical_path, deleted, CAST(0 AS BIGINT) AS restored_at FROM files")
def _(cat, spark):
    return A.upgrade_files(cat["files"].drop("restored_at")).select("id", "logical_path", "deleted", "restored_at")


@query("a3_read_changes", "SELECT seq, CASE op WHEN 'add' THEN 'tag_add' WHEN 'rename' THEN 'tag_rename' WHEN 'recolor' THEN 'tag_recolor' ELSE 'tag_remove' END AS op, id, modified_at FROM tag_changes WHERE seq % 10 <> 0")
def _(cat, spark):
    c = cat["tag_changes"].select(F.when(F.col("seq") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("seq", F.concat(F.lit("tag_"), "op").alias("op"), "id", "modified_at"))).alias("value"))
    return A.read_changes(c)[0].select("seq", "op", "id", "modified_at")


@query("a5_export_results", f"WITH {LV}, {SHORT} SELECT 'file' AS kind, to_json(x)::VARCHAR AS json FROM (SELECT f.id, logical_path, logical_path_modified_at, deleted, deleted_at, restored_at, created_at, observed_at AS modified_at, content_hash, version_number, size, short_len FROM files f JOIN lv ON lv.file_id = f.id JOIN sh ON sh.id = f.id WHERE NOT deleted) x UNION ALL SELECT 'tag', to_json(t)::VARCHAR FROM (SELECT id, name, color, modified_at, deleted FROM tags WHERE NOT deleted) t")
def _(cat, spark):
    return A.export_results(C.list_files(cat, short=True), C.list_tags(cat))


@query("b1_normalize_id", "SELECT id, CASE WHEN id LIKE 'a%' THEN NULL ELSE id END AS norm FROM files")
def _(cat, spark):
    odd = F.when(F.col("id").startswith("a"), F.concat("id", F.lit("-g"))).otherwise(F.upper(F.concat(F.substring("id", 1, 8), F.lit("-"), F.substring("id", 9, 24))))
    return cat["files"].select("id", S.normalize_id_prefix(odd).alias("norm"))


BAD = "CASE length(logical_path) % 7 WHEN 0 THEN '' WHEN 1 THEN concat('/', logical_path) WHEN 2 THEN replace(logical_path, '/', '//') WHEN 3 THEN concat('../', logical_path) WHEN 4 THEN concat('./', logical_path) WHEN 5 THEN concat(logical_path, '/') ELSE logical_path END"


@query("b2_path_error", "SELECT id, CASE length(logical_path) % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'absolute' WHEN 2 THEN 'empty component' WHEN 3 THEN 'parent directory' WHEN 4 THEN 'current directory' END AS error FROM files")
def _(cat, spark):
    return cat["files"].select("id", S.path_error(F.expr(BAD)).alias("error"))


@query("b3_b4_b9_path_parts", "SELECT id, regexp_extract(logical_path, '([^/]*)$', 1) AS base, nullif(lower(regexp_extract(logical_path, '[^/]\\.([^./]+)$', 1)), '') AS ext, CASE lower(regexp_extract(logical_path, '[^/]\\.([^./]+)$', 1)) WHEN 'md' THEN 'text' WHEN 'csv' THEN 'text' WHEN 'jpg' THEN 'image' WHEN 'pdf' THEN 'pdf' WHEN 'mp4' THEN 'video' END AS kind FROM files")
def _(cat, spark):
    return cat["files"].select("id", S.basename("logical_path").alias("base"), S.extension("logical_path").alias("ext"), S.kind_by_extension("logical_path").alias("kind"))


@query("b5_b8_text_matches", "SELECT id, contains(lower(logical_path), 'archive/ph') AS part, regexp_matches(logical_path, '(?i)^photos/.*\\.jpg$') AS pattern, regexp_matches(logical_path, '\\.JPG$') AS cased, false AS broken, contains(lower(logical_path), 'archive') AS ascii FROM files")
def _(cat, spark):
    p = "logical_path"
    return cat["files"].select("id", S.matches_substring(p, "ARCHIVE/ph").alias("part"), S.matches_regex(p, r"^photos/.*\.jpg$").alias("pattern"), S.matches_regex(p, r"(?-i)\.JPG$").alias("cased"), S.matches_regex(p, "*.md").alias("broken"), S.name_like_ascii(p, "ARCHIVE").alias("ascii"))


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
WINDOW = "substring(text, 1, list_max(list_filter(range(0, {0} + 1), lambda i: strlen(substring(text, 1, i)) <= {0})))"
IS_TEXT = f"(text = '' OR (NOT contains({WINDOW.format(1024)}, chr(0)) AND (length({WINDOW.format(1024)}) - length(regexp_replace({WINDOW.format(1024)}, '{CONTROL}', '', 'g'))) * 20 < length({WINDOW.format(1024)})))"


@query("b10_b11_text_heads", f"SELECT doc_id, regexp_replace({WINDOW.format(256)}, '{CONTROL}', '', 'g') AS head, coalesce({IS_TEXT}, false) AS is_text FROM documents")
def _(cat, spark):
    raw = F.encode(F.col("text"), "utf-8")
    return spark.table("documents").select("doc_id", S.text_snippet(raw).alias("head"), S.looks_like_text(raw).alias("is_text"))


@query("b12_format_size", "SELECT file_id, version_number, CASE WHEN size < 1024 THEN concat(size::VARCHAR, ' B') WHEN size < 1048576 THEN printf('%.1f KiB', floor(size / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MiB', floor(size / 1048576.0 * 10 + 0.5) / 10) END AS s FROM versions")
def _(cat, spark):
    return cat["versions"].select("file_id", "version_number", S.format_size("size").alias("s"))


@query("b13_validate_tags", "SELECT id, name, '#F44336' AS color FROM tags WHERE name NOT LIKE 'Brand#1%'")
def _(cat, spark):
    blank = cat["tags"].withColumn("color", F.lit(" ")).withColumn("name", F.when(F.col("name").startswith("Brand#1"), F.lit("  ")).otherwise(F.col("name")))
    return S.validate_tags(blank)[0].select("id", "name", "color")


# reads


@query("c1_list_files", f"WITH {LV}, {SHORT} SELECT f.id, logical_path, deleted, created_at, observed_at AS modified_at, content_hash, version_number, size, short_len FROM files f JOIN lv ON lv.file_id = f.id JOIN sh ON sh.id = f.id WHERE NOT deleted")
def _(cat, spark):
    return C.list_files(cat, short=True).select("id", "logical_path", "deleted", "created_at", "modified_at", "content_hash", "version_number", "size", "short_len")


@query("c2_latest_versions", "SELECT file_id, max(version_number) AS version_number, max_by(content_hash, version_number) AS content_hash, max_by(size, version_number) AS size FROM versions GROUP BY 1")
def _(cat, spark):
    return C.latest_versions(cat["versions"]).select("file_id", "version_number", "content_hash", "size")


@query("c3_version_history", "SELECT file_id, string_agg(concat(version_number, ':', content_hash, ':', size), ',' ORDER BY version_number) AS h FROM versions GROUP BY 1")
def _(cat, spark):
    return C.version_history(cat["versions"]).select("file_id", F.array_join(F.transform("history", lambda v: F.concat_ws(":", v.version_number.cast("string"), v.content_hash, v["size"].cast("string"))), ",").alias("h"))


@query("c4_record_versions", "SELECT file_id, version_number, content_hash, observed_at, origin, size FROM versions UNION ALL SELECT file_id, version_number + max(version_number) OVER (PARTITION BY file_id), content_hash, observed_at, origin, size FROM versions QUALIFY version_number <= 2")
def _(cat, spark):
    new = cat["versions"].where("version_number <= 2").withColumnRenamed("version_number", "arrival")
    return C.record_versions(cat["versions"], new).select("file_id", "version_number", "content_hash", "observed_at", "origin", "size")


@query("c5_reverts", "SELECT file_id, version_number, content_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY file_id ORDER BY version_number) AS p, min(version_number) OVER (PARTITION BY file_id, content_hash) AS f FROM versions) WHERE f < version_number AND p <> content_hash")
def _(cat, spark):
    return C.reverts(cat["versions"]).select("file_id", "version_number", "content_hash")


@query("c6_drop_noop_versions", "WITH b AS (SELECT file_id, max_by(content_hash, version_number) AS now FROM versions GROUP BY 1) SELECT file_id, arrival FROM (SELECT file_id, version_number AS arrival, content_hash, lag(content_hash) OVER (PARTITION BY file_id ORDER BY version_number) AS p, now FROM versions JOIN b USING (file_id)) WHERE content_hash IS DISTINCT FROM coalesce(p, now)")
def _(cat, spark):
    return C.drop_noop_versions(cat["versions"], cat["versions"].withColumnRenamed("version_number", "arrival")).select("file_id", "arrival")


@query("c7_list_tags", "SELECT * FROM tags WHERE deleted")
def _(cat, spark):
    return C.list_tags(cat, "only")


@query("c8_catalog_size", f"WITH {LV} SELECT coalesce(sum(size), 0)::BIGINT AS bytes, count(*) AS files FROM lv JOIN files ON id = file_id WHERE NOT deleted")
def _(cat, spark):
    return C.catalog_size(cat)


@query("c9_size_of", f"WITH {LV} SELECT coalesce(sum(size), 0)::BIGINT AS bytes, count(*) AS files FROM lv JOIN files ON id = file_id WHERE NOT deleted AND id LIKE '0%'")
def _(cat, spark):
    return C.size_of(cat, cat["files"].where("id like '0%'").select(F.col("id").alias("file_id")))


@query("c10_storage_stats", f"WITH {LV}, s AS (SELECT lv.* FROM lv JOIN files ON id = file_id WHERE NOT deleted) SELECT device, sum(size)::BIGINT AS local_bytes, count(*) AS local_files, (SELECT sum(size) FROM s)::BIGINT AS total_bytes, (SELECT count(*) FROM s) AS total_files FROM (SELECT DISTINCT device, file_id FROM placements) p JOIN s USING (file_id) GROUP BY 1")
def _(cat, spark):
    return C.storage_stats(cat, cat["placements"])


@query("c11_audit_deleted_flag", f"WITH {LV} SELECT f.id, NOT f.deleted AS deleted, f.deleted_at > 0 AND f.deleted_at >= greatest(coalesce(lv.observed_at, 0), f.restored_at) AS should_be FROM files f LEFT JOIN lv ON lv.file_id = f.id WHERE f.id LIKE '9%'")
def _(cat, spark):
    flipped = cat["files"].withColumn("deleted", F.col("deleted") != F.col("id").startswith("9"))
    return C.audit_deleted_flag({**cat, "files": flipped})


@query("c12_find_by_path", "SELECT logical_path AS path, id FROM files WHERE NOT deleted AND logical_path LIKE '%.md'")
def _(cat, spark):
    return C.find_by_path(cat, cat["files"].where("logical_path like '%.md'").select(F.col("logical_path").alias("path")))


@query("c13_find_tags_by_name", "SELECT name, id FROM tags WHERE NOT deleted AND name IN ('ASIA', 'Brand#11', 'Brand#13', 'none')")
def _(cat, spark):
    return C.find_tags_by_name(cat, spark.createDataFrame([("ASIA",), ("Brand#11",), ("Brand#13",), ("none",)], "name string"))


@query("c14_name_collisions", "SELECT 'file' AS kind, name, count(*) AS n FROM (SELECT substring(logical_path, 1, 12) AS name FROM files WHERE NOT deleted) GROUP BY 2 HAVING count(*) > 1")
def _(cat, spark):
    short = {**cat, "files": cat["files"].withColumn("logical_path", F.substring("logical_path", 1, 12))}
    return C.name_collisions(short).select("kind", "name", "n")


@query("c15_files_under", "SELECT * FROM placements WHERE physical_path LIKE 'd7/%'")
def _(cat, spark):
    return C.files_under(cat["placements"], "d7/")


@query("c16_tag_names", "SELECT target_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM entries e JOIN tags t ON t.id = e.tag_id WHERE NOT e.deleted AND NOT t.deleted AND type = 0 GROUP BY 1")
def _(cat, spark):
    return C.tag_names(cat, 0).select("target_id", F.array_join("names", ",").alias("names"))


# short ids


@query("d1_short_ids", f"WITH {SHORT} SELECT * FROM sh")
def _(cat, spark):
    return D.short_ids(cat["files"], "id")


PREFIXES = ["0", "f", "00", "0f", "a1b", "A1-B2", "zz", "", md5("f1"), "ffffffff"]


@query("d2_resolve_prefixes", "WITH p AS (SELECT prefix, nullif(lower(replace(prefix, '-', '')), '') AS q FROM (VALUES " + ", ".join(f"('{p}')" for p in PREFIXES) + ") x(prefix)), r AS (SELECT prefix, q, count(id) AS n, min(id) AS id FROM p LEFT JOIN files ON starts_with(id, q) GROUP BY 1, 2) SELECT prefix, CASE WHEN q IS NULL OR NOT regexp_full_match(q, '[0-9a-f]+') THEN 'invalid' WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS id FROM r")
def _(cat, spark):
    return D.resolve_prefixes(cat["files"], spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"))


@query("d3_resolve_tag_tokens", "SELECT 'brand#1' AS term, id FROM tags WHERE NOT deleted AND contains(lower(name), 'brand#1') UNION SELECT 'a', id FROM tags WHERE NOT deleted AND (contains(lower(name), 'a') OR id LIKE 'a%') UNION SELECT '^A.*A$', id FROM tags WHERE NOT deleted AND regexp_matches(name, '(?i)^A.*A$')")
def _(cat, spark):
    return D.resolve_tag_tokens(cat["tags"], [("brand#1", False), ("a", False), ("^A.*A$", True)])


# tag graph

R2 = ", ".join(f"'{r}'" for r in REGIONS[:2])


@query("e1_subtags", f"WITH {DOWN} SELECT src AS root, dst AS node FROM e WHERE src IN ({R2})")
def _(cat, spark):
    return E.subtags(cat, _roots(spark))


@query("e2_subtags_transitive", f"RECURSIVE {DOWN}, {CLOSE} SELECT root, node FROM c WHERE root IN ({R2})")
def _(cat, spark):
    return E.subtags(cat, _roots(spark), True)


@query("e3_parent_tags", f"RECURSIVE {UP}, {CLOSE} SELECT root, node FROM c WHERE root IN (SELECT id FROM tags WHERE name LIKE 'Brand#2%')")
def _(cat, spark):
    return E.parent_tags(cat, cat["tags"].where("name like 'Brand#2%'").select(F.col("id").alias("root")), True)


FT = "ft AS (SELECT DISTINCT target_id AS file_id, tag_id FROM entries WHERE type = 0 AND NOT deleted AND tag_id NOT IN (SELECT id FROM tags WHERE deleted))"


@query("e4_tags_of_files", f"WITH {FT} SELECT * FROM ft")
def _(cat, spark):
    return E.tags_of_files(cat)


@query("e5_tags_of_files_transitive", f"RECURSIVE {UP}, {CLOSE}, {FT} SELECT file_id, tag_id FROM ft UNION SELECT file_id, node FROM ft JOIN c ON root = tag_id")
def _(cat, spark):
    return E.tags_of_files(cat, True)


@query("e6_files_of_tags", f"RECURSIVE {RAW}, {CLOSE}, o AS (SELECT id AS root, id AS node FROM tags UNION SELECT root, node FROM c WHERE root IN (SELECT id FROM tags)) SELECT DISTINCT root, target_id AS file_id FROM o JOIN entries ON tag_id = node WHERE type = 0 AND NOT deleted")
def _(cat, spark):
    return E.files_of_tags(cat, cat["tags"].select(F.col("id").alias("root")), True)


@query("e7_tag_cycles", f"RECURSIVE {DOWN}, {CLOSE} SELECT root AS tag_id FROM c WHERE root = node")
def _(cat, spark):
    return E.tag_cycles(cat)


@query("e8_validate_edges", "SELECT tag_id, target_id, type FROM entries WHERE NOT (target_id LIKE '1%')")
def _(cat, spark):
    odd = cat["entries"].withColumn("target_id", F.when(F.col("target_id").startswith("1"), F.lit("xyz")).otherwise(F.col("target_id")))
    return E.validate_edges(odd)[0].select("tag_id", "target_id", "type")


@query("e9_tag_stats", f"RECURSIVE {RAW}, {CLOSE}, {LV}, o AS (SELECT id AS root, id AS node FROM tags UNION SELECT root, node FROM c), tf AS (SELECT DISTINCT root, target_id FROM o JOIN entries ON tag_id = node WHERE type = 0 AND NOT deleted), df AS (SELECT DISTINCT tag_id AS root, target_id FROM entries WHERE type = 0 AND NOT deleted), t AS (SELECT root, count(*) AS n, sum(size) AS b FROM tf JOIN lv ON file_id = target_id GROUP BY 1), d AS (SELECT root, count(*) AS n, sum(size) AS b FROM df JOIN lv ON file_id = target_id GROUP BY 1) SELECT id AS tag_id, coalesce(d.n, 0) AS direct_files, coalesce(d.b, 0)::BIGINT AS direct_bytes, coalesce(t.n, 0) AS transitive_files, coalesce(t.b, 0)::BIGINT AS transitive_bytes FROM tags LEFT JOIN d ON d.root = id LEFT JOIN t ON t.root = id")
def _(cat, spark):
    return E.tag_stats(cat)


# search

LISTED = f"{LV}, li AS (SELECT f.* FROM files f JOIN lv ON lv.file_id = f.id)"
TG = "tg AS (SELECT DISTINCT target_id FROM entries WHERE type = 0 AND NOT deleted AND tag_id IN (SELECT id FROM tags WHERE NOT deleted AND contains(lower(name), 'brand#1')))"


def _term(kind, text, negated=False, regex=False):
    return {"kind": kind, "text": text, "negated": negated, "regex": regex}


@query("f1_search_tag", f"WITH {LISTED}, {TG} SELECT id FROM li WHERE NOT deleted AND id IN (SELECT * FROM tg)")
def _(cat, spark):
    return X.search_files(cat, [_term("tag", "Brand#1")]).select("id")


@query("f2_search_not_tag", f"WITH {LISTED}, {TG} SELECT id FROM li WHERE NOT deleted AND id NOT IN (SELECT * FROM tg) AND NOT contains(lower(logical_path), 'photos')")
def _(cat, spark):
    return X.search_files(cat, [_term("tag", "Brand#1", True), _term("name", "PHOTOS", True)]).select("id")


@query("f4_search_path", f"WITH {LISTED} SELECT li.id, logical_path, version_number, size FROM li JOIN lv ON lv.file_id = li.id WHERE NOT deleted AND regexp_matches(logical_path, '(?i)^photos/.*\\.jpg$')")
def _(cat, spark):
    return X.search_files(cat, [_term("logical", r"^photos/.*\.jpg$", regex=True)]).select("id", "logical_path", "version_number", "size")


@query("f5_search_any", f"WITH {LISTED}, {TG} SELECT id FROM li WHERE NOT deleted AND (id IN (SELECT * FROM tg) OR contains(lower(logical_path), 'brand#1')) AND NOT contains(lower(logical_path), '.md')")
def _(cat, spark):
    return X.search_files(cat, [_term("any", "brand#1"), _term("any", ".md", True)]).select("id")


@query("f6_search_tags", f"WITH {DOWN} SELECT id FROM tags WHERE NOT deleted AND id IN (SELECT dst FROM e WHERE src IN (SELECT id FROM tags WHERE NOT deleted AND contains(lower(name), 'asia'))) AND NOT contains(lower(name), 'in')")
def _(cat, spark):
    return X.search_tags(cat, [_term("tag", "asia"), _term("name", "IN", True)]).select("id")


@query("f7_search_files_deleted", f"WITH {LISTED} SELECT id FROM li WHERE deleted AND contains(lower(logical_path), 'archive')")
def _(cat, spark):
    return X.search_files(cat, [_term("logical", "archive")], deleted="only").select("id")


@query("f8_search_tags_deep", f"RECURSIVE {DOWN}, {CLOSE} SELECT id FROM tags WHERE NOT deleted AND id IN (SELECT node FROM c WHERE root IN (SELECT id FROM tags WHERE NOT deleted AND contains(lower(name), 'europe')))")
def _(cat, spark):
    return X.search_tags(cat, [_term("tag", "europe")], True).select("id")


SEARCHES = [(1, 0, "logical", False, False, "photos"), (1, 1, "logical", True, True, r"\.jpg$"), (2, 0, "tag", False, False, "brand#1"), (2, 1, "name", False, False, ".md"), (3, 0, "any", True, False, "work"), (4, 0, "tag", True, False, "brand#1"), (4, 1, "logical", False, False, "archive")]
BATCH = "SELECT 1 AS query_id, id FROM {0} WHERE contains(lower(logical_path), 'photos') AND NOT regexp_matches(logical_path, '(?i)\\.jpg$') UNION ALL SELECT 2, id FROM {0} WHERE id IN (SELECT * FROM tg) AND contains(lower(logical_path), '.md') UNION ALL SELECT 3, id FROM {0} WHERE NOT contains(lower(logical_path), 'work') UNION ALL SELECT 4, id FROM {0} WHERE id NOT IN (SELECT * FROM tg) AND contains(lower(logical_path), 'archive')"


def _searches(spark):
    return spark.createDataFrame(SEARCHES, "query_id int, pos int, kind string, negated boolean, regex boolean, text string")


@query("f9_search_batch", f"WITH {LISTED}, {TG}, a AS (SELECT * FROM li WHERE NOT deleted) {BATCH.format('a')}")
def _(cat, spark):
    return X.search_batch(cat, _searches(spark))


FLAGS = [(1, 0, "logical", None, None, "photos"), (1, 1, "logical", True, None, ".JPG"), (2, 0, "any", False, None, None), (3, 0, None, None, None, None), (4, 0, "tag", None, False, "B-Rand#1"), (5, 0, "tag", False, None, md5("n1")[:9].upper()), (6, 0, "logical", False, False, "Md"), (6, 1, "any", None, True, "^BRAND#1[12]$|^work"), (7, 0, "name", False, False, "")]


@query("f9_search_batch_flags", f"WITH {LISTED}, a AS (SELECT * FROM li WHERE NOT deleted), el AS (SELECT target_id AS id, tag_id FROM entries WHERE type = 0 AND NOT deleted), tt AS (SELECT id, name FROM tags WHERE NOT deleted) SELECT 1 AS query_id, id FROM a WHERE contains(lower(logical_path), 'photos') AND NOT contains(lower(logical_path), '.jpg') UNION ALL SELECT 3, id FROM a UNION ALL SELECT 5, id FROM a WHERE id IN (SELECT id FROM el WHERE tag_id = md5('n1')) UNION ALL SELECT 6, id FROM a WHERE contains(lower(logical_path), 'md') AND (regexp_matches(logical_path, '(?i)^work') OR id IN (SELECT id FROM el WHERE tag_id IN (SELECT id FROM tt WHERE name IN ('Brand#11', 'Brand#12')))) UNION ALL SELECT 7, id FROM a")
def _(cat, spark):
    return X.search_batch(cat, spark.createDataFrame(FLAGS, "query_id int, pos int, kind string, negated boolean, regex boolean, text string"))


@query("f10_search_log", f"WITH {LISTED}, {TG}, q AS (SELECT DISTINCT user_id % 2 = 0 AS a, user_id % 3 = 0 AS b FROM events) SELECT concat('/l photos', CASE WHEN a THEN ' ! .md' ELSE '' END, CASE WHEN b THEN ' /p z /t \"Brand#1\"' ELSE '' END) AS search, id FROM li, q WHERE NOT deleted AND contains(lower(logical_path), 'photos') AND NOT (a AND contains(lower(logical_path), '.md')) AND NOT (b AND id NOT IN (SELECT * FROM tg))")
def _(cat, spark):
    log = spark.table("events").select(F.concat_ws(" ", F.lit("/l photos"), F.when(F.col("user_id") % 2 == 0, F.lit("! .md")), F.when(F.col("user_id") % 3 == 0, F.lit('/p z /t "Brand#1"'))).alias("q"))
    return X.search_log(log, "q", cat)


@query("f10_tokenize_searches")
def _(cat, spark):
    log = spark.table("events").select(F.concat_ws(" ", F.lit("/t"), "event_type", F.when(F.col("user_id") % 2 == 0, F.lit('! "a b"')), F.when(F.col("user_id") % 3 == 0, F.lit("%x$% /l y"))).alias("q"))
    return X.tokenize_searches(log, "q").select("search", F.to_json("tokens").alias("tokens"))


@query("f11_search_log_report", "WITH q AS (SELECT DISTINCT event_type, user_id % 2 = 0 AS even FROM events), t AS (SELECT 'tag' AS kind, false AS regex, event_type AS text FROM q UNION ALL SELECT 'tag', false, 'asia' FROM q WHERE even UNION ALL SELECT 'any', true, '*x' FROM q WHERE even), n AS (SELECT string_agg(lower(name), ' ') AS names FROM tags WHERE NOT deleted) SELECT kind, false AS negated, regex, count(*) AS n, count(*) FILTER (kind = 'tag' AND NOT contains(names, lower(text))) AS unresolved, count(*) FILTER (regex) AS invalid_regex FROM t, n GROUP BY kind, regex")
def _(cat, spark):
    log = spark.table("events").select(F.concat_ws(" ", F.lit("/t"), "event_type", F.when(F.col("user_id") % 2 == 0, F.lit("/t asia %*x%"))).alias("q"))
    return X.search_log_report(X.tokenize_searches(log, "q"), cat)


@query("f12_search_deleted_split", f"WITH {LISTED}, tg AS (SELECT DISTINCT target_id FROM entries WHERE type = 0 AND NOT deleted AND tag_id IN (SELECT id FROM tags WHERE contains(lower(name), 'brand#1'))), q AS ({BATCH.format('li')}) SELECT query_id, deleted, count(*) AS n FROM q JOIN files USING (id) GROUP BY 1, 2")
def _(cat, spark):
    return X.search_deleted_split(cat, _searches(spark))


# last writer wins

NEWTAGS = "inc AS (SELECT id, concat(name, '!') AS name, color, modified_at + CASE WHEN id < '8' THEN 1 ELSE 0 END AS modified_at, deleted FROM tags)"


@query("g1_merge_tags", f"WITH {NEWTAGS} SELECT t.id, CASE WHEN i.modified_at > t.modified_at THEN i.name ELSE t.name END AS name, t.color, greatest(t.modified_at, i.modified_at) AS modified_at, t.deleted FROM tags t JOIN inc i USING (id)")
def _(cat, spark):
    inc = cat["tags"].withColumn("name", F.concat("name", F.lit("!"))).withColumn("modified_at", F.col("modified_at") + F.when(F.col("id") < "8", 1).otherwise(0))
    return G.merge_tags(cat["tags"], inc)


ACC = "b AS (SELECT *, min(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY id) AS born FROM tag_changes), w AS (SELECT *, max(CASE WHEN seq >= born THEN modified_at END) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b), acc AS (SELECT *, coalesce(seq >= born AND (top IS NULL OR modified_at > top), false) AS ok FROM w)"


@query("g2_replay_tags", f"WITH {ACC} SELECT id, max_by(value, seq) FILTER (op IN ('add', 'rename')) AS name, max_by(value, seq) FILTER (op = 'recolor') AS color, max(modified_at) AS modified_at, max_by(op, seq) FILTER (op IN ('add', 'remove')) = 'remove' AS deleted FROM acc WHERE ok GROUP BY 1")
def _(cat, spark):
    return G.replay_tags(cat["tag_changes"])


@query("g3_merge_entries", "SELECT tag_id, target_id, type, modified_at + 1 AS modified_at, NOT deleted AS deleted FROM entries")
def _(cat, spark):
    return G.merge_entries(cat["entries"], cat["entries"].withColumn("modified_at", F.col("modified_at") + 1).withColumn("deleted", ~F.col("deleted")))


EDGES = "ec AS (SELECT seq, id AS tag_id, md5(concat('f', CAST(seq % 5 AS STRING))) AS target_id, 0 AS type, CASE op WHEN 'remove' THEN 'untag' WHEN 'recolor' THEN 'untag' ELSE 'tag' END AS op, modified_at FROM tag_changes)"


def _edge_changes(cat):
    return cat["tag_changes"].select("seq", F.col("id").alias("tag_id"), F.md5(F.concat(F.lit("f"), (F.col("seq") % 5).cast("string"))).alias("target_id"), F.lit(0).alias("type"), F.when(F.col("op").isin("remove", "recolor"), "untag").otherwise("tag").alias("op"), "modified_at")


@query("g4_replay_entries", f"WITH {EDGES}, r AS (SELECT *, min(CASE WHEN op = 'tag' THEN seq END) OVER (PARTITION BY tag_id, target_id, type) AS born FROM ec), x AS (SELECT *, row_number() OVER (PARTITION BY tag_id, target_id, type ORDER BY modified_at DESC, seq) AS n FROM r WHERE seq >= born) SELECT tag_id, target_id, type, modified_at, op = 'untag' AS deleted FROM x WHERE n = 1")
def _(cat, spark):
    return G.replay_entries(_edge_changes(cat))


def _path_changes(cat):
    return cat["tag_changes"].select("seq", F.col("id").alias("file_id"), F.when(F.col("op") == "add", "add").otherwise("move").alias("op"), F.col("value").alias("path"), "modified_at")


@query("g5_replay_paths", "WITH b AS (SELECT *, min(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY id) AS born FROM tag_changes), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified_at DESC, seq) AS n FROM b WHERE seq = born OR (seq > born AND op <> 'add')) SELECT id AS file_id, value AS logical_path, modified_at AS logical_path_modified_at FROM x WHERE n = 1")
def _(cat, spark):
    return G.replay_paths(_path_changes(cat))


@query("g6_resolve_tombstones", "SELECT id AS file_id, coalesce(max(CASE WHEN op IN ('rename', 'recolor') THEN modified_at END), 0) AS observed_at, coalesce(max(CASE WHEN op = 'remove' THEN modified_at END), 0) AS deleted_at, coalesce(max(CASE WHEN op = 'add' THEN modified_at END), 0) AS restored_at, coalesce(max(CASE WHEN op = 'remove' THEN modified_at END), 0) > 0 AND coalesce(max(CASE WHEN op = 'remove' THEN modified_at END), 0) >= coalesce(max(CASE WHEN op <> 'remove' THEN modified_at END), 0) AS deleted FROM tag_changes GROUP BY 1")
def _(cat, spark):
    c = cat["tag_changes"]
    at = lambda *ops: F.when(F.col("op").isin(*ops), F.col("modified_at"))
    return G.resolve_tombstones(c.select(F.col("id").alias("file_id"), at("rename", "recolor").alias("observed_at"), at("remove").alias("deleted_at"), at("add").alias("restored_at")))


# The changes of each file one after the other, as a recursion over their numbers.
FOLDED = """o AS (SELECT id, modified_at AS "at", CASE op WHEN 'remove' THEN 'delete' WHEN 'add' THEN 'restore' ELSE 'edit' END AS op, row_number() OVER (PARTITION BY id ORDER BY seq) AS i FROM tag_changes),
st AS (SELECT DISTINCT id, 0::BIGINT AS i, false AS dead, 0::BIGINT AS edited, 0::BIGINT AS killed, 0::BIGINT AS raised FROM o
 UNION ALL SELECT id, i, kills OR (dead AND NOT ((op = 'edit' AND "at" > killed) OR (op = 'restore' AND greatest(up, edited) > killed))), CASE WHEN op = 'edit' THEN "at" ELSE edited END, CASE WHEN kills THEN "at" ELSE killed END, up
 FROM (SELECT st.id, o.i, o.op, o."at", st.dead, st.edited, st.killed, o.op = 'delete' AND NOT st.dead AND o."at" > greatest(st.edited, st.raised) AS kills, CASE WHEN o.op = 'restore' THEN greatest(o."at", st.raised) ELSE st.raised END AS up FROM st JOIN o ON o.id = st.id AND o.i = st.i + 1) x)"""


@query("g7_replay_tombstones", f"RECURSIVE {FOLDED} SELECT id AS file_id, arg_max(dead, i) AS deleted, arg_max(edited, i) AS observed_at, arg_max(killed, i) AS deleted_at, arg_max(raised, i) AS restored_at FROM st GROUP BY 1")
def _(cat, spark):
    c = cat["tag_changes"].select("seq", F.col("id").alias("file_id"), F.when(F.col("op") == "remove", "delete").when(F.col("op") == "add", "restore").otherwise("edit").alias("op"), F.col("modified_at").alias("at"))
    return G.replay_tombstones(c)


@query("g8_replay")
def _(cat, spark):
    c = cat["tag_changes"].select("seq", F.col("id").alias("file_id"), F.when(F.col("op") == "remove", "delete").otherwise("edit").alias("op"), F.col("modified_at").alias("at"))
    return G.replay({"tags": cat["tag_changes"], "entries": _edge_changes(cat), "paths": _path_changes(cat), "tombstones": c})["files"]


def _wire(spark):
    """A log of wire changes of all variants from the events, one in 50 cut off."""
    k, kinds = F.col("event_id"), F.array(*[F.lit(v) for v in A.VARIANTS])
    at = (k * 7919) % 9973
    named = {"file_id": F.concat(F.lit("f"), (k % 13).cast("string")), "logical_path": F.concat(F.lit("p/"), (k % 7).cast("string")), "logical_path_modified_at": at, "content_hash": F.concat(F.lit("h"), (at % 3).cast("string")), "size": k % 1000, "modified_at": at, "deleted_at": at, "restored_at": at + 5, "tag_id": F.concat(F.lit("t"), (k % 11).cast("string")), "taggee_id": F.concat(F.lit("t"), (k % 5).cast("string")), "tag_name": F.concat(F.lit("n"), (k % 3).cast("string")), "color": F.lit("#000000")}
    value = F.struct(*[v.alias(n) for n, v in named.items()], F.array(F.lit("t1"), F.lit("t2")).alias("tags"))
    record = F.to_json(F.struct(k.alias("seq"), k.alias("at"), F.lit("peer1").alias("origin"), F.create_map(F.element_at(kinds, (F.pmod(at, F.lit(16)) + 1).cast("int")), value).alias("change")))
    return spark.table("events").select(F.when(k % 50 == 3, F.substring(record, 1, 40)).otherwise(record).alias("value"))


WIRE = "wi AS (SELECT event_id AS seq, (event_id * 7919) % 9973 AS c, concat('f', event_id % 13) AS file_id, event_id % 1000 AS size FROM events WHERE event_id % 50 <> 3), kn AS (SELECT * FROM (SELECT *, c % 16 AS op, concat('h', c % 3) AS h, min(seq) FILTER (c % 16 = 0) OVER (PARTITION BY file_id) AS born FROM wi WHERE c % 16 < 5) WHERE seq >= born)"


@query("a3_read_wire_changes", f"WITH {WIRE} SELECT seq, concat('t', seq % 11) AS tag_id, list_extract([{', '.join(repr(v) for v in A.VARIANTS)}], (c % 16 + 1)::INT) AS op, c AS modified_at FROM wi")
def _(cat, spark):
    return A.read_wire_changes(_wire(spark))[0].select("seq", "tag_id", "op", "modified_at")


@query("g8_replay_log_versions", f"WITH {WIRE}, p AS (SELECT *, lag(h) OVER (PARTITION BY file_id ORDER BY seq) AS b FROM kn WHERE op IN (0, 2)) SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS version_number, h AS content_hash, seq AS observed_at, size FROM p WHERE h IS DISTINCT FROM b")
def _(cat, spark):
    return G.replay_log(A.read_wire_changes(_wire(spark))[0])["versions"].select("file_id", "version_number", "content_hash", "observed_at", "size")


@query("g8_replay_log_paths", f"WITH {WIRE}, x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY c DESC, seq) AS n FROM kn WHERE seq = born OR op = 1) SELECT file_id AS id, concat('p/', seq % 7) AS logical_path, c AS logical_path_modified_at FROM x WHERE n = 1")
def _(cat, spark):
    return G.replay_log(A.read_wire_changes(_wire(spark))[0])["files"].select("id", "logical_path", "logical_path_modified_at")


@query("g9_rejected_changes", f"WITH {ACC} SELECT seq, id, op FROM acc WHERE NOT ok")
def _(cat, spark):
    return G.rejected_changes(cat["tag_changes"]).select("seq", "id", "op")


@query("g9_rejected_entries", f"WITH {EDGES}, b AS (SELECT *, min(CASE WHEN op = 'tag' THEN seq END) OVER (PARTITION BY tag_id, target_id, type) AS born FROM ec), w AS (SELECT *, max(CASE WHEN seq >= born THEN modified_at END) OVER (PARTITION BY tag_id, target_id, type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b) SELECT seq, tag_id, target_id, op FROM w WHERE NOT coalesce(seq >= born AND (top IS NULL OR modified_at > top), false)")
def _(cat, spark):
    return G.rejected_entries(_edge_changes(cat)).select("seq", "tag_id", "target_id", "op")


@query("g9_rejected_paths", "WITH b AS (SELECT *, min(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY id) AS born FROM tag_changes), w AS (SELECT *, max(CASE WHEN seq = born OR (seq > born AND op <> 'add') THEN modified_at END) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b) SELECT seq, id AS file_id FROM w WHERE NOT coalesce((seq = born OR (seq > born AND op <> 'add')) AND (top IS NULL OR modified_at > top), false)")
def _(cat, spark):
    return G.rejected_paths(_path_changes(cat)).select("seq", "file_id")


@query("g9_rejected_tombstones", "RECURSIVE o AS (SELECT id, seq, CASE op WHEN 'remove' THEN 'delete' WHEN 'add' THEN 'restore' ELSE 'edit' END AS op, modified_at AS t, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM tag_changes), f AS (SELECT id, 0::BIGINT AS k, 0::BIGINT AS seq, false AS dead, 0::BIGINT AS obs, 0::BIGINT AS del, 0::BIGINT AS res, false AS lost FROM o WHERE k = 1 UNION ALL SELECT id, k, seq, kills OR (dead AND NOT ((op = 'edit' AND t > del) OR (op = 'restore' AND greatest(res2, obs) > del))), CASE WHEN op = 'edit' THEN t ELSE obs END, CASE WHEN kills THEN t ELSE del END, res2, op = 'delete' AND NOT kills FROM (SELECT f.id, o.k, o.seq, o.op, o.t, f.dead, f.obs, f.del, f.res, o.op = 'delete' AND NOT f.dead AND o.t > greatest(f.obs, f.res) AS kills, CASE WHEN o.op = 'restore' THEN greatest(f.res, o.t) ELSE f.res END AS res2 FROM f JOIN o ON o.id = f.id AND o.k = f.k + 1) x) SELECT id AS file_id, seq FROM f WHERE lost")
def _(cat, spark):
    op = F.when(F.col("op") == "remove", "delete").when(F.col("op") == "add", "restore").otherwise("edit")
    return G.rejected_tombstones(cat["tag_changes"].select("seq", F.col("id").alias("file_id"), op.alias("op"), F.col("modified_at").alias("at")))


@query("g10_declared_tags", "SELECT id, name, modified_at FROM tags WHERE id >= '8' UNION ALL SELECT id, concat('d-', name), (-9223372036854775808)::BIGINT FROM tags WHERE id < '8'")
def _(cat, spark):
    return G.apply_declared_tags(cat["tags"].where("id >= '8'"), cat["tags"].select("id", F.concat(F.lit("d-"), "name").alias("name"), F.lit("").alias("color"))).select("id", "name", "modified_at")


@query("g11_restore_tags", f"SELECT id, name, color, CAST({NOW} AS BIGINT) AS modified_at, false AS deleted FROM tags WHERE deleted")
def _(cat, spark):
    return G.restore_tags(cat["tags"], cat["tags"], NOW)


AGE = f"CASE WHEN ({NOW} - \"at\") / 86400000.0 < 7 THEN 'week' WHEN ({NOW} - \"at\") / 86400000.0 < 30 THEN 'month' WHEN ({NOW} - \"at\") / 86400000.0 < 365 THEN 'year' ELSE 'older' END"


@query("g12_tombstones", f"SELECT kind, {AGE} AS age, count(*) AS n FROM (SELECT 'file' AS kind, deleted_at AS \"at\" FROM files WHERE deleted UNION ALL SELECT 'tag', modified_at FROM tags WHERE deleted UNION ALL SELECT 'entry', modified_at FROM entries WHERE deleted) GROUP BY 1, 2")
def _(cat, spark):
    return G.tombstones(cat, NOW)


# reconciliation


def _manifests(cat):
    return H.file_manifest(cat["files"], cat["our_versions"]), H.file_manifest(cat["theirs"], cat["their_versions"])


DEC = f"ov AS ({LATEST.format('our_versions')}), tv AS ({LATEST.format('their_versions')}), o AS (SELECT f.*, ov.* FROM files f JOIN ov ON ov.file_id = f.id), t AS (SELECT f.*, tv.* FROM theirs f JOIN tv ON tv.file_id = f.id), dec AS (SELECT coalesce(t.id, o.id) AS file_id, CASE WHEN o.id IS NULL THEN 'unknown' WHEN t.id IS NULL THEN 'theirs_missing' WHEN t.content_hash = o.content_hash THEN 'equal' WHEN EXISTS (SELECT 1 FROM our_versions v WHERE v.file_id = t.id AND v.content_hash = t.content_hash) THEN 'they_behind' WHEN EXISTS (SELECT 1 FROM their_versions v WHERE v.file_id = t.id AND v.content_hash = o.content_hash) THEN 'we_behind' WHEN t.observed_at > o.observed_at THEN 'divergent_theirs' ELSE 'divergent_ours' END AS decision FROM t FULL JOIN o ON o.id = t.id)"
PLAN = f"{DEC}, p AS (SELECT t.id AS file_id, decision, t.content_hash, t.size, t.logical_path, t.deleted AS td, coalesce(o.deleted, false) AS od, o.id IS NOT NULL AS known, t.deleted AND NOT coalesce(o.deleted, false) AND t.deleted_at > greatest(coalesce(o.observed_at, 0), coalesce(o.restored_at, 0)) AS kill, NOT t.deleted AND coalesce(o.deleted, false) AND t.restored_at > coalesce(o.deleted_at, 0) AS up, t.logical_path_modified_at > o.logical_path_modified_at AS moved FROM t LEFT JOIN o ON o.id = t.id JOIN dec ON dec.file_id = t.id)"


@query("h1_file_manifest", f"WITH tv AS ({LATEST.format('versions')}) SELECT id AS file_id, observed_at AS latest_observed_at, (SELECT count(*) FROM versions v WHERE v.file_id = files.id) AS n FROM files JOIN tv ON file_id = id")
def _(cat, spark):
    return H.file_manifest(cat["files"], cat["versions"]).select("file_id", "latest_observed_at", F.size("history").cast("long").alias("n"))


@query("h2_edge_manifest", "SELECT tag_id, target_id, type, modified_at, deleted FROM entries")
def _(cat, spark):
    return H.edge_manifest(cat)


@query("h3_content_decisions", f"WITH {DEC} SELECT * FROM dec")
def _(cat, spark):
    return H.content_decisions(*_manifests(cat))


@query("h4_plan_pulls", f"WITH {PLAN} SELECT file_id, content_hash, size, CASE WHEN decision = 'unknown' THEN 'create' ELSE 'change' END AS placing FROM p WHERE NOT td AND NOT kill AND NOT up AND decision IN ('unknown', 'we_behind', 'divergent_theirs')")
def _(cat, spark):
    return H.plan_pulls(*_manifests(cat))


@query("h5_plan_deletions", f"WITH {PLAN} SELECT file_id FROM p WHERE kill")
def _(cat, spark):
    return H.plan_deletions(*_manifests(cat))


@query("h6_plan_restores", f"WITH {PLAN} SELECT file_id FROM p WHERE up")
def _(cat, spark):
    return H.plan_restores(*_manifests(cat))


@query("h7_plan_moves", f"WITH {PLAN} SELECT file_id, logical_path AS path FROM p WHERE NOT td AND NOT kill AND NOT up AND known AND moved")
def _(cat, spark):
    return H.plan_moves(*_manifests(cat))


@query("h8_plan_file_sync", f"WITH {PLAN}, r AS (SELECT file_id, 'delete' AS action, NULL AS content_hash, NULL AS size, NULL AS path FROM p WHERE kill UNION ALL SELECT file_id, 'restore', content_hash, size, NULL FROM p WHERE up UNION ALL SELECT file_id, 'move', NULL, NULL, logical_path FROM p WHERE NOT td AND NOT up AND known AND moved UNION ALL SELECT file_id, CASE WHEN decision = 'unknown' THEN 'pull_create' ELSE 'pull_change' END, content_hash, size, NULL FROM p WHERE NOT td AND NOT up AND decision IN ('unknown', 'we_behind', 'divergent_theirs')) SELECT file_id, action, content_hash, coalesce(size, -1)::BIGINT AS size, path FROM r")
def _(cat, spark):
    return H.plan_file_sync(*_manifests(cat)).select("file_id", "action", "content_hash", F.coalesce("size", F.lit(-1)).cast("long").alias("size"), "path")


def _fleet(cat):
    """Manifests of three devices: a and b as in the queries above, c with a's state."""
    ours, theirs = _manifests(cat)
    same = [c for c in ours.columns if c in theirs.columns]
    twice = ours.select(F.explode(F.array(F.lit("a"), F.lit("c"))).alias("device"), *same)  # a union would make them twice
    return twice.unionByName(theirs.select(F.lit("b").alias("device"), *same))


@query("h8_plan_fleet", f"WITH {PLAN}, one AS (SELECT file_id, 'delete' AS action, NULL AS content_hash, NULL::BIGINT AS size, NULL AS path FROM p WHERE kill UNION ALL SELECT file_id, 'restore', content_hash, size, NULL FROM p WHERE up UNION ALL SELECT file_id, 'move', NULL, NULL, logical_path FROM p WHERE NOT td AND NOT kill AND NOT up AND known AND moved UNION ALL SELECT file_id, CASE WHEN decision = 'unknown' THEN 'pull_create' ELSE 'pull_change' END, content_hash, size, NULL FROM p WHERE NOT td AND NOT kill AND NOT up AND decision IN ('unknown', 'we_behind', 'divergent_theirs')) SELECT ours, 'b' AS theirs, one.* FROM one, (VALUES ('a'), ('c')) x(ours)")
def _(cat, spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "c"), ("c", "a")], "ours string, theirs string")
    return H.plan_fleet(_fleet(cat), pairs, 64)


@query("h14_fleet_files", "WITH l AS (SELECT file_id, max_by(content_hash, version_number) AS content_hash, max_by(size, version_number) AS size, max_by(observed_at, version_number) AS observed_at FROM our_versions GROUP BY 1), k AS (SELECT file_id, max_by(content_hash, version_number) AS content_hash, max_by(size, version_number) AS size, max_by(observed_at, version_number) AS observed_at FROM their_versions GROUP BY 1), m AS (SELECT f.id, f.logical_path, greatest(f.logical_path_modified_at, t.logical_path_modified_at) AS logical_path_modified_at, greatest(f.deleted_at, coalesce(t.deleted_at, 0)) AS deleted_at, greatest(f.restored_at, coalesce(t.restored_at, 0)) AS restored_at, CASE WHEN k.observed_at > l.observed_at OR l.observed_at IS NULL THEN k.content_hash ELSE l.content_hash END AS content_hash, CASE WHEN k.observed_at > l.observed_at OR l.observed_at IS NULL THEN k.size ELSE l.size END AS size, greatest(l.observed_at, k.observed_at) AS observed_at FROM files f LEFT JOIN theirs t ON t.id = f.id LEFT JOIN l ON l.file_id = f.id LEFT JOIN k ON k.file_id = f.id) SELECT *, deleted_at > 0 AND deleted_at >= greatest(coalesce(observed_at, 0), restored_at) AS deleted FROM m")
def _(cat, spark):
    old = cat["files"].where("id < 'c'").withColumn("logical_path", F.lit("older")).withColumn("logical_path_modified_at", F.col("logical_path_modified_at") - 1)
    return H.merge_fleet_files([cat["files"], cat["theirs"], old], [cat["our_versions"], cat["their_versions"], cat["versions"].where("version_number = 1")])


def _their_tags(cat):
    return cat["tags"].where("name not like 'Brand#4%'").withColumn("modified_at", F.col("modified_at") + F.when(F.col("id") < "8", 1).otherwise(0))


@query("h9_plan_tag_definitions", "SELECT id, CASE WHEN deleted THEN 'remove' ELSE 'request' END AS action FROM tags WHERE name NOT LIKE 'Brand#4%' AND id < '8'")
def _(cat, spark):
    return H.plan_tag_definitions(cat["tags"], _their_tags(cat))


@query("h10_plan_entries", "SELECT tag_id, target_id, type, CASE WHEN deleted THEN 'untag' ELSE 'tag' END AS op FROM entries WHERE target_id < '8'")
def _(cat, spark):
    theirs = cat["entries"].withColumn("modified_at", F.col("modified_at") + F.when(F.col("target_id") < "8", 1).otherwise(0))
    return H.plan_entries(cat["entries"], theirs)[0].select("tag_id", "target_id", "type", "op")


@query("h11_answer_tag_requests", f"SELECT id, name, true AS found FROM tags WHERE NOT deleted OR deleted UNION ALL SELECT '{md5('none')}', NULL, false")
def _(cat, spark):
    return H.answer_tag_requests(cat["tags"], cat["tags"].select("id").union(spark.createDataFrame([(md5("none"),)], "id string"))).select("id", "name", "found")


@query("h12_divergent_files", f"WITH {DEC} SELECT file_id, substring(decision, 11) AS winner FROM dec WHERE decision LIKE 'divergent%'")
def _(cat, spark):
    return H.divergent_files(*_manifests(cat))


@query("h13_sweep_files", f"WITH {PLAN} SELECT file_id FROM p WHERE td OR kill OR up OR decision NOT IN ('unknown', 'we_behind', 'divergent_theirs')")
def _(cat, spark):
    ours, theirs = _manifests(cat)
    return H.sweep_files(theirs, H.plan_pulls(ours, theirs))


@query("h14_fleet_lag", "SELECT 'b' AS device, count(*) AS behind FROM tags WHERE id < '8' OR name LIKE 'Brand#4%' HAVING count(*) > 0 UNION ALL SELECT 'a', count(*) FROM tags WHERE id < '8' AND name NOT LIKE 'Brand#4%' HAVING count(*) > 0")
def _(cat, spark):
    b = _their_tags(cat)
    merged, _edges = H.merge_fleet([cat["tags"], b], [cat["entries"], cat["entries"]])
    old_b = cat["tags"].where("name not like 'Brand#4%'")
    return H.lag_report(merged, cat["tags"].withColumn("device", F.lit("a")).unionByName(old_b.withColumn("device", F.lit("b"))), ["id"])


@query("h15_fan_out", "SELECT seq, peer, NOT connected AS dropped FROM tag_changes, (VALUES ('v0', true), ('v1', false), ('v2', true)) x(peer, connected) WHERE value <> peer")
def _(cat, spark):
    peers = spark.createDataFrame([("v0", True), ("v1", False), ("v2", True)], "peer string, connected boolean")
    return H.fan_out(cat["tag_changes"].withColumn("origin", F.col("value")), peers).select("seq", "peer", "dropped")


# rules

MATCH = [r"regexp_matches(logical_path, '\.md$')", "regexp_matches(logical_path, '^photos/')", None, r"regexp_matches(logical_path, '(^work/|\.tmp$)')", "regexp_matches(logical_path, '^nothing')"]
RT = "rt AS (" + " UNION ".join(f"SELECT id AS file_id, '{t}' AS tag_id FROM files WHERE NOT deleted AND {m}" for (_, _, tags), m in zip(RULES, MATCH) if m for t in tags) + ")"
# The tags that rules give each file, at their first place in the order of declaration.
GIVEN = " UNION ALL ".join(f"SELECT id AS file_id, '{t}' AS tag_id, {100 * o + k} AS pos FROM files WHERE {m}" for (o, _, tags), m in zip(RULES, MATCH) if m for k, t in enumerate(tags))
RULED = f"ru AS (SELECT file_id, tag_id, min(pos) AS pos FROM ({GIVEN}) GROUP BY 1, 2)"


@query("i1_apply_rules", f"WITH {RULED} SELECT file_id, string_agg(tag_id, ',' ORDER BY pos) AS tags FROM ru JOIN files ON id = file_id WHERE NOT deleted GROUP BY 1")
def _(cat, spark):
    return I.apply_rules(C.alive(cat["files"]), RULES).where("size(tags) > 0").select(F.col("id").alias("file_id"), F.array_join("tags", ",").alias("tags"))


@query("i2_tag_new_files", f"WITH {RULED} SELECT id AS file_id, concat_ws(',', 'own', string_agg(tag_id, ',' ORDER BY pos)) AS tags FROM files LEFT JOIN ru ON file_id = id AND id < '8' WHERE NOT deleted GROUP BY 1")
def _(cat, spark):
    new = C.alive(cat["files"]).select(F.col("id").alias("file_id"), F.when(F.col("id") < "8", "local").otherwise("peer1").alias("origin"), F.col("logical_path").alias("path"), F.array(F.lit("own")).alias("tags"))
    return I.tag_new_files(new, RULES).select("file_id", F.array_join("tags", ",").alias("tags"))


@query("i3_retag_plan", f"WITH {RT}, {FT} SELECT * FROM rt EXCEPT SELECT * FROM ft")
def _(cat, spark):
    return I.retag_plan(cat, RULES)


@query("i4_retag_summary", f"WITH {RT}, {FT}, m AS (SELECT * FROM rt EXCEPT SELECT * FROM ft) SELECT (SELECT count(*) FROM files WHERE NOT deleted) AS scanned, count(DISTINCT file_id) AS changed, count(*) AS applied FROM m")
def _(cat, spark):
    return I.retag_summary(cat, RULES)


# Whether a pattern is valid is the one thing that SQL is told.
RULE_TAGS = "x AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, {str(p != '*.md').lower()}, '{t}')" for o, p, tags in RULES for t in tags) + ") v(ordinal, active, tag_id))"


@query("i5_rule_report", f"WITH {RULE_TAGS} SELECT ordinal, active, coalesce(string_agg(DISTINCT tag_id, ',' ORDER BY tag_id) FILTER (tag_id NOT IN (SELECT id FROM tags)), '') AS unknown FROM x GROUP BY 1, 2")
def _(cat, spark):
    return I.rule_report(RULES, cat["tags"]).select("ordinal", "active", F.array_join("unknown_tags", ",").alias("unknown"))


RH = "rh AS (" + " UNION ALL ".join(f"SELECT id, {o} AS o FROM files WHERE {m}" for (o, _, _), m in zip(RULES, MATCH) if m) + ")"


@query("i6_rule_coverage", f"WITH {RH}, pr AS (SELECT x.o AS a, y.o AS b, count(*) AS files FROM rh x JOIN rh y ON x.id = y.id AND x.o <= y.o GROUP BY 1, 2) SELECT * FROM pr UNION ALL SELECT k::INT, k::INT, 0 FROM range(5) r(k) WHERE k NOT IN (SELECT a FROM pr WHERE a = b)")
def _(cat, spark):
    return I.rule_coverage(cat["files"], RULES)


@query("i7_first_rule_by_tag", f"WITH {FT}, rl AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{t}')" for o, _, tags in RULES for t in tags) + ") x(ordinal, tag_id)) SELECT file_id, min(ordinal) AS ordinal FROM ft JOIN rl USING (tag_id) GROUP BY 1")
def _(cat, spark):
    return I.first_rule_by_tag(cat, RULES)


# placement

DV = "dr AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{x}', {o}, '{k}', {str(kd).lower()}, {t or '[]::VARCHAR[]'})" for d, x, o, k, kd, t in DIRS) + ") x(device, directory, ordinal, kind, keep_deleted, tags))"
WANT = f"{FT}, {DV}, hv AS (SELECT device, directory, file_id, count(*) AS n FROM (SELECT device, directory, unnest(tags) AS tag_id FROM dr) u JOIN ft USING (tag_id) GROUP BY 1, 2, 3), wa AS (SELECT dr.device, dr.directory, f.id AS file_id FROM dr CROSS JOIN files f LEFT JOIN hv ON hv.device = dr.device AND hv.directory = dr.directory AND hv.file_id = f.id WHERE NOT f.deleted AND (kind = 'universal' OR len(tags) = coalesce(n, 0)))"


@query("j1_wanted", f"WITH {WANT} SELECT * FROM wa")
def _(cat, spark):
    return J.wanted(C.alive(cat["files"]), E.tags_of_files(cat), _dirs(spark))


@query("j2_effective_tags", f"WITH {RULED}, {FT}, al AS (SELECT * FROM ru UNION ALL SELECT file_id, tag_id, 1000 FROM ft), f AS (SELECT file_id, tag_id, min(pos) AS pos FROM al GROUP BY 1, 2), n AS (SELECT id AS file_id FROM files UNION SELECT file_id FROM ft) SELECT n.file_id, coalesce(string_agg(tag_id, ',' ORDER BY pos, tag_id), '') AS tags FROM n LEFT JOIN f USING (file_id) GROUP BY 1")
def _(cat, spark):
    stored = E.tags_of_files(cat).groupBy("file_id").agg(F.array_sort(F.collect_list("tag_id")).alias("tags"))
    carried = I.apply_rules(cat["files"], RULES).select(F.col("id").alias("file_id"), "tags")
    return J.effective_tags(carried, stored).select("file_id", F.array_join("tags", ",").alias("tags"))


@query("j3_physical_path", f"WITH {WANT} SELECT wa.device, wa.directory, file_id, CASE WHEN kind = 'universal' THEN file_id ELSE logical_path END AS path FROM wa JOIN dr USING (device, directory) JOIN files ON id = file_id")
def _(cat, spark):
    want = J.wanted(C.alive(cat["files"]), E.tags_of_files(cat), _dirs(spark)).join(F.broadcast(_dirs(spark).select("device", "directory", "kind")), J.DIR)
    return want.join(cat["files"].select(F.col("id").alias("file_id"), "logical_path"), "file_id").select(*J.DIR, "file_id", J.physical_path(F.col("kind"), F.col("file_id"), F.col("logical_path")).alias("path"))


NAMED = "cd AS (SELECT id AS file_id, concat('x/', substring(id, 1, 2), CASE WHEN id LIKE '%7' THEN '.tar (2).gz' ELSE '.tar.gz' END) AS path FROM files), pl AS (SELECT DISTINCT concat('x/', substring(id, 1, 2), '.tar', CASE WHEN id LIKE '%1' THEN '' ELSE concat(' (', CAST(ascii(substring(id, 3, 1)) % 9 + 1 AS VARCHAR), ')') END, '.gz') AS name FROM files WHERE id < '8')"
FREE = "p AS (SELECT path, count(*) AS k FROM cd GROUP BY 1), f AS (SELECT path, n, CASE WHEN n = 0 THEN path ELSE concat(path[:-4], ' (', n, ').gz') END AS name FROM (SELECT path, unnest(range(k + 20)) AS n FROM p)), g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM f WHERE name NOT IN (SELECT name FROM pl) AND (n = 0 OR name NOT IN (SELECT path FROM p)))"


@query("j4_resolve_collisions", f"WITH {NAMED}, {FREE}, c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_id) AS r FROM cd) SELECT 'dev0' AS device, 'd0' AS directory, file_id, name AS physical_path FROM c JOIN g USING (path, r)")
def _(cat, spark):
    place, fid = [F.lit("dev0").alias("device"), F.lit("d0").alias("directory")], F.col("id")
    stem = F.concat(F.lit("x/"), F.substring("id", 1, 2))
    names = cat["files"].select(*place, fid.alias("file_id"), F.concat(stem, F.when(fid.endswith("7"), F.lit(".tar (2).gz")).otherwise(F.lit(".tar.gz"))).alias("path"))
    mark = F.when(fid.endswith("1"), F.lit("")).otherwise(F.concat(F.lit(" ("), (F.ascii(F.substring("id", 3, 1)) % 9 + 1).cast("string"), F.lit(")")))
    placed = cat["files"].where("id < '8'").select(*place, F.concat(stem, F.lit(".tar"), mark, F.lit(".gz")).alias("physical_path")).distinct()
    return J.resolve_collisions(placed, names)


@query("j5_placement_diff", f"WITH {WANT}, w AS (SELECT wa.* FROM wa JOIN dr USING (device, directory) WHERE kind <> 'universal'), h AS (SELECT DISTINCT device, directory, file_id FROM placements JOIN dr USING (device, directory) WHERE kind <> 'universal') SELECT coalesce(w.device, h.device) AS device, coalesce(w.directory, h.directory) AS directory, coalesce(w.file_id, h.file_id) AS file_id, CASE WHEN w.file_id IS NULL THEN 'remove' WHEN h.file_id IS NOT NULL THEN 'keep' WHEN w.file_id NOT IN (SELECT file_id FROM placements) THEN 'fetch' ELSE 'add' END AS action FROM w FULL JOIN h ON w.device = h.device AND w.directory = h.directory AND w.file_id = h.file_id")
def _(cat, spark):
    return J.placement_diff(cat, _dirs(spark), cat["placements"])


@query("j6_copy_source", f"WITH {DV} SELECT device, file_id, min_by(directory, ordinal) AS directory FROM placements JOIN dr USING (device, directory) GROUP BY 1, 2")
def _(cat, spark):
    return J.copy_source(cat["placements"], _dirs(spark))


CH = "ch AS (SELECT DISTINCT device, file_id, 'd0' AS origin_directory FROM placements)"


def _changes(cat):
    return cat["placements"].select("device", "file_id", F.lit("d0").alias("origin_directory")).distinct()


def _target_sql(where):
    return f"WITH {WANT}, {CH} SELECT ch.device, ch.file_id, wa.directory FROM ch JOIN wa USING (device, file_id) JOIN dr USING (device, directory) WHERE {where}"


def _target(f, cat, spark):
    return f(_changes(cat).join(C.alive(cat["files"]).select(F.col("id").alias("file_id")), "file_id", "left_semi"), E.tags_of_files(cat), _dirs(spark)).select("device", "file_id", "directory")


@query("j7_change_targets", _target_sql("directory <> origin_directory"))
def _(cat, spark):
    return _target(J.change_targets, cat, spark)


@query("j8_create_targets", _target_sql("directory <> origin_directory OR kind = 'universal'"))
def _(cat, spark):
    return _target(J.create_targets, cat, spark)


@query("j9_assign_transfer", f"WITH {DV} SELECT device, file_id, directory, CASE WHEN row_number() OVER (PARTITION BY device, file_id ORDER BY ordinal DESC) = 1 THEN 'move' ELSE 'copy' END AS transfer FROM (SELECT DISTINCT device, directory, file_id FROM placements) JOIN dr USING (device, directory)")
def _(cat, spark):
    t = cat["placements"].select("device", "directory", "file_id").distinct().join(F.broadcast(_dirs(spark).select("device", "directory", "ordinal")), J.DIR)
    return J.assign_transfer(t).select("device", "file_id", "directory", "transfer")


@query("j10_delete_targets", _target_sql("NOT (kind = 'universal' AND keep_deleted)"))
def _(cat, spark):
    return _target(J.delete_targets, cat, spark)


def _listing(cat):
    now = C.latest_versions(cat["versions"]).select("file_id", "content_hash")
    seen = cat["placements"].join(now, "file_id").where("file_id not like '1%'")
    new = F.when(F.col("file_id").startswith("2"), F.md5("content_hash")).otherwise(F.col("content_hash"))
    moved = F.when(F.col("file_id").startswith("3"), F.concat("physical_path", F.lit("x"))).otherwise(F.col("physical_path"))
    return seen.select("device", "directory", moved.alias("physical_path"), new.alias("content_hash"))


DRIFT = "SELECT device, directory, physical_path, CASE WHEN file_id LIKE '1%' OR file_id LIKE '3%' THEN 'deleted' WHEN file_id LIKE '2%' THEN 'changed' ELSE 'unchanged' END AS drift FROM placements UNION ALL SELECT device, directory, concat(physical_path, 'x'), 'added' FROM placements WHERE file_id LIKE '3%'"


@query("j11_directory_drift", DRIFT)
def _(cat, spark):
    return J.directory_drift(_listing(cat), cat["placements"], cat["versions"]).select("device", "directory", "physical_path", "drift")


@query("j12_drift_changes", f"WITH {DV}, dd AS ({DRIFT}) SELECT device, directory, physical_path AS path, CASE drift WHEN 'added' THEN 'create' WHEN 'changed' THEN 'modify' ELSE 'remove' END AS op, CASE WHEN drift = 'added' AND kind <> 'universal' THEN array_to_string(tags, ',') ELSE '' END AS tags FROM dd JOIN dr USING (device, directory) WHERE drift <> 'unchanged'")
def _(cat, spark):
    return J.drift_changes(J.directory_drift(_listing(cat), cat["placements"], cat["versions"]), _dirs(spark)).select("device", "directory", "path", "op", F.array_join("tags", ",").alias("tags"))


@query("j13_rename_tree", "SELECT device, directory, file_id, physical_path, concat('new/e', substring(physical_path, 3)) AS new_path FROM placements WHERE physical_path LIKE 'd7/%'")
def _(cat, spark):
    ren = cat["placements"].select("device", "directory").distinct().select("*", F.lit("d7").alias("old"), F.lit("new/e").alias("new"))
    return J.rename_tree(cat["placements"], ren)


@query("j14_recoverable", f"WITH {LV} SELECT file_id, content_hash FROM lv JOIN files ON id = file_id WHERE deleted AND (file_id, content_hash) IN (SELECT file_id, content_hash FROM versions WHERE origin = 'local')")
def _(cat, spark):
    return J.recoverable(cat, cat["versions"].where("origin = 'local'"))


@query("j15_replication", "SELECT id AS file_id, count(DISTINCT device) AS holders FROM files LEFT JOIN placements ON id = file_id WHERE NOT deleted GROUP BY 1")
def _(cat, spark):
    return J.replication(cat, cat["placements"])


# previews

PV = "pv AS (SELECT DISTINCT file_id, content_hash, CASE WHEN file_id < '8' THEN 'text' END AS kind FROM versions WHERE version_number % 2 = 1)"


def _previews(cat):
    return cat["versions"].where("version_number % 2 = 1").select("file_id", "content_hash", F.when(F.col("file_id") < "8", "text").alias("kind")).distinct()


NOWV = f"{LV}, nv AS (SELECT file_id, content_hash FROM lv JOIN files ON id = file_id WHERE NOT deleted)"


@query("k1_preview_lookup", f"WITH {NOWV}, {PV} SELECT nv.file_id, nv.content_hash, CASE WHEN pv.file_id IS NULL THEN 'miss' WHEN kind IS NULL THEN 'negative' ELSE 'hit' END AS state FROM nv LEFT JOIN pv USING (file_id, content_hash)")
def _(cat, spark):
    return K.preview_lookup(cat, _previews(cat))


@query("k2_merge_previews", f"WITH {PV} SELECT file_id, content_hash, CASE WHEN file_id LIKE '0%' THEN 'image' ELSE kind END AS kind FROM pv")
def _(cat, spark):
    new = _previews(cat).where("file_id like '0%'").withColumn("kind", F.lit("image")).withColumn("arrival", F.lit(1))
    return K.merge_previews(_previews(cat), new)


@query("k3_invalidate_previews", f"WITH {PV} SELECT file_id, content_hash, kind FROM pv WHERE file_id NOT LIKE 'c%'")
def _(cat, spark):
    return K.invalidate_previews(_previews(cat), cat["files"].where("id like 'c%'").select(F.col("id").alias("file_id")))[0]


@query("k4_preview_backlog", f"WITH {NOWV}, {PV} SELECT file_id, content_hash FROM nv WHERE (file_id, content_hash) NOT IN (SELECT file_id, content_hash FROM pv)")
def _(cat, spark):
    return K.preview_backlog(cat, _previews(cat))


HEADS = {0: "89504E470D0A1A0A", 1: "0000FF", 3: "23212F62696E2F73680A", 4: "5249464630303030574156456674", 5: "203C3F786D6C20", 6: "0A3C48746D6C3E"}


def _contents(spark):
    d, head = spark.table("documents"), F.lit(b"")
    for k, marks in HEADS.items():
        head = F.when(F.col("doc_id") % 10 == k, F.unhex(F.lit(marks))).otherwise(head)
    return d.select(F.md5(F.col("doc_id").cast("string")).alias("file_id"), F.md5("text").alias("content_hash"), F.concat(F.lit("a/b"), F.when(F.col("doc_id") % 10 == 2, F.lit(".mp4")).when(F.col("doc_id") % 10 == 3, F.lit(".txt")).otherwise(F.lit(""))).alias("path"), F.concat(head, F.encode("text", "utf-8")).alias("content"), "doc_id", "text")


KINDS = f"CASE WHEN text IS NULL THEN NULL WHEN doc_id % 10 = 0 THEN 'image' WHEN doc_id % 10 = 2 THEN 'video' WHEN doc_id % 10 IN (1, 3, 4, 5, 6) THEN NULL WHEN {IS_TEXT} THEN 'text' END"


@query("k5_classify", f"SELECT doc_id, {KINDS} AS kind FROM documents")
def _(cat, spark):
    return K.classify(_contents(spark)).select("doc_id", "kind")


@query("k6_text_previews", f"SELECT md5(doc_id::VARCHAR) AS file_id, md5(text) AS content_hash, CASE WHEN kind = 'text' THEN 'text' END AS kind, CASE WHEN kind = 'text' THEN head END AS data FROM (SELECT doc_id, text, {KINDS} AS kind, regexp_replace({WINDOW.format(256)}, '{CONTROL}', '', 'g') AS head FROM documents)")
def _(cat, spark):
    return K.text_previews(_contents(spark))


LOG = "lg AS (SELECT event_id AS \"at\", concat('l', CAST(user_id % 4 AS STRING)) AS link, CASE event_type WHEN 'view' THEN 'asked' WHEN 'click' THEN 'data' WHEN 'purchase' THEN 'data' ELSE 'miss' END AS msg, md5(CAST(user_id AS STRING)) AS file_id, CAST(user_id % 3 AS STRING) AS content_hash FROM events)"


def _reply_log(spark):
    u = F.col("user_id")
    return spark.table("events").select(F.col("event_id").alias("at"), F.concat(F.lit("l"), (u % 4).cast("string")).alias("link"), F.when(F.col("event_type") == "view", "asked").when(F.col("event_type").isin("click", "purchase"), "data").otherwise("miss").alias("msg"), F.md5(u.cast("string")).alias("file_id"), (u % 3).cast("string").alias("content_hash"))


@query("k7_resolve_preview_replies", f"WITH {LOG} SELECT file_id, content_hash, CASE WHEN count(*) FILTER (msg = 'data') > 0 THEN 'data' WHEN count(DISTINCT link) FILTER (msg = 'miss') >= count(DISTINCT link) FILTER (msg = 'asked') THEN 'unavailable' ELSE 'waiting' END AS state, min_by(link, \"at\") FILTER (msg = 'data') AS link FROM lg GROUP BY 1, 2")
def _(cat, spark):
    return K.resolve_preview_replies(_reply_log(spark))


# chunks

CP = "cp AS (SELECT DISTINCT file_id, content_hash, size, o AS offset, least(size - o, 65536) AS length FROM versions, unnest(range(0, greatest(size, 1), 65536)) r(o))"


@query("l1_chunk_plan", f"WITH {CP} SELECT file_id, content_hash, \"offset\", length FROM cp")
def _(cat, spark):
    return L.chunk_plan(cat["versions"])


CL = f"{CP}, cl AS (SELECT 'r1' AS receiver, file_id, content_hash, \"offset\", length, (\"offset\" // 65536) * 10 AS \"at\" FROM cp WHERE (\"offset\" // 65536) % 3 <> 2)"


def _chunk_log(cat):
    p = L.chunk_plan(cat["versions"])
    k = F.floor(F.col("offset") / L.CHUNK)
    # each good reply, again 7 ms later, one that is misaligned and one past the end; a union of
    # four tables would make the plan of chunks four times
    reply = lambda by, later: F.struct((F.col("offset") + by).alias("offset"), (k * 10 + later).alias("at"))
    replies = F.explode(F.array(reply(0, 0), reply(0, 7), reply(1, 0), reply(1 << 40, 0))).alias("r")
    good = p.where(k % 3 != 2).select("file_id", "content_hash", "length", replies)
    return good.select(F.lit("r1").alias("receiver"), "file_id", "content_hash", "r.offset", "length", "r.at", F.lit("data").alias("msg"))


@query("l2_clean_chunks", f"WITH {CL} SELECT receiver, file_id, content_hash, \"offset\", min(\"at\") AS \"at\", min(length) AS length FROM cl GROUP BY 1, 2, 3, 4")
def _(cat, spark):
    return L.clean_chunks(_chunk_log(cat), cat["versions"])


@query("l3_chunk_coverage", f"WITH {CL}, m AS (SELECT file_id, content_hash, count(*) FILTER ((\"offset\" // 65536) % 3 = 2) AS missing, sum(length)::BIGINT AS size, min(\"offset\") FILTER ((\"offset\" // 65536) % 3 = 2) AS gap FROM cp GROUP BY 1, 2) SELECT 'r1' AS receiver, file_id, content_hash, coalesce(gap, size) AS contiguous, missing, missing = 0 AS complete FROM m")
def _(cat, spark):
    return L.chunk_coverage(L.chunk_plan(cat["versions"]), L.clean_chunks(_chunk_log(cat), cat["versions"]))


@query("l4_verify_chunks", "SELECT md5(CAST(doc_id AS STRING)) AS file_id, CASE WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM documents")
def _(cat, spark):
    text = F.coalesce("text", F.lit(""))
    d = spark.table("documents").select(F.md5(F.col("doc_id").cast("string")).alias("file_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("bad")).otherwise(F.sha2(text, 256)).alias("content_hash"), F.encode(text, "utf-8").alias("b"))
    parts = d.select("file_id", "content_hash", F.explode(F.sequence(F.lit(0), F.greatest(F.length("b") - 1, F.lit(0)), F.lit(1000))).alias("offset"), "b").select("file_id", "content_hash", "offset", F.substr("b", F.col("offset") + 1, F.lit(1000)).alias("bytes"))
    return L.verify_chunks(parts).select("file_id", "state")


@query("l5_receive_outcomes", f"WITH {CL}, g AS (SELECT *, \"at\" * CASE WHEN file_id LIKE 'a%' THEN 1000 ELSE 1 END AS w FROM cl), d AS (SELECT *, w - lag(w) OVER (PARTITION BY file_id, content_hash ORDER BY w) AS gap FROM g), q AS (SELECT file_id, content_hash, max(gap) AS gap, max(w) AS last, count(DISTINCT \"offset\") AS n FROM d GROUP BY 1, 2), m AS (SELECT file_id, content_hash, count(DISTINCT \"offset\") AS n FROM cp GROUP BY 1, 2) SELECT file_id, content_hash, CASE WHEN q.gap > 8000 OR (q.n < m.n AND {NOW} - last > 8000 AND file_id NOT LIKE 'e%') THEN 'stalled' WHEN q.n = m.n AND file_id < '4' THEN 'hash_mismatch' WHEN q.n = m.n THEN 'complete' WHEN file_id LIKE 'e%' THEN 'unavailable' ELSE 'running' END AS outcome FROM q JOIN m USING (file_id, content_hash)")
def _(cat, spark):
    slow = F.when(F.col("file_id").startswith("a"), 1000).otherwise(1)
    got = L.clean_chunks(_chunk_log(cat).withColumn("at", F.col("at") * slow), cat["versions"])
    cover = L.chunk_coverage(L.chunk_plan(cat["versions"]), got)
    keys = cat["versions"].select("file_id", "content_hash").distinct()
    verified = keys.withColumn("state", F.when(F.col("file_id") < "4", "mismatch").otherwise("ok"))
    misses = keys.where("file_id like 'e%'").withColumn("receiver", F.lit("r1"))
    return L.receive_outcomes(cover, got, verified, misses, NOW).select("file_id", "content_hash", "outcome")


def _requests(spark):
    u = F.col("user_id")
    return spark.table("events").select((F.col("event_id") * 137).alias("at"), F.concat(F.lit("l"), (F.col("event_id") % 5).cast("string")).alias("link"), F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "ask").when(F.col("event_type") == "purchase", "data").otherwise("miss").alias("msg"), F.md5(u.cast("string")).alias("file_id"), F.lit("h").alias("content_hash"), (u % 2 * L.CHUNK).alias("offset"))


# The requests of each key one after the other: a fetch lasts 8000 ms from its first request.
ASKED = """r AS (SELECT md5(CAST(user_id AS VARCHAR)) AS file_id, (user_id % 2) * 65536 AS "offset", event_id * 137 AS "at", concat('l', event_id % 5) AS link, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type = 'view'),
st AS (SELECT file_id, "offset", i, "at" AS opened, link FROM r WHERE i = 1
 UNION ALL SELECT r.file_id, r."offset", r.i, CASE WHEN r."at" < st.opened + 8000 THEN st.opened ELSE r."at" END, r.link FROM st JOIN r ON r.file_id = st.file_id AND r.i = st.i + 1),
e AS (SELECT file_id, "offset", opened, count(*) AS n, count(DISTINCT link) AS links FROM st GROUP BY 1, 2, 3)"""


@query("l6_coalescing", f"RECURSIVE {ASKED} SELECT file_id, 'h' AS content_hash, \"offset\", sum(n)::BIGINT AS requests, count(*) AS fetches, max(links)::INT AS widest FROM e GROUP BY 1, 3")
def _(cat, spark):
    return L.coalescing(_requests(spark))


# The messages of each key one after the other, as a recursion over their numbers.
REQ = """lg AS (SELECT md5(CAST(user_id AS VARCHAR)) AS file_id, (user_id % 2) * 65536 AS "offset", event_id * 137 AS "at", concat('l', event_id % 5) AS link, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS m FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id, "offset" ORDER BY "at", m, link) AS i FROM lg),
st AS (SELECT DISTINCT file_id, "offset", 0::BIGINT AS i, NULL::BIGINT AS opened, []::VARCHAR[] AS rest, 0 AS asked, NULL::BIGINT AS was, NULL::VARCHAR AS outcome FROM lg
 UNION ALL SELECT file_id, "offset", i, CASE WHEN cur IS NULL THEN (CASE WHEN m = 0 THEN "at" END) WHEN fin IS NULL THEN cur END, CASE WHEN cur IS NULL THEN [] ELSE rest2 END, CASE WHEN cur IS NULL THEN 0 WHEN m = 1 THEN asked + 1 ELSE asked END, CASE WHEN ex OR (cur IS NOT NULL AND fin IS NOT NULL) THEN opened END, CASE WHEN ex THEN 'expired' WHEN cur IS NOT NULL THEN fin END
 FROM (SELECT *, CASE WHEN m = 2 THEN 'data' WHEN m = 3 AND asked > 0 AND len(rest2) = 0 THEN 'missed' END AS fin
  FROM (SELECT s.file_id, s."offset", o.i, o.m, o."at", s.opened, s.asked, coalesce(o."at" >= s.opened + 8000, false) AS ex, CASE WHEN o."at" < s.opened + 8000 THEN s.opened END AS cur, CASE o.m WHEN 1 THEN list_append(s.rest, o.link) WHEN 3 THEN list_filter(s.rest, lambda x: x <> o.link) ELSE s.rest END AS rest2
   FROM st s JOIN o ON o.file_id = s.file_id AND o."offset" = s."offset" AND o.i = s.i + 1) a) b)"""


@query("l7_miss_exhaustion", f"RECURSIVE {REQ} SELECT file_id, 'h' AS content_hash, \"offset\", was AS opened_at, outcome <> 'data' AS exhausted FROM st WHERE outcome IS NOT NULL UNION ALL SELECT file_id, 'h', \"offset\", arg_max(coalesce(opened, -1), i), true FROM st GROUP BY file_id, \"offset\" HAVING arg_max(coalesce(opened, -1), i) >= 0")
def _(cat, spark):
    return L.miss_exhaustion(R.request_outcomes(_requests(spark), NOW))


@query("l8_hash_memo", "SELECT id AS path, logical_path_modified_at AS mtime, CASE WHEN id < '8' THEN md5(id) END AS content_hash FROM files")
def _(cat, spark):
    listing = cat["files"].select(F.col("id").alias("path"), F.col("logical_path_modified_at").alias("mtime"), F.lit(5).alias("size"))
    memo = listing.select("path", (F.col("mtime") + F.when(F.col("path") < "8", 0).otherwise(1)).alias("mtime"), "size", F.md5("path").alias("content_hash"))
    return L.hash_memo(listing, memo).drop("size")


# events


FEV = """ev AS (SELECT concat('dev', CAST(user_id % 3 AS STRING)) AS device, concat('d', CAST(user_id % 2 AS STRING)) AS directory, event_id AS seq, event_id * 100 + event_id // 20 * 400 AS "at",
 CASE event_type WHEN 'view' THEN 'modify' WHEN 'click' THEN 'create' WHEN 'purchase' THEN 'remove' ELSE 'move' END AS op,
 CASE WHEN event_type IN ('view', 'click', 'purchase') OR event_id % 3 <> 0 THEN concat('p', left(md5(CAST(user_id AS STRING)), 1), CASE WHEN event_id % 4 = 0 THEN concat('/', left(md5(CAST(event_id AS STRING)), 2)) ELSE '' END) END AS path,
 CASE WHEN event_type NOT IN ('view', 'click', 'purchase') AND event_id % 3 <> 1 THEN concat('q', CAST(user_id % 5 AS STRING)) END AS "to", CAST(event_id % 3 AS STRING) AS content_hash FROM events)"""


def _file_events(spark):
    u, n, t = F.col("user_id"), F.col("event_id"), F.col("event_type")
    op = F.when(t == "view", "modify").when(t == "click", "create").when(t == "purchase", "remove").otherwise("move")
    below = F.when(n % 4 == 0, F.concat(F.lit("/"), F.left(F.md5(n.cast("string")), F.lit(2)))).otherwise("")
    path = F.when((op != "move") | (n % 3 != 0), F.concat(F.lit("p"), F.left(F.md5(u.cast("string")), F.lit(1)), below))
    to = F.when((op == "move") & (n % 3 != 1), F.concat(F.lit("q"), (u % 5).cast("string")))
    return spark.table("events").select(F.concat(F.lit("dev"), (u % 3).cast("string")).alias("device"), F.concat(F.lit("d"), (u % 2).cast("string")).alias("directory"), n.alias("seq"), (n * 100 + F.floor(n / 20) * 400).alias("at"), op.alias("op"), path.alias("path"), to.alias("to"), (n % 3).cast("string").alias("content_hash"))


@query("m4_coalesce_events")
def _(cat, spark):
    return Q.coalesce_events(_file_events(spark))


OWN = """ow AS (SELECT device, directory, seq - 1 AS seq, path, CASE WHEN seq % 12 = 0 THEN NULL ELSE CAST(seq // 4 % 3 AS STRING) END AS content_hash FROM ev WHERE seq % 4 = 0 AND path IS NOT NULL),
 asks AS (SELECT device, directory, seq, op, content_hash, unnest(CASE WHEN op = 'move' AND "to" IS NULL THEN [] WHEN "to" IS NULL THEN [path] WHEN path IS NULL THEN ["to"] ELSE [path, "to"] END) AS path FROM ev),
 fit AS (SELECT a.device, a.directory, a.path, w.seq AS record, min(a.seq) AS seq FROM asks a ASOF JOIN ow w ON a.device = w.device AND a.directory = w.directory AND a.path = w.path AND a.seq >= w.seq WHERE a.op <> 'modify' OR w.content_hash IS NULL OR w.content_hash = a.content_hash GROUP BY 1, 2, 3, 4)"""


@query("m5_suppress_self_writes", f"WITH {FEV}, {OWN} SELECT device, directory, seq, op, path, \"to\", content_hash FROM ev WHERE (device, directory, seq) NOT IN (SELECT (device, directory, seq) FROM fit)")
def _(cat, spark):
    e, s = _file_events(spark), F.col("seq")
    own = e.where("seq % 4 = 0").select("device", "directory", (s - 1).alias("seq"), "path", F.when(s % 12 != 0, (F.floor(s / 4) % 3).cast("string")).alias("content_hash"))
    return M.suppress_self_writes(e, own)


PLC = "pl AS (SELECT device, directory, path, min(file_id) AS file_id FROM (SELECT device, directory, file_id, concat('p', left(file_id, 1), CASE WHEN file_id < 'c' THEN concat('/', substring(file_id, 2, 2)) ELSE '' END) AS path FROM placements) x GROUP BY 1, 2, 3)"
DIRV = "di(device, directory, kind) AS (VALUES " + ", ".join(f"('{d[0]}', '{d[1]}', '{d[3]}')" for d in DIRS) + ")"
HIT = "hit AS (SELECT ev.*, kind, file_id FROM ev JOIN di USING (device, directory) LEFT JOIN pl USING (device, directory, path) WHERE NOT (op = 'move' AND path IS NOT NULL AND \"to\" IS NOT NULL AND kind = 'universal'))"
CHANGES = """SELECT device, directory, seq, 'create' AS change, md5(concat_ws(chr(31), device, directory, CAST(seq AS STRING), coalesce("to", path))) AS file_id, coalesce("to", path) AS path FROM hit WHERE op = 'create' OR path IS NULL
 UNION ALL SELECT device, directory, seq, CASE WHEN file_id IS NULL THEN 'rejected' WHEN op = 'modify' THEN 'edit' ELSE 'delete' END, file_id, path FROM hit WHERE op IN ('modify', 'remove')
 UNION ALL SELECT device, directory, seq, CASE WHEN "to" IS NULL THEN 'delete' ELSE 'move' END, file_id, coalesce("to", path) FROM hit WHERE op = 'move' AND path IS NOT NULL AND file_id IS NOT NULL
 UNION ALL SELECT h.device, h.directory, seq, CASE WHEN "to" IS NULL THEN 'delete' ELSE 'move' END, pl.file_id, CASE WHEN "to" IS NULL THEN pl.path ELSE concat("to", substring(pl.path, length(h.path) + 1)) END FROM hit h JOIN pl ON pl.device = h.device AND pl.directory = h.directory AND starts_with(pl.path, concat(h.path, '/')) WHERE op = 'move' AND h.file_id IS NULL"""


@query("m6_events_to_changes", f"WITH {FEV}, {PLC}, {DIRV}, {HIT} {CHANGES}")
def _(cat, spark):
    i = F.col("file_id")
    path = F.concat(F.lit("p"), F.left(i, F.lit(1)), F.when(i < "c", F.concat(F.lit("/"), F.substring(i, 2, 2))).otherwise(""))
    placed = cat["placements"].groupBy("device", "directory", path.alias("physical_path")).agg(F.min("file_id").alias("file_id"))
    return M.events_to_changes(_file_events(spark), placed, _dirs(spark)).drop("tags")


OPE = "oe AS (SELECT user_id AS op_id, 'k' AS kind, CASE event_type WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'progress' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'started' ELSE 'dropped' END AS status, event_id AS done, CAST(100 AS BIGINT) AS total, event_id AS \"at\" FROM events)"


def _op_events(spark):
    t = F.col("event_type")
    return spark.table("events").select(F.col("user_id").alias("op_id"), F.lit("k").alias("kind"), F.when(t == "signup", "completed").when(t.isin("purchase", "view"), "progress").when(t == "click", "started").otherwise("dropped").alias("status"), F.col("event_id").alias("done"), F.lit(100).cast("long").alias("total"), F.col("event_id").alias("at"))


OPS = f"{OPE}, en AS (SELECT op_id, min(\"at\") AS e FROM oe WHERE status IN ('completed', 'dropped') GROUP BY 1), st AS (SELECT op_id, CASE max_by(status, \"at\") WHEN 'dropped' THEN 'aborted' ELSE max_by(status, \"at\") END AS status, max_by(done, \"at\") AS done, min(\"at\") AS started_at, max(\"at\") AS \"at\", max_by(kind, \"at\") AS kind FROM oe LEFT JOIN en USING (op_id) WHERE e IS NULL OR \"at\" <= e GROUP BY 1)"


@query("m7_operations_state", f"WITH {OPS} SELECT op_id, status, done, started_at, \"at\", status IN ('completed', 'aborted') AS finished FROM st")
def _(cat, spark):
    return M.operations_state(_op_events(spark)).select("op_id", "status", "done", "started_at", "at", "finished")


@query("m8_operation_report", f"WITH {OPS} SELECT kind, count(*) AS operations, count(*) FILTER (status = 'completed') AS completed, avg(\"at\" - started_at) AS mean_ms, sum(done)::BIGINT AS bytes, max(\"at\") AS newest FROM st WHERE status IN ('completed', 'aborted') GROUP BY 1")
def _(cat, spark):
    return M.operation_report(_op_events(spark))
