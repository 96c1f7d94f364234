"""Catalog tables derived from the star-schema tables. One SQL text serves Spark and the
SQL check; {ms:col} stands for milliseconds since the epoch (session time zone UTC).
Tables made of orders or lineitem have plans of their own in Spark, which lay their rows
out once."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART_ROWS = 100_000  # rows of lineitem or orders in a task
BASE = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "pages")

TABLES = {
    "versions": """SELECT md5(concat('f',CAST(l_orderkey AS STRING))) AS file_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax) AS version_number,
 md5(concat('c',CAST(l_partkey % 20 AS STRING),'-',CAST(l_orderkey AS STRING))) AS content_hash,
 {ms:l_shipdate} AS observed_at,
 CASE l_suppkey % 3 WHEN 0 THEN 'local' ELSE concat('peer',CAST(l_suppkey % 3 AS STRING)) END AS origin,
 CAST(floor(l_quantity) AS BIGINT)*4096 + l_partkey % 4096 AS size FROM lineitem""",
    "files": """SELECT b.id,b.logical_path,b.logical_path_modified_at, b.deleted_at > 0 AND b.deleted_at >= greatest(coalesce(v.o,0),b.restored_at) AS deleted,b.deleted_at,b.restored_at
 FROM (SELECT md5(concat('f',CAST(o_orderkey AS STRING))) AS id,
 concat(CASE o_orderkey % 4 WHEN 0 THEN 'photos/' WHEN 1 THEN 'notes/' WHEN 2 THEN 'work/' ELSE 'Archive/Photos/' END, CAST(o_custkey AS STRING),'/',lower(substring(o_orderpriority,3)),'-',CAST(o_orderkey AS STRING),
  CASE o_orderkey % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.JPG' WHEN 2 THEN '.pdf' WHEN 3 THEN '.mp4' WHEN 4 THEN '.csv' WHEN 5 THEN '.tmp' ELSE '' END) AS logical_path,
 {ms:o_orderdate} AS logical_path_modified_at,
 CASE WHEN o_orderkey % 5 = 0 THEN {ms:o_orderdate} + (o_orderkey % 150 + 1)*86400000 ELSE 0 END AS deleted_at,
 CASE WHEN o_orderkey % 15 = 0 THEN {ms:o_orderdate} + (o_orderkey % 70 + 40)*86400000 ELSE 0 END AS restored_at FROM orders) b
 LEFT JOIN (SELECT file_id, max_by(observed_at,version_number) AS o FROM versions GROUP BY file_id) v ON v.file_id=b.id""",
    "tags": """SELECT md5(concat('r',CAST(r_regionkey AS STRING))) AS id, r_name AS name, '#F44336' AS color, CAST(1000 AS BIGINT) AS modified_at, false AS deleted FROM region
 UNION ALL SELECT md5(concat('n',CAST(n_nationkey AS STRING))), n_name, '#2196F3', CAST(2000+n_nationkey AS BIGINT), n_nationkey % 11 = 3 FROM nation
 UNION ALL SELECT md5(concat('b',p_brand)), p_brand, '#4CAF50', CAST(3000 AS BIGINT), p_brand = 'Brand#13' FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#25') x""",
    "entries": """SELECT md5(concat('r',CAST(n_regionkey AS STRING))) AS tag_id, md5(concat('n',CAST(n_nationkey AS STRING))) AS target_id, 1 AS type, CAST(100 AS BIGINT) AS modified_at, false AS deleted FROM nation
 UNION ALL SELECT md5(concat('n',CAST(n_nationkey AS STRING))), md5(concat('bBrand#',CAST(n_nationkey+1 AS STRING))),1,CAST(200 AS BIGINT), n_nationkey % 9 = 4 FROM nation
 UNION ALL SELECT md5(concat('bBrand#',CAST(n_nationkey+1 AS STRING))), md5(concat('r',CAST((CASE n_nationkey WHEN 10 THEN n_regionkey+1 ELSE n_regionkey END) % 5 AS STRING))),1,CAST(300 AS BIGINT), false FROM nation WHERE n_nationkey % 10 = 0
 UNION ALL SELECT DISTINCT md5(concat('b',p_brand)), md5(concat('f',CAST(l_orderkey AS STRING))),0,CAST(400 AS BIGINT), l_orderkey % 13 = 0 FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_linenumber=1
 UNION ALL SELECT md5(concat('n',CAST(c_nationkey AS STRING))), md5(concat('f',CAST(o_orderkey AS STRING))),0,CAST(500 AS BIGINT), false FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderkey % 3 = 0""",
    "tag_changes": """SELECT event_id AS seq, md5(concat('u',CAST(user_id AS STRING))) AS id,
 CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'rename' WHEN 'click' THEN 'recolor' ELSE 'remove' END AS op,
 concat('v',CAST(event_id % 17 AS STRING)) AS value, {ms:ts} + ((event_id*7919) % 97 - 48)*21600000 AS modified_at FROM events""",
    "placements": """SELECT concat('dev', CAST(l_suppkey % 4 AS STRING)) AS device, concat('d', CAST(l_suppkey % 2 AS STRING)) AS directory, md5(concat('f',CAST(l_orderkey AS STRING))) AS file_id,
 min(concat('d', CAST(l_partkey % 50 AS STRING), '/f', CAST(l_orderkey AS STRING))) AS physical_path FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2, 3""",
    "theirs": """SELECT f.id, f.logical_path, f.logical_path_modified_at + CASE WHEN length(f.logical_path) % 3 = 0 THEN 1 ELSE 0 END AS logical_path_modified_at, (f.deleted OR f.id LIKE '3%') AND f.id NOT LIKE '4%' AS deleted,
 CASE WHEN f.id LIKE '3%' THEN f.deleted_at + 99999999999999 ELSE f.deleted_at END AS deleted_at, CASE WHEN f.id LIKE '4%' THEN f.restored_at + 99999999999999 ELSE f.restored_at END AS restored_at FROM files f WHERE f.id NOT LIKE '5%'""",
    "their_versions": """SELECT file_id, version_number, content_hash, observed_at + 1 AS observed_at, origin, size FROM versions WHERE NOT (file_id LIKE '6%' AND version_number > 1)
 UNION ALL SELECT file_id, max(version_number) + 1, md5(concat('new', file_id)), max(observed_at) + 5, 'peer9', CAST(7 AS BIGINT) FROM versions WHERE file_id LIKE '7%' OR file_id LIKE '8%' GROUP BY file_id""",
    "our_versions": """SELECT * FROM versions
 UNION ALL SELECT file_id, max(version_number) + 1, md5(concat('own', file_id)), max(observed_at) + 6, 'local', CAST(8 AS BIGINT) FROM versions WHERE file_id LIKE '8%' GROUP BY file_id""",
}
LAST = "(SELECT file_id, max_by(observed_at,version_number) AS o FROM versions GROUP BY file_id)"
COLUMNS = {"our_versions": "file_id, version_number, content_hash, observed_at, origin, size"}


def _for(engine: str, sql: str) -> str:
    to = r"unix_millis(CAST(\1 AS TIMESTAMP))" if engine == "spark" else r"(epoch_us(CAST(\1 AS TIMESTAMP))//1000)"
    return re.sub(r"\{ms:(\w+)\}", to, sql)


def _parts(*tables: DataFrame) -> int:
    """Partitions that the tables are dealt to: as many as a shuffle has, and more where a task
    would get over PART_ROWS rows, so that what a task holds does not grow with the tables.
    Rows are counted from the files' footers."""
    n = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, *(math.ceil(t.count() / PART_ROWS) for t in tables))


def _dealt(table: DataFrame, n: int, key: str, *columns: str) -> DataFrame:
    """Columns of a given table, dealt by the file id that is made of ``key``. Only they are
    shuffled, and the ids and texts that are made of them come after it.

    The number of partitions is fixed, as exploded chunks are many times what is shuffled."""
    return table.select(key, *columns).repartition(n, _file_id(key))


def _file_id(key: str):
    return F.expr(f"md5(concat('f',CAST({key} AS STRING)))")


def _versions(lineitem: DataFrame, n: int) -> DataFrame:
    """The table versions of the SQL text. The numbering, aggregations and joins by file_id
    (or by more columns) all find the rows where they need them, so the table is shuffled
    once in a query. Rows that are alike in the columns of ``order`` give the same version
    apart from its number, so the price, discount and tax that the SQL text goes on to sort
    by stay behind."""
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    columns = re.match(r"SELECT (.*) AS file_id,.*AS version_number,(.*) AS content_hash,(.*) FROM lineitem", _for("spark", TABLES["versions"]), re.S)
    content_hash, rest = F.expr(columns[2]), columns[3].split(",\n")
    # no name of the given table stays above the window, and none gets a qualifier: a union
    # keeps a layout that it finds under one and the same name in all its branches
    laid = _dealt(lineitem, n, "l_orderkey", *order).select(_file_id("l_orderkey").alias("file_id"), content_hash.alias("content_hash"), *order)
    numbered = laid.withColumn("version_number", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)))
    return numbered.selectExpr("file_id", "version_number", "content_hash", *rest)


def _files(orders: DataFrame, lineitem: DataFrame, n: int) -> DataFrame:
    """The table files of the SQL text. Versions are numbered by l_shipdate first, so the
    latest one of a file was observed at its newest date: two columns of lineitem do."""
    at = _for("spark", "{ms:l_shipdate} AS at")
    seen = _dealt(lineitem, n, "l_orderkey", "l_shipdate").select(_file_id("l_orderkey").alias("file_id"), F.expr(at)).groupBy("file_id").agg(F.max("at").alias("o"))
    laid = _dealt(orders, n, "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    text = _for("spark", TABLES["files"]).replace("FROM orders)", "FROM {laid})").replace(LAST, "{seen}")
    return orders.sparkSession.sql(text, laid=laid, seen=seen)


def _placements(lineitem: DataFrame, n: int) -> DataFrame:
    """The table placements of the SQL text."""
    columns = re.match(r"SELECT (.* AS device),(.* AS directory),.* AS file_id,\s*min\((.*)\) AS physical_path FROM lineitem WHERE (.*) GROUP BY", TABLES["placements"], re.S)
    device, directory, path, where = columns.groups()
    laid = _dealt(lineitem.where(where), n, "l_orderkey", "l_partkey", "l_suppkey")
    named = laid.select(F.expr(device), F.expr(directory), _file_id("l_orderkey").alias("file_id"), F.expr(path).alias("path"))
    return named.groupBy("device", "directory", "file_id").agg(F.min("path").alias("physical_path"))


def _their_versions(versions: DataFrame) -> DataFrame:
    """The table their_versions of the SQL text, in a form whose union keeps the layout."""
    old = versions.where("not (file_id like '6%' and version_number > 1)").withColumn("observed_at", F.col("observed_at") + 1)
    last = versions.where("file_id like '7%' or file_id like '8%'").groupBy("file_id").agg(F.max("version_number").alias("n"), F.max("observed_at").alias("at"))
    new = last.selectExpr("file_id", "n + 1 AS version_number", "md5(concat('new', file_id)) AS content_hash", "at + 5 AS observed_at", "'peer9' AS origin", "CAST(7 AS BIGINT) AS size")
    columns = ["file_id", "version_number", "content_hash", "observed_at", "origin", "size"]
    return old.select(columns).unionAll(new.select(columns))


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All derived tables by name; each is lazy and prunes to the columns a query uses."""
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    lineitem, orders = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders"))
    n = _parts(lineitem, orders)
    own = {"versions": lambda: _versions(lineitem, n), "files": lambda: _files(orders, lineitem, n), "placements": lambda: _placements(lineitem, n), "their_versions": lambda: _their_versions(out["versions"])}
    out = {}
    for name, sql in TABLES.items():
        out[name] = own[name]() if name in own else spark.sql(_for("spark", sql))
        out[name].createOrReplaceTempView(name)
    return out


def oracle(sql: str) -> str:
    """SQL over the derived tables as one statement over the given ones; a query that starts
    with RECURSIVE brings its own recursive tables."""
    sql = sql.strip()
    own = [f"{name} AS ({_for('duckdb', text)})" for name, text in TABLES.items() if re.search(rf"\b{name}\b", _closure(sql))]
    kind = "WITH RECURSIVE " if sql.startswith("RECURSIVE") else "WITH "
    if sql.startswith(("WITH", "RECURSIVE")):
        return kind + ", ".join([*own, sql.split(None, 1)[1]])
    return kind + ", ".join(own) + " " + sql if own else sql


def _closure(sql: str) -> str:
    """The query with the texts of all derived tables that it reaches."""
    text = sql
    for name in reversed(list(TABLES)):
        if re.search(rf"\b{name}\b", text):
            text += " " + TABLES[name]
    return text
