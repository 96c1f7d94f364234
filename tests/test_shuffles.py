"""What queries shuffle: tables that lie by file_id are not shuffled again."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagloom.operators import chunks as L
from tagloom.operators import previews as K
from tagloom.operators.textindex import containing
from tagloom.plans import fixtures, registry
from tagloom.sources.staging import steps

SF = "/root/testdata/sf0.001"


def _moved(spark, name):
    """Exchanges that Spark puts below joins and aggregations of a query."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["l5_receive_outcomes", "l3_chunk_coverage", "l2_clean_chunks", "c4_record_versions"])
def test_versions_are_shuffled_once(spark, name):
    assert _moved(spark, name) == 0


def test_versions_are_those_of_the_sql_text(spark):
    laid = fixtures.catalog(spark, SF)["versions"]
    spark.read.parquet(f"{SF}/lineitem.parquet").createOrReplaceTempView("lineitem")
    text = spark.sql(fixtures._for("spark", fixtures.TABLES["versions"]))
    assert laid.dtypes == text.dtypes
    assert laid.exceptAll(text).isEmpty() and text.exceptAll(laid).isEmpty()


def test_coverage_of_several_receivers(spark):
    plan = spark.createDataFrame([("f", "h", 0, 65536), ("f", "h", 65536, 10), ("g", "h", 0, 5)], "file_id string, content_hash string, offset long, length long")
    got = spark.createDataFrame([("a", "f", "h", 0), ("b", "f", "h", 65536), ("b", "f", "h", 7), ("c", "x", "h", 0), ("a", None, "h", 0)], "receiver string, file_id string, content_hash string, offset long")
    rows = {tuple(r) for r in L.chunk_coverage(plan, got).collect()}
    assert rows == {("a", "f", "h", 65536, 1, False), ("b", "f", "h", 0, 1, False)}


def test_clean_chunks_of_empty_and_unknown_files(spark):
    versions = spark.createDataFrame([("e", "h", 0), ("f", "h", 70000), ("n", "h", None)], "file_id string, content_hash string, size long")
    log = spark.createDataFrame([(k, "h", "r", at, o, 1, "data") for k, at, o in (("e", 1, 0), ("e", 1, 65536), ("f", 3, 65536), ("f", 2, 65536), ("f", 2, 131072), ("f", 2, 7), ("n", 1, 0), ("u", 1, 0))], "file_id string, content_hash string, receiver string, at long, offset long, length long, msg string")
    assert {(r.file_id, r.offset, r["at"]) for r in L.clean_chunks(log, versions).collect()} == {("e", 0, 1), ("f", 65536, 2)}


def test_postings_of_texts_are_not_shuffled_for_few_terms(spark):
    terms = spark.createDataFrame([("notes",), ("ab",), ("zz9",)], "term string")
    texts = spark.range(500).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("abc/notes/"), F.col("id")).alias("text"))
    with steps(spark):
        found = containing(terms, texts)
        assert "Exchange hashpartitioning(gram" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 1000


@pytest.mark.parametrize("name", ["h3_content_decisions", "h4_plan_pulls", "h5_plan_deletions", "h7_plan_moves", "h8_plan_file_sync", "k1_preview_lookup", "k4_preview_backlog"])
def test_manifests_and_previews_meet_where_they_lie(spark, name):
    assert _moved(spark, name) == 0


@pytest.mark.parametrize("name", ["j11_directory_drift", "j12_drift_changes"])
def test_drift_shuffles_only_by_place(spark, name):
    assert _moved(spark, name) == 2


@pytest.mark.parametrize("name", ["files", "placements", "their_versions", "our_versions"])
def test_laid_tables_are_those_of_the_sql_text(spark, name):
    laid = fixtures.catalog(spark, SF)[name]
    text = spark.sql(fixtures._for("spark", fixtures.TABLES[name]))
    assert laid.dtypes == text.dtypes
    assert laid.exceptAll(text).isEmpty() and text.exceptAll(laid).isEmpty()


def test_laid_tables_of_ties_and_nulls(spark, tmp_path):
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    rows = [(k, p, s, 1, q, float(x), 0.0, 0.0, None if d is None else datetime(2000, 1, d)) for k in (1, 7, None) for p in (3, 23, None) for s in (2, None) for q in (-0.0, 0.0, 4.5, None) for x in (1, 2) for d in (None, 1, 2)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp"
    spark.createDataFrame([(1, 5, "1-URGENT", None), (7, None, None, None), (15, 2, "2-HIGH", datetime(1990, 1, 1)), (None, 1, "x", None)], orders).write.parquet(f"{tmp_path}/orders.parquet")
    for name in fixtures.BASE:
        if name not in ("lineitem", "orders"):
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    cat = fixtures.catalog(spark, str(tmp_path))
    for name in ("versions", "files", "placements", "their_versions", "our_versions"):
        text = spark.sql(fixtures._for("spark", fixtures.TABLES[name]))
        assert cat[name].exceptAll(text).isEmpty() and text.exceptAll(cat[name]).isEmpty(), name
        text.createOrReplaceTempView(name)


def test_preview_states_of_null_and_other_keys(spark):
    files = spark.createDataFrame([(k, False) for k in "abcd"] + [("e", True)], "id string, deleted boolean")
    versions = spark.createDataFrame([(k, n, h) for k, n, h in (("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, None), ("d", 1, "z"), ("e", 1, "x"))], "file_id string, version_number int, content_hash string")
    previews = spark.createDataFrame([("a", "x", "text"), ("b", "x", None), ("c", None, "text"), ("d", "z", "text"), ("e", "x", "text"), (None, "x", "text")], "file_id string, content_hash string, kind string")
    cat = {"files": files, "versions": versions}
    assert {tuple(r) for r in K.preview_lookup(cat, previews).collect()} == {("a", "y", "miss"), ("b", "x", "negative"), ("c", None, "miss"), ("d", "z", "hit")}
    assert {tuple(r) for r in K.preview_backlog(cat, previews).collect()} == {("a", "y"), ("c", None)}
