"""What a task holds does not grow with the tables."""

import pytest

from tagloom.plans import fixtures, registry

SF = "/root/testdata/sf0.001"


def test_versions_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert fixtures.catalog(spark, SF)["versions"].rdd.getNumPartitions() == 4
    monkeypatch.setattr(fixtures, "PART_ROWS", rows // 9)
    cat = fixtures.catalog(spark, SF)
    for name in ("versions", "files", "placements"):
        assert cat[name].rdd.getNumPartitions() >= 9, name
    sizes = cat["versions"].rdd.glom().map(len).collect()
    assert sum(sizes) == rows and max(sizes) < 2 * rows / len(sizes)


@pytest.mark.parametrize(("name", "most"), [("l2_clean_chunks", 2), ("l3_chunk_coverage", 3), ("l5_receive_outcomes", 7)])
def test_a_log_reads_its_chunks_once(spark, name, most):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == most
