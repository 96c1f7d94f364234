"""Plans of a fleet: one pass over the manifests for both sides, the same rows as pair by pair."""

from pyspark.sql import functions as F

from tagloom.operators import reconcile as H
from tagloom.plans import fixtures, registry
from tagloom.sources import staging

SF = "/root/testdata/sf0.001"


def test_manifests_are_not_shuffled_for_pairs(spark, monkeypatch):
    plans = []

    def stage(df, name, old=staging.stage):
        plans.append(df._jdf.queryExecution())
        return old(df, name)

    monkeypatch.setattr(staging, "stage", stage)
    rows = registry.QUERIES["h8_plan_fleet"](spark, SF).count()
    plan = plans[-1]
    assert "hashpartitioning(ours" not in plan.executedPlan().toString()
    assert plan.optimizedPlan().toString().count("RepartitionByExpression") <= 8
    assert rows > 100


def test_fleet_plans_are_those_of_each_pair(spark):
    """Also for a file that one device lacks, several pairs of a device, and repeated files."""
    cat = fixtures.catalog(spark, SF)
    ours, theirs = registry._manifests(cat)
    same = [c for c in ours.columns if c in theirs.columns]
    some = "file_id < '3' or file_id like '6%' or file_id like '8%'"
    of = {"a": ours.select(same).where(some), "b": theirs.select(same).where(some).unionAll(theirs.select(same).where("file_id < '1'")), "c": ours.select(same).where(some + " and file_id > '2'")}
    of = {k: staging.stage(df, "manifest") for k, df in of.items()}
    fleet = None
    for k, df in of.items():
        one = df.select(F.lit(k).alias("device"), *same)
        fleet = one if fleet is None else fleet.unionByName(one)
    pairs = [("a", "b"), ("b", "a"), ("c", "b"), ("a", "a"), ("c", "x"), ("x", "a")]
    got = H.plan_fleet(fleet, spark.createDataFrame(pairs, "ours string, theirs string"), 16)
    none = of["a"].where("false")
    want = None
    for o, t in pairs:
        if o != t:
            one = H.plan_file_sync(of.get(o, none), of.get(t, none)).select(F.lit(o).alias("ours"), F.lit(t).alias("theirs"), "*")
            want = one if want is None else want.unionAll(one)
    assert got.columns == want.columns and got.count() > 100
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
