"""Components, closures and statistics of tag graphs against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import graph as E


def reach(edges):
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    out = {}
    for root in below:
        seen, todo = set(), list(below[root])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += below.get(n, ())
        out[root] = seen
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def circles(edges):
    r = reach(edges)
    return {n: min(m for m in below | {n} if m == n or n in r.get(m, ())) for n, below in r.items() if n in below}


GRAPHS = {
    "two circles, a bridge and loops": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "y"), ("y", "y2"), ("l", "l"), ("l", "a"), ("b", "a"), ("b", "a"), (None, "b"), ("b", None)],
    "random": [(f"{random.Random(k).randrange(40)}", f"{random.Random(-k - 1).randrange(40)}") for k in range(70)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_closure(spark, name):
    edges = GRAPHS[name]
    real = [e for e in edges if None not in e]
    assert {r.node: r.component for r in E.strong_components(frame(spark, edges)).collect()} == circles(real)
    roots = spark.createDataFrame([(n,) for n in sorted({n for e in real for n in e} | {"zz"})], "root string")
    got = E.closure(frame(spark, real), roots).collect()
    assert sorted((r.root, r.node) for r in got) == sorted((a, b) for a, below in reach(real).items() for b in below)


def test_a_large_circle_makes_no_pairs(spark):
    """5000 tags in one circle, with a tail before and one after it."""
    n = 5000
    ring = spark.range(n).select(F.concat(F.lit("t"), "id").alias("src"), F.concat(F.lit("t"), (F.col("id") + 1) % n).alias("dst"))
    edges = ring.union(frame(spark, [("before", "t7"), ("t9", "after"), ("after", "later")]))
    graph = E.Condensed(edges)
    assert (graph.of.count(), graph.of.select("component").distinct().collect()) == (n, [("t0",)])
    assert sorted(tuple(r) for r in graph.edges.collect()) == [("after", "later"), ("before", "t0"), ("t0", "after")]
    tags = spark.range(n).select(F.concat(F.lit("t"), "id").alias("id"), F.lit(False).alias("deleted"))
    cat = {
        "tags": tags,
        "entries": ring.select(F.col("src").alias("tag_id"), F.col("dst").alias("target_id"), F.lit(1).alias("type"), F.lit(False).alias("deleted")).union(spark.createDataFrame([("t1", "f1", 0, False), ("t2", "f1", 0, False), ("t3", "f2", 0, False)], "tag_id string, target_id string, type int, deleted boolean")),
        "versions": spark.createDataFrame([("f1", 1, 5), ("f1", 2, 7), ("f2", 1, 10)], "file_id string, version_number int, size long"),
    }
    stats = E.tag_stats(cat).groupBy("direct_files", "transitive_files", "transitive_bytes").count().collect()
    assert sorted(map(tuple, stats)) == [(0, 2, 17, n - 3), (1, 2, 17, 3)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 300, []
    chain = lambda n: spark.range(n).select(F.format_string("t%04d", "id").alias("src"), F.format_string("t%04d", F.col("id") + 1).alias("dst"))
    stage = E.stage
    monkeypatch.setattr(E, "stage", lambda df, name: (rounds.append(name), stage(df, name))[1])
    assert E.paths(chain(n)).count() == n * (n + 1) // 2
    assert len(rounds) <= 11
    monkeypatch.setattr(E, "LEVELS", 2)
    monkeypatch.setattr(E, "JOBS", 1)
    monkeypatch.setattr(E, "TRIMS", 2)
    got = E.closure(chain(12), spark.createDataFrame([("t0003",), ("t0011",)], "root string"))
    assert sorted(map(tuple, got.groupBy("root").count().collect())) == [("t0003", 9), ("t0011", 1)]
