"""Packing deals repeated rows to all shards; tables of steps belong to the thread that wrote them."""

import threading

from pyspark.sql import functions as F

from tagloom.llm import packing
from tagloom.llm.common import _scratch, scratch, stage


def test_repeated_rows_are_dealt_to_all_shards(spark):
    same = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = packing.pack(same, shard_rows=500).groupBy(F.shiftright("bin_id", 32).alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("bin_id").alias("bins")).collect()
    assert len(got) == 13 and sum(r.n for r in got) == 6000
    assert max(r.n for r in got) < 700 and all(r.n == r.bins for r in got)


def test_empty_table_and_null_keys(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, shard int, salt double")
    assert packing.pack(none).count() == 0
    odd = spark.createDataFrame([(None, "a b", None), (None, "a b", None), (1, None, "s"), (2, "", "s")], "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.bin_id is None) for r in packing.pack(odd).collect())
    assert got == [(0, 2, False), (0, 2, False), (1, 0, True), (2, 0, True)]


def test_threads_do_not_take_each_others_tables(spark):
    seen, go, done = [], threading.Event(), threading.Event()

    def other():
        with scratch(spark):
            go.set()
            done.wait(60)
            seen.append(len(_scratch.get()[0]))

    t = threading.Thread(target=other)
    t.start()
    go.wait(60)
    with scratch(spark) as keep:
        first = stage(spark.range(3), "first")
        kept = keep(first.where("id > 0"), "kept")
        assert len(_scratch.get()[0]) == 1
    done.set()
    t.join()
    assert seen == [0] and kept.count() == 2 and _scratch.get() == ()


def test_inner_results_go_with_the_outer_block(spark):
    with scratch(spark) as keep:
        with scratch(spark) as inner:
            part = inner(spark.range(4), "part")
        out = keep(part.where("id > 1"), "out")
    assert out.count() == 2
    try:
        gone = not part.count()
    except Exception:
        gone = True
    assert gone
