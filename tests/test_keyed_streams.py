import random
import time

import pytest
from pyspark.sql import functions as F

from tagloom.operators import lww
from tagloom.streaming import coalesce, events, jobs, keyed


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each batch starts a worker for each partition that has rows. A job with timers always
    wants another batch, so a run that is to end must not make batches without data."""
    own = {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def run(spark, tmp_path, df, job, name, mode, parts=2, order="seq"):
    """All rows that job gives for df, which arrives in some files one after the other."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return spark.table(name)


def phases(spark, tmp_path, schema, job, batches):
    """Rows of a job over batches (rows, seconds to wait before them), each in a run of its own
    that starts from the state of the last one."""
    for rows, wait in batches:
        time.sleep(wait)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = job(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)


def test_files_agree_with_replay(spark, tmp_path):
    rng = random.Random(3)
    made = [(i, f"f{rng.randrange(9)}", rng.choice(["add", "move", "edit", "edit", "delete", "restore"]), f"p{i}", f"h{i}", rng.randrange(1, 60)) for i in range(240)]
    df = spark.createDataFrame(made + [(None, "f1", "add", "x", None, 1), (999, None, "add", "x", None, 1)], "seq long, file_id string, op string, path string, content_hash string, at long")
    got = run(spark, tmp_path, df, keyed.stream_files, "files_out", "update").collect()
    last = {r.file_id: r for r in got}  # rows of later batches come later
    ops = df.where("seq is not null and file_id is not null")
    paths = {r.file_id: r for r in lww.replay_paths(ops.withColumnRenamed("at", "modified_at")).collect()}
    states = {r.file_id: r for r in lww.replay_tombstones(ops.where("op in ('edit', 'delete', 'restore')")).collect()}
    edits = dict(ops.where("op = 'edit'").groupBy("file_id").count().collect())
    assert last.keys() == paths.keys()
    for k, r in last.items():
        assert (r.logical_path, r.logical_path_modified_at) == (paths[k].logical_path, paths[k].logical_path_modified_at)
        assert (r.deleted, r.observed_at, r.deleted_at, r.restored_at) == (states[k].deleted, states[k].observed_at, states[k].deleted_at, states[k].restored_at)
        assert r.version_number == edits.get(k, 0)


def test_same_content_is_no_version(spark, tmp_path):
    made = [(1, "f", "add", "p", None, 1), (2, "f", "edit", None, "A", 2), (3, "f", "edit", None, "A", 9), (4, "f", "edit", None, "B", 3), (5, "f", "edit", None, "A", 4)]
    df = spark.createDataFrame(made, "seq long, file_id string, op string, path string, content_hash string, at long")
    last = run(spark, tmp_path, df, keyed.stream_files, "same_out", "update", parts=1).first()
    assert (last.version_number, last.content_hash, last.observed_at) == (3, "A", 4)


def test_operations_agree_with_batch(spark, tmp_path):
    rng = random.Random(6)
    made = [(f"o{rng.randrange(8)}", "pull", rng.choice(["started", "progress", "progress", "completed", "dropped"]), i, None if i % 9 == 0 else 100, i) for i in range(60)]
    df = spark.createDataFrame(made, "op_id string, kind string, status string, done long, total long, at long")
    got = {r.op_id: tuple(r) for r in run(spark, tmp_path, df, keyed.stream_operations, "operations_out", "update", order="at").collect()}
    names = ["op_id", "kind", "status", "done", "total", "started_at", "at", "finished"]
    assert got == {r.op_id: tuple(r) for r in events.operations_state(df).select(names).collect()}


LOG = "file_id string, content_hash string, offset long, at long, msg string, link string"


def test_request_outcomes(spark):
    def outcomes(*messages):
        log = spark.createDataFrame([("f", "h", 0, at, msg, link) for at, msg, link in messages], LOG)
        return [(r.opened_at, r.closed_at, r.outcome, r.waiting, r.asked) for r in keyed.request_outcomes(log, 100_000).orderBy("opened_at").collect()]

    assert outcomes((0, "request", "a"), (1, "ask", "u"), (5, "request", "b"), (9, "data", "u"), (10, "data", "u")) == [(0, 9, "data", 2, 1)]
    assert outcomes((0, "request", "a"), (1, "ask", "u"), (1, "ask", "v"), (2, "miss", "u"), (3, "drop", "v")) == [(0, 3, "missed", 1, 2)]
    assert outcomes((0, "request", "a"), (1, "ask", "u"), (2, "drop", "a")) == [(0, 2, "abandoned", 0, 1)]
    assert outcomes((0, "request", "a"), (7999, "request", "b"), (8000, "request", "c")) == [(0, 8000, "expired", 2, 0), (8000, 16000, "expired", 1, 0)]
    assert outcomes((0, "data", "u"), (1, "hello", "u"), (None, "request", "a")) == []


def test_requests_agree_with_batch(spark, tmp_path):
    rng = random.Random(11)
    made = [("f", "h", rng.randrange(5) * 65536, i * 40_000 + rng.randrange(40_000), rng.choice(["request", "request", "ask", "miss", "data", "drop"]), rng.choice("abcd")) for i in range(120)]
    df = spark.createDataFrame(made, LOG)
    got = run(spark, tmp_path, df, lambda s: keyed.stream_requests(s, ttl=800_000), "requests_out", "append", order="at")
    want = keyed.request_outcomes(df, ttl=800_000)
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r[0] for r in want.select(F.col("outcome")).distinct().collect()} >= {"data", "expired"}


def test_requests_of_a_lagging_peer_are_not_lost(spark, tmp_path):
    row = lambda f, at, msg: (f, "h", 0, at, msg, "a")
    batches = [
        ([row("fast", 1_000_000, "request"), row("slow", 1_000, "request")], 0),
        ([row("slow", 1_500, "data"), row("slow", 1_600, "request"), row("fast", 1_000_900, "request")], 0),
        ([row("other", 5, "data")], 2.5),  # by then the processing clock has passed both open requests
    ]
    got = phases(spark, tmp_path, LOG, lambda s: keyed.stream_requests(s, ttl=2000), batches)
    assert got == sorted([("fast", "h", 0, 1_000_000, 1_002_000, "expired", 2, 0), ("slow", "h", 0, 1_000, 1_500, "data", 1, 0), ("slow", "h", 0, 1_600, 3_600, "expired", 1, 0)], key=str)


def test_events_of_a_lagging_device_are_not_lost(spark, tmp_path):
    row = lambda device, seq, at: (device, "d", seq, at, "create", f"p{seq}", None)
    batches = [([row("fast", 1, 100_000), row("slow", 2, 1_000)], 0), ([row("slow", 3, 2_000), row("fast", 4, 101_000)], 0), ([row("other", 5, 1)], 2.5)]
    got = phases(spark, tmp_path, coalesce.EVENT, lambda s: coalesce.stream_coalesce(s, idle=2000), batches)
    assert [r[:4] for r in sorted(got, key=lambda r: r[2])] == [("fast", "d", 1, 100_000), ("slow", "d", 2, 1_000), ("slow", "d", 3, 2_000), ("fast", "d", 4, 101_000)]


def test_tags_and_entries_agree_with_replay(spark, tmp_path):
    rng = random.Random(4)
    made = [(i, f"t{rng.randrange(7)}", rng.choice(["add", "rename", "recolor", "remove"]), f"v{i}", rng.randrange(1, 50)) for i in range(150)]
    df = spark.createDataFrame(made, "seq long, id string, op string, value string, modified_at long")
    (tmp_path / "t").mkdir()
    last = {r.id: tuple(r) for r in run(spark, tmp_path / "t", df, jobs.stream_tags, "tags_out", "update").collect()}
    assert last == {r.id: tuple(r[c] for c in ("id", "name", "color", "modified_at", "deleted")) for r in lww.replay_tags(df).collect()}
    made = [(i, f"t{rng.randrange(3)}", f"f{rng.randrange(4)}", rng.randrange(2), rng.choice(["tag", "untag"]), rng.randrange(1, 40)) for i in range(150)]
    df = spark.createDataFrame(made, "seq long, tag_id string, target_id string, type int, op string, modified_at long")
    (tmp_path / "e").mkdir()
    last = {tuple(r)[:3]: tuple(r) for r in run(spark, tmp_path / "e", df, jobs.stream_entries, "entries_out", "update").collect()}
    assert last == {tuple(r[c] for c in ("tag_id", "target_id", "type")): tuple(r[c] for c in ("tag_id", "target_id", "type", "modified_at", "deleted")) for r in lww.replay_entries(df).collect()}
