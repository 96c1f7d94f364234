"""Tables that follow a stream, journals, standing searches, and listings that read only what
changed."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from tagloom.operators import lww, placement, search
from tagloom.sources import catalog
from tagloom.streaming import jobs, snapshots

TAG = "id string, name string, color string, modified_at long, deleted boolean"


def tags(spark, rows):
    return spark.createDataFrame([(i, n, "c", at, False) for i, n, at in rows], TAG)


def test_snapshots_follow_all_batches(spark, tmp_path):
    rng, table = random.Random(1), jobs.tag_snapshots(spark, f"file://{tmp_path}", fan=3, share=0.9, buckets=2)
    state, sizes = {}, []
    for n in range(11):
        rows = [(f"t{rng.randrange(12)}", f"n{n}-{k}", rng.randrange(40)) for k in range(3)] if n != 4 else []
        best = {}
        for i, name, at in rows:  # one row a key: ties within a batch are not defined
            best[i] = (i, name, at)
        before = dict(state)
        for i, name, at in best.values():
            if i not in state or at > state[i][1]:
                state[i] = (name, at)
        for _ in range(2 if n in (3, 6, 9) else 1):  # a batch that runs again
            table.add(tags(spark, best.values()), n)
        sizes.append(len(table.parts()))
        if n % 3 == 0:
            assert {r.id: (r.name, r.modified_at) for r in table.read().collect()} == state
            if n:
                assert {r.id: (r.name, r.modified_at) for r in table.read(n).collect()} == before
    assert table.last_batch() == 10
    kinds = [p.level for p in table.parts()]
    assert -1 in kinds and kinds.count(-1) <= 2  # there are bases, and old ones go
    assert max(sizes) <= 12
    again = jobs.tag_snapshots(spark, f"file://{tmp_path}", fan=3, share=0.9, buckets=2)  # a restart
    assert {r.id: (r.name, r.modified_at) for r in again.read().collect()} == state


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    table = jobs.tag_snapshots(spark, f"file://{tmp_path}")
    table.add(spark.range(50_000).select(F.concat(F.lit("t"), "id").alias("id"), F.md5(F.col("id").cast("string")).alias("name"), F.lit("c").alias("color"), F.lit(1).cast("long").alias("modified_at"), F.lit(False).alias("deleted")), 0)
    table.add(tags(spark, [("t7", "new", 5)]), 1)
    by_last = {p.last: p for p in table.parts()}
    assert by_last[1].size < by_last[0].size / 20
    assert table.read().where("id = 't7'").first().name == "new" and table.read().count() == 50_000
    assert [r.id for r in table.changed_keys(1).collect()] == ["t7"]


def test_feed_after_a_restart(spark, tmp_path):
    said = []
    feed = lambda: snapshots.change_feed(lambda n, kind, df: said.append((n, kind, df.count())), lambda: spark.range(9), f"file://{tmp_path}/journal")
    one = feed()
    one(spark.range(2), 0)
    one(spark.range(3), 1)
    two = feed()  # a new process knows nothing but the journal
    two(spark.range(3), 1)
    two(spark.range(4), 4)
    two(spark.range(1), 5)
    assert said == [(0, "changes", 2), (1, "changes", 3), (4, "resynced", 9), (4, "changes", 4), (5, "changes", 1)]
    assert [f for f in os.listdir(tmp_path / "journal") if not f.startswith(".")] == ["5"]

    def stop(*_):
        raise RuntimeError

    try:
        snapshots.change_feed(stop, lambda: spark.range(0), f"file://{tmp_path}/journal")(spark.range(1), 6)
    except RuntimeError:
        pass
    feed()(spark.range(1), 6)  # what stopped half way comes again
    assert said[-1] == (6, "changes", 1)


def test_standing_search_of_a_table(spark, tmp_path):
    got = {}
    search_ = lambda t: t.where("not deleted and name like 'a%'")
    batch = jobs.snapshot_batch(jobs.tag_snapshots(spark, f"file://{tmp_path}"), jobs.standing_search(search_, lambda n, df: got.update({n: sorted(map(tuple, df.collect()))})))
    batch(tags(spark, [("1", "ab", 1), ("2", "b", 1)]), 0)
    batch(tags(spark, [("1", "b", 2), ("2", "ac", 2), ("3", "a", 1)]), 1)
    batch(tags(spark, [("3", "z", 0)]), 2)
    assert got == {0: [("1", "added")], 1: [("1", "removed"), ("2", "added"), ("3", "added")], 2: []}


def random_catalog(spark, rng):
    files = [(f"f{i}", rng.choice(["a/x.md", "b/y.jpg"]) + str(i), 1, rng.random() < 0.2, 0, 0) for i in range(12)]
    names = [(f"t{i}", rng.choice(["red", "blue", "green"]), "c", 1, rng.random() < 0.15) for i in range(6)]
    edges = {(f"t{rng.randrange(6)}", f"f{rng.randrange(12)}", 0): rng.random() < 0.2 for _ in range(14)} | {(f"t{a}", f"t{b}", 1): rng.random() < 0.2 for a, b in [(rng.randrange(6), rng.randrange(6)) for _ in range(6)] if a != b}
    return {"files": {f[0]: f for f in files}, "tags": {t[0]: t for t in names}, "entries": edges, "versions": {f"f{i}": (f"f{i}", "h", 1, 1, "o", 5) for i in range(12)}}


def frames(spark, cat):
    return {
        "files": spark.createDataFrame(list(cat["files"].values()), catalog.SCHEMAS["files"]), "tags": spark.createDataFrame(list(cat["tags"].values()), catalog.SCHEMAS["tags"]),
        "entries": spark.createDataFrame([(*k, 1, dead) for k, dead in cat["entries"].items()], catalog.SCHEMAS["entries"]), "versions": spark.createDataFrame(list(cat["versions"].values()), catalog.SCHEMAS["versions"]),
    }


def test_standing_file_search_equals_the_full_difference(spark):
    for seed in range(1, 2):
        rng = random.Random(seed)
        old = random_catalog(spark, rng)
        new = {k: dict(v) for k, v in old.items()}
        t, f = f"t{rng.randrange(6)}", f"f{rng.randrange(12)}"
        edges = rng.sample(sorted(new["entries"]), 2)
        new["tags"][t] = (t, "red", "c", 2, False)
        new["files"][f] = (f, "a/z.md", 2, not new["files"][f][3], 0, 0)
        for e in edges:
            new["entries"][e] = not new["entries"][e]
        touched = {"tags": spark.createDataFrame([(t,)], "id string"), "files": spark.createDataFrame([(f,)], "id string"), "entries": spark.createDataFrame(edges, "tag_id string, target_id string, type int")}
        terms = [{"kind": "tag", "text": "red", "negated": bool(seed), "regex": False}, {"kind": "any", "text": "a", "negated": False, "regex": False}]
        a, b = frames(spark, old), frames(spark, new)
        hits = lambda c: {r.id for r in search.search_files(c, terms, True).select("id").collect()}
        was, now = hits(a), hits(b)
        got = jobs.standing_file_search(a, b, touched, terms, True)
        assert sorted(map(tuple, got.collect())) == sorted([(i, "added") for i in now - was] + [(i, "removed") for i in was - now])


def test_only_changed_files_are_read(spark, tmp_path):
    top = tmp_path / "files"
    (top / "sub [1]").mkdir(parents=True)
    content = {"big": b"x" * 3_000_000, "sub [1]/a*b?": b"one", "sub [1]/{c}": b"two"}
    for name, data in content.items():
        (top / name).write_bytes(data)
    key = lambda r: r.path.split("/files/")[1]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    first = catalog.scan_listing(spark, f"file://{top}", block=2)
    assert {key(r): (r.length, r.content_hash) for r in first.collect()} == {n: (len(d), sha(d)) for n, d in content.items()}
    memo = first.select("path", "mtime", F.col("length").alias("size"), "content_hash")
    (top / "sub [1]/a*b?").write_bytes(b"one and more")
    (top / "new").write_bytes(b"3")
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getStatistics("file", spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.LocalFileSystem"))
    before = stats.getBytesRead()
    second = {key(r): r.content_hash for r in catalog.scan_listing(spark, f"file://{top}", memo).collect()}
    assert stats.getBytesRead() - before < 1_000_000  # the big file was not opened
    assert second == {"big": sha(content["big"]), "sub [1]/a*b?": sha(b"one and more"), "sub [1]/{c}": sha(b"two"), "new": sha(b"3")}
    assert catalog.list_metadata(spark, f"file://{top}").columns == ["path", "length", "mtime"]


def test_merges_of_edges_follow_too(spark, tmp_path):
    table = jobs.entry_snapshots(spark, f"file://{tmp_path}")
    e = lambda at, dead: spark.createDataFrame([("t", "f", 0, at, dead)], catalog.SCHEMAS["entries"])
    for n, (at, dead) in enumerate([(5, False), (4, True), (6, True)]):
        table.add(e(at, dead), n)
    assert [tuple(r) for r in table.read().collect()] == [("t", "f", 0, 6, True)] and lww.EDGE == table.keys


def test_rejected_changes_by_a_fold(spark):
    rng = random.Random(8)
    made = [(i, f"f{rng.randrange(5)}", rng.choice(["add", "move"]), f"p{i}", rng.randrange(30)) for i in range(120)]
    at, lost = {}, []
    for seq, f, op, _, t in made:
        if op == "add" and f not in at or op == "move" and f in at and t > at[f]:
            at[f] = t
        else:
            lost.append(seq)
    got = lww.rejected_paths(spark.createDataFrame(made, "seq long, file_id string, op string, path string, modified_at long")).collect()
    assert sorted(r.seq for r in got) == lost


def test_collisions_in_stretches(spark, monkeypatch):
    rng = random.Random(2)
    key = ("dev", "d")
    placed = [(*key, f"p{n}", f"a ({n}).b") for n in rng.sample(range(1, 60), 30)] + [(*key, "p0", "a.b")]
    cands = [(*key, f"{i:04d}", "a.b") for i in range(80)]
    p, c = spark.createDataFrame(placed, "device string, directory string, file_id string, physical_path string"), spark.createDataFrame(cands, "device string, directory string, file_id string, path string")
    monkeypatch.setattr(placement, "CHUNK", 7)
    taken, want = {r[3] for r in placed}, []
    for *_, f, _path in cands:
        n = 1
        while f"a ({n}).b" in taken:
            n += 1
        taken.add(f"a ({n}).b")
        want.append((f, f"a ({n}).b"))
    assert sorted((r.file_id, r.physical_path) for r in placement.resolve_collisions(p, c).collect()) == want
