"""File events against plain sequential twins of the rules."""

import random

from test_keyed_streams import run, one_partition  # noqa: F401

from tagloom.streaming import coalesce, events

EVENT = coalesce.EVENT


def plain(log, quiet=500):
    """One list per device, looked through from its end; events as [dir, seq, at, op, path, to]."""
    out = []
    for device in sorted({e[0] for e in log}):
        queue = []

        def latest(test, queue=queue):
            found = [k for k, x in enumerate(queue) if test(x)]
            return found[-1] if found else None

        for _, *e in sorted((e for e in log if e[0] == device), key=lambda e: (e[3], e[2])):
            while queue and e[2] - queue[0][2] > quiet:
                out.append((device, *queue.pop(0)))
            d, op, path, to = e[0], e[3], e[4], e[5]
            made = latest(lambda x: x[0] == d and x[3] == "create" and x[4] == path)
            if op == "remove":
                kept = [x for k, x in enumerate(queue) if not (x[0] == d and x[3] == "modify" and x[4] == path and (made is None or k > made))]
                queue[:] = kept
                made = latest(lambda x: x[0] == d and x[3] == "create" and x[4] == path)
                if made is not None:
                    queue.pop(made)
                    continue
                away = latest(lambda x: x[0] == d and x[3] == "move" and x[4] is not None and x[5] == path)
                if away is not None:
                    source = queue[away][4]
                    again = latest(lambda x: x[0] == d and x[3] == "create" and x[4] == source)
                    if again is not None and again > away:
                        queue[again][3] = "modify"
                        queue.pop(away)
                        continue
            elif op == "move" and path is not None and to is not None:
                if len(queue) > 1 and queue[-2][0] == queue[-1][0] == d and queue[-2][3:] == ["move", path, None] and queue[-1][3:] == ["move", None, to]:
                    del queue[-2:]
                    made = latest(lambda x: x[0] == d and x[3] == "create" and x[4] == path)
                if made is not None:
                    queue[made][4] = to
                    continue
            elif op == "modify" and (made is not None or latest(lambda x: x[0] == d and x[3] == "modify" and x[4] == path) is not None):
                continue
            queue.append(list(e))
        out += [(device, *x) for x in queue]
    return sorted(out, key=str)


def random_log(seed, n=900, steps=(0, 5, 40, 90, 300, 1400)):
    rng, at, log = random.Random(seed), 0, []
    for k in range(n):
        at += rng.choice(steps)
        op, p, q = rng.choice(["create", "modify", "modify", "remove", "move"]), f"p{rng.randrange(4)}", f"p{rng.randrange(4)}"
        device, directory = f"v{rng.randrange(2)}", f"d{rng.randrange(2)}"
        if op == "move" and rng.random() < 0.5:  # as a watcher sends it: two halves, then the whole
            log += [(device, directory, 4 * k, at, op, p, None), (device, directory, 4 * k + 1, at, op, None, q)]
        elif op == "move" and rng.random() < 0.4:
            p, q = rng.choice([(p, None), (None, q)])
        log.append((device, directory, 4 * k + 2, at, op, p, q if op == "move" else None))
    return log


def test_coalescing_agrees_with_the_plain_queue(spark):
    for seed in range(4):
        log = random_log(seed, steps=(0, 5, 40) if seed == 3 else (0, 5, 40, 90, 300, 1400))
        odd = [(None, "d0", 1, 1, "create", "p", None), ("v0", "d0", 1, None, "create", "p", None), ("v0", "d0", 1, 1, "look", "p", None), ("v0", "d0", 1, 1, "create", None, "x"), ("v0", "d0", 1, 1, "move", None, None)]
        df = spark.createDataFrame(log + odd, EVENT).selectExpr("*", "1 AS run", "2 AS slot")
        assert sorted((tuple(r) for r in coalesce.coalesce_events(df).collect()), key=str) == plain(log)
    assert coalesce.coalesce_events(spark.createDataFrame([], EVENT)).count() == 0


def test_coalescing_rules(spark):
    cases = {
        "editor save": ([("move", "a", "a~", 0), ("create", "a", None, 10), ("modify", "a", None, 20), ("remove", "a~", None, 30)], [("modify", "a", None)]),
        "create and remove": ([("create", "b", None, 0), ("remove", "b", None, 400)], []),
        "final before the remove": ([("create", "b", None, 0), ("modify", "c", None, 400), ("remove", "b", None, 501)], [("create", "b", None), ("modify", "c", None), ("remove", "b", None)]),
        "still waiting at 500": ([("create", "b", None, 0), ("remove", "b", None, 500)], []),
        "halves": ([("move", "a", None, 0), ("move", None, "b", 0), ("move", "a", "b", 1)], [("move", "a", "b")]),
        "rename and remove stay": ([("move", "a", "b", 0), ("remove", "b", None, 9)], [("move", "a", "b"), ("remove", "b", None)]),
        "create and rename": ([("create", "a", None, 0), ("move", "a", "b", 1), ("modify", "b", None, 2)], [("create", "b", None)]),
        "modifies and remove": ([("modify", "a", None, 0), ("modify", "a", None, 3), ("remove", "a", None, 9)], [("remove", "a", None)]),
    }
    rows = [(name, "d", k, at, op, path, to) for name, (log, _) in cases.items() for k, (op, path, to, at) in enumerate(log)]
    rows += [("two directories", "d", 0, 0, "create", "a", None), ("two directories", "e", 1, 1, "remove", "a", None)]
    got = coalesce.coalesce_events(spark.createDataFrame(rows, EVENT)).collect()
    for name, (_, want) in cases.items():
        assert [(r.op, r.path, r.to) for r in sorted(got, key=lambda r: r.seq) if r.device == name] == want, name
    assert sum(r.device == "two directories" for r in got) == 2


def test_coalescing_stream_agrees_with_batch(spark, tmp_path):
    log = random_log(8, 300)
    end = max(e[3] for e in log) + 9000
    ticks = [(d, "tick", 5000 + k, end, "modify", "t", None) for k, d in enumerate(sorted({e[0] for e in log}))]  # each device's own clock goes on
    got = run(spark, tmp_path, spark.createDataFrame(log + ticks, EVENT), lambda s: coalesce.stream_coalesce(s, idle=600_000), "coalesced", "append", parts=4, order="at")
    assert sorted((tuple(r) for r in got.where("directory <> 'tick'").collect()), key=str) == plain(log)


def plain_suppress(log, writes):
    pending, out = {}, []
    for own, (device, directory, seq, op, path, to, digest) in sorted([(True, w) for w in writes] + [(False, e) for e in log], key=lambda x: (x[1][2], not x[0])):
        if own:
            pending[device, directory, path] = digest
            continue
        used = False
        for p in [] if op == "move" and to is None else [path, to]:
            k = (device, directory, p)
            if p is not None and k in pending and (op != "modify" or digest is None or pending[k] is None or digest == pending[k]):
                del pending[k]
                used = True
        if not used:
            out.append((device, directory, seq, op, path, to, digest))
    return sorted(out, key=str)


def random_writes(seed, n=500):
    rng, log, writes = random.Random(seed), [], []
    for k in range(n):
        row = lambda op, p, q, k=k: ("v", f"d{rng.randrange(2)}", k, op, p, q, rng.choice([None, "A", "B"]))
        p, q = f"p{rng.randrange(4)}", f"p{rng.randrange(4)}"
        if rng.random() < 0.4:
            writes.append(row(None, p, None))
        if rng.random() < 0.8:
            op = rng.choice(["create", "modify", "modify", "remove", "move"])
            log.append(row(op, *(rng.choice([(p, q), (None, q), (p, None)]) if op == "move" else (p, None))))
    return log, writes


def test_own_writes_agree_with_the_plain_fold(spark, tmp_path):
    log, writes = random_writes(1)
    e, w = spark.createDataFrame(log, events.WRITE), spark.createDataFrame(writes, events.WRITE)
    want = plain_suppress(log, writes)
    assert 0 < len(want) < len(log)
    assert sorted((tuple(r) for r in events.suppress_self_writes(e, w).collect()), key=str) == want
    both = e.selectExpr("*", "false AS own").union(w.selectExpr("*", "true AS own"))
    got = run(spark, tmp_path, both, events.stream_suppress, "suppressed", "append")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert events.suppress_self_writes(e, w.limit(0)).count() == len(log)


def test_many_pending_writes_of_one_directory(spark, tmp_path):
    """The state is one entry a path: a later batch touches the entries of its events alone."""
    n = 20_000
    writes = spark.range(n).selectExpr("'v' AS device", "'d' AS directory", "id AS seq", "CAST(NULL AS string) AS op", "concat('p', id) AS path", "CAST(NULL AS string) AS to", "'A' AS content_hash", "true AS own")
    hits = spark.createDataFrame([("v", "d", n + k, "modify", f"p{k * 7}", None, "A" if k % 2 else "B", False) for k in range(10)], events.WRITE + ", own boolean")
    got = run(spark, tmp_path, writes.union(hits), events.stream_suppress, "many_pending", "append", parts=2).collect()
    assert sorted(r.seq - n for r in got) == [0, 2, 4, 6, 8]


def test_changes_of_events(spark):
    dirs = spark.createDataFrame([("v", "u", "universal", ["x"]), ("v", "t", "tag", ["x", "y"])], "device string, directory string, kind string, tags array<string>")
    placed = spark.createDataFrame([("v", d, p, f"{d}:{p}") for d in "ut" for p in ("a", "s/b", "s/c/d", "sx")], "device string, directory string, physical_path string, file_id string")
    listing = spark.createDataFrame([("v", "t", "n/1"), ("v", "t", "n/m/2"), ("v", "t", "o")], "device string, directory string, path string")
    made = [(1, "t", "create", "o", None), (2, "u", "create", "o", None), (3, "u", "move", "a", "b"), (4, "t", "move", "a", "b"), (5, "t", "move", "s", "z"), (6, "t", "move", "a", None), (7, "u", "move", "s", None), (8, "t", "move", None, "n"), (9, "t", "move", None, "o"), (10, "t", "modify", "a", None), (11, "t", "modify", "q", None), (12, "t", "remove", "sx", None), (13, "t", "remove", "q", None), (14, "t", "move", "q", "r"), (15, "w", "create", "a", None)]
    e = spark.createDataFrame([("v", d, k, op, p, q) for k, d, op, p, q in made], "device string, directory string, seq long, op string, path string, to string")
    got = {}
    for r in events.events_to_changes(e, placed, dirs, listing).collect():
        got.setdefault(r.seq, set()).add((r.change, r.file_id if r.change != "create" else None, r.path, tuple(r.tags)))
    none, tags = (), ("x", "y")
    assert got == {
        1: {("create", None, "o", tags)}, 2: {("create", None, "o", none)},
        4: {("move", "t:a", "b", none)}, 5: {("move", "t:s/b", "z/b", none), ("move", "t:s/c/d", "z/c/d", none)},
        6: {("delete", "t:a", "a", none)}, 7: {("delete", "u:s/b", "s/b", none), ("delete", "u:s/c/d", "s/c/d", none)},
        8: {("create", None, "n/1", tags), ("create", None, "n/m/2", tags)}, 9: {("create", None, "o", tags)},
        10: {("edit", "t:a", "a", none)}, 11: {("rejected", None, "q", none)},
        12: {("delete", "t:sx", "sx", none)}, 13: {("rejected", None, "q", none)},
    }
    ids = [r.file_id for r in events.events_to_changes(e, placed, dirs, listing).where("change = 'create'").collect()]
    assert len(ids) == len(set(ids)) == 5
