"""The replay of one log of wire changes against a plain fold, record by record."""

import json
import random

from tagloom.operators.lww import replay_log
from tagloom.sources.catalog import VARIANTS, read_wire_changes


def log_of(rng, n):
    out = []
    for seq in range(n):
        t = rng.randrange(60)
        values = {"file_id": f"f{rng.randrange(4)}", "logical_path": f"p{rng.randrange(5)}", "logical_path_modified_at": t, "content_hash": f"h{rng.randrange(3)}", "size": seq, "tags": [f"t{rng.randrange(3)}"], "modified_at": t, "deleted_at": t, "restored_at": t, "tag_id": f"t{rng.randrange(3)}", "taggee_id": f"t{rng.randrange(3)}", "tag_name": f"n{seq}", "color": f"c{seq}"}
        op = rng.choice([*VARIANTS, "FileMetadataAdded", "TagAdded"])
        out.append({"seq": seq, "at": seq // 3, "origin": "peer", "change": {op: {k: values[k] for k in VARIANTS[op]}}})
    return out


def fold(records):
    files, versions, entries = {}, [], {}
    for r in records:
        (op, c), = r["change"].items()
        f = files.get(c.get("file_id")) if op in ("FileMetadataAdded", "FileMetadataChanged", "FileMoved", "FileDeleted", "FileRestored") else None
        if op == "FileMetadataAdded" and f is None:
            f = files[c["file_id"]] = {"path": c["logical_path"], "pat": c["logical_path_modified_at"], "hash": None, "n": 0, "seen": 0, "dead": False, "del": 0, "res": 0}
            for t in c["tags"]:
                edge(entries, (t, c["file_id"], 0), c["logical_path_modified_at"], False)
        if op in ("FileMetadataAdded", "FileMetadataChanged") and f and f["hash"] != c["content_hash"]:
            f["hash"], f["n"], f["seen"] = c["content_hash"], f["n"] + 1, r["at"]
            versions.append((c["file_id"], f["n"], c["content_hash"], r["at"], c["size"]))
            f["dead"] = f["dead"] and r["at"] <= f["del"]
        if op == "FileMoved" and f and c["modified_at"] > f["pat"]:
            f["path"], f["pat"] = c["logical_path"], c["modified_at"]
        if op == "FileDeleted" and f and not f["dead"] and c["deleted_at"] > max(f["seen"], f["res"]):
            f["dead"], f["del"] = True, c["deleted_at"]
        if op == "FileRestored" and f and not (f["hash"] == c["content_hash"] and not f["dead"]):
            f["res"] = max(f["res"], c["restored_at"])
            f["dead"] = f["dead"] and max(f["res"], f["seen"]) <= f["del"]
        if op in ("FileTagged", "FileUntagged", "TagTagged", "TagUntagged"):
            edge(entries, (c["tag_id"], c.get("file_id") or c["taggee_id"], int(op.startswith("Tag"))), c["modified_at"], op.endswith("Untagged"))
    return files, versions, entries


def edge(entries, key, at, gone):
    if key not in entries and not gone or key in entries and at > entries[key][0]:
        entries[key] = (at, gone)


def test_replay_of_a_log(spark):
    records = log_of(random.Random(8), 400)
    good, bad = read_wire_changes(spark.createDataFrame([(json.dumps(r),) for r in records], "value string"))
    assert bad.count() == 0
    out, (files, versions, entries) = replay_log(good), fold(records)
    got = {r.id: (r.logical_path, r.logical_path_modified_at, r.deleted, r.deleted_at, r.restored_at) for r in out["files"].collect()}
    assert got == {k: (f["path"], f["pat"], f["dead"], f["del"], f["res"]) for k, f in files.items()}
    assert sorted((r.file_id, r.version_number, r.content_hash, r.observed_at, r.size) for r in out["versions"].collect()) == sorted(versions)
    assert {(r.tag_id, r.target_id, r.type): (r.modified_at, r.deleted) for r in out["entries"].collect()} == entries
    tags = {r.id: r for r in out["tags"].collect()}
    assert all(t.name.startswith("n") and t.color.startswith("c") for t in tags.values()) and tags


def test_bad_records(spark):
    one = {"seq": 1, "at": 2, "origin": "o", "change": {"TagRemoved": {"tag_id": "t", "modified_at": 3}}}
    lines = [json.dumps(one), None, "", "{x", json.dumps({**one, "seq": None}), json.dumps({**one, "change": {}}), json.dumps({**one, "change": {"Gone": {"tag_id": "t"}}}), json.dumps({**one, "change": {"TagRemoved": {"tag_id": "t"}}}), json.dumps({**one, "change": {**one["change"], "TagAdded": {}}}), json.dumps({**one, "change": {"TagChanged": {"tag_id": "t", "metadata": {"a": 1}, "modified_at": 3}}})]
    good, bad = read_wire_changes(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.op, r.tag_id, r.metadata) for r in good.collect()) == [("TagChanged", "t", '{"a":1}'), ("TagRemoved", "t", None)]
    assert bad.count() == len(lines) - 2
    assert all(df.count() == 0 for df in replay_log(good.limit(0)).values())
