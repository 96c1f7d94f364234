import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.operators import chunks, graph, lww, placement, previews, reads, rules, search, shortid
from tagloom.plans import registry
from tagloom.sources import catalog
from tagloom.streaming import jobs

DATA = "/root/testdata/sf0.001"
SOME = ["b10_b11_text_heads", "b12_format_size", "c11_audit_deleted_flag", "k5_classify", "l4_verify_chunks", "c1_list_files", "c5_reverts", "d1_short_ids", "d2_resolve_prefixes", "e2_subtags_transitive", "e7_tag_cycles", "f5_search_any", "f9_search_batch", "g2_replay_tags", "g4_replay_entries", "h3_content_decisions", "h8_plan_file_sync", "i6_rule_coverage", "j1_wanted", "j11_directory_drift", "k1_preview_lookup", "l3_chunk_coverage", "m7_operations_state", "a5_export_results", "c4_record_versions", "g7_replay_tombstones", "i1_apply_rules", "i2_tag_new_files", "i5_rule_report", "j2_effective_tags", "j12_drift_changes", "k6_text_previews", "l5_receive_outcomes", "l6_coalescing", "l7_miss_exhaustion"]


def rows(df):
    out = df.astype(object).where(df.notna(), None)[sorted(df.columns)].values.tolist()
    return sorted(str([v.item() if hasattr(v, "item") else v for v in r]) for r in out)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


@pytest.mark.parametrize("path,want", [("a/b", None), ("a/b/", None), ("", "empty"), ("/etc", "absolute"), ("a/../b", "parent directory"), ("a/./b", "current directory"), ("a//b", "empty component"), ("a/..b/c", None), ("a\x00b", "nul"), (None, None)])
def test_path_error(spark, path, want):
    assert one(spark, S.path_error("x"), path) == want


@pytest.mark.parametrize("path,base,ext", [("a/b.TXT", "b.TXT", "txt"), (".env", ".env", None), ("a/b/", "b", None), ("", "", None), ("x/bar.tar.gz", "bar.tar.gz", "gz"), ("a.", "a.", None)])
def test_base_and_extension(spark, path, base, ext):
    assert one(spark, S.basename("x"), path) == base
    assert one(spark, S.extension("x"), path) == ext


@pytest.mark.parametrize("text,pattern,want", [("x\n", "x$", False), ("Photo.JPG", r"\.jpg$", True), ("Photo.JPG", r"(?-i)\.jpg$", False), ("a", "*.md", False), ("aa", r"(a)\1", False), ("ab", "a(?=b)", False), ("٣", r"^\d$", True)])
def test_regex(spark, text, pattern, want):
    assert one(spark, S.matches_regex("x", pattern), text) is want


def test_text_heads(spark):
    cut = ("a" * 255 + "é").encode()
    assert one(spark, S.text_snippet("x"), cut, "binary") == "a" * 255
    assert one(spark, S.looks_like_text("x"), b"", "binary") is True
    assert one(spark, S.looks_like_text("x"), b"a\x00b", "binary") is False
    assert one(spark, S.looks_like_text("x"), b"\xff\xfe\xfd\xfc\xfb", "binary") is False


def test_two_foldings(spark):
    assert one(spark, S.name_like_ascii("x", "ärger"), "ÄRGER") is False
    assert one(spark, S.matches_substring("x", "ärger"), "ÄRGER") is True


def test_replays_equal_a_fold(spark):
    rng = random.Random(3)
    made = [(i, f"k{rng.randrange(40)}", rng.choice(["add", "rename", "recolor", "remove"]), f"v{i}", rng.randrange(30)) for i in range(900)]
    want = {}
    for _, k, op, v, at in made:
        s = want.get(k)
        if s is None and op != "add" or s and at <= s["at"]:
            continue
        s = want.setdefault(k, {"name": None, "color": None, "deleted": False})
        s["at"] = at
        s.update({"add": {"name": v, "deleted": False}, "rename": {"name": v}, "recolor": {"color": v}, "remove": {"deleted": True}}[op])
    rng.shuffle(made)
    got = lww.replay_tags(spark.createDataFrame(made, "seq long, id string, op string, value string, modified_at long")).collect()
    assert {r.id: {"name": r.name, "color": r.color, "deleted": r.deleted, "at": r.modified_at} for r in got} == want

    made = [(i, f"k{rng.randrange(40)}", rng.choice(["edit", "delete", "restore"]), rng.randrange(60)) for i in range(600)]
    want = {}
    for _, k, op, at in made:
        s = want.setdefault(k, [False, 0, 0, 0])
        if op == "delete":
            if not s[0] and at > max(s[1], s[3]):
                s[0], s[2] = True, at
        elif op == "edit":
            s[0], s[1] = s[0] and at <= s[2], at
        else:
            s[3] = max(s[3], at)
            s[0] = s[0] and s[3] <= s[2]
    got = lww.replay_tombstones(spark.createDataFrame(made, "seq long, file_id string, op string, at long")).collect()
    assert {r.file_id: [r.deleted, r.observed_at, r.deleted_at, r.restored_at] for r in got} == want


def test_cycle_ends_and_lists_its_root(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = graph.closure(edges, spark.createDataFrame([("a",)], "root string")).collect()
    assert sorted(r.node for r in got) == ["a", "b", "c", "d"]


def test_short_ids_of_neighbours(spark):
    ids = ["abcd000000000000000000000000000a", "abcd000000000000000000000000000b", "f" * 32]
    got = dict(shortid.short_ids(spark.createDataFrame([(i,) for i in ids], "id string"), "id").collect())
    assert got == {ids[0]: 32, ids[1]: 32, ids[2]: 1}
    assert shortid.short_ids(spark.createDataFrame([("0a",)], "id string"), "id").first().short_len == 1


def test_collisions_take_the_lowest_free_number(spark):
    placed = spark.createDataFrame([("v", "d", "f0", "x.tar.gz"), ("v", "d", "f9", "x.tar (2).gz")], "device string, directory string, file_id string, physical_path string")
    new = spark.createDataFrame([("v", "d", f"f{k}", "x.tar.gz") for k in (1, 2)] + [("v", "d", "f3", ".env")], "device string, directory string, file_id string, path string")
    got = {r.file_id: r.physical_path for r in placement.resolve_collisions(placed, new).collect()}
    assert got == {"f1": "x.tar (1).gz", "f2": "x.tar (3).gz", "f3": ".env"}


def test_collisions_take_the_lowest_free_number_in_turn(spark):
    rng = random.Random(3)
    options = ["a.b", "a (1).b", "a (2).b", "a (02).b", "q/a", "q/a (1)", "q/a (1) (1)", ".x", ".x (1)", " (3)", "é (1).b"]
    for _ in range(2):
        placed = sorted({rng.choice(options) for _ in range(4)})
        rows = [(f"{rng.randrange(16):x}{rng.randrange(16):x}{k}", rng.choice(options)) for k in range(60)]
        names, want = set(placed) | {p for _, p in rows}, {}
        for path in {p for _, p in rows}:
            n, taken = 0, names - {path} | ({path} & set(placed))
            for f in sorted(f for f, p in rows if p == path):
                head, _, last = path.rpartition("/")
                stem, dot, ext = last.rpartition(".")
                stem, ext = (stem, dot + ext) if stem else (last, "")
                while (name := path if n == 0 else (head + "/" if head else "") + f"{stem} ({n}){ext}") in taken:
                    n += 1
                want[f], n = name, n + 1
        old = spark.createDataFrame([("v", "d", p) for p in placed], "device string, directory string, physical_path string")
        new = spark.createDataFrame([("v", "d", *r) for r in rows] + [("v", "d", None, "a.b"), ("v", "d", "00", None)], "device string, directory string, file_id string, path string")
        assert {r.file_id: r.physical_path for r in placement.resolve_collisions(old, new).collect()} == want
        assert len(set(want.values())) == len(want)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("", []), ("  \t ", []), ("foo bar", ["foo", "bar"]), ("! foo", ["-foo"]), ("!foo", ["!foo"]), ("! ! foo", ["foo"]), ("/t foo", ["tag:foo"]), ("! /n foo", ["-name:foo"]), ("/l ! foo", ["-logical:foo"]), ("/t /l foo", ["foo"]),
        ("/x foo", ["/x", "foo"]), ("/home/a", ["/home/a"]), ("foo !", ["foo"]), ("foo ! /p", ["foo"]), ('"a b" c', ["a b", "c"]), (r'"a\"b" c', ['a"b', "c"]), (r'"a\\b"', [r"a\b"]), (r'"a\nb"', [r"a\nb"]), ('""', [""]), ('a "b', ["a"]), ('"b\\', []),
        ("%a b% c", ["~a b", "c"]), ("! /l %^x%", ["-logical:~^x"]), ("a %b", ["a"]), ('"%20"', ["%20"]), ('"a"b', ["a", "b"]), ("%%", ["~"]), (r"%a\"%", [r'~a\"']),
    ],
)
def test_tokens(query, want):
    shown = lambda t: "-" * t["negated"] + (t["kind"] + ":" if t["kind"] != "any" else "") + "~" * t["regex"] + t["text"]
    assert [shown(t) for t in search._tokens(query)] == want


def test_kinds_of_content(spark):
    cases = [
        (b"RIFF0000WEBPVP8 ", "x", "image"), (b"RIFF0000AVI LIST", "x", "video"), (b"RIFF0000WAVEfmt ", "x.txt", None), (b"#!/bin/sh\necho", "x.sh", None), (b" <?xml version", "x.xml", None), (b"\n<Html lang=en>", "x.html", None), (b"<p", "x.html", "text"), (b"<article>", "x", "text"), (b"<b>x", "x.md", None), (b"\0\0\0\x18ftypmp42", "x", "video"), (b"\0\0\0\x18ftypheic", "x", "image"), (b"II*\0abc", "x", "image"),
        (b"PK\3\4abc", "x.md", None), (b"\x1f\x8b\x08aa", "x.csv", None), (b"%PDF-1.7", "x", "pdf"), (b"hello", "a.tsv", "text"), (b"\0\0", "a.wmv", "video"), (b"plain text \xff more plain text", "x", "text"), (b"\xff\xfe", "x", None), (b"a\0b", "x", None), (b"", "x", "text"), (b"\1\2\3ab", "x", None),
    ]
    df = spark.createDataFrame([(k, bytearray(c), p) for k, (c, p, _) in enumerate(cases)], "k int, content binary, path string")
    got = {r.k: r.kind for r in previews.classify(df).collect()}
    assert [got[k] for k in range(len(cases))] == [want for *_, want in cases]


def test_chunks_of_any_size_are_verified(spark):
    data = {k: os.urandom(n) for k, n in enumerate((0, 1, 3000, 70_000))}
    rows = [(f"f{k}", hashlib.sha256(b).hexdigest() if k != 2 else "bad", at, bytearray(b[at:at + 700])) for k, b in data.items() for at in range(0, max(len(b), 1), 700)]
    random.Random(1).shuffle(rows)
    got = {r.file_id: r.state for r in chunks.verify_chunks(spark.createDataFrame(rows, "file_id string, content_hash string, offset long, bytes binary")).collect()}
    assert got == {"f0": "ok", "f1": "ok", "f2": "mismatch", "f3": "ok"}


def test_bad_changes_are_set_aside(spark):
    lines = spark.createDataFrame([('{"seq":1,"op":"add","id":"a"}',), ("{",), ('{"seq":2,"op":"dance"}',), (None,)], "value string")
    good, bad = catalog.read_changes(lines)
    assert (good.count(), bad.count()) == (1, 3)


def test_rules_on_no_rows(spark):
    none = spark.createDataFrame([], "id string, logical_path string")
    assert rules.apply_rules(none, [(0, "a", ["t"])]).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    from tagloom.streaming import jobs

    made = [(i, f"k{i % 7}", ["add", "rename", "remove"][i % 3], f"v{i}", (i * 7) % 50) for i in range(60)]
    df = spark.createDataFrame(made, "seq long, id string, op string, value string, modified_at long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_tags(stream).writeStream.format("memory").queryName("tags_out").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.id, r.name, r.deleted) for r in lww.replay_tags(df).collect()}
    assert {(r.id, r.name, r.deleted) for r in spark.table("tags_out").collect()} == want
