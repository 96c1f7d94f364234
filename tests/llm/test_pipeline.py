"""The pipeline as a whole over a small corpus, each stage against a plain version."""

import random


import corpus_pipeline

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta", "vu") for b in ("ban", "der", "fil", "gor", "hus", "jem", "kil", "lan", "mot", "nep")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_run(spark, tmp_path):
    rng = random.Random(9)
    clean = [prose(rng, 120) for _ in range(60)]
    exam = prose(rng, 30)
    copies, near = clean[3], " ".join([*clean[5].split()[:-1], "other"])
    texts = clean + [copies, copies, near, prose(rng, 40) + " " + exam + " " + prose(rng, 40), None, "", "short one"]
    rows = [(i, t, rng.choice(["en", None]), f"s{i % 4}", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    best = {}
    for i, t in enumerate(texts):  # of equal texts the largest id stays
        best[t or ""] = max(best.get(t or "", -1), i)
    left = set(best.values()) - {63}  # the one with the benchmark item
    left -= {max(5, 62)}  # of the near copies the smaller id stays
    assert {r.doc_id for r in out} == left
    by_doc = {}
    for r in out:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.n_tokens
    assert by_doc == {i: len((texts[i] or "").split()) for i in left}
    bins = {}
    for r in out:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + r.n_tokens, rows[r.doc_id][3]))
    for places in bins.values():
        places.sort()
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:])) and places[-1][1] <= 2048
        assert len({s for *_, s in places}) == len(places)  # no source twice in a bin


def test_run_on_empty_documents(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_exact_stage_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "a", "de", "t", 2), (3, None, None, None, None), (4, "", "en", "s", 3)], SCHEMA)
    got = sorted(map(tuple, corpus_pipeline.exact_stage(spark, docs, "").collect()), key=str)
    assert got == [(2, "a", "de", "t", 2), (4, "", "en", "s", 3)]
