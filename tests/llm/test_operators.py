"""Small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns,
each against a brute-force version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontamination, exact_dedup, gru, language_id, license_scan, line_dedup, lm_scoring, minhash, packing, repeats, suffix_sort, toxicity
from tagloom.llm.common import scratch
from tagloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n int, a long, keep_id string"


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [words(rng, n) for n in (3, 5, 6, 40, 80, 300)]
    near = []
    for b in base[3:]:
        w = b.split()
        for k in (1, 2, 5):
            v = list(w)
            v[k * 3 % len(v)] = "zzz"
            near.append(" ".join(v))
    return [None, "", " \n\t", *base, *near, base[4], base[4].upper(), base[0], words(rng, 9000), "é ü " * 30, "x\ny\nx\n\n", base[3] + "\n" + base[4]]


def test_exact(spark, texts):
    for primes in (exact_dedup.PRIMES, (7, 5)):  # the small ones make different texts meet
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, texts), chunk=64, primes=primes).collect()}
        for i, t in enumerate(texts):
            group = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(group), len(group), i == max(group))
            assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_near(spark, texts):
    def shingles(t):
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = [shingles(t) for t in texts]
    comp = list(range(len(s)))
    for _ in s:
        for i in range(len(s)):
            for j in range(i):
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: r for r in minhash.near_dedup(table(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(s))] == [(len(x), comp[i], comp[i] == i) for i, x in enumerate(s)]
    assert minhash.near_dedup(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_repeats(spark, texts):
    length, data = 40, [(t or "").encode() for t in texts]
    count = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    got = {r.doc_id: r for r in repeats.remove_repeats(table(spark, texts), length).collect()}
    for i, b in enumerate(data):
        off = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                off[p:p + length] = True
        spans = sum(off[k] and not (k and off[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, o in zip(b, off) if not o)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), off.sum(), spans, hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(table(spark, []), length).count() == 0


@pytest.mark.parametrize("length", [5, 9, 26, 83, 200, 240])
def test_suffix_sort_finds_equal_windows(spark, length):
    """By brute force, over texts that share passages at all shifts modulo 3, with bytes
    above 127 and runs of one letter; every second window is only looked at, not given out."""
    rng = random.Random(length)
    passages = [bytes(rng.choice(b"ab\xc3") for _ in range(length + k)) for k in (0, 1, 40)] + [b"z" * (length + 9)]
    texts = [b"".join(bytes(rng.choice(b"xy") for _ in range(rng.randrange(7))) + rng.choice(passages) for _ in range(4)) for _ in range(12)]
    ranges = [[{"a": a, "b": min(a + w, len(t) - length), "n": 1 + a % 2} for a in range(0, len(t) - length + 1, 2 * w)] for t, w in zip(texts, [1, 3, 50] * 4)]
    made, reach, at_all = [], suffix_sort.Reach(length), []
    for row, (t, r) in enumerate(zip(texts, ranges)):
        r = [x for x in r if x["a"] <= x["b"]]
        r = [x for k, x in enumerate(r) if not k or x["a"] > r[k - 1]["b"]]
        cols = suffix_sort.triples(reach)(t, r)
        made += [(row, *map(int, v)) for v in zip(*cols)]
        at_all += [(row, p, x["n"]) for x in r for p in range(x["a"], x["b"] + 1)]
    count = Counter(texts[row][p:p + length] for row, p, _ in at_all)
    want = {(row, p) for row, p, n in at_all if n == 1 and count[texts[row][p:p + length]] > 1}
    places = spark.createDataFrame(made, "row long, at int, n int, edge long, k0 long, k1 long, k2 long")
    with scratch(spark):
        got = {tuple(r) for r in suffix_sort.repeated(places, length).collect()}
        assert got == want and want
        assert suffix_sort.repeated(places.limit(0), length).count() == 0


def test_repeats_of_200_bytes(spark, texts):
    """The length that is used: passages of 199, 200 and more bytes in other surroundings."""
    rng = random.Random(4)
    p = "".join(rng.choice("abcdeé ") for _ in range(400)).encode()[:340].decode(errors="ignore")
    data = [words(rng, 20) + p[k:k + n] + words(rng, 30) for k, n in ((0, 180), (0, 230), (10, 240), (60, 250), (3, 330), (90, 240))] + [p, p + "x", None]
    raw = [(t or "").encode() for t in data]
    count = Counter(b[i:i + 200] for b in raw for i in range(len(b) - 199))
    got = {r.doc_id: r for r in repeats.remove_repeats(table(spark, data)).collect()}
    for i, b in enumerate(raw):
        off = {k for s in range(len(b) - 199) if count[b[s:s + 200]] > 1 for k in range(s, s + 200)}
        assert got[i].n_removed == len(off)
        assert got[i].kept_sha256 == hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in off)).hexdigest()
    assert any(r.n_removed for r in got.values())


def test_myers():
    rng = random.Random(2)
    for _ in range(60):
        p, t = words(rng, 3), words(rng, 8)
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            row = [i]
            for j, d in enumerate(t, 1):
                row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (c != d)))
            prev = row
        masks = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in set(p)}
        assert decontamination.best_distance(masks, len(p), t) == min(prev)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [words(rng, 30) for _ in range(4)] + [None, ""]
    hurt = list(items[1])
    for k in range(5):
        hurt[7 + 20 * k] = "#"
    docs = [words(rng, 50) + " " + items[0].upper() + " " + words(rng, 9), "".join(hurt), words(rng, 200), None, "", items[2][:60]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (2_000_000, 50):
        got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.benchmark_hits(table(spark, docs), bench, block_chars=block).collect()}
        assert got == {(0, 0, 0), (1, 1, 5)}
    assert sorted(r.doc_id for r in decontamination.without_benchmark(table(spark, docs), bench).collect()) == [2, 3, 4, 5]


def test_hits_against_a_distance_table(spark):
    """All documents against all items by the plain edit distance to any substring."""
    rng = random.Random(12)

    def changed(text, n):
        out = list(text)
        for _ in range(n):
            k = rng.randrange(len(out))
            out[k:k + 1] = rng.choice([[], ["#"], [out[k], "é"]])
        return "".join(out)

    items = [words(rng, n) for n in (2, 4, 12, 25, 40)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 20]
    docs = [words(rng, rng.randrange(9)) + " " + changed(rng.choice(items), rng.randrange(7)) + rng.choice(["", " \t"]) + words(rng, rng.randrange(9)) for _ in range(50)] + ["a" * 200, "AB" * 90, None, "", items[3], items[3]]

    def best(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            now = [i + 1]
            for j, d in enumerate(text):
                now.append(min(row[j] + (c != d), row[j + 1] + 1, now[j] + 1))
            row = now
        return min(row)

    want = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            n = best(item, decontamination.normal(text)) if text else len(item)
            if n <= int(decontamination.ERROR_SHARE * len(item)):
                want.add((d, i, n))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(None, items[0], "x")], "item_id long, text string, doc_id string")
    rows = table(spark, docs).unionByName(table(spark, [items[4]]).withColumn("doc_id", F.lit(None).cast("long")))
    got = [tuple(r) for r in decontamination.benchmark_hits(rows, bench).collect()]
    assert sorted(got) == sorted(want) and {e for _, _, e in want} > {0, 1, 2}
    assert decontamination.benchmark_hits(rows.limit(0), bench).count() == 0 == decontamination.benchmark_hits(rows, bench.limit(0)).count()
    clean = decontamination.without_benchmark(rows, bench.where("item_id is not null"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(docs))) - {d for d, _, _ in want})


def test_lines(spark):
    rng = random.Random(4)
    a = words(rng, 60)
    b = a.replace(a.split()[7], "q", 1)
    docs = [f"{a}\nshort\n\n{words(rng, 20)}", f"{b}\n  SHORT ", None, "", f"{a}\n{words(rng, 300)}"]
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_dedup(table(spark, docs)).collect()}
    assert len(got) == sum(len((d or "").split("\n")) for d in docs)
    assert got[0, 0].kept and not got[4, 0].kept and got[4, 0].group_id == got[0, 0].group_id
    assert got[0, 1].kept and not got[1, 1].kept
    assert got[0, 2].kept and got[0, 2].group_id is None and got[2, 0].kept and got[3, 0].kept
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def edit_distance(p, t):
    prev = list(range(len(t) + 1))
    for i, c in enumerate(p, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (c != d)))
        prev = row
    return prev[-1]


def test_one_change_never_hides_a_similar_line(spark):
    """Lines of one to forty words with one word or letter changed, against edit similarity
    by brute force; and lines that share only their start or end."""
    rng = random.Random(17)
    lines = []
    for n in (1, 2, 3, 5, 6, 7, 8, 9, 11, 12, 15, 16, 40):
        for how in range(4):
            w = [words(rng, 1) + words(rng, 1) for _ in range(n)]
            v = list(w)
            i = rng.randrange(n)
            if how == 0:
                v[i] = words(rng, 1)
            elif how == 1:
                v[i] = v[i][:2] + "z" + v[i][2:]
            elif how == 2:
                v.insert(i, words(rng, 1))
            elif n > 1:
                del v[i]
            lines += [" ".join(w), " ".join(v), " ".join(w[: n // 2] + ["qq"] * n)]
    got = {(r.doc_id): r.group_id for r in line_dedup.line_dedup(table(spark, lines)).collect()}
    linked = 0
    for k in range(0, len(lines), 3):
        a, b = lines[k], lines[k + 1]
        near = a == b or edit_distance(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9)
        linked += near
        assert (got[k] == got[k + 1]) == near, (a, b)
    assert linked > 30


def test_simhash_of_blocks(spark):
    """Blocks equal a plain version; odd places and repeated words do not make blocks alike."""
    import xxhash

    def h(w, k):
        x = xxhash.xxh64(w.encode(), seed=42).intdigest()
        return xxhash.xxh64((k).to_bytes(4, "little"), seed=x).intdigest()

    line = "aa | bb | cc | dd | ee | ff | gg | hh"
    w = line.split()

    def sim(block):
        hs = [h(x, k) for k, x in enumerate(block)]
        v = sum(1 << j for j in range(64) if sum(x >> j & 1 for x in hs) > len(hs) / 2)
        return v - (1 << 64) if v >> 63 else v

    got = {r.kind: tuple(r)[2:] for r in line_dedup.line_blocks(spark.createDataFrame([(0, line)], "id long, norm string")).collect()}
    for size in (2, 3):
        want = [w[:size], w[size:2 * size], w[::-1][:size], w[::-1][size:2 * size]]
        if -size in got:
            assert got[-size] == tuple(map(sim, want))
    assert set(got) == {-2, -3}


def test_packing(spark, texts):
    got = packing.pack(table(spark, texts), capacity=50, shard_rows=8).collect()
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        assert all(x.bin_offset + x.n_tokens <= y.bin_offset for x, y in zip(rows, rows[1:])) and rows[-1].bin_offset + rows[-1].n_tokens <= 50
        assert len({r.doc_id % 3 for r in rows}) == len(rows)  # one of each source
    for i, t in enumerate(texts):
        assert sum(r.n_tokens for r in got if r.doc_id == i) == len((t or "").split())
    rng = random.Random(6)
    pieces = sorted(((rng.randrange(1, 30), rng.randrange(5), rng.randrange(40)) for _ in range(200)), reverse=True)
    free, src, want = [], [], []
    for n, s, c in pieces:
        fits = [(free[k], k) for k in range(len(free)) if free[k] >= n and s not in src[k] and (c, "c") not in src[k]]
        k = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(32), src.append(set())
        free[k] -= n
        src[k] |= {s, (c, "c")}
        want.append(k)
    assert [k for k, _ in packing.best_fit(pieces, 32)] == want


def test_license(spark):
    docs = ["Released under the MIT License.", "apache LICENSE, version 2 and Apache License Version 2.0\nunder the mit license", "licensed cc under by nc 4 0", None, "", "mit " * 9000]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, docs)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (1, 1, "mit", 1.0)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 10, "apache-2,mit")
    assert (got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, None, "cc-by-nc", 1.0)
    assert (got[3].n_words, got[4].n_words, got[5].n_words, got[5].labels) == (0, 0, 9000, "")
    assert license_scan.license_scan(table(spark, [])).count() == 0


def test_license_blocks_are_windows_of_words(spark):
    """Against every window of every text: words of a template that are scattered over a long
    line make no block, and letters that only look like A-Z are none."""
    rng = random.Random(8)
    vocabulary = "permission is hereby granted free of charge to any person obtaining a copy this software licensed under cc by nc 4 0 x y".split()
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    docs += ["Licensed under C\u212a by nc 4 0", "L\u0130censed under cc by nc 4 0", "licensed under cc\nBY, nc 4 0", "licensed x under x cc x by x nc x 4 x 0", None]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, docs)).collect()}
    for i, d in enumerate(docs):
        text = "".join(c.lower() if c < "\x80" else c for c in d or "")
        ws = "".join(c if c.isalnum() or c >= "\x80" else " " for c in text).split(" ")
        ws = [w for w in ws if w]
        labels, share = set(), 0
        for label, template in license_scan.TEMPLATES:
            t = template.split()
            best = max((len(set(ws[k:k + len(t)]) & set(t)) for k in range(len(ws))), default=0)
            if best >= math.ceil(0.9 * len(set(t)) - 1e-9):
                labels.add(label)
                share = max(share, best / len(set(t)))
        assert (got[i].n_words, got[i].labels) == (len(ws), ",".join(sorted(labels | set(got[i].base_labels.split(",")) - {""}))), d
        assert got[i].n_base or math.isclose(got[i].score, share)


def test_license_over_line_breaks(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, [mit, bsd, f"a\n{mit} {bsd}", "permission is hereby granted\n" + "x " * 40 + "\nfree of charge to any person obtaining a copy of this software"])).collect()}
    assert [got[i].labels for i in range(4)] == ["mit", "bsd-3", "bsd-3,mit", ""] and got[0].score == got[1].score == 1.0


def test_lm(spark, texts):
    got = {r.doc_id: r for r in lm_scoring.lm_score(table(spark, texts), vocabulary=20, broadcast=50).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(lm_scoring.tokens((t or "").encode()))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        toks = lm_scoring.tokens((t or "").encode())
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(toks), sum(w in c for w in toks), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks), rel_tol=1e-9)
        assert got[i].score < 0


def test_lm_learns_from_every_training_text(spark, texts):
    """Over all rounds and models, training sees the tokens of every text."""
    rows = table(spark, [t or "" for t in texts]).select("doc_id", "text")
    counts = sorted(((bytes(r.word), r.n) for r in lm_scoring.token_counts(rows).collect()), key=lambda x: (-x[1], x[0]))
    total = sum(n for _, n in counts)
    for rounds, tokens in ((1, 10**6), (3, 400), (2, 300)):
        model, learned = lm_scoring._fit(rows, counts[:20], total, rounds, tokens)
        assert learned == total and np.isfinite(model["wh"]).all()


def test_gru_training_uses_the_whole_stream():
    """Any cut into lanes leaves no word out: a model learns the last word of the stream."""
    for n in (1, 5, 24, 25, 601, 1203):
        p, cache = gru.init(np.array([5, 4, 3, 2, 1]), 3, 0), {}
        stream = [np.full(n, 3)]
        before = gru.log_prob(p, stream)[0]
        gru.train(p, stream, cache, lanes=7)
        assert gru.log_prob(p, stream)[0] > before


def test_gru_is_a_distribution_and_learns():
    p = gru.init(np.array([5, 4, 3, 2, 1]), 3, 0)
    text = [np.array([1, 2, 1, 2, 1, 2, 0] * 5)] * 40
    total = sum(math.exp(gru.log_prob(p, [np.array([a])])[0]) for a in range(6))
    assert math.isclose(total, 1, rel_tol=1e-5)
    before = gru.log_prob(p, text)[0]
    cache = {}
    for _ in range(30):
        gru.train(p, text, cache)
    assert gru.log_prob(p, text)[0] > before + 10
    long = np.array([1, 2, 3] * 50)  # windows carry the state: the same as one window
    first = gru.log_prob(p, [long])[0]
    gru.WINDOW, old = 500, gru.WINDOW
    assert math.isclose(first, gru.log_prob(p, [long])[0], rel_tol=1e-5)
    gru.WINDOW = old


def test_language(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        kind = rng.randrange(2)
        rows.append((i, " ".join("".join(rng.choice(("abcd", "wxyz")[kind]) for _ in range(4)) for _ in range(12)), ("aa", "zz")[kind]))
    rows += [(900, None, "aa"), (901, "12 ...", "zz"), (902, "abab", None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang in rows if i < 300) and got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa"
    empty = language_id.language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in empty] == [("und", 0.0)]


def test_language_counts_every_word_and_ngram(spark):
    """A small cache gives what a model of all words and n-grams gives."""
    rng = random.Random(12)
    rows = [(i, words(rng, 6) + " common " * (i % 4), "bb" if i % 9 else "aa") for i in range(60)] + [(70, "QQ!", "aa"), (71, "", "aa"), (72, "cab zzz", None)]
    train = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    whole, grams = Counter(), Counter()
    for _, text, lang in train:
        whole.update((lang, w) for w in language_id.words_of(text))
    for (lang, w), n in whole.items():
        for k in (1, 2, 3):
            for i in range(len(w) + 3 - k):
                grams[lang, f" {w} "[i:i + k]] += n
    kinds, gram_kinds = len({w for _, w in whole}), len({g for _, g in grams})

    def logs(counts, key, kinds, same):
        return np.array([math.log((counts[x, key] + 0.5) / (sum(n for (y, g), n in counts.items() if x == y and same(g)) + 0.5 * kinds + 1)) for x in ("aa", "bb")])

    def of(w):
        if any(whole[x, w] for x in ("aa", "bb")):
            return logs(whole, w, kinds, lambda g: True)
        for k in (3, 2, 1):
            found = [g for g in (f" {w} "[i:i + k] for i in range(len(w) + 3 - k)) if grams["aa", g] or grams["bb", g]]
            if found:
                return np.mean([logs(grams, g, gram_kinds, lambda x: len(x) == k) for g in found], axis=0)
        return np.zeros(2)

    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        found = language_id.words_of(text)
        t = sum(map(of, found), np.zeros(2))
        p = np.exp(t - t.max())
        assert math.isclose(got[i].score, p.max() / p.sum() if found else 0, rel_tol=1e-4)
        assert got[i].lang_pred == (("aa", "bb")[int(p.argmax())] if found else "und")


def test_toxicity(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.2
        docs.append((i, words(rng, 30) + (" badword" if bad else "")))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    docs += [(5000, None), (5001, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).toPandas().set_index("doc_id")
    truth = np.array(["badword" in (t or "") for _, t in docs])
    assert (got.predicted.reindex([i for i, _ in docs]).to_numpy() == truth).mean() > 0.99
    assert toxicity.toxicity(d, lab.limit(0)).toPandas().predicted.sum() == 0


def test_bucket_comparison_does_not_depend_on_batches():
    """Groups that are cut by the ends of batches give the members that a plain double loop gives."""
    rng = np.random.default_rng(3)
    rows = []
    for key in range(12):
        base = rng.integers(0, 9, 128).astype(np.uint16)
        for k in range(int(rng.integers(1, 9))):
            sig = base.copy()
            sig[rng.integers(4, 128, int(rng.integers(0, 40)))] += 1
            bands = np.arange(32, dtype=np.uint32) + np.uint32(1000 * k)
            bands[0] = 7  # the first bucket is the one they share
            rows.append({"band": 0, "key": key, "x": 0, "y": key % 2, "blk": k % 2 * (key % 2), "rep": key * 100 + k, "comp": key * 100 + k // 2, "centre": key * 100, "n": 1000, "sig": sig.tobytes() + bands.tobytes(), "small": b""})
    sigs = [np.frombuffer(r["sig"], np.uint16)[:128] for r in rows]
    least = 0.85 - 4.5 * np.sqrt(0.85 * 0.15 / (128 * (1 - np.exp(-1000 / 128))))
    want = set()
    for i, r in enumerate(rows):
        for j, o in enumerate(rows[:i]):
            if r["key"] == o["key"] and r["comp"] != o["comp"] and r["centre"] not in (r["rep"], o["rep"]) and (r["x"] == r["y"] or r["blk"] != o["blk"]) and (sigs[i] == sigs[j]).mean() >= least:
                want |= {r["rep"], o["rep"]}
    kinds = {"band": pa.int32(), "key": pa.int64(), "x": pa.int32(), "y": pa.int32(), "blk": pa.int32(), "rep": pa.int64(), "comp": pa.int64(), "centre": pa.int64(), "n": pa.int64(), "sig": pa.binary(), "small": pa.binary()}
    part = pa.Table.from_pylist(rows, schema=pa.schema(list(kinds.items())))
    assert want
    for size in (1, 3, 7, 1000):
        got = [r for b in minhash._open_members(4, 0.85)(iter(part.to_batches(max_chunksize=size))) for r in b.column("rep").to_pylist()]
        assert sorted(got) == sorted(want)
    assert list(minhash._open_members(4, 0.85)(iter([]))) == []


def test_overlaps_and_links_of_a_group():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))).astype(np.uint64) for _ in range(40)] + [np.arange(45, dtype=np.uint64) + k for k in range(6)]
    want = [[len(set(a) & set(b)) for b in map(list, sets)] for a in map(list, sets)]
    for cells in (50, 1 << 22):
        assert minhash.overlaps(sets, cells).tolist() == want
    rows = [{"band": 0, "key": k % 2, "x": 0, "y": 0, "blk": 0, "rep": k, "comp": k, "s": s.tobytes()} for k, s in sorted(enumerate(sets), key=lambda x: x[0] % 2)]
    part = pa.Table.from_pylist(rows, schema=pa.schema([("band", pa.int32()), ("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("blk", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("s", pa.binary())]))
    for size in (1, 9, 100):
        got = [p for b in minhash._links_in_groups(85, 100)(iter(part.to_batches(max_chunksize=size))) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]

        def components_of(pairs):
            label = list(range(len(sets)))
            for _ in sets:
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        full = [(a, b) for a in range(len(sets)) for b in range(a) if a % 2 == b % 2 and 100 * want[a][b] >= 85 * (len(sets[a]) + len(sets[b]) - want[a][b])]
        assert components_of(got) == components_of(full) and len(got) <= len(sets) - 2 and len(set(got)) > 1


def test_near_copies_that_stars_miss(spark):
    """Chains, and a large group whose members are just below and just above the threshold."""
    rng = random.Random(21)
    base = words(rng, 120).split()
    docs = []
    for k in range(80):
        w = list(base)
        for i in rng.sample(range(0, 120, 6), k % 5):
            w[i] = f"{k}x{i}"
        docs.append(" ".join(w))
    for k in range(20):  # each differs a little more from the first, and little from the one before
        docs.append(" ".join([f"c{k}"] * 0 + words(random.Random(5), 150).split()[k * 2:k * 2 + 100]))
    test_near(spark, docs)


def test_pipeline_stages_judge_rows_by_their_own_text(spark):
    """Repeated and null ids: no unique text is lost, and no copy stays."""
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "z"), (3, "z"), (None, "q"), (None, "q"), (None, "r"), (4, "r"), (5, None), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, _n int")
    got = exact_dedup.without_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "b"), (2, "a"), (3, "z"), (None, "q"), (4, "r"), (6, "")], key=str)
    rng = random.Random(31)
    a, b, c = (words(rng, 120) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " zz"
    docs = spark.createDataFrame([(1, a, "x"), (2, near, "x"), (2, c, "x"), (None, b, "x"), (None, b.rsplit(" ", 1)[0] + " yy", "x"), (7, None, "x"), (8, "", "x")], "doc_id long, text string, component string")
    got = [(r.doc_id, r.text) for r in minhash.without_near_copies(docs, num=80).collect()]
    assert len(got) == 5 and {(2, c), (7, None), (8, "")} <= set(got) and sum(t == a or t == near for _, t in got) == 1
    assert minhash.without_near_copies(docs.limit(0)).count() == exact_dedup.without_copies(docs.limit(0)).count() == 0


def test_bounds_of_the_distance_decide_like_the_distance(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [("", ""), ("a", ""), ("", "x" * 500)]
    for n in (4, 40, 120, 700, 1300):
        for share in (0.01, 0.15, 0.25, 0.4, 1):
            a = [rng.choice(words) for _ in range(n)]
            b = list(a)
            for _ in range(max(1, int(share * n))):
                k = rng.randrange(len(b))
                b[k : k + 1] = rng.choice([[rng.choice(words)], [], [b[k], rng.choice(words)]]) if len(b) > 1 else [rng.choice(words)]
            rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    whole = F.levenshtein("a", "b") <= F.floor(0.2 * F.greatest(F.length("a"), F.length("b")) + 1e-9)
    got = df.select(line_dedup._similar("a", "b", 0.8).alias("s"), whole.alias("w")).collect()
    assert all(r.s == r.w for r in got) and 0 < sum(r.w for r in got) < len(got)


@pytest.mark.parametrize("name", ["repeats", "license"])
def test_rows_survive_another_split_of_the_files(spark, tmp_path, monkeypatch, name):
    """Executors that come or go change how files are split between two scans."""
    rng = random.Random(5)
    shared = words(rng, 70)
    texts = [f"{words(rng, 30)} {shared if i % 3 else ''} " + ("under the mit license" if i % 4 == 0 else "this work is licensed under the gnu general public license version 3" if i % 5 == 0 else "") for i in range(80)]
    table(spark, texts).repartition(8, "doc_id").write.parquet(str(tmp_path / "docs"))
    module, run = (repeats, repeats.remove_repeats) if name == "repeats" else (license_scan, license_scan.license_scan)
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = sorted(map(str, run(docs).collect()))
    splits = iter([1, 32, 2, 16] * 20)

    def moving(f):
        def call(*args, **how):
            out = f(*args, **how)
            spark.conf.set("spark.sql.files.minPartitionNum", str(next(splits)))
            return out
        return call

    for target, attr in ((module, "stage"), (module, "frequency_order")):
        if hasattr(target, attr):
            monkeypatch.setattr(target, attr, moving(getattr(target, attr)))
    if name == "license":
        monkeypatch.setattr("tagloom.llm.common.stage", moving(__import__("tagloom.llm.common", fromlist=["stage"]).stage))
    try:
        assert sorted(map(str, run(docs).collect())) == before and len(before) == 80
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_repeats_of_copies_with_changes(spark, monkeypatch):
    """Few places are left to the sort of suffixes where copies differ by single words."""
    rng = random.Random(8)
    base = [words(rng, 700) for _ in range(4)]
    data = []
    for b in base:
        for k in range(3):
            w = b.split()
            for at in range(40 + 30 * k, 700, 130):
                w[at] = f"{k}{at}"
            data.append(" ".join(w))
    raw, seen, stage = [t.encode() for t in data], {}, repeats.stage

    def counted(df, name):
        out = stage(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "stage", counted)
    count = Counter(b[i:i + 200] for b in raw for i in range(len(b) - 199))
    got = {r.doc_id: r for r in repeats.remove_repeats(table(spark, data)).collect()}
    for i, b in enumerate(raw):
        off = {k for s in range(len(b) - 199) if count[b[s:s + 200]] > 1 for k in range(s, s + 200)}
        assert got[i].kept_sha256 == hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in off)).hexdigest()
    assert 0 < seen["repeats-places"] < sum(map(len, raw)) / 4


def test_hashes_of_ranges_know_no_place():
    rng = random.Random(9)
    part = bytes(rng.randrange(256) for _ in range(70))
    for before in (0, 1, 999, 70_000):
        h = repeats.Hashes(b"x" * before + part + b"y")
        assert h(np.array([before + 3]), np.array([before + 60])) == repeats.Hashes(part)(np.array([3]), np.array([60]))
        assert h.grams(32)[before] == h(np.array([before]), np.array([before + 32]))[0] == repeats.Hashes(part).grams(32)[0]
